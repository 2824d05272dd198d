import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausegrid.llm import decontaminate as d


def brute(text, items):
    words, hit, ids = d.words(text.encode()), set(), set()
    for item_id, item in items:
        w = d.words(item.encode())
        n = min(10, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add(item_id)
    return len(words), len(hit), ids


VOCAB = st.sampled_from(["a", "b", "the", "The", "c1", "é", "of", "x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(VOCAB, max_size=60), st.lists(st.lists(VOCAB, max_size=16), max_size=4), st.integers(0, 50))
def test_match_equals_brute_force(text, items, at):
    text = text[:at] + (items[0] if items else []) + text[at:]
    items = [(i, ", ".join(x)) for i, x in enumerate(items)]
    n, flags, ids = d.Index([(i, t.encode()) for i, t in items]).match("  ".join(text).encode())
    assert (n, int(flags.sum()), ids) == brute(" ".join(text), items)


def test_every_shared_span_is_found():
    rng = random.Random(1)
    item = [f"i{k}" for k in range(30)]
    index = d.Index([(1, " ".join(item).encode())])
    for length in (9, 10, 11, 15):
        for start in range(len(item) - length):
            text = [f"d{rng.random()}" for _ in range(40)] + item[start : start + length] + [f"e{rng.random()}" for _ in range(20)]
            _, flags, ids = index.match(" - ".join(text).replace("0.", "").encode())
            assert int(flags.sum()) == (length if length >= 10 else 0) and bool(ids) == (length >= 10)


def test_blocks_nulls_and_stage(spark):
    span = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, span, 0), (10, span.upper(), 0), (2, "short one", 0), (3, None, 0), (None, "lost", 0), (2, "short one", 0)], "item_id long, text string, spans int")
    docs = spark.createDataFrame([(1, f"x {span} y", "k"), (2, None, "k"), (3, "a short one here", "k"), (3, "a short one here", "k"), (None, "clean", "k"), (4, "lost", "k"), (5, "z " * 60_000 + span, "k")], "doc_id long, text string, items string")
    whole = sorted(map(str, d.contamination(docs, items).collect()))
    blocks = sorted(map(str, d.contamination(docs, items, block_bytes=70).collect()))
    assert whole == blocks and len(whole) == 7
    by_id = {r.doc_id: r for r in d.contamination(docs, items).collect()}
    assert (by_id[1].n_hit, by_id[1].n_items, by_id[3].n_hit, by_id[2].n_words, by_id[4].n_hit, by_id[5].n_hit) == (12, 2, 2, 0, 0, 12)
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(kept.toPandas().doc_id.fillna(-1)) == [-1, 2, 4]
    assert d.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert d.contamination(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("w", range(1, 9))
def test_sliding_least(w):
    import numpy as np

    a = np.random.default_rng(w).integers(0, 9, 30).astype(np.uint64)
    assert d._least(a, w).tolist() == [min(a[i : i + w]) for i in range(len(a) - w + 1)]


def test_rows_are_dropped_for_their_own_text(spark):
    span = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, span)], "item_id long, text string")
    rows = [(None, span), (None, "clean"), (None, None), (7, f"x {span}"), (7, "clean too"), (8, span)]
    kept = d.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "clean"), (None, None), (7, "clean too")], key=str)
