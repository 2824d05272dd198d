import numpy as np
import xxhash

from clausegrid.llm import simhash


def brute_classes(prints):
    """Smallest index reachable over links of at most 4 bits."""
    a = np.array(prints, np.uint64)
    label = list(range(len(a)))
    changed = True
    while changed:
        changed = False
        for i in range(len(a)):
            near = np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    return label


def plain_fingerprint(text):
    words = text.lower().encode().split() if text.isascii() else text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_their_definition():
    for text in ("", " \t ", "one", "One two three", "a b c d e f g", "Ärger É x y z a b a b a b a b a b", "word " * 50, "a\x0bb\x0cc\rd e f g h i"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text), text


def clustered(rng, n, centres, flips):
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(n):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


def found_classes(spark, prints, **options):
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.fp: r.root for r in simhash.near_classes(frame, **options).collect()}
    return [root.get(x, x) for x in signed]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_classes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    prints = clustered(rng, 25, 8, 6) + clustered(rng, 1, 40, 0) + [0, 0xF, 0xFF, 0x0101010100000000]
    prints = sorted(set(prints))
    want = brute_classes(prints)
    assert same_partition(found_classes(spark, prints), want)
    # Long lists, dealt as pairs of chunks, find the same.
    assert same_partition(found_classes(spark, prints, chunk=4), want)


def test_links_across_every_kind_of_difference(spark):
    base = 0x0123456789ABCDEF
    for bits in ((0, 1, 2, 3), (0, 8, 16, 24), (7, 15, 62, 63), (0, 20, 40, 60), (33,)):
        other = base
        for b in bits:
            other ^= 1 << b
        assert len(set(found_classes(spark, sorted([base, other])))) == 1, bits
    assert len(set(found_classes(spark, sorted([base, base ^ 0b11111])))) == 2


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "x"), (3, long + " tail", "y"), (9, long, "z"), (1, None, "n"), (2, "", "e"), (2, "", "e"), (7, "alone here", "a"), (None, "nobody knows this id", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (7, 7), (None, None)}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas().fp) == ["a", "n", "q", "y"]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_rows_of_null_and_repeated_ids_go_by_their_own_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(400)) for c in "abc")
    rows = [(5, one), (5, one + " tail"), (5, "something else"), (None, two), (None, two + " tail"), (None, "alone"), (4, three), (6, three + " tail"), (6, "stays"), (None, three + " end"), (8, "again"), (8, "again")]
    kept = [tuple(r) for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(x for x in kept if x[0] is not None and x[0] != 5) == [(4, three), (6, "stays"), (8, "again")]
    assert sorted(t[:4] for i, t in kept if i == 5) == ["a0 a", "some"] and sorted(t[:4] for i, t in kept if i is None) == ["alon", "b0 b"]
