import hashlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
from clausegrid.llm import bpe, decontaminate, langid, simhash  # noqa: E402

WORDS = {"en": "the cat and dog are here with water house green river stone walk under".split(), "de": "der hund und die katze sind hier mit wasser haus grün fluss stein unter".split()}


def _text(lang, seed, n=60):
    own = WORDS[lang]
    return " ".join(own[(seed * 7919 + i * i * (seed + 3)) % len(own)] + (str(seed) if i % 5 == 0 else "") for i in range(n))


def test_pipeline_against_plain_python(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(14))
    long = _text("en", 1, 400)
    texts = [(i, _text(l, i), l) for i in range(40) for l in (("en", "de")[i % 2],)]
    texts += [(100, _text("en", 0), "en"), (101, long, "en"), (102, long + " more", "en"), (7, f"{_text('de', 50)} {passage}", "de"), (7, _text("de", 51), "de"), (None, f"{_text('en', 52)} {passage}", "en"), (None, _text("en", 53), "en"),
              (None, _text("en", 53), "en"), (200, None, "en"), (201, "123 !!", None), (202, "", "de")]
    schema = "doc_id long, text string, lang string, id string, row int, bucket int, hit boolean"
    docs = spark.createDataFrame([(*x, "x", 1, 2, True) for x in texts], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    rows = [(i, t) for i, t, _ in texts if not model.predict((t or "").encode())[2]]
    once = {}
    for i, t in rows:  # of equal texts the largest id, null ones last
        if t not in once or (i is not None, i or 0) > (once[t] is not None, once[t] or 0):
            once[t] = i
    left = [(i, t, simhash.fingerprint(t.encode())) for t, i in once.items()]
    classes = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(len(left)):
                if (left[a][2] ^ left[b][2]).bit_count() <= 4:
                    classes[a] = classes[b] = min(classes[a], classes[b])
    kept = {}
    for c, (i, t, _) in zip(classes, left):
        key = (i is None, i or 0, hashlib.sha256(t.encode()).digest())
        if c not in kept or key < kept[c][0]:
            kept[c] = (key, i, t)
    windows = {tuple(decontaminate.words(passage.encode())[j : j + 10]) for j in range(5)}
    clean = [(i, t) for _, i, t in kept.values() if not any(tuple(w[j : j + 10]) in windows for w in [decontaminate.words(t.encode())] for j in range(len(w)))]
    encoder = bpe.MergeReplay(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    want = sorted((str(i), len(encoder.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == want
    assert any(i is None for i, _ in clean) and (7, _text("de", 51)) in clean and len(clean) < len(rows)
    stage = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert stage.columns == docs.columns
    empty = docs.where(F.lit(False))
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0
