from pyspark.sql import functions as F

from clausegrid.llm import exact_dedup as x

ROWS = [(4, "same", "a"), (9, "same", "b"), (2, "other", "c"), (7, None, "d"), (8, "", "e"), (None, "same", "f"), (3, "Same", "g"), (5, "long" * 50_000, "h"), (6, "long" * 50_000, "i")]


def answer(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in frame.collect()), key=str)


def expected(rows, largest=True):
    out, pick = [], max if largest else min
    for i, t, _ in rows:
        group = [(j is not None, j or 0) for j, u, _ in rows if (u or "") == (t or "")]
        keep = pick(group)
        out.append((i, keep[1] if keep[0] else None, len(group), (i is not None, i or 0) == keep))
    return sorted(out, key=str)


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    assert answer(x.exact_groups(docs)) == expected(ROWS)
    assert answer(x.exact_groups(docs.where("doc_id is not null"), keep="smallest")) == expected([r for r in ROWS if r[0] is not None], largest=False)
    assert x.exact_groups(docs.limit(0)).count() == 0


def test_colliding_digests_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    weak = lambda text: F.substring(x.sha256_bytes(text), 1, 0)  # noqa: E731  one digest for all
    assert answer(x.exact_groups(docs, digest=weak)) == expected(ROWS)


def test_one_of_repeated_rows_stays(spark):
    rows = ROWS + [(9, "same", "again"), (1, "alone", "x"), (1, "alone", "y"), (None, "same", "f2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    groups = x.exact_groups(docs)
    assert groups.where("kept").count() == groups.select("digest").distinct().count() == 6
    kept = x.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.select("doc_id", F.coalesce("text", F.lit(""))).collect()))
    assert got == sorted([(9, "same"), (2, "other"), (8, ""), (3, "Same"), (6, "long" * 50_000), (1, "alone")])


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    plan = x.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
