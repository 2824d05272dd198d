"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Each input partition is a memtable. It is flushed as one run: a Parquet file of (digest, doc_id, uid) sorted by
digest, whose footer holds the run's filters (Parquet Bloom filter and min/max of the digest). Nothing here reads
those filters: compaction is an aggregate over the rows of all runs, which needs neither them nor the order, first by
a digest within a salt, then by the digest, so that a group with a third of all rows is pre-aggregated and never meets
in one task. It keeps one identifier per digest. Hits (digests of more than one row)
are verified on the text's bytes: a bit filter of bounded size over the digests of the hits lets only their texts
through to an aggregate that compares the least and the greatest text of each digest. Digests that fail are
regrouped by the texts themselves.

Defined cases: null text counts as empty; of rows that tie on doc_id one stays (the later flushed); a null doc_id
sorts before all others and so stays only among its like; an empty table gives an empty result; other columns of
the input are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import drop_rows, fold, in_filter, key_filter, materialize, one_of_repeated

#: Salts among which the rows of one digest are dealt.
SALTS = 16


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One sorted run per input partition, in the shared folder: uid, doc_id, digest."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), digest(fold(F.col(text_col))).alias("digest"))
    return materialize(rows.sortWithinPartitions("digest"), "dedup-runs", **{"parquet.bloom.filter.enabled#digest": "true"})


def compact(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """Merge runs: digest, salt, keeper(doc_id, uid), group_size; a row for each salt that the digest has."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    best = F.max if keep == "largest" else F.min
    level1 = runs.groupBy("digest", _salt().alias("salt")).agg(best(F.struct("doc_id", "uid")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    level2 = level1.groupBy("digest").agg(best("keeper").alias("keeper"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    return level2.select("digest", F.explode("salts").alias("salt"), "keeper", "group_size")


def _salt() -> Column:
    return F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")


def failed_digests(docs: DataFrame, index: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that different texts share. Texts of one digest are reduced to two before the shuffle."""
    rows = docs.select(fold(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    hits = key_filter(index.where("group_size > 1").select("digest"), F.col("digest"))
    return in_filter(rows, F.col("digest"), hits).where("hit").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, digest."""
    runs = flush(docs, id_col, text_col, digest)
    index = materialize(compact(runs, keep), "dedup-index")
    failed = materialize(failed_digests(docs, index, text_col, digest), "dedup-failed")
    salted = runs.withColumn("salt", _salt())
    sound = salted.join(index, ["digest", "salt"])
    out = sound.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("keeper.uid") == F.col("uid")).alias("kept"), "digest")
    if failed.isEmpty():
        return out
    # Different texts under one digest: their rows are grouped by the whole text.
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), fold(F.col(text_col)).alias("text"))
    rows = materialize(rows.withColumn("digest", digest(F.col("text"))).join(failed, "digest", "left_semi"), "dedup-collided")
    groups = rows.groupBy("digest", "text").agg(best(F.struct("doc_id", "uid")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    again = rows.join(groups, ["digest", "text"]).select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("keeper.uid") == F.col("uid")).alias("kept"), "digest")
    return out.join(failed, "digest", "left_anti").select(again.columns).unionByName(again)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they came."""
    groups = exact_groups(docs, id_col, text_col, keep)
    dropped = materialize(groups.where("not kept").select(F.col("doc_id").alias("id"), F.col("keep_id"), F.col("digest").alias("also")), "dedup-dropped")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    digest = sha256_bytes(fold(F.col(text_col)))
    return one_of_repeated(drop_rows(docs, dropped.where(~same).distinct(), id_col, digest), dropped.where(same), id_col, digest)


def op10_exact_dedup(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    groups = exact_groups(table(prepare(spark), sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
