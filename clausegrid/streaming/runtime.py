"""Bounded micro-batch execution: admission, rate limits, batch replay, streaming search, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegrid.functions.constants import DEFAULT_HITS, FAMILY_CLAIMS, MAX_CLAIM_TEXT, MAX_HITS, MAX_QUERIES, MAX_QUERY, MAX_TEXT
from clausegrid.functions.sequence import Batcher
from clausegrid.operators import retrieval


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def validate_requests(requests: DataFrame, most_chars: int = MAX_TEXT, most_queries: int = MAX_QUERIES, most_query_chars: int = MAX_QUERY, most_hits: int = MAX_HITS) -> DataFrame:
    """requests with a column error: null for what may run.

    Columns patent_text, queries, top_n; optionally query (one, instead of queries) and record_text (of the record that
    is asked about, used where there is no patent_text). Texts and queries come back trimmed, query as one of queries.
    """
    has = lambda name: F.col(name) if name in requests.columns else F.lit(None).cast("string")
    text, one, many = F.coalesce(F.col("patent_text"), has("record_text")), has("query"), F.col("queries")
    queries = F.when(one.isNotNull(), F.array(one)).otherwise(many)
    error = (
        F.when(_blank(text), "invalid_request: patent_text is blank")
        .when(F.length(text) > most_chars, "request_too_large")
        .when(one.isNotNull() & many.isNotNull(), "invalid_request: query or queries, not both")
        .when(F.coalesce(F.size(queries), F.lit(0)) < 1, "invalid_request: no query")
        .when(F.size(queries) > most_queries, "invalid_request: too many queries")
        .when(F.exists(queries, _blank), "invalid_request: blank query")
        .when(F.exists(queries, lambda q: F.length(q) > most_query_chars), "invalid_request: query too long")
        .when(~F.coalesce(F.col("top_n"), F.lit(DEFAULT_HITS)).between(1, most_hits), "invalid_request: top_n")
    )
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return requests.withColumns({"error": error, "patent_text": strip(text), "queries": F.transform(queries, strip)}).drop("query", "record_text")


def validate_claim_text(rows: DataFrame, column: str = "claim_text", most: int = MAX_CLAIM_TEXT) -> DataFrame:
    """rows with an error for a blank or too long claim; blanks around it don't count."""
    text = F.regexp_replace(column, r"^\s+|\s+$", "")
    return rows.withColumn("error", F.when(_blank(F.col(column)), f"invalid_request: {column} is blank").when(F.length(text) > most, f"invalid_request: {column} too long"))


def validate_diff(rows: DataFrame, most: int = MAX_CLAIM_TEXT) -> DataFrame:
    """rows (before_claim_text, after_claim_text) with an error for the first that is blank or too long."""
    both = [F.when(_blank(F.col(c)), f"invalid_request: {c} is blank").when(F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) > most, f"invalid_request: {c} too long") for c in ("before_claim_text", "after_claim_text")]
    return rows.withColumn("error", F.coalesce(*both))


def validate_families(claims: DataFrame, most_chars: int = MAX_TEXT, number: tuple[int, int] = FAMILY_CLAIMS) -> DataFrame:
    """family_id, error of families of claims (label, document_number, claim_text): how many there are, blanks, size, and two documents."""
    blank = _blank(F.col("label")) | _blank(F.col("document_number")) | _blank(F.col("claim_text"))
    n = claims.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), F.coalesce(F.sum(F.length("claim_text")), F.lit(0)).alias("size"), F.countDistinct("label", "document_number").alias("documents")
    )
    error = (
        F.when(F.col("n") < number[0], "invalid_request: two family claims needed").when(F.col("n") > number[1], "invalid_request: too many family claims")
        .when(F.col("blank") > 0, "invalid_request: label, document number and text needed").when(F.col("size") > most_chars, "invalid_request: family claims too large")
        .when(F.col("documents") < 2, "invalid_request: two family documents needed")
    )
    return n.select("family_id", error.alias("error"))


def validate_concepts(requests: DataFrame, most: int = MAX_QUERIES, most_chars: int = MAX_QUERY) -> DataFrame:
    """requests with an error about their concepts: array of structs (title, evidence)."""
    c = F.col("concepts")
    error = (
        F.when(F.coalesce(F.size(c), F.lit(0)) < 1, "invalid_request: no concept").when(F.size(c) > most, "invalid_request: too many concepts")
        .when(F.exists(c, lambda x: _blank(x["title"]) | _blank(x["evidence"])), "invalid_request: title and evidence needed")
        .when(F.exists(c, lambda x: F.length(x["title"]) > most_chars), "invalid_request: title too long")
    )
    return requests.withColumn("error", error)


def admit(requests: DataFrame, capacity: int) -> DataFrame:
    """Requests in order of arrival within their tick; those beyond its capacity are rejected."""
    w = Window.partitionBy("tick").orderBy("arrived_at", "request_id")
    return requests.withColumn("status", F.when(F.row_number().over(w) <= capacity, "accepted").otherwise("overloaded"))


def rate_limited(events: DataFrame, key: str, ts: str, order: str, most: int = 8, window: str = "10 seconds") -> DataFrame:
    """The first `most` events of each key and fixed window pass."""
    w = Window.partitionBy(key, F.window(ts, window)["start"]).orderBy(ts, order)
    return events.withColumn("allowed", F.row_number().over(w) <= most)


def late(enqueued: Column, now: Column, seconds: int = 120) -> Column:
    return now.cast("double") - enqueued.cast("double") > seconds


def replay_batches(items: DataFrame, key: str, size: int = 8, budget: float = 4_000_000, window: float = 0.02) -> DataFrame:
    """Batch of each item (arrival, cost, item_id) of a queue (key), as the bounded batcher would form them.

    A queue's order is a fold from its first item on; queues run side by side. Rows stream through in order, and a task
    holds one open batch, whatever a queue's length.
    """
    schema = f"{key} {dict(items.dtypes)[key]}, item_id long, batch long"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now = None, None
        for f in frames:
            out = []
            for k, arrival, cost in zip(f[key], f["arrival"], f["cost"]):
                if now is None or k != own:
                    own, now = k, Batcher(size, budget, window)
                out.append(now.take(arrival, cost))
            yield pd.DataFrame({key: f[key], "item_id": f["item_id"], "batch": out})

    rows = items.select(key, "item_id", "arrival", "cost").repartition(key).sortWithinPartitions(key, "arrival", "item_id")
    return rows.mapInPandas(fold, schema)


def analyze_batch(requests: DataFrame, profile: str = "throughput") -> DataFrame:
    """Hits of valid requests; each distinct text and query is worked on once, and a bad request fails none but itself."""
    good = validate_requests(requests).where("error IS NULL").withColumn("doc_id", F.sha2("patent_text", 256))
    docs = good.select("doc_id", F.col("patent_text").alias("text")).dropDuplicates(["doc_id"])
    asked = good.select("request_id", "doc_id", "top_n", F.posexplode("queries").alias("query_pos", "query"))
    # A document meets the queries that are asked of it, not all of the batch.
    queries = asked.select("doc_id", F.col("query").alias("text")).distinct().withColumn("query_id", F.sha2("text", 256))
    hits = retrieval.search(docs, queries, profile, top_n=MAX_HITS)
    mine = asked.withColumn("query_id", F.sha2("query", 256))
    return mine.join(hits, ["doc_id", "query_id"]).where(F.col("rank") <= F.coalesce("top_n", F.lit(DEFAULT_HITS))).drop("doc_id", "query_id")


def search_stream(requests: DataFrame, output: str, checkpoint: str, trigger: dict | None = None, profile: str = "throughput"):
    """Run a stream of requests in micro-batches; each batch's hits are written under its number, so a retried batch overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        analyze_batch(batch, profile).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    schema = "request_id string, patent_text string, queries array<string>, top_n int, arrived_at timestamp"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return raw.withWatermark("arrived_at", "2 minutes").dropDuplicatesWithinWatermark(["request_id"])


def stream_metrics(query) -> dict:
    """Counters of a running or finished query."""
    progress = list(query.recentProgress)
    return {"batches": len(progress), "rows": sum(p["numInputRows"] for p in progress), "active": query.isActive, "last_ms": progress[-1]["durationMs"].get("triggerExecution") if progress else None}


def queue_metrics(log: DataFrame) -> DataFrame:
    """Counters and guarded averages of a batch log (status, wait_s, batch_size)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return log.agg(
        F.count(F.lit(1)).alias("submitted"), count("completed").alias("completed"), count("overloaded").alias("rejected"), count("failed").alias("failed"),
        F.coalesce(F.try_divide(F.sum("wait_s"), count("completed")), F.lit(0.0)).alias("mean_wait_s"), F.coalesce(F.avg("batch_size"), F.lit(0.0)).alias("mean_batch"),
    )
