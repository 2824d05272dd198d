"""A matter's workspace: which tools apply, counts, prosecution history, findings, rankings, metric deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.operators import claims as C

EXAMPLE_ONLY = "Complete example only"
#: Tools and what of a matter they need: any of the groups, of each group all.
TOOLS = {
    "family-history": ([["family_claims", "prosecution_history"]], EXAMPLE_ONLY),
    "family-claims": ([["family_claims"]], EXAMPLE_ONLY),
    "unclaimed": ([["family_claims", "coverage_candidates"]], EXAMPLE_ONLY),
    "support": ([["specification_character_count"]], "Patent text unavailable"),
    "antecedent": ([["claims_character_count"]], "Claims unavailable"),
    "linguistic": ([["claims_character_count"]], "Claims unavailable"),
    "art-unit": ([["classification_records"], ["examiner_profile"], ["art_unit_prediction_example"]], EXAMPLE_ONLY),
    "examiner": ([["examiner_profile"]], EXAMPLE_ONLY),
}


def tool_availability(matters: DataFrame) -> DataFrame:
    """record_id, tool, available, label; matters have a number (of entries or characters, null for none) under each name in TOOLS."""
    has = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    rows = []
    for tool, (groups, label) in TOOLS.items():
        fit = F.lit(False)
        for group in groups:
            own = F.lit(True)
            for name in group:
                own = own & has(name)
            fit = fit | own
        rows.append(F.struct(F.lit(tool).alias("tool"), fit.alias("available"), F.lit(label).alias("label")))
    return matters.select("record_id", F.explode(F.array(*rows)).alias("t")).select("record_id", "t.*")


def recent_analyses(analyses: DataFrame, tools: list[str], example: str, n: int = 12) -> DataFrame:
    """The newest n analyses of known tools; those of an example matter only if it is the present one."""
    known = F.col("tool").isin(tools) & F.col("record_id").isNotNull() & (~F.coalesce("is_demo", F.lit(False)) | (F.col("record_id") == example))
    return analyses.where(known).orderBy(F.desc("created_at"), "id").limit(n)


def prosecution_counts(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """record_id, events, office_actions, amendments of each record that has either."""
    e = events.groupBy("record_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "office_action").alias("office_actions"))
    s = snapshots.groupBy("record_id").agg(F.count(F.lit(1)).alias("amendments"))
    zero = F.lit(0).cast("long")
    return e.join(s, "record_id", "full").select("record_id", *(F.coalesce(c, zero).alias(c) for c in ("events", "office_actions", "amendments")))


def snapshot_key(application: Column, date: Column, claim_number: Column) -> Column:
    return F.concat_ws(":", application.cast("string"), date.cast("string"), F.coalesce(F.nullif(claim_number.cast("string"), F.lit("")), F.lit("summary")))


def amendments(snapshots: DataFrame) -> DataFrame:
    """Snapshots (application_number, date, claim_number, before_claim_text, after_claim_text) that have both texts, with their key."""
    both = (F.coalesce(F.col("before_claim_text"), F.lit("")) != "") & (F.coalesce(F.col("after_claim_text"), F.lit("")) != "")
    return snapshots.where(both).withColumn("key", snapshot_key(F.col("application_number"), F.col("date"), F.col("claim_number")))


def amendment_diffs(snapshots: DataFrame) -> DataFrame:
    """key and redline of each amendment; only their texts reach Python."""
    return amendments(snapshots).select("key", C.redline(F.col("before_claim_text"), F.col("after_claim_text")).alias("d")).select("key", "d.*")


def snapshots_with_diffs(snapshots: DataFrame, diffs: DataFrame) -> DataFrame:
    """All snapshots, with the diff of their key if there is one."""
    keyed = snapshots.withColumn("key", snapshot_key(F.col("application_number"), F.col("date"), F.col("claim_number")))
    return keyed.join(diffs, "key", "left")


def family_history(claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A family's comparison and its amendments' diffs in one long table: part, family_id or key, counts."""
    compared = C.compare_family(claims).select(F.lit("comparison").alias("part"), F.concat_ws(":", F.col("family_id").cast("string"), F.col("position").cast("string")).alias("key"), "changed", "added", "removed")
    diffs = amendment_diffs(snapshots).select(F.lit("amendment").alias("part"), "key", F.col("blocks").alias("changed"), F.col("inserted").alias("added"), F.col("deleted").alias("removed"))
    return compared.unionByName(diffs)


def with_policy_markers(timeline: DataFrame, markers: DataFrame) -> DataFrame:
    """A timeline by year with each year's marker (the last given one), if it has one."""
    last = markers.groupBy("year").agg(F.max_by("label", "pos").alias("marker"))
    return timeline.join(last, "year", "left")


def brief_findings(matters: DataFrame, n: int = 3) -> DataFrame:
    """The first n findings of each matter in order of their rules: record_id, position, tool, finding.

    matters: record_id, high_issues, comparison_rows, changed, family_claims, concepts, coverage_candidates, events (numbers, null for none).
    """
    n_of = lambda c: F.coalesce(F.col(c), F.lit(0))
    rule = lambda test, tool, text: F.when(test, F.struct(F.lit(tool).alias("tool"), text.alias("finding")))
    say = lambda c, text: F.concat(n_of(c).cast("string"), F.lit(text))
    compared, reviewed, events = F.col("comparison_rows").isNotNull(), n_of("concepts") > 0, n_of("events") > 0
    found = F.filter(
        F.array(
            rule(n_of("high_issues") > 0, "antecedent", F.concat(n_of("high_issues").cast("string"), F.when(n_of("high_issues") == 1, " reference issue needs review").otherwise(" reference issues need review"))),
            rule(compared, "family-claims", say("comparison_rows", " claim pairs changed")),
            rule(~compared & (n_of("family_claims") > 0), "family-claims", F.lit("Compare independent claims")),
            rule(reviewed, "unclaimed", say("concepts", " concepts ready")),
            rule(~reviewed & (n_of("coverage_candidates") > 0), "unclaimed", F.lit("Review potential coverage gaps")),
            rule(events, "family-history", say("events", " dated public events")),
            rule(~events, "support", F.lit("Search the disclosure")),
        ),
        lambda x: x.isNotNull(),
    )
    return matters.select("record_id", F.posexplode(F.slice(found, 1, n)).alias("at", "f")).select("record_id", (F.col("at") + 1).alias("position"), "f.*")


def art_unit_ranking(predictions: DataFrame, observed: DataFrame) -> DataFrame:
    """Candidates of each record by falling probability (rank from 1), with the observed unit and whether the candidate is it."""
    w = Window.partitionBy("record_id").orderBy(F.desc("probability"), "art_unit")
    rows = predictions.withColumn("rank", F.row_number().over(w)).join(observed.select("record_id", F.col("art_unit").alias("observed")), "record_id", "left")
    return rows.withColumn("matches", F.coalesce(F.col("art_unit") == F.col("observed"), F.lit(False)))


def metric_delta(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Counters of two snapshots (value) by key: what was added between; a key that one of them lacks counts from zero."""
    zero = F.lit(0.0)
    both = before.withColumnRenamed("value", "v0").join(after.withColumnRenamed("value", "v1"), on, "full")
    return both.select(*on, (F.coalesce("v1", zero) - F.coalesce("v0", zero)).alias("delta"))


def mean_of_delta(total: Column, count: Column) -> Column:
    """A counter's mean between two snapshots; 0 where nothing was counted."""
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def support_counts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """limitations, best_matches, alternatives of each request: hits beyond one for each query are alternatives."""
    n = queries.join(hits.groupBy("request_id", "query_id").agg(F.count(F.lit(1)).alias("hits")), ["request_id", "query_id"], "left")
    out = n.groupBy("request_id").agg(F.count(F.lit(1)).alias("limitations"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return out.withColumn("alternatives", F.greatest(F.lit(0), F.col("hits") - F.col("limitations")))


def outcomes(df: DataFrame, by: list[str], granted: Column, actions: Column) -> DataFrame:
    """applications, granted, not granted, their shares and office actions for each grant."""
    n, g = F.count(F.lit(1)), F.count_if(granted)
    share = F.round(F.coalesce(F.try_divide(100.0 * g, n), F.lit(0.0)), 1)
    each = F.round(F.coalesce(F.try_divide(F.sum(F.when(granted, actions)).cast("double"), g), F.lit(0.0)), 2)
    return df.groupBy(*by).agg(n.alias("applications"), g.alias("granted"), (n - g).alias("not_granted"), share.alias("grant_ratio"), (F.lit(100.0) - share).alias("non_grant_ratio"), each.alias("actions_per_grant"))


def most_common(df: DataFrame, columns: list[str]) -> Column:
    """Name of the column with the greatest value, the first of those that tie."""
    return F.element_at(F.array_sort(F.array(*(F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)))), 1)["name"]
