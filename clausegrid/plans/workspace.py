"""Queries of records, requests, prosecution history and the workspace, bound to whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.functions import text as X
from clausegrid.operators import claims as C
from clausegrid.operators import matters as M
from clausegrid.plans.catalog import _doc_mentions, _family, query
from clausegrid.sources import records as REC
from clausegrid.streaming import runtime as S

# --- Records ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, '18' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS application_number, CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS patent_number, o_orderpriority AS title, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS filing_date FROM orders")
def application_metadata(spark, t):
    meta = F.struct(F.concat(F.lit("18/"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("applicationNumberText"), F.lit("").alias("inventionTitle"), F.concat(F.lit(" "), "o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"))
    payload = F.to_json(F.struct(F.array(F.struct(meta.alias("meta"), F.struct(F.col("o_orderstatus").alias("applicationStatus")).alias("more"))).alias("results"), F.struct(F.col("o_custkey").alias("patentNumber")).alias("grant")))
    return t("orders").select("o_orderkey", REC.application_metadata(payload).alias("m")).select("o_orderkey", "m.*")


@query("SELECT o_orderkey, '15' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS application_number, CAST(1000000 + o_custkey AS VARCHAR) AS patent_number, lower(o_orderpriority) AS title, 'Granted · ' || strftime(o_orderdate, '%Y-%m-%d') AS status, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, strftime(o_orderdate, '%Y-%m-%d') AS grant_date, o_orderkey % 90 AS claim_count FROM orders")
def grant_metadata(spark, t):
    date = F.date_format("o_orderdate", "MMM. d, yyyy")
    page = F.concat(F.lit("(10) Patent No.: US "), F.format_number(1000000 + F.col("o_custkey"), 0), F.lit(" B2\n(45) Date of Patent: "), date, F.lit("\n(54) "), F.lower("o_orderpriority"), F.lit("\n\n(21) Appl. No.: 15/"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit("\n(22) Filed: "), date, F.lit("\n"), (F.col("o_orderkey") % 90).cast("string"), F.lit(" Claims, 3 Drawing Sheets"))
    return t("orders").select("o_orderkey", REC.grant_metadata(page).alias("m")).select("o_orderkey", "m.*")


KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'patent' WHEN 1 THEN 'application' WHEN 2 THEN 'patent' ELSE 'other' END"
ASKED = "CASE o_orderkey % 4 WHEN 0 THEN 'US ' || CAST(1000000 + o_custkey AS VARCHAR) || ' B2x' WHEN 1 THEN '18/' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') WHEN 2 THEN 'US ' || CAST(1000000 + o_custkey AS VARCHAR) ELSE '12345678' END"


def _customers(t):
    c = t("customer").select(F.concat(F.lit("grant:"), (1000000 + F.col("c_custkey")).cast("string")).alias("record_id"), (1000000 + F.col("c_custkey")).cast("string").alias("patent_number"), F.concat(F.lit("18"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("application_number"), F.col("c_name").alias("title"), F.col("c_name").alias("specification_text"), F.col("c_mktsegment").alias("claims_text"), F.lit("").alias("principal_claim_text"))
    return c.where("c_custkey % 3 != 0")


@query(f"""WITH q AS (SELECT o_orderkey AS request_id, {KIND} AS kind, regexp_replace({ASKED}, '\\D+', '', 'g') AS digits FROM orders),
v AS (SELECT *, CASE WHEN kind = 'patent' THEN CASE WHEN length(digits) NOT BETWEEN 6 AND 8 THEN 'patent number needs 6 to 8 digits' END WHEN kind = 'application' THEN CASE WHEN length(digits) <> 8 THEN 'application number needs 8 digits' END ELSE 'unknown identifier type' END AS invalid FROM q),
r AS (SELECT 'grant:' || CAST(1000000 + c_custkey AS VARCHAR) AS record_id, CAST(1000000 + c_custkey AS VARCHAR) AS p, '18' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS a, length(c_name) AS n FROM customer WHERE c_custkey % 3 <> 0)
SELECT request_id, record_id, n AS specification_character_count, CASE WHEN invalid IS NOT NULL THEN 'invalid_request: ' || invalid WHEN record_id IS NULL THEN 'patent_data_unavailable' END AS error
FROM v LEFT JOIN r ON invalid IS NULL AND (kind = 'patent' AND p = digits OR kind = 'application' AND a = digits)""")
def record_lookup(spark, t):
    asked = t("orders").select(F.col("o_orderkey").alias("request_id"), F.expr(KIND.replace("VARCHAR", "STRING")).alias("identifier_type"), F.expr(ASKED.replace("VARCHAR", "STRING")).alias("identifier"))
    return REC.lookup(_customers(t), asked).select("request_id", "record_id", "specification_character_count", "error")


@query("""WITH q AS (SELECT o_orderkey AS request_id, o_custkey AS c, CASE o_orderkey % 4 WHEN 0 THEN 'specification' WHEN 1 THEN 'claims' WHEN 2 THEN 'principal_claim' ELSE 'abstract' END AS section FROM orders)
SELECT request_id, CASE WHEN section = 'specification' THEN c_name WHEN section = 'claims' THEN c_mktsegment END AS text, CASE WHEN section = 'abstract' THEN 'invalid_request: unknown section' WHEN c_custkey IS NULL OR section = 'principal_claim' THEN 'invalid_request: record unavailable' END AS error
FROM q LEFT JOIN customer ON c_custkey = c AND c_custkey % 3 <> 0""")
def record_section(spark, t):
    section = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'specification' WHEN 1 THEN 'claims' WHEN 2 THEN 'principal_claim' ELSE 'abstract' END")
    asked = t("orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("grant:"), (1000000 + F.col("o_custkey")).cast("string")).alias("record_id"), section.alias("section"))
    return REC.record_sections(_customers(t), asked)


# --- Requests --------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS body, count(*) AS n, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\\S')) AS blank, max(length(text)) AS longest FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN NOT coalesce(regexp_matches(body, '\\S'), false) THEN 'invalid_request: patent_text is blank' WHEN length(body) > 300 THEN 'request_too_large' WHEN n > 6 THEN 'invalid_request: too many queries' WHEN blank > 0 THEN 'invalid_request: blank query'
  WHEN longest > 400 THEN 'invalid_request: query too long' WHEN conv_id % 60 NOT BETWEEN 1 AND 50 THEN 'invalid_request: top_n' END AS error FROM r""")
def request_validation(spark, t):
    r = t("conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("patent_text"), F.collect_list(F.coalesce("text", F.lit(""))).alias("queries"))
    return S.validate_requests(r.withColumn("top_n", F.col("conv_id") % 60), most_chars=300, most_queries=6, most_query_chars=400).select("conv_id", "error")


@query("""SELECT conv_id AS family_id, CASE WHEN count(*) < 2 THEN 'invalid_request: two family claims needed' WHEN count(*) > 6 THEN 'invalid_request: too many family claims' WHEN count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\\S')) > 0 THEN 'invalid_request: label, document number and text needed'
WHEN sum(length(coalesce(text, ''))) > 900 THEN 'invalid_request: family claims too large' WHEN count(DISTINCT role) < 2 THEN 'invalid_request: two family documents needed' END AS error FROM conversations GROUP BY conv_id""")
def family_validation(spark, t):
    return S.validate_families(_family(t), most_chars=900, number=(2, 6))


@query("""SELECT conv_id, CASE WHEN count(*) > 6 THEN 'invalid_request: too many concepts' WHEN count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\\S')) > 0 THEN 'invalid_request: title and evidence needed' WHEN max(length(text)) > 400 THEN 'invalid_request: title too long' END AS error FROM conversations GROUP BY conv_id""")
def concept_validation(spark, t):
    r = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.coalesce("text", F.lit("")).alias("title"), F.col("role").alias("evidence"))).alias("concepts"))
    return S.validate_concepts(r, most=6, most_chars=400).select("conv_id", "error")


@query("""SELECT conv_id, turn, CASE WHEN NOT coalesce(regexp_matches(before, '\\S'), false) THEN 'invalid_request: before_claim_text is blank' WHEN length(regexp_replace(before, '^\\s+|\\s+$', '', 'g')) > 300 THEN 'invalid_request: before_claim_text too long'
  WHEN NOT coalesce(regexp_matches(text, '\\S'), false) THEN 'invalid_request: after_claim_text is blank' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 300 THEN 'invalid_request: after_claim_text too long' END AS error
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def diff_validation(spark, t):
    from pyspark.sql import Window

    rows = t("conversations").select("conv_id", "turn", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before_claim_text"), F.col("text").alias("after_claim_text"))
    return S.validate_diff(rows, most=300).select("conv_id", "turn", "error")


# --- History and workspace -------------------------------------------------------------------------------------------


def _history(t):
    e = t("events")
    return e.select(F.col("user_id").alias("record_id"), F.when(F.col("event_type") == "error", "office_action").otherwise(F.col("event_type")).alias("type")), e.where("event_type = 'purchase'").select(F.col("user_id").alias("record_id"))


@query("SELECT user_id AS record_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS office_actions, count(*) FILTER (event_type = 'purchase') AS amendments FROM events GROUP BY user_id")
def prosecution_counts(spark, t):
    return M.prosecution_counts(*_history(t))


def _snapshots(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select(F.col("conv_id").alias("application_number"), F.col("turn").alias("date"), F.when(F.col("turn") % 2 == 1, F.col("turn")).alias("claim_number"), F.lag("text").over(w).alias("before_claim_text"), F.col("text").alias("after_claim_text"))


@query("SELECT conv_id || ':' || turn || ':' || CASE WHEN turn % 2 = 1 THEN CAST(turn AS VARCHAR) ELSE 'summary' END AS key, length(before) AS n_before, length(text) AS n_after FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE coalesce(before, '') <> '' AND coalesce(text, '') <> ''")
def amendment_snapshots(spark, t):
    return M.amendments(_snapshots(t)).select("key", F.length("before_claim_text").alias("n_before"), F.length("after_claim_text").alias("n_after"))


@query("SELECT conv_id || ':' || turn || ':' || CASE WHEN turn % 2 = 1 THEN CAST(turn AS VARCHAR) ELSE 'summary' END AS key, coalesce(before, '') <> '' AND coalesce(text, '') <> '' AS has_diff FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)")
def snapshot_diffs(spark, t):
    s = _snapshots(t)
    return M.snapshots_with_diffs(s, M.amendment_diffs(s)).select("key", F.col("blocks").isNotNull().alias("has_diff"))


@query()
def family_history(spark, t):
    return M.family_history(_family(t), _snapshots(t))


@query("SELECT year, applications, marker FROM (SELECT year(o_orderdate) AS year, count(*) AS applications FROM orders GROUP BY 1) LEFT JOIN (SELECT year(l_shipdate) AS year, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS marker FROM lineitem WHERE l_quantity > 30 GROUP BY 1) USING (year)")
def policy_markers(spark, t):
    years = t("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("applications"))
    marks = t("lineitem").where("l_quantity > 30").select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("label"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return M.with_policy_markers(years, marks)


def _matters(t):
    n = lambda k: F.when(F.col("o_orderkey") % k != 0, F.col("o_orderkey") % k)
    names = ["family_claims", "prosecution_history", "coverage_candidates", "specification_character_count", "claims_character_count", "classification_records", "examiner_profile", "art_unit_prediction_example"]
    return t("orders").select(F.col("o_orderkey").alias("record_id"), *(n(k).alias(c) for c, k in zip(names, (2, 3, 5, 7, 11, 2, 13, 3))))


@query("""SELECT o_orderkey AS record_id, count(*) FILTER (ok) AS available FROM (SELECT o_orderkey, unnest([o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0, o_orderkey % 2 <> 0, o_orderkey % 2 <> 0 AND o_orderkey % 5 <> 0, o_orderkey % 7 <> 0, o_orderkey % 11 <> 0, o_orderkey % 11 <> 0,
  o_orderkey % 2 <> 0 OR o_orderkey % 13 <> 0 OR o_orderkey % 3 <> 0, o_orderkey % 13 <> 0]) AS ok FROM orders) GROUP BY o_orderkey""")
def tool_availability(spark, t):
    return M.tool_availability(_matters(t)).groupBy("record_id").agg(F.count_if("available").alias("available"))


@query("""WITH f AS (SELECT o_orderkey AS record_id, [x for x in [CASE WHEN k % 3 > 0 THEN 'antecedent' END, CASE WHEN k % 2 = 0 THEN 'family-claims' END, CASE WHEN k % 2 <> 0 AND k % 5 > 0 THEN 'family-claims' END, CASE WHEN k % 7 > 0 THEN 'unclaimed' END, CASE WHEN k % 7 = 0 AND k % 11 > 0 THEN 'unclaimed' END,
  CASE WHEN k % 13 > 0 THEN 'family-history' ELSE 'support' END] if x IS NOT NULL] AS l FROM (SELECT o_orderkey, o_orderkey AS k FROM orders))
SELECT record_id, i AS position, l[i] AS tool FROM (SELECT record_id, l, unnest(range(1, least(3, len(l)) + 1)) AS i FROM f)""")
def brief_findings(spark, t):
    k = F.col("o_orderkey")
    m = t("orders").select(k.alias("record_id"), (k % 3).alias("high_issues"), F.when(k % 2 == 0, k).alias("comparison_rows"), (k % 5).alias("family_claims"), (k % 7).alias("concepts"), (k % 11).alias("coverage_candidates"), (k % 13).alias("events"))
    return M.brief_findings(m).select("record_id", "position", "tool")


@query("SELECT event_id AS id, tool FROM (SELECT event_id, event_type AS tool, ts FROM events WHERE event_type IN ('view', 'click') AND (user_id % 2 <> 0 OR user_id = 4) ORDER BY ts DESC, event_id LIMIT 12)")
def recent_analyses(spark, t):
    a = t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("record_id"), (F.col("user_id") % 2 == 0).alias("is_demo"), F.col("ts").alias("created_at"))
    return M.recent_analyses(a, ["view", "click"], "4").select("id", "tool")


@query("""SELECT l_orderkey AS record_id, l_partkey AS art_unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_partkey) AS rank, coalesce(l_partkey = o, false) AS matches FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS p FROM lineitem GROUP BY ALL)
LEFT JOIN (SELECT l_orderkey AS k, min(l_partkey) AS o FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON k = l_orderkey""")
def art_unit_ranking(spark, t):
    li = t("lineitem")
    predicted = li.groupBy(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("art_unit")).agg(F.sum("l_quantity").alias("probability"))
    observed = li.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.min("l_partkey").alias("art_unit"))
    return M.art_unit_ranking(predicted, observed).select("record_id", "art_unit", "rank", "matches")


@query("SELECT user_id, event_type, coalesce(b, 0) - coalesce(a, 0) AS delta FROM (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0)::DOUBLE AS a, count(*) FILTER (event_id % 3 = 0)::DOUBLE AS b FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY ALL)")
def queue_delta(spark, t):
    count = lambda c: t("events").where(c).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return M.metric_delta(count("event_id % 2 = 0"), count("event_id % 3 = 0"), ["user_id", "event_type"])


@query("""WITH q AS (SELECT DISTINCT conv_id AS request_id, role FROM conversations), h AS (SELECT conv_id AS request_id, count(*) FILTER (turn > 1) AS hits FROM conversations GROUP BY 1), n AS (SELECT request_id, count(*) AS limitations FROM q GROUP BY 1)
SELECT request_id, limitations, hits, greatest(0, hits - limitations) AS alternatives FROM n JOIN h USING (request_id)""")
def support_counts(spark, t):
    c = t("conversations").select(F.col("conv_id").alias("request_id"), F.col("role").alias("query_id"), "turn")
    return M.support_counts(c.where("turn > 1"), c.select("request_id", "query_id").distinct())


@query("SELECT c_mktsegment, count(*) AS applications, count(*) FILTER (o_orderstatus = 'F') AS granted, count(*) - count(*) FILTER (o_orderstatus = 'F') AS not_granted, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS grant_ratio, 100 - round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS non_grant_ratio, round(sum(o_orderkey % 7) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) FILTER (o_orderstatus = 'F'), 2) AS actions_per_grant FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def examiner_outcomes(spark, t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return M.outcomes(rows, ["c_mktsegment"], F.col("o_orderstatus") == "F", F.col("o_orderkey") % 7)


# --- Claims and text --------------------------------------------------------------------------------------------------


@query("SELECT family_id, claim_count, document_count, greatest(a, b) AS comparison_rows FROM (SELECT conv_id AS family_id, count(*) AS claim_count, count(DISTINCT role) AS document_count, max(n) AS a, min(n) AS b FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations) GROUP BY 1)")
def family_overall(spark, t):
    f = _family(t)
    return C.overall_summary(C.compare_family(f), f).select("family_id", "claim_count", "document_count", "comparison_rows")


@query("""SELECT conv_id, turn, CASE WHEN a + b + c = 0 THEN 'No material limitation-block change' ELSE array_to_string([x for x in [CASE WHEN a > 0 THEN a || ' modified' END, CASE WHEN b > 0 THEN b || ' added' END, CASE WHEN c > 0 THEN c || ' removed' END] if x IS NOT NULL], ', ') || CASE WHEN a + b + c = 1 THEN ' limitation block' ELSE ' limitation blocks' END END AS conclusion
FROM (SELECT conv_id, turn, turn % 3 AS a, conv_id % 2 AS b, (turn + conv_id) % 2 AS c FROM conversations)""")
def claim_conclusion(spark, t):
    return t("conversations").select("conv_id", "turn", X.conclusion(F.col("turn") % 3, F.col("conv_id") % 2, (F.col("turn") + F.col("conv_id")) % 2).alias("conclusion"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS shown FROM orders")
def display_dates(spark, t):
    return t("orders").select("o_orderkey", X.display_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '—' ELSE format('{:,}', c_custkey * 1001) END AS patent, CASE WHEN c_custkey % 10 = 0 THEN '18/' || substr(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 1, 3) || ',' || substr(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 4) ELSE CAST(c_custkey AS VARCHAR) END AS application FROM customer")
def number_formats(spark, t):
    empty = F.col("c_custkey") % 10 == 0
    number = F.when(empty, F.concat(F.lit("18/"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).otherwise(F.col("c_custkey").cast("string"))
    return t("customer").select("c_custkey", X.format_patent(F.when(empty, "none").otherwise((F.col("c_custkey") * 1001).cast("string"))).alias("patent"), X.format_application(number).alias("application"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN '' WHEN length(text) < 20 THEN replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') ELSE replace(replace(replace(replace(replace(left(text, strpos(text, substr(text, 11, 10)) - 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') || '<mark>' || replace(replace(replace(replace(replace(substr(text, 11, 10), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') || '</mark>' || replace(replace(replace(replace(replace(substr(text, strpos(text, substr(text, 11, 10)) + 10), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') END AS shown FROM conversations")
def passage_highlight(spark, t):
    part = F.when(F.length("text") >= 20, F.substring("text", 11, 10)).otherwise("")
    return t("conversations").select("conv_id", "turn", X.highlight_passage(F.col("text"), part).alias("shown"))


@query("SELECT conv_id, string_agg(turn + 1 || '. ' || regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), '|' ORDER BY turn) AS claims FROM conversations GROUP BY conv_id")
def numbered_claims(spark, t):
    one = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    texts = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("c")))), lambda x: x["c"]), "\n").alias("claims_text"), F.collect_list(F.col("turn") + 1).alias("n"))
    found = texts.select("conv_id", "claims_text", F.explode(F.array_sort("n")).alias("k")).select("conv_id", "k", X.numbered_claim(F.col("claims_text"), F.col("k")).alias("c"))
    return found.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]), "|").alias("claims"))


@query("SELECT conv_id, CAST(least(50, greatest(8, 4 * count(*))) AS BIGINT) AS top_n FROM conversations GROUP BY conv_id")
def coverage_hits(spark, t):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", X.coverage_hits(F.col("n")).alias("top_n"))


@query("SELECT c_custkey, c_custkey || '::' || CASE WHEN c_custkey % 2 = 0 THEN 'support::{\"queries\":[\"' || c_name || '\"],\"top_n\":5}' ELSE 'antecedent::record' END AS key FROM customer")
def cache_keys(spark, t):
    tool = F.when(F.col("c_custkey") % 2 == 0, "support").otherwise("antecedent")
    return t("customer").select("c_custkey", X.cache_key(F.col("c_custkey").cast("string"), tool, F.array("c_name"), F.lit(None).cast("int")).alias("key"))


@query("SELECT event_id, '{\"event\":\"' || event_type || '_done\",\"request_id\":' || event_id || ',\"user\":' || user_id || '}' AS line FROM events")
def log_lines(spark, t):
    return t("events").select("event_id", F.replace(X.log_line("X", request_id=F.col("event_id"), user=F.col("user_id")), F.lit("X"), F.concat("event_type", F.lit("_done"))).alias("line"))


def _issue_sets(t):
    m = _doc_mentions(t).withColumns({"set_id": F.col("claim_id") % 10})
    return C.antecedent_issues(m.drop("set_id")), t("documents").select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 10).alias("set_id"))


@query()
def issue_overall(spark, t):
    return C.issue_summary(*_issue_sets(t))


@query()
def flagged_claims(spark, t):
    return C.flagged_claims(C.issue_summary(*_issue_sets(t)))


def _sets(t):
    return t("documents").select((F.col("doc_id") % 10).alias("set_id"), F.col("doc_id").alias("claim_id"), F.lit(1).alias("claim_number"), F.lit("Loaded").alias("label"), F.col("source").alias("document_number"), F.coalesce("text", F.lit("")).alias("claim_text"))


@query()
def antecedent_documents(spark, t):
    return C.antecedent(_sets(t))


@query()
def highlight_marks(spark, t):
    return C.marks(_sets(t))


@query()
def segment_documents(spark, t):
    return _sets(t).select("claim_id", F.explode(C.segment(F.col("claim_text"))["segments"]).alias("s")).select("claim_id", "s.*")


@query()
def claim_graph_nodes(spark, t):
    return C.claim_graph(_sets(t))[0]


@query()
def claim_graph_edges(spark, t):
    return C.claim_graph(_sets(t))[1]
