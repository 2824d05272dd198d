"""Registered queries over whole tables (or literal fixtures for claims), and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegrid.functions import text as X
from clausegrid.functions.constants import ABBREVIATION_END
from clausegrid.operators import analytics as A
from clausegrid.operators import claims as C
from clausegrid.operators import retrieval as R
from clausegrid.sources import io as IO
from clausegrid.streaming import runtime as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- Segmentation and tokens -------------------------------------------------------------------------------------

SENT = r"""
para AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS paragraph_id FROM (SELECT doc_id, [trim(x) for x in string_split(coalesce(text, ''), chr(10)) if trim(x) <> ''] AS ps FROM documents)),
sent0 AS (SELECT doc_id, paragraph_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_id
  FROM (SELECT doc_id, paragraph_id, [trim(x) for x in string_split(regexp_replace(regexp_replace(p, '[ \t\r\f\v]+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> ''] AS ss FROM para)),
"""
SENT_LAST = "sent AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, sentence_id) - 1 AS sentence_global_idx FROM sent0)"
SENT += SENT_LAST
LINE = "\n"
#: Word boundaries of the SQL's patterns know ASCII only.
ABBREVIATION = ABBREVIATION_END.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])")


@query("SELECT doc_id, p.i AS paragraph_id, p.t AS paragraph FROM (SELECT doc_id, unnest([{'i': i - 1, 't': ps[i]} for i in range(1, len(ps) + 1)]) AS p FROM (SELECT doc_id, [trim(x) for x in string_split(coalesce(text, ''), chr(10)) if trim(x) <> ''] AS ps FROM documents))")
def paragraph_split(spark, t):
    return t("documents").select("doc_id", F.posexplode(X.paragraphs(F.col("text"), LINE)).alias("paragraph_id", "paragraph"))


@query(f"WITH {SENT} SELECT doc_id, paragraph_id, sentence_id, sentence_global_idx, sentence FROM sent")
def sentence_split(spark, t):
    return R.split_sentences(t("documents"), LINE)


FIG = "(VALUES (1, 'See FIG. 2 for details. The U.S. Patent shows it. No. 5 is old.'), (2, 'Smith et al. describe it. (a) first. Next one.'), (3, 'Plain. Text.'))"


@query(f"""
WITH s0 AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_id FROM (SELECT doc_id, [trim(x) for x in string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if trim(x) <> ''] AS ss FROM {FIG} AS v(doc_id, text))),
f AS (SELECT *, CASE WHEN regexp_matches(coalesce(lag(sentence) OVER w, ''), '(?i)(\\bfigs?\\.|\\bu\\.?\\s*s\\.?|\\bno\\.|\\bet\\s+al\\.)\\s*$') AND regexp_matches(sentence, '^\\s*([A-Za-z0-9,:;]|\\([0-9A-Za-z]+\\))') THEN 0 ELSE 1 END AS brk FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY sentence_id) AS island FROM f)
SELECT doc_id, CAST(0 AS BIGINT) AS paragraph_id, CAST(island - 1 AS BIGINT) AS sentence_id, string_agg(sentence, ' ' ORDER BY sentence_id) AS sentence FROM i GROUP BY doc_id, island
""")
def abbrev_merge(spark, t):
    docs = spark.sql(f"SELECT * FROM {FIG} AS v(doc_id, text)")
    return R.merge_abbreviations(R.split_sentences(docs)).drop("sentence_global_idx")


@query(f"""
WITH {SENT},
f AS (SELECT *, CASE WHEN regexp_matches(coalesce(lag(sentence) OVER w, ''), '(?i){ABBREVIATION}') AND regexp_matches(sentence, '^\\s*([A-Za-z0-9,:;]|\\([0-9A-Za-z]+\\))') THEN 0 ELSE 1 END AS brk FROM sent WINDOW w AS (PARTITION BY doc_id, paragraph_id ORDER BY sentence_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, paragraph_id ORDER BY sentence_id) AS island FROM f)
SELECT doc_id, CAST(paragraph_id AS BIGINT) AS paragraph_id, CAST(island - 1 AS BIGINT) AS sentence_id, string_agg(sentence, ' ' ORDER BY sentence_id) AS sentence FROM i GROUP BY doc_id, paragraph_id, island
""")
def abbrev_merge_documents(spark, t):
    return R.split_sentences(t("documents"), LINE, merge=True).drop("sentence_global_idx")


@query("SELECT doc_id, len(tk) AS n_tokens, len(list_distinct(tk)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tk FROM documents)")
def bm25_tokens(spark, t):
    tk = X.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(tk).alias("n_tokens"), F.size(F.array_distinct(tk)).alias("n_distinct"))


@query(f"WITH {SENT}, tk AS (SELECT doc_id, sentence_global_idx, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS term FROM sent) SELECT doc_id, term, count(DISTINCT sentence_global_idx) AS df, count(*) AS cf FROM tk GROUP BY doc_id, term")
def term_stats(spark, t):
    return R.term_statistics(R.split_sentences(t("documents"), LINE))


@query("SELECT item_id, array_to_string(list_sort(list_distinct([w for w in regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') if length(w) >= 3 and not list_contains(['the','a','an','and','or','of','to','in','for','with','on','by','at','from','as','is','are','be','being','been','using','use','used','based'], w)])), ',') AS terms FROM benchmark")
def query_terms(spark, t):
    return t("benchmark").select("item_id", F.array_join(F.array_sort(X.query_terms(F.col("text"))), ",").alias("terms"))


# --- Retrieval -----------------------------------------------------------------------------------------------------

ASKED = "(VALUES (1, 'the tion and hand with'), (2, 'de la der und que the'))"
BM25 = f"""
{SENT},
tk AS (SELECT doc_id, sentence_global_idx AS sent, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS term FROM sent),
tf AS MATERIALIZED (SELECT doc_id, sent, term, count(*) AS tf FROM tk GROUP BY ALL),
len AS (SELECT doc_id, sentence_global_idx AS sent, len(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS l FROM sent),
st AS (SELECT doc_id, count(*) AS n, avg(l) AS avg_len FROM len GROUP BY doc_id),
idf AS (SELECT doc_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL) JOIN st USING (doc_id)),
mean AS (SELECT doc_id, avg(idf) AS m FROM idf GROUP BY doc_id),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {ASKED} AS v(query_id, text)) GROUP BY ALL),
hit AS (SELECT query_id, tf.doc_id, tf.sent, sum(times * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avg_len))) AS s
  FROM tf JOIN q USING (term) JOIN idf USING (doc_id, term) JOIN mean USING (doc_id) JOIN st USING (doc_id) JOIN len ON len.doc_id = tf.doc_id AND len.sent = tf.sent GROUP BY ALL),
every AS (SELECT DISTINCT query_id, doc_id, sentence_global_idx AS sent FROM sent, (SELECT DISTINCT query_id FROM q)),
scored AS (SELECT e.query_id, e.doc_id, e.sent, round(coalesce(s, 0), 6) + 0.0 AS score FROM every AS e LEFT JOIN hit USING (query_id, doc_id, sent)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, sent) AS rank FROM scored)
"""


def _asked(spark):
    return spark.sql(f"SELECT * FROM {ASKED} AS v(query_id, text)")


def _benchmark(t):
    return t("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, doc_id, sent, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark, t):
    return R.bm25_top(t("documents"), _asked(spark), 5, LINE, places=6)


@query(f"WITH {BM25.replace(ASKED, '(SELECT item_id, text FROM benchmark WHERE item_id % 100 = 0)')} SELECT query_id, doc_id, sent, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk_benchmark(spark, t):
    return R.bm25_top(t("documents"), _benchmark(t), 5, LINE, places=6)


LETTERS = "[" + ",".join(f"'{c}'" for c in "abcdefghijklmnopqrstuvwxyz0123456789") + "]"
#: Both lists of each query in each document, of single precision, and their fusion.
HYBRID = BM25.replace("round(coalesce(s, 0), 6) + 0.0 AS score", "CAST(coalesce(s, 0) AS FLOAT) AS score") + f""",
counted AS (SELECT doc_id, sentence_global_idx AS sent, [CAST(length(sentence) - length(replace(lower(sentence), c, '')) AS DOUBLE) for c in {LETTERS}] AS c FROM (SELECT doc_id, sentence_global_idx, lower(sentence) AS sentence FROM sent)),
vec AS MATERIALIZED (SELECT doc_id, sent, [CAST(coalesce(x / nullif(sqrt(list_sum([y * y for y in c])), 0), 0) AS FLOAT) for x in c] AS v FROM counted),
qcounted AS (SELECT query_id, [CAST(length(text) - length(replace(lower(text), c, '')) AS DOUBLE) for c in {LETTERS}] AS c FROM (SELECT query_id, lower(text) AS text FROM {ASKED} AS v(query_id, text))),
qvec AS MATERIALIZED (SELECT query_id, [CAST(coalesce(x / nullif(sqrt(list_sum([y * y for y in c])), 0), 0) AS FLOAT) for x in c] AS q FROM qcounted),
dense AS (SELECT query_id, doc_id, sent, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY CAST(list_dot_product(q::DOUBLE[], v::DOUBLE[]) AS FLOAT) DESC, sent) AS rank FROM vec, qvec),
a AS (SELECT * FROM ranked WHERE rank <= 200), b AS (SELECT * FROM dense WHERE rank <= 200),
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.sent, b.sent) AS sent, a.rank AS rank_a, b.rank AS rank_b,
    CAST(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS FLOAT) AS score
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.sent = b.sent),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, sent) AS place FROM fused)
"""


@query(f"WITH {HYBRID} SELECT query_id, doc_id, sent, rank_a, rank_b, round(score::DOUBLE, 7) AS score FROM placed WHERE place <= 200")
def rrf_fusion(spark, t):
    rows = R.candidates(R.with_queries(R.index(t("documents"), LINE), _asked(spark)), "throughput", R.letter_embedding())
    found = rows.select("query_id", "doc_id", F.explode("found").alias("f"))
    return found.select("query_id", "doc_id", "f.sent", "f.rank_a", "f.rank_b", F.round(-F.col("f.neg").cast("double"), 7).alias("score"))


DENSE = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS ql, v.label AS vl, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10")
def dense_topk(spark, t):
    return R.top_k(_dense(t), 10, ["query_id"], "vec_id")


def _dense(t):
    e = t("embeddings")
    return R.dense(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).withColumn("score", F.round("score", 9))


@query(f"""WITH {DENSE}, r AS (SELECT query_id, ql = vl AS same, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE query_id <> vec_id),
f AS (SELECT query_id, min(CASE WHEN same THEN rank END) AS rank FROM r GROUP BY query_id)
SELECT round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS recall_10, avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END) AS recall_20 FROM f""")
def retrieval_quality(spark, t):
    labels = t("embeddings").select("vec_id", "label")
    r = R.ranked(_dense(t).where("query_id <> vec_id"), ["query_id"], "vec_id").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    first = r.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("rank"))
    return R.quality(first).withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH {BM25}, best AS (SELECT query_id, doc_id, sent, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, sent) AS r FROM scored)
SELECT query_id AS concept_id, doc_id AS claim_id, sent, round(score + 1e-9, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 1e-9, 4) DESC, doc_id) AS match_rank FROM best WHERE r = 1""")
def coverage_best(spark, t):
    s = R.bm25(t("documents"), _asked(spark), LINE, places=6)
    hits = s.select(F.col("query_id").alias("concept_id"), F.col("sent").alias("hit_pos"), F.concat_ws("/", "doc_id", "sent").alias("paragraph_id"), F.col("sent").alias("sentence"), (F.col("score") + 1e-9).alias("score"))
    claims = s.where("query_id = 1").select(F.concat_ws("/", "doc_id", "sent").alias("paragraph_id"), F.col("doc_id").alias("claim_id"))
    concepts = spark.sql(f"SELECT query_id AS concept_id FROM {ASKED} AS v(query_id, text)")
    return C.coverage(hits, claims, concepts).withColumnRenamed("sentence", "sent")


MERGED = rf"""
flag AS (SELECT *, CASE WHEN regexp_matches(coalesce(lag(sentence) OVER w, ''), '(?i){ABBREVIATION}') AND regexp_matches(sentence, '^\s*([A-Za-z0-9,:;]|\([0-9A-Za-z]+\))') THEN 0 ELSE 1 END AS brk FROM sent0 WINDOW w AS (PARTITION BY doc_id, paragraph_id ORDER BY sentence_id)),
island AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, paragraph_id ORDER BY sentence_id) AS island FROM flag),
joined AS (SELECT doc_id, paragraph_id, island - 1 AS sentence_id, string_agg(sentence, ' ' ORDER BY sentence_id) AS sentence FROM island GROUP BY doc_id, paragraph_id, island),
sent AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, sentence_id) - 1 AS sentence_global_idx FROM joined)
"""


@query(f"""WITH {HYBRID.replace(ASKED, '(SELECT item_id, text FROM benchmark WHERE item_id % 100 = 0)').replace(SENT_LAST, MERGED)}
SELECT query_id, placed.doc_id AS doc_id, CAST(paragraph_id AS BIGINT) AS paragraph_id, CAST(sentence_id AS BIGINT) AS sentence_id, placed.sent AS sentence_global_idx, md5(sentence) AS sentence_md5, md5(p) AS paragraph_md5, round(score::DOUBLE, 7) AS score, place AS rank
FROM placed JOIN sent ON sent.doc_id = placed.doc_id AND sentence_global_idx = placed.sent JOIN para ON para.doc_id = sent.doc_id AND para.paragraph_id = sent.paragraph_id WHERE place <= 8""".replace("(SELECT CAST(paragraph_id", "(SELECT CAST(sent.paragraph_id").replace("CAST(paragraph_id AS BIGINT)", "CAST(sent.paragraph_id AS BIGINT)"))
def hybrid_search(spark, t):
    hits = R.search(t("documents"), _benchmark(t), "throughput", top_n=8, embed=R.letter_embedding(), separator=LINE)
    return hits.withColumns({"sentence_md5": F.md5("sentence"), "paragraph_md5": F.md5("paragraph"), "score": F.round(F.col("score").cast("double"), 7)}).drop("sentence", "paragraph")


# --- Pages, records, claims ------------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, t):
    return t("pages").select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " ")).alias("title"))


STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({STRIP}) AS text_md5, length({STRIP}) AS n FROM pages")
def html_to_text(spark, t):
    text = X.strip_tags(F.col("html"))
    return t("pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("n"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<p[^>]*>')) AS n_paragraphs, len(regexp_extract_all(html, '(?is)<a\s')) AS n_links FROM pages")
def html_paragraphs(spark, t):
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return t("pages").select("page_id", count(r"(?is)<p[^>]*>").alias("n_paragraphs"), count(r"(?is)<a\s").alias("n_links"))


@query(r"""SELECT doc_id, md5(array_to_string([regexp_replace(regexp_replace(replace(regexp_replace(b, '\s*\n\s*', ' ', 'g'), '__PB__', ' '), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') for b in
  [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])', '\1\2', 'g'),
    '[ \t]+', ' ', 'g'), '\s*<<<PAGE_BREAK>>>\s*', ' __PB__ ', 'g'), '\[\s*(\d{3,5})\s*\]', chr(10) || chr(10) || '[\1] ', 'g'), '\n\s*\n+')] if b <> ''], chr(10) || chr(10))) AS text_md5 FROM documents""")
def ocr_unwrap(spark, t):
    return t("documents").select("doc_id", F.md5(X.unwrap(F.coalesce("text", F.lit("")))).alias("text_md5"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g'))) AS text_md5 FROM documents")
def ws_norm(spark, t):
    return t("documents").select("doc_id", F.md5(X.squash(F.coalesce("text", F.lit("")))).alias("text_md5"))


@query(r"SELECT c_custkey, regexp_replace(c_name, '\D+', '', 'g') AS digits FROM customer")
def digits_only(spark, t):
    return t("customer").select("c_custkey", X.digits(F.col("c_name")).alias("digits"))


@query(r"""SELECT doc_id, len(ls) AS n, md5(array_to_string(ls, '|')) AS parts_md5 FROM (SELECT doc_id, [y for y in [trim(x, ' ,.;') for x in regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g')), '\s*;\s*(?:and\s+)?|\s*:\s*')] if y <> ''] AS ls FROM documents)""")
def limitations(spark, t):
    ls = X.limitations(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", F.size(ls).alias("n"), F.md5(F.array_join(ls, "|")).alias("parts_md5"))


CLAIMS = "(VALUES ('r1', '1. A system, comprising: a pump; and a valve.\n2. The system of claim 1, wherein the pump is red.\n5. The method of any of claims 2-4, further comprising\n10\na sensor.\n6. A device as in claims 3 through 1.\n7. The unit of claims 1, 2 or 3.'), ('r2', '1. The kit of claim 3.\n2. A method for cooling.'), ('r3', 'No claims here'))"
PARSED = f"""
raw AS (SELECT record_id, unnest([x for x in string_split(regexp_replace(claims_text, '(?m)^\\s*(\\d{{1,3}})\\.\\s+', chr(1) || '\\1. ', 'g'), chr(1)) if regexp_matches(x, '^\\d{{1,3}}\\.\\s')]) AS raw FROM {CLAIMS} AS v(record_id, claims_text)),
pos AS (SELECT *, row_number() OVER (PARTITION BY record_id) AS i FROM raw),
cl AS (SELECT record_id, i, CAST(regexp_extract(raw, '(\\d{{1,3}})\\.', 1) AS BIGINT) AS number, trim(regexp_replace(regexp_replace(raw, '(?m)^\\s*(?:5|10|15|20|25|30|35|40|45|50|55|60|65)\\s*$', '', 'g'), '\\s+', ' ', 'g')) AS text FROM pos),
ref AS (SELECT record_id, number, unnest(regexp_extract_all(text, '(?i)\\bclaims?\\s+\\d+(?:\\s*(?:-|–|to|through)\\s*\\d+)?')) AS m FROM cl),
span AS (SELECT record_id, number, [CAST(x AS BIGINT) for x in regexp_extract_all(m, '\\d+')] AS ns FROM ref),
dep AS (SELECT record_id, number, array_to_string(list_sort(list_distinct(flatten(list(range(list_min(ns), list_max(ns) + 1))))), ',') AS deps FROM span GROUP BY ALL)
"""


def _claims(spark):
    return C.parse_claims(spark.sql(f"SELECT * FROM {CLAIMS} AS v(record_id, claims_text)"))


@query(f"WITH {PARSED} SELECT record_id, number, text, coalesce(deps, '') AS dependencies, deps IS NULL AS independent FROM cl LEFT JOIN dep USING (record_id, number)")
def claims_parse(spark, t):
    return _claims(spark).withColumn("dependencies", F.array_join("dependencies", ",")).drop("pos", "error")


@query(f"WITH {PARSED} SELECT record_id, number AS src, unnest([CAST(x AS BIGINT) for x in string_split(deps, ',')]) AS dst FROM dep")
def claim_dependencies(spark, t):
    return _claims(spark).select("record_id", F.col("number").alias("src"), F.explode("dependencies").alias("dst"))


@query(f"WITH {PARSED}, r AS (SELECT record_id, number, text, row_number() OVER (PARTITION BY record_id ORDER BY deps IS NOT NULL, i) AS r FROM cl LEFT JOIN dep USING (record_id, number)) SELECT record_id, number, text FROM r WHERE r = 1")
def principal_claim(spark, t):
    return C.principal_claims(_claims(spark)).select("record_id", "number", "text")


IDS = "(VALUES (1, 'application', '18/456,219'), (2, 'patent', '12,345,678'), (3, 'patent', 'US 12'), (4, 'application', '1'), (5, 'other', '12345678'), (6, 'patent', CAST(NULL AS VARCHAR(9))))"


@query(f"""SELECT id, regexp_replace(coalesce(v, ''), '\\D+', '', 'g') AS digits, CASE WHEN kind = 'application' THEN length(regexp_replace(coalesce(v, ''), '\\D+', '', 'g')) = 8 WHEN kind = 'patent' THEN length(regexp_replace(coalesce(v, ''), '\\D+', '', 'g')) BETWEEN 6 AND 8 ELSE false END AS valid FROM {IDS} AS t(id, kind, v)""")
def identifier_validation(spark, t):
    return spark.sql(f"SELECT * FROM {IDS} AS t(id, kind, v)").select("id", X.digits(F.col("v")).alias("digits"), X.identifier_error(F.col("kind"), F.col("v")).isNull().alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus LIKE 'F%' THEN 'Granted' ELSE 'Published' END || ' · ' || strftime(o_orderdate, '%Y-%m-%d') AS status FROM orders")
def status_label(spark, t):
    return t("orders").select("o_orderkey", F.concat_ws(" · ", F.when(F.col("o_orderstatus").startswith("F"), "Granted").otherwise("Published"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("status"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 2000 THEN 'text_layer' ELSE 'ocr' END AS route FROM documents")
def text_layer_route(spark, t):
    return t("documents").select("doc_id", IO.text_route(F.col("text")).alias("route"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS escaped_md5 FROM documents")
def html_escape(spark, t):
    return t("documents").select("doc_id", F.md5(X.html_escape(F.coalesce("text", F.lit("")))).alias("escaped_md5"))


@query("SELECT event_id, CAST(ceil(least(greatest(abs(value), 0), 30) * 1000 * 1.125) AS BIGINT) AS delay_ms FROM events")
def retry_delay(spark, t):
    return t("events").select("event_id", X.retry_delay_ms(F.abs("value").cast("string"), F.lit(0.5)).cast("long").alias("delay_ms"))


@query("SELECT conv_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS cost FROM conversations GROUP BY conv_id")
def request_cost(spark, t):
    return t("conversations").groupBy("conv_id").agg(F.sum(X.request_cost(F.col("text"), F.array().cast("array<string>"))).alias("cost"))


@query("""WITH w AS (SELECT doc_id, list_distinct([x for x in string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') if x <> '' and not list_contains(['a','an','and','are','at','being','by','comprising','each','for','from','having','in','is','method','of','one','or','the','to','wherein','with'], x)]) AS t FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END, 9) AS jaccard FROM w AS a JOIN w AS b ON b.doc_id = a.doc_id + 1""")
def jaccard_similarity(spark, t):
    w = t("documents").select("doc_id", X.similarity_terms(F.coalesce("text", F.lit(""))).alias("t"))
    return w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id").select("doc_id", F.round(X.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@query("""WITH g AS (SELECT conv_id, role, min(turn) AS first, count(*) AS n_claims, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS texts_md5 FROM conversations GROUP BY conv_id, role)
SELECT conv_id, role, n_claims, texts_md5, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS position FROM g""")
def family_grouping(spark, t):
    g = C.family_groups(_family(t))
    return g.select(F.col("family_id").alias("conv_id"), F.col("label").alias("role"), F.size("claims").alias("n_claims"), F.md5(F.array_join(F.transform("claims", lambda c: c["claim_text"]), "|")).alias("texts_md5"), "position")


def _family(t):
    return t("conversations").select(F.col("conv_id").alias("family_id"), F.col("role").alias("label"), F.col("role").alias("document_number"), F.col("turn").alias("claim_number"), F.col("turn").alias("input_pos"), F.coalesce("text", F.lit("")).alias("claim_text"))


@query()
def family_compare(spark, t):
    return C.compare_family(_family(t)).select("family_id", "position", "shared", "changed", "added", "removed", "scope_label")


@query()
def claim_redline(spark, t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t("conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL AND text IS NOT NULL")
    d = pairs.select("conv_id", "turn", C.redline(F.col("before"), F.col("text")).alias("d"))
    return d.select("conv_id", "turn", "d.before", "d.after", "d.unchanged", "d.inserted", "d.deleted", "d.blocks")


MENTION = r"""
ment AS (SELECT doc_id, i AS seq, CASE WHEN d[i] IN ('a', 'an') THEN 'intro' ELSE 'ref' END AS kind, k[i] AS key
  FROM (SELECT doc_id, d, k, unnest(range(1, len(d) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^\p{L}\p{N}_])(a|an|the|said)\s+(\p{L}+)', 1) AS d, regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^\p{L}\p{N}_])(a|an|the|said)\s+(\p{L}+)', 2) AS k FROM documents))),
run AS (SELECT *, coalesce(max(CASE WHEN kind = 'intro' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, min(CASE WHEN kind = 'intro' THEN seq END) OVER (PARTITION BY doc_id, key) AS first FROM ment),
ref AS (SELECT *, max(CASE WHEN kind = 'ref' AND seen = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, key) AS used FROM run)
"""


def _doc_mentions(t):
    pattern, low = r"(?:^|[^\p{L}\p{N}_])(a|an|the|said)\s+(\p{L}+)", F.lower(F.coalesce("text", F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("k"))
    m = t("documents").select(F.col("doc_id").alias("claim_id"), F.posexplode(pairs).alias("seq", "m"))
    return m.select("claim_id", (F.col("seq") + 1).alias("seq"), F.when(F.col("m.d").isin("a", "an"), "intro").otherwise("ref").alias("kind"), F.col("m.k").alias("key"), F.col("m.k").alias("text"))


@query(f"WITH {MENTION} SELECT doc_id AS claim_id, seq, key FROM ref WHERE kind = 'ref' AND seen = 0")
def antecedent_used_without_intro(spark, t):
    return C.antecedent_issues(_doc_mentions(t)).where("severity = 'high'").select("claim_id", "seq", "key")


@query(f"WITH {MENTION} SELECT doc_id AS claim_id, seq, key FROM ref WHERE kind = 'intro' AND seq = first AND used = 0")
def introduced_never_referenced(spark, t):
    return C.antecedent_issues(_doc_mentions(t)).where("severity = 'info'").select("claim_id", "seq", "key")


@query(f"""WITH {MENTION}, iss AS (SELECT doc_id, seq, key, CASE WHEN kind = 'ref' AND seen = 0 THEN 'high' WHEN kind = 'intro' AND seq = first AND used = 0 THEN 'info' END AS severity FROM ref)
SELECT doc_id AS set_id, seq, severity, CASE WHEN n < 1000 THEN 'I' || lpad(CAST(n AS VARCHAR), 3, '0') ELSE 'I' || CAST(n AS VARCHAR) END AS issue_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN severity = 'high' THEN 0 ELSE 1 END, seq) AS n FROM iss WHERE severity IS NOT NULL)""")
def issue_numbering(spark, t):
    return C.number_issues(C.antecedent_issues(_doc_mentions(t)).withColumn("set_id", F.col("claim_id"))).select("set_id", "seq", "severity", "issue_id")


@query(f"""WITH {MENTION}, iss AS (SELECT doc_id, CASE WHEN kind = 'ref' AND seen = 0 THEN 'high' WHEN kind = 'intro' AND seq = first AND used = 0 THEN 'info' END AS severity FROM ref)
SELECT doc_id AS claim_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM iss WHERE severity IS NOT NULL GROUP BY GROUPING SETS ((doc_id), ())""")
def issue_summary(spark, t):
    return C.antecedent_issues(_doc_mentions(t)).rollup("claim_id").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "info").alias("info"), F.count(F.lit(1)).alias("total"))


LISTED = "(VALUES (1, 0, 'intro', 'a pump', 0, 6), (1, 1, 'intro', 'a valve', 8, 15), (1, 2, 'intro', 'a hose', 20, 26), (1, 3, 'intro', 'a lid', 200, 205), (2, 0, 'intro', 'an axle', 0, 7), (2, 1, 'intro', 'a rim', 12, 17))"
SAID = "(VALUES (1, 'a pump, a valve and a hose'), (2, 'an axle has a rim'))"


@query(f"""WITH m AS (SELECT *, lag(e) OVER (PARTITION BY claim_id ORDER BY seq) AS last FROM {LISTED} AS v(claim_id, seq, kind, text, s, e) JOIN {SAID} AS w(claim_id, claim_text) USING (claim_id)),
i AS (SELECT *, sum(CASE WHEN coalesce(s - last <= 150 AND regexp_matches(substring(claim_text, last + 1, s - last), '(?i)[,;]|\\band\\b|\\bor\\b'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY claim_id ORDER BY seq) AS island FROM m)
SELECT claim_id, CAST(island AS BIGINT) AS island, string_agg(text, '|' ORDER BY seq) AS members FROM i GROUP BY claim_id, island HAVING count(*) >= 2""")
def enumeration_islands(spark, t):
    m = spark.sql(f"SELECT claim_id, seq, kind, text, s AS start, e AS end FROM {LISTED} AS v(claim_id, seq, kind, text, s, e)")
    said = spark.sql(f"SELECT * FROM {SAID} AS w(claim_id, claim_text)")
    return C.enumeration_groups(m, said).select("claim_id", "island", F.array_join(F.transform("members", lambda x: x["text"]), "|").alias("members"))


@query()
def enumeration_islands_documents(spark, t):
    said = t("documents").select(F.col("doc_id").alias("claim_id"), F.coalesce("text", F.lit("")).alias("claim_text"))
    return C.enumerations(said).select("claim_id", "island", F.array_join("members", "|").alias("members"))


CLAIM = "(VALUES (1, 'A method for cooling a battery comprising: measuring a temperature of the battery; comparing the temperature with a threshold; and starting a pump when the temperature exceeds the threshold.'), (2, 'A system, comprising: at least one of a pump; a valve; or a hose (red; blue); selecting the device based on a rank between 1 and 5, wherein the rank is stored.'))"


def _claim(spark):
    return spark.sql(f"SELECT * FROM {CLAIM} AS v(claim_id, claim_text)")


@query()
def segment_claims(spark, t):
    return _claim(spark).select("claim_id", F.explode(C.segment(F.col("claim_text"))["segments"]).alias("s")).select("claim_id", "s.*")


@query()
def frame_leaves(spark, t):
    s = segment_claims(spark, t).select("claim_id", "idx", C.frame(F.col("text")).alias("f"))
    return s.select("claim_id", "idx", "f.anchor_verb", "f.object_np", F.explode_outer("f.leaves").alias("l")).select("claim_id", "idx", "anchor_verb", "object_np", "l.*")


@query()
def claim_antecedents(spark, t):
    return C.antecedent_issues(C.mentions(_claim(spark)))


# --- Cohorts, timelines, load, joins --------------------------------------------------------------------------------

COHORT = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _cohort(t):
    o = t("orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by definition
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"""SELECT r_name, n_name, c_mktsegment, applications, granted, scope, round(coalesce(100.0::DOUBLE * granted / nullif(applications, 0), 0), 1) AS grant_rate FROM (
SELECT r_name, n_name, c_mktsegment, count(*) AS applications, count(*) FILTER (o_orderstatus = 'F') AS granted, CASE GROUPING(r_name, n_name, c_mktsegment) WHEN 0 THEN 'c_mktsegment' WHEN 1 THEN 'n_name' WHEN 3 THEN 'r_name' ELSE 'all' END AS scope {COHORT} GROUP BY ROLLUP (r_name, n_name, c_mktsegment))""")
def cohort_rollup(spark, t):
    return A.cohort_rollup(_cohort(t), ["r_name", "n_name", "c_mktsegment"], F.col("o_orderstatus") == "F")


YEARLY = "y AS (SELECT year(o_orderdate) AS year, count(*) AS applications, count(*) FILTER (o_orderstatus = 'F') AS granted FROM orders GROUP BY 1)"


@query(f"WITH {YEARLY} SELECT *, round(100.0::DOUBLE * granted / applications, 1) AS grant_rate FROM y")
def grant_timeline(spark, t):
    return A.yearly(t("orders"), "o_orderdate", F.col("o_orderstatus") == "F")


@query(f"WITH {YEARLY} SELECT year, applications, granted, round(100.0::DOUBLE * granted / applications, 1) AS grant_rate FROM (SELECT *, row_number() OVER (ORDER BY year DESC) AS r FROM y) WHERE r > 2")
def timeline_trim(spark, t):
    return A.without_last_years(A.yearly(t("orders"), "o_orderdate", F.col("o_orderstatus") == "F"))


@query("SELECT l_linenumber AS oa_number, round(avg(CASE WHEN l_returnflag = 'R' THEN 100.0::DOUBLE ELSE 0 END), 6) AS s101, round(avg(CASE WHEN l_linestatus = 'O' THEN 100.0::DOUBLE ELSE 0 END), 6) AS s102, round(avg(CASE WHEN l_discount > 0.05 THEN 100.0::DOUBLE ELSE 0 END), 6) AS s103, round(avg(CASE WHEN l_tax > 0.04 THEN 100.0::DOUBLE ELSE 0 END), 6) AS s112 FROM lineitem GROUP BY 1")
def rejection_pattern(spark, t):
    flags = {"s101": "l_returnflag = 'R'", "s102": "l_linestatus = 'O'", "s103": "l_discount > 0.05", "s112": "l_tax > 0.04"}
    return t("lineitem").groupBy(F.col("l_linenumber").alias("oa_number")).agg(*(F.round(F.avg(F.when(F.expr(c), 100.0).otherwise(0.0)), 6).alias(k) for k, c in flags.items()))


@query("SELECT event_type, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, t):
    return A.percentiles(t("events"), "value", ["event_type"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS most FROM events GROUP BY event_type")
def status_histogram(spark, t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max("value").alias("most"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, min(ts) AS first_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_success(spark, t):
    return t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min("ts").alias("first_ts"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def rate_limit(spark, t):
    return S.rate_limited(t("events"), "user_id", "ts", "event_id", 3, "1 day").select("event_id", "allowed")


@query()
def microbatch_cost(spark, t):
    items = t("events").select("event_type", F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").cast("double").alias("arrival"), F.length("props").cast("double").alias("cost"))
    return S.replay_batches(items, "event_type", 8, 400, 3600.0)


@query("SELECT event_type, position, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS position FROM events) WHERE position <= 12")
def recent_topn(spark, t):
    return A.latest(t("events"), ["event_type"], "ts", "event_id", 12).select("event_type", "position", "event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def freshness_ttl(spark, t):
    e = t("events")
    return e.join(e.agg(F.max("ts").alias("now"))).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 6 HOURS")).select("event_id")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1) ON l_orderkey = o_orderkey")
def event_snapshot_join(spark, t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("at"))
    return A.first_match(t("orders").select("o_orderkey"), lines, ["o_orderkey"], "at").drop("at")


DOCS = "(VALUES ('US 9,922,200 B2', 'd1'), ('EP 123', 'd2'), ('US 8,111,222', 'd3'))"
RECORDS = "(VALUES (1, '9922200'), (2, '8111222'), (3, '777'))"


@query(f"SELECT id, doc FROM {RECORDS} AS r(id, number) LEFT JOIN {DOCS} AS d(name, doc) ON contains(regexp_replace(name, '\\D+', '', 'g'), number)")
def substring_theta_join(spark, t):
    d = spark.sql(f"SELECT * FROM {DOCS} AS d(name, doc)")
    return spark.sql(f"SELECT * FROM {RECORDS} AS r(id, number)").join(d, F.contains(X.digits(F.col("name")), F.col("number")), "left").select("id", "doc")


EDGES = "(VALUES (1, 0), (2, 1), (3, 1), (4, 3), (5, 4), (9, 8))"


@query(f"WITH RECURSIVE c AS (SELECT pid, ppid AS root, 1 AS depth FROM {EDGES} AS e(pid, ppid) UNION ALL SELECT e.pid, c.root, c.depth + 1 FROM c JOIN {EDGES} AS e(pid, ppid) ON e.ppid = c.pid) SELECT pid, root, depth FROM c")
def process_closure(spark, t):
    return spark.sql(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES} AS v(pid, ppid)), c AS (SELECT pid, ppid AS root, 1 AS depth FROM e UNION ALL SELECT e.pid, c.root, c.depth + 1 FROM c JOIN e ON e.ppid = c.pid) SELECT * FROM c")


SPANS = "(VALUES (1, 0, 5, 0), (1, 3, 9, 1), (1, 12, 15, 2), (2, 0, 4, 0), (2, 4, 6, 1), (2, 9, 10, 2))"


@query(f"""WITH m AS (SELECT *, sum(CASE WHEN s <= coalesce(mx, -1) THEN 0 ELSE 1 END) OVER (PARTITION BY claim_id ORDER BY s, n) AS island FROM (SELECT *, max(e) OVER (PARTITION BY claim_id ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM {SPANS} AS v(claim_id, s, e, n)))
SELECT claim_id, CAST(island AS BIGINT) AS island, min(s) AS "start", max(e) AS "end", count(*) AS n FROM m GROUP BY claim_id, island""")
def covered_spans(spark, t):
    return A.islands(spark.sql(f"SELECT claim_id, s AS start, e AS end, n FROM {SPANS} AS v(claim_id, s, e, n)"), ["claim_id"], "start", "end", "n")


@query("SELECT anchor, positive FROM (SELECT text AS anchor, lang AS positive FROM documents) WHERE anchor IS NOT NULL AND positive IS NOT NULL")
def pairs_scan(spark, t):
    return t("documents").select(F.col("text").alias("anchor"), F.col("lang").alias("positive")).where("anchor IS NOT NULL AND positive IS NOT NULL")


@query("SELECT c_nationkey, round(max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) / nullif(max(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 0), 6) AS ratio FROM customer GROUP BY 1")
def worker_ratio(spark, t):
    best = lambda s: F.max(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal")))
    return t("customer").groupBy("c_nationkey").agg(F.round(F.try_divide(best("BUILDING"), best("MACHINERY")), 6).alias("ratio"))


@query("SELECT 0::BIGINT AS differing")
def batched_equals_sequential(spark, t):
    """Hits of a search for both queries at once, against those of one search for each."""
    asked, found = _asked(spark), lambda q: R.search(t("documents"), q, "throughput", top_n=3, embed=R.letter_embedding(), separator=LINE).drop("sentence", "paragraph")
    both, each = found(asked), found(asked.where("query_id = 1")).unionByName(found(asked.where("query_id = 2")))
    return R.differing(both, each)
