"""Claims: extraction, dependencies, antecedent basis, segmentation, redlines, families and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clausegrid.functions import sequence
from clausegrid.functions import text as X
from clausegrid.functions.constants import CLAIM_HEADING, CLAIM_START, DEPENDENCY, FIRST_CLAIM, MARGIN_NUMBER, PAGE_BREAK, RUNNING_HEADER

#: A range of dependencies over more numbers isn't expanded: claims have numbers of three digits at most.
MAX_SPAN = 999
#: Rows that a Python worker hands on at a time, and characters of the texts that it makes them of.
MADE_ROWS, MADE_CHARS = 20_000, 2_000_000


def _wrapped(function: Callable, field: str) -> Callable:
    return lambda *x: {field: function(*x)}


def _struct_udf(function: Callable, schema: str) -> Callable[..., Column]:
    """A Python function of one or two columns to a struct, Arrow-batched."""

    def apply(*columns: Column) -> Column:
        kind = T.StructType.fromDDL(schema)  # needs a session, so not before it is used
        names = kind.names

        def one(a: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function("" if x is None else x) for x in a], columns=names)

        def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function(x, y) for x, y in zip(a, b)], columns=names)

        return F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)

    return apply


redline = _struct_udf(sequence.redline, "segments array<struct<operation:string,text:string>>, before int, after int, unchanged int, inserted int, deleted int, blocks int")
align = _struct_udf(_wrapped(lambda a, b: sequence.align(list(a), list(b)), "items"), "items array<struct<kind:string,left_index:int,right_index:int,similarity:double,changed:boolean>>")
segment = _struct_udf(_wrapped(sequence.segments, "segments"), "segments array<struct<idx:int,start:int,end:int,text:string,starter:string,kind:string>>")
frame = _struct_udf(sequence.action_frame, "anchor_verb string, object_np string, core_text string, or_alternatives array<string>, leaves array<struct<label:string,start:int,end:int,text:string>>, main_requirement string")
graph = _struct_udf(sequence.graph, "nodes array<struct<id:string,segment:int,kind:string,label:string>>, edges array<struct<source:string,target:string>>")
list_items = _struct_udf(lambda x: sequence.enumeration(x) or {"head": None, "items": None}, "head string, items array<string>")


def split_specification(docs: DataFrame) -> DataFrame:
    """specification and claims text: at a claims heading, else at the first line numbered 1, else no claims."""
    at = F.regexp_instr("text", F.lit(CLAIM_HEADING))
    first = F.regexp_instr("text", F.lit(FIRST_CLAIM))
    marker = F.regexp_extract("text", CLAIM_HEADING, 0)
    spec = F.when(at > 0, F.substring(F.col("text"), F.lit(1), at - 1)).when(first > 0, F.substring(F.col("text"), F.lit(1), first - 1)).otherwise(F.col("text"))
    claims = F.when(at > 0, F.substring(F.col("text"), at + F.length(marker), F.length("text"))).when(first > 0, F.substring(F.col("text"), first, F.length("text"))).otherwise("")
    return docs.withColumns({"specification_text": F.trim(spec), "claims_text": F.trim(claims)})


def parse_claims(records: DataFrame) -> DataFrame:
    """record_id, pos, number, text, dependencies, independent of each numbered claim of claims_text."""
    t = F.replace(F.col("claims_text"), F.lit(PAGE_BREAK), F.lit("\n\n"))
    parts = F.filter(F.split(t, CLAIM_START.replace("(?m)", "(?m)(?=") + ")"), lambda x: x.rlike(r"^\s*\d{1,3}\.\s"))
    rows = records.select("record_id", F.posexplode(parts).alias("pos", "raw"))
    clean = X.squash(F.regexp_replace(F.regexp_replace("raw", RUNNING_HEADER, ""), MARGIN_NUMBER, ""))
    rows = rows.select("record_id", "pos", F.regexp_extract("raw", r"(\d{1,3})\.", 1).cast("int").alias("number"), clean.alias("text"))
    rows = rows.withColumns({"dependencies": dependencies(F.col("text")), "error": dependency_error(F.col("text"))})
    return rows.withColumn("independent", ~F.col("text").rlike(DEPENDENCY))


def _spans(text: Column) -> Column:
    """(least, greatest) of each number or range after "claim(s)"; null for numbers that no integer holds."""
    numbers = lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.transform(F.regexp_extract_all(text, F.lit(DEPENDENCY), F.lit(0)), lambda m: F.when(F.exists(numbers(m), lambda x: x.isNull()), None).otherwise(F.struct(F.array_min(numbers(m)).alias("a"), F.array_max(numbers(m)).alias("b"))))


def dependencies(text: Column) -> Column:
    """Sorted numbers that "claim n" and "claims n-m" name; one number or range after each. What has an error isn't expanded."""
    fit = F.filter(_spans(text), lambda s: s.isNotNull() & (s["b"] - s["a"] <= MAX_SPAN))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fit, lambda s: F.sequence(s["a"], s["b"])))))


def dependency_error(text: Column) -> Column:
    """Null, or that a claim names a number or a range that no set of claims has."""
    return F.when(F.exists(_spans(text), lambda s: s.isNull() | (s["b"] - s["a"] > MAX_SPAN)), "dependency out of range")


def principal_claims(claims: DataFrame) -> DataFrame:
    """The first independent claim of each record, else its first."""
    w = Window.partitionBy("record_id").orderBy(F.col("independent").desc(), "pos")
    return claims.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _made(claims: DataFrame, function: Callable, ddl: str) -> DataFrame:
    """A row for each tuple that `function` makes of claim_text (null: empty), beside the claim's other columns.

    A worker hands its rows on in bounded batches, so it never holds what it makes of all its texts.
    """
    others = [c for c in claims.columns if c != "claim_text"]
    made = T.StructType.fromDDL(ddl)
    types = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts, at, rows, chars = batch.select(others), batch.column("claim_text"), [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(at, pa.int64())).columns, *(pa.array(v, t) for v, t in zip(zip(*rows), types))], names=[*others, *made.names])

            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                chars += len(text)
                for x in function(text):
                    at.append(i)
                    rows.append(x)
                    if len(at) >= MADE_ROWS:
                        yield out()
                        at, rows = [], []
                if at and chars >= MADE_CHARS:
                    yield out()
                    at, rows, chars = [], [], 0
            if at:
                yield out()

    return claims.select(*others, "claim_text").mapInArrow(run, T.StructType([*(claims.schema[c] for c in others), *made]))


def mentions(claims: DataFrame) -> DataFrame:
    """claim_id, seq, kind, text, key, start, end of the claims' noun phrases (columns claim_id, claim_text)."""
    return _made(claims.select("claim_id", "claim_text"), lambda text: ((i, *m) for i, m in enumerate(sequence.each_mention(text))), "seq int, kind string, text string, key string, start int, end int")


def antecedent_issues(mentions: DataFrame) -> DataFrame:
    """Definite phrases without an earlier introduction (high), introductions never referred to (info)."""
    before = Window.partitionBy("claim_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    key = Window.partitionBy("claim_id", "key")
    m = mentions.withColumns({
        "introduced": F.coalesce(F.max(F.col("kind").isin("intro", "bare")).over(before), F.lit(False)),
        "first_intro": F.min(F.when(F.col("kind") == "intro", F.col("seq"))).over(key),
    })
    m = m.withColumn("referenced", F.max((F.col("kind") == "ref") & F.col("introduced")).over(key))
    high = (F.col("kind") == "ref") & ~F.col("introduced")
    info = (F.col("kind") == "intro") & (F.col("seq") == F.col("first_intro")) & ~F.col("referenced")
    severity = F.when(high, "high").when(info, "info")
    found = m.withColumn("severity", severity).where("severity is not null")
    return found.select("claim_id", "seq", "severity", _code().alias("code"), "text", "key", _confidence().alias("confidence"))


def _code() -> Column:
    return F.when(F.col("severity") == "high", "missing_antecedent").otherwise("introduced_not_reused")


def _confidence() -> Column:
    return F.when(F.col("severity") == "high", 0.82).otherwise(0.68)


def number_issues(issues: DataFrame) -> DataFrame:
    """issue_id I001 ... within each claim set (column set_id), by claim, high before info, in order."""
    w = Window.partitionBy("set_id").orderBy("claim_id", F.when(F.col("severity") == "high", 0).otherwise(1), "seq")
    return issues.withColumn("issue_id", F.format_string("I%03d", F.row_number().over(w)))


def antecedent(claims: DataFrame) -> DataFrame:
    """Numbered issues with title, message and confidence of claim sets (set_id, claim_id, claim_number, label, document_number, claim_text).

    A claim's issues follow from its own row, so only they are shuffled, for their numbers.
    """
    found = _made(claims, sequence.issues, "seq int, severity string, text string, key string")
    found = found.select("claim_id", "seq", "severity", _code().alias("code"), "text", "key", _confidence().alias("confidence"), *(c for c in claims.columns if c not in ("claim_id", "claim_text")))
    high = F.col("severity") == "high"
    quoted = F.concat(F.lit("'"), "text", F.lit("'"))
    message = F.when(high, F.concat(quoted, F.lit(" does not have a clear earlier introduction in claim "), F.col("claim_number").cast("string"), F.lit("."))).otherwise(
        F.concat(quoted, F.lit(" is introduced once in claim "), F.col("claim_number").cast("string"), F.lit(" and is not referred to again."))
    )
    title = F.when(high, "Missing earlier introduction").otherwise("Introduced but not later referenced")
    return number_issues(found).withColumns({"title": title, "message": message, "confidence_label": F.lit("Medium")})


def issue_summary(issues: DataFrame, claims: DataFrame) -> DataFrame:
    """high, info, total of each claim, and of each set (claim_id null) with its number of claims; claims without issues have zeros."""
    counted = claims.select("set_id", "claim_id").join(issues.select("claim_id", "severity"), "claim_id", "left")
    out = counted.groupingSets([["set_id", "claim_id"], ["set_id"]], "set_id", "claim_id").agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "info").alias("info"), F.count("severity").alias("total"), F.countDistinct("claim_id").alias("claim_count"),
        F.grouping("claim_id").alias("overall"),
    )
    return out.withColumn("overall", F.col("overall") == 1)


def flagged_claims(summary: DataFrame) -> DataFrame:
    """Claims with a high issue; position orders a set's by falling number."""
    w = Window.partitionBy("set_id").orderBy(F.desc("high"), "claim_id")
    return summary.where("not overall and high > 0").withColumn("position", F.row_number().over(w)).select("set_id", "claim_id", "high", "position")


def highlight_marks(mentions: DataFrame, issues: DataFrame) -> DataFrame:
    """Marks of a claim's mentions with their labels; of those that overlap the first and longest stays, by a fold within the claim's row."""
    used = Window.partitionBy("claim_id", "key")
    m = mentions.join(issues.select("claim_id", "seq", "severity"), ["claim_id", "seq"], "left")
    introduced = F.min(F.when(F.col("kind") != "ref", F.col("seq"))).over(used)
    m = m.withColumn("referenced", F.coalesce(F.max((F.col("kind") == "ref") & F.col("severity").isNull()).over(used), F.lit(False)) & introduced.isNotNull())
    label = F.when(F.col("kind") == "ref", F.when(F.col("severity") == "high", "REF w/o INTRO").otherwise("REF ok")).otherwise(F.when(F.col("severity").isNull() & F.col("referenced"), "INTRO used").otherwise("INTRO never ref"))
    sorted_ = m.withColumn("label", label).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg_end"), "label", "text"))).alias("m"))
    zero = F.struct(F.lit(-1).alias("reached"), F.array().cast("array<struct<start:int,neg_end:int,label:string,text:string>>").alias("kept"))
    fold = F.aggregate("m", zero, lambda a, x: F.when(x["start"] >= a["reached"], F.struct((-x["neg_end"]).alias("reached"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))
    return sorted_.select("claim_id", F.posexplode(fold["kept"]).alias("mark", "x")).select("claim_id", "mark", "x.start", (-F.col("x.neg_end")).alias("end"), "x.label", "x.text")


def marks(claims: DataFrame) -> DataFrame:
    """claim_id, mark, start, end, label, text of highlight_marks, from each claim's own row: nothing is shuffled."""
    return _made(claims.select("claim_id", "claim_text"), sequence.marks, "mark int, start int, end int, label string, text string")


def claim_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: claim_id, id, segment, kind, label; edges: claim_id, source, target) of claims."""
    rows = claims.select("claim_id", graph(F.col("claim_text")).alias("g"))
    return rows.select("claim_id", F.explode("g.nodes").alias("n")).select("claim_id", "n.*"), rows.select("claim_id", F.explode("g.edges").alias("e")).select("claim_id", "e.*")


def enumeration_groups(mentions: DataFrame, texts: DataFrame, gap: int = 150) -> DataFrame:
    """Runs of two or more introductions with a connector and at most `gap` characters between: claim_id, island, members."""
    w = Window.partitionBy("claim_id").orderBy("seq")
    m = mentions.where("kind = 'intro'").join(texts, "claim_id").withColumn("last", F.lag("end").over(w))
    between = F.substring(F.col("claim_text"), F.col("last") + 1, F.col("start") - F.col("last"))
    follows = (F.col("start") - F.col("last") <= gap) & between.rlike(r"(?i)[,;]|\band\b|\bor\b")
    islands = m.withColumn("island", F.sum(F.when(follows, 0).otherwise(1)).over(w))
    return islands.groupBy("claim_id", "island").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("members")).where("size(members) >= 2")


def enumerations(claims: DataFrame) -> DataFrame:
    """claim_id, island, members (texts) of enumeration_groups, from each claim's own row: neither mentions nor texts are shuffled."""
    return _made(claims.select("claim_id", "claim_text"), sequence.enumerations, "island long, members array<string>")


def family_groups(claims: DataFrame) -> DataFrame:
    """Documents of a family (family_id) in order of first appearance: position, label, document_number, claims by number."""
    g = claims.groupBy("family_id", "label", "document_number").agg(F.min("input_pos").alias("first"), F.array_sort(F.collect_list(F.struct("claim_number", "input_pos", "claim_text"))).alias("claims"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("family_id").orderBy("first"))).drop("first")


def compare_family(claims: DataFrame) -> DataFrame:
    """The first two documents of each family, claim by claim: items (shared, removed, added), counts, scope label."""
    g = family_groups(claims)
    side = lambda n: g.where(F.col("position") == n).select("family_id", F.posexplode("claims").alias("position", "c"))
    a = side(1).select("family_id", "position", F.col("c.claim_text").alias("left_text"))
    b = side(2).select("family_id", "position", F.col("c.claim_text").alias("right_text"))
    rows = a.join(b, ["family_id", "position"], "full")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"left": F.coalesce(X.limitations(F.col("left_text")), none), "right": F.coalesce(X.limitations(F.col("right_text")), none)})
    rows = rows.withColumn("items", align(F.col("left"), F.col("right"))["items"])
    of = lambda test: F.size(F.filter("items", test))
    rows = rows.withColumns({
        "shared": of(lambda x: (x["kind"] == "shared") & ~x["changed"]),
        "changed": of(lambda x: (x["kind"] == "shared") & x["changed"]),
        "added": of(lambda x: x["kind"] == "added"),
        "removed": of(lambda x: x["kind"] == "removed"),
    })
    return rows.withColumn("scope_label", scope_label())


def overall_summary(compared: DataFrame, claims: DataFrame) -> DataFrame:
    """A row per family: claims, documents, comparison rows and limitation blocks that are shared, changed, added, removed."""
    counts = compared.groupBy("family_id").agg(F.count(F.lit(1)).alias("comparison_rows"), *(F.sum(c).alias(f"{c}_limitations") for c in ("shared", "changed", "added", "removed")))
    size = claims.groupBy("family_id").agg(F.count(F.lit(1)).alias("claim_count"), F.countDistinct("label", "document_number").alias("document_count"))
    return size.join(counts, "family_id", "left")


def difference_summary() -> Column:
    """A sentence on a pair of compare_family's rows."""
    return F.format_string("%s. %d limitation block(s) changed, %d added, and %d removed.", "scope_label", "changed", "added", "removed")


def all_items(compared: DataFrame) -> DataFrame:
    """Long form of all shared, added and removed limitations of all pairs of a family, in order: kind, side (0 or 1), text."""
    i = F.explode("items").alias("i")
    rows = compared.select("family_id", "position", "left", "right", i)
    side = F.when(F.col("i.kind") == "added", 1).when(F.col("i.kind") == "removed", 0)
    text = F.when(F.col("i.kind") == "added", F.get("right", F.col("i.right_index"))).otherwise(F.get("left", F.col("i.left_index")))
    return rows.select("family_id", "position", "i.kind", side.alias("side"), "i.left_index", "i.right_index", "i.similarity", "i.changed", text.alias("text"))


def scope_label() -> Column:
    added, removed, changed = F.col("added") > 0, F.col("removed") > 0, F.col("changed") > 0
    return (
        F.when(F.col("left_text").isNull(), "Later-family claim only").when(F.col("right_text").isNull(), "Parent-family claim only").when(added & ~removed, "Adds limitation blocks")
        .when(removed & ~added, "Removes limitation blocks").when(added | removed | changed, "Reframes claim scope").otherwise("Substantially aligned")
    )


def changed_redlines(compared: DataFrame) -> DataFrame:
    """Redlines of changed pairs only: other pairs never reach Python."""
    pairs = compared.select("family_id", "position", "left", "right", F.explode("items").alias("i")).where("i.changed")
    return pairs.select("family_id", "position", redline(F.col("left")[F.col("i.left_index")], F.col("right")[F.col("i.right_index")]).alias("diff")).select("family_id", "position", "diff.*")


def coverage(hits: DataFrame, paragraph_claims: DataFrame, concepts: DataFrame) -> DataFrame:
    """Best hit of each concept and claim, and each concept's closest match; concepts without a hit stay.

    hits: concept_id, hit_pos, paragraph_id, sentence, score; paragraph_claims: paragraph_id, claim_id.
    """
    joined = hits.join(paragraph_claims, "paragraph_id")
    best = joined.withColumn("r", F.row_number().over(Window.partitionBy("concept_id", "claim_id").orderBy(F.desc("score"), "hit_pos"))).where("r = 1")
    best = best.select("concept_id", "claim_id", F.round("score", 4).alias("score"), "sentence")
    rank = F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("score"), "claim_id"))
    return concepts.join(best.withColumn("match_rank", rank), "concept_id", "left")
