"""Records of patents and applications from landed files: metadata, sections, documents, loading and lookup.

What can't be read has an error in its row and fails no job.
"""

from __future__ import annotations

import html as entities
import json
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions import text as X
from clausegrid.functions.constants import GRANT_PATTERNS, METADATA_KEYS
from clausegrid.operators import claims as C

SECTIONS = {"specification": "specification_text", "claims": "claims_text", "principal_claim": "principal_claim_text"}
DOCUMENT_KEYS = ["documents", "documentBag", "document_bag", "results", "items"]


def _missing(value) -> bool:
    return value is None or value == "" or value == []


def find_first(value, keys: Sequence[str]):
    """The first value under any of the keys, depth first: an object's own keys, in order of preference, before what lies below."""
    if isinstance(value, dict):
        own = [value.get(k) for k in keys]
        below = value.values()
    elif isinstance(value, list):
        own, below = [], value
    else:
        return None
    for found in own:
        if not _missing(found):
            return found
    for x in below:
        if not _missing(found := find_first(x, keys)):
            return found
    return None


def _parsed(text: str | None):
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


def application_metadata(payload: Column) -> Column:
    """Struct of application_number, patent_number (digits), title, status, filing_date of a JSON payload; empty if missing or unreadable."""

    @F.pandas_udf(", ".join(f"{k} string" for k in METADATA_KEYS))
    def read(payloads: pd.Series) -> pd.DataFrame:
        rows = [[str(find_first(p, keys) or "").strip() for keys in METADATA_KEYS.values()] for p in map(_parsed, payloads)]
        out = pd.DataFrame(rows, columns=list(METADATA_KEYS))
        for c in ("application_number", "patent_number"):
            out[c] = out[c].str.replace(r"\D+", "", regex=True)
        return out

    return read(payload)


def grant_metadata(text: Column) -> Column:
    """Struct of a grant's front page: numbers as digits, ISO dates, title, status, claim count."""

    def first(name):
        found = [F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), F.lit("")) for p in GRANT_PATTERNS[name]]
        return F.coalesce(*found, F.lit(""))

    issued, title = X.patent_date(first("issue_date")), X.squash(first("title"))
    shown = F.when((F.upper(title) == title) & title.rlike(r"\p{L}"), F.initcap(title)).otherwise(title)
    return F.struct(
        X.digits(first("application_number")).alias("application_number"), X.digits(first("patent_number")).alias("patent_number"), shown.alias("title"),
        F.when(issued != "", F.concat(F.lit("Granted · "), issued)).otherwise("Granted").alias("status"), X.patent_date(first("filing_date")).alias("filing_date"), issued.alias("grant_date"),
        first("claim_count").try_cast("int").alias("claim_count"),
    )


def resolve_application(requests: DataFrame) -> DataFrame:
    """requests (application_number, patent_number, payload) with resolved (digits) and error."""
    given, found = X.digits(F.col("application_number")), application_metadata(F.col("payload"))["application_number"]
    has = F.coalesce(F.col("application_number"), F.lit("")) != ""
    number = F.when(has, given).otherwise(found)
    error = (
        F.when(~has & (F.coalesce(F.col("patent_number"), F.lit("")) == ""), "invalid_request: patent or application number needed")
        .when(number == "", "patent_data_unavailable: no application number in the response").when(F.length(number) < 8, "patent_data_unavailable: application number looks wrong")
    )
    return requests.withColumns({"error": error, "resolved": F.when(error.isNull(), number)})


def documents_of(payload: Column) -> Column:
    """Array of the documents that a JSON listing holds at any depth: code, official_date, identifier, raw."""

    @F.pandas_udf("array<struct<code:string,official_date:string,identifier:string,raw:string>>")
    def read(payloads: pd.Series) -> pd.Series:
        def rows(p):
            found = find_first(p, DOCUMENT_KEYS[:3]) or find_first(p, DOCUMENT_KEYS[3:]) or []
            return [{"code": str(d.get("documentCode") or ""), "official_date": str(d.get("officialDate") or ""), "identifier": str(d.get("documentIdentifier") or ""), "raw": json.dumps(d)} for d in found if isinstance(d, dict)] if isinstance(found, list) else []

        return payloads.map(lambda x: rows(_parsed(x)))

    return read(payload)


class _Sections(HTMLParser):
    """Text of the first paragraph with any text behind each h3 heading, among the heading's siblings."""

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, str] = {}
        self.heading: list[str] | None = None
        self.name: str | None = None
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "h3":
            self._end()
            self.heading = []
        elif tag == "p" and self.name is not None:
            self._end(go_on=True)
            self.text = [] if self.name is not None else None
        elif tag == "br" and self.text is not None:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag == "h3" and self.heading is not None:
            self.name, self.heading = "".join(self.heading).strip(), None
        elif tag == "p":
            self._end(go_on=True)

    def handle_data(self, data):
        for part in (self.heading, self.text):
            if part is not None:
                part.append(data)

    def _end(self, go_on: bool = False) -> None:
        if self.text is not None and "".join(self.text).strip() and self.name is not None:
            self.found.setdefault(self.name, "".join(self.text))
            self.name = None
        self.text = None
        if not go_on:
            self.name = None


def sections(html: str | None) -> dict[str, str]:
    p = _Sections()
    p.feed(html or "")
    p.close()
    p._end()
    return p.found


def section_by_heading(html: Column, heading: str, separator: str = "\n\n") -> Column:
    """A section's lines, squashed, empty ones dropped; null if the heading or its paragraph is missing."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        def one(page):
            text = sections(page).get(heading)
            return None if text is None else separator.join(y for y in (" ".join(x.split()) for x in text.splitlines()) if y)

        return pages.map(one)

    return read(html)


def four_sections(pages: DataFrame) -> DataFrame:
    """path, abstract, background, description, claims of landed pages, and an error that names what is missing."""
    names = {"abstract": "Abstract", "background": "Background/Summary", "description": "Description", "claims": "Claims"}
    rows = pages.select("path", *(section_by_heading(F.col("html"), h, "\n" if k == "claims" else "\n\n").alias(k) for k, h in names.items()))
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(k).isNull(), k) for k in names)), lambda x: x.isNotNull()), ", ")
    return rows.withColumn("error", F.when(missing != "", F.concat(F.lit("missing: "), missing)))


def unescape(text: Column) -> Column:
    """All character references decoded."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else entities.unescape(x))

    return read(text)


def description_text(pages: DataFrame, least: int = 5000) -> DataFrame:
    """pages (html) with description, and an error where the section is missing or shorter than `least` characters."""
    raw = F.regexp_extract("html", r'(?s)<section[^>]+itemprop="description"[^>]*>(.*?)</section>', 1)
    rows = pages.withColumns({"description": X.squash(unescape(F.regexp_replace(raw, r"<[^>]+>", " "))), "there": F.col("html").rlike(r'(?s)<section[^>]+itemprop="description"[^>]*>.*?</section>')})
    error = F.when(~F.coalesce("there", F.lit(False)), "description not found").when(F.length("description") < least, "description too short")
    return rows.withColumn("error", error).drop("there")


def load_records(pages: DataFrame, applications: DataFrame | None = None) -> DataFrame:
    """Records from parsed pages (patent_number, application_number, title, specification_text, claims: array) and from
    applications (application_number, patent_number, title, specification: the whole text): one row per record_id, pages first.
    """
    shown = pages.where("error IS NULL").select(
        F.concat(F.lit("grant:"), "patent_number").alias("record_id"), F.lit("public page").alias("source"), "patent_number", "application_number", "title", "specification_text", F.array_join("claims", "\n\n").alias("claims_text")
    )
    if applications is not None:
        split = C.split_specification(applications.withColumn("text", F.col("specification")))
        shown = shown.unionByName(split.select(F.concat(F.lit("application:"), "application_number").alias("record_id"), F.lit("application").alias("source"), "patent_number", "application_number", "title", "specification_text", "claims_text"))
    once = shown.withColumn("r", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("source"), "specification_text"))).where("r = 1").drop("r")
    parsed = C.parse_claims(once)
    numbers = parsed.groupBy("record_id").agg(F.count(F.lit(1)).alias("claim_count"), F.array_sort(F.collect_list(F.when(F.col("independent"), F.struct("pos", "number")))).alias("i"))
    principal = C.principal_claims(parsed).select("record_id", F.col("text").alias("principal_claim_text"))
    out = once.join(numbers, "record_id", "left").join(principal, "record_id", "left")
    return out.withColumns({"claim_count": F.coalesce("claim_count", F.lit(0)), "principal_claim_text": F.coalesce("principal_claim_text", F.lit("")), "independent_claim_numbers": F.transform("i", lambda x: x["number"])}).drop("i")


def public_record(records: DataFrame) -> DataFrame:
    """Records without their big texts, which are given by their length."""
    counts = {"specification_character_count": F.length(F.coalesce("specification_text", F.lit(""))), "claims_character_count": F.length(F.coalesce("claims_text", F.lit("")))}
    return records.withColumns(counts).drop("specification_text", "claims_text")


def lookup(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, identifier_type, identifier) with the record that has that very number, or an error."""
    asked = requests.withColumns({"digits": X.digits(F.col("identifier")), "invalid": X.identifier_error(F.col("identifier_type"), F.col("identifier"))})
    keys = F.array(*(F.struct(F.lit(k).alias("identifier_type"), F.col(c).alias("digits")) for k, c in (("patent", "patent_number"), ("application", "application_number"))))
    own = public_record(records).withColumn("k", F.explode(keys)).where("k.digits != ''").withColumns({"identifier_type": F.col("k.identifier_type"), "digits": F.col("k.digits")}).drop("k")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("identifier_type", "digits").orderBy("record_id"))).where("r = 1").drop("r")
    found = asked.join(first, (asked.identifier_type == first.identifier_type) & (asked.digits == first.digits) & asked.invalid.isNull(), "left").drop(first.identifier_type, first.digits)
    error = F.when(F.col("invalid").isNotNull(), F.concat(F.lit("invalid_request: "), "invalid")).when(F.col("record_id").isNull(), "patent_data_unavailable")
    return found.withColumn("error", error).drop("invalid", "digits")


def record_sections(records: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, text, error of requests (request_id, record_id, section): unknown sections and records, and empty texts, are errors."""
    rows = requests.join(records.select("record_id", F.lit(True).alias("there"), *SECTIONS.values()), "record_id", "left")
    text = F.coalesce(*(F.when(F.col("section") == s, F.col(c)) for s, c in SECTIONS.items()), F.lit(""))
    error = F.when(~F.coalesce(F.col("section").isin(list(SECTIONS)), F.lit(False)), "invalid_request: unknown section").when(F.col("there").isNull() | (text == ""), "invalid_request: record unavailable")
    return rows.select("request_id", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def requests_of_pairs(pairs: DataFrame, n_requests: int, n_paragraphs: int, seed: int = 20260718) -> DataFrame:
    """Search requests from a fixed sample of anchor/positive pairs: one text of n_paragraphs positives, an anchor each as the query."""
    order = F.row_number().over(Window.orderBy("h", "anchor", "positive"))
    most = max(n_requests, n_paragraphs)
    sample = pairs.where("anchor IS NOT NULL AND positive IS NOT NULL").withColumn("h", F.xxhash64("anchor", "positive", F.lit(seed))).orderBy("h", "anchor", "positive").limit(most)
    numbered = sample.withColumn("i", order)  # of at most `most` rows
    text = numbered.where(F.col("i") <= n_paragraphs).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "positive"))), lambda x: x["positive"]), "\n\n").alias("patent_text"))
    asked = numbered.where(F.col("i") <= n_requests).select(F.concat(F.lit("load-"), (F.col("i") - 1).cast("string")).alias("request_id"), F.array("anchor").alias("queries"), F.lit(5).alias("top_n"))
    return asked.crossJoin(F.broadcast(text))  # one row
