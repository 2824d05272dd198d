"""Reading and writing: Parquet pairs, profile JSON, JSON inside a script, landed pages and documents; sinks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions import text as X


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """anchor, positive, neither null; projection and filter go down to the scan."""
    return spark.read.parquet(path).where("anchor IS NOT NULL AND positive IS NOT NULL").select("anchor", "positive")


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same on every run and whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def read_script_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON assigned to a variable in a script file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.from_json(F.regexp_extract("value", r"(?s)=\s*(\{.*\})\s*;?\s*$", 1), schema).alias("record")).select("record.*")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_landed_documents(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """path, content of landed files, and text if a function from bytes to text is given (a failing file gives '')."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if extract is None:
        return files

    @F.pandas_udf("string")
    def texts(content: pd.Series) -> pd.Series:
        def safe(x):
            try:
                return extract(x)
            except Exception:
                return ""

        return content.map(safe)

    return files.withColumn("text", texts("content"))


def text_route(text: Column, least: int = 2000) -> Column:
    """Whether a document's own text layer is enough."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= least, "text_layer").otherwise("ocr")


def section_text(records: DataFrame, record_id: str, section: str) -> DataFrame:
    """One section of a record: specification, claims or principal_claim."""
    columns = {"specification": "specification_text", "claims": "claims_text", "principal_claim": "principal_claim_text"}
    return records.where(F.col("record_id") == record_id).select(F.col(columns[section]).alias("text"))


class _PageFields(HTMLParser):
    """Values by itemprop, claims by element id, and paragraphs of the description, of a patent page."""

    def __init__(self) -> None:
        super().__init__()
        self.fields: dict[str, list[str]] = {}
        self.claims: list[str] = []
        self.paragraphs: list[tuple[str, str]] = []
        self.open: list[tuple[str, str | None, bool, bool]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        prop = a.get("itemprop")
        if prop:
            self.fields.setdefault(prop, []).append(a.get("datetime") or a.get("content") or a.get("href") or "")
        classes = (a.get("class") or "").split()
        claim = tag == "div" and "claim" in classes and (a.get("id") or "").startswith("CLM-")
        paragraph = "description-paragraph" in classes
        if claim:
            self.claims.append("")
        if paragraph:
            self.paragraphs.append(("".join(c for c in a.get("num") or "" if c.isdigit()), ""))
        if tag not in ("meta", "link", "br", "img", "hr", "input"):
            self.open.append((tag, prop, claim, paragraph))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, prop, claim, paragraph in self.open:
            if prop and not self.fields[prop][-1].strip():
                self.fields[prop][-1] = data
            if claim:
                self.claims[-1] += f" {data}"
            if paragraph:
                self.paragraphs[-1] = self.paragraphs[-1][0], f"{self.paragraphs[-1][1]} {data}"


def parse_page(html: str) -> dict:
    p = _PageFields()
    p.feed(html or "")
    first = lambda k: " ".join((p.fields.get(k) or [""])[0].split())
    claims = [" ".join(c.split()) for c in p.claims if c.strip()]
    paragraphs = [f"[{n.zfill(4)}] {t}" if n else t for n, t in ((n, " ".join(t.split())) for n, t in p.paragraphs) if t]
    kind, abstract = first("kindCode"), first("abstract") or first("content")
    patent = "".join(c for c in first("numberWithoutCodes") or first("publicationNumber") if c.isdigit())
    application = "".join(c for c in first("applicationNumber") if c.isdigit())
    numbered = [c for c in claims if re.match(r"\d{1,3}\.\s", c)]
    error = (
        "record identifiers missing" if not patent or not application else "description missing" if not paragraphs else "claims missing" if not claims
        else "claims not in sequence" if len(numbered) != len(claims) else None
    )
    status = "Granted" if kind.startswith("B") else "Published"
    if first("publicationDate"):
        status = f"{status} · {first('publicationDate')}"
    parts = [f"Abstract\n\n{abstract}"] if abstract else []
    return {
        "publication_number": first("publicationNumber"), "patent_number": patent, "application_number": application, "title": first("title"), "abstract": abstract, "kind": kind,
        "filing_date": first("filingDate"), "publication_date": first("publicationDate"), "grant_date": first("publicationDate") if kind.startswith("B") else "", "status": status,
        "specification_text": "\n\n".join([*parts, "Detailed description\n\n" + "\n\n".join(paragraphs)]), "pdf_url": first("pdfLink"),
        "inventors": [y for y in (" ".join(x.split()) for x in p.fields.get("inventor", [])) if y], "assignee": first("assigneeCurrent"), "claims": claims, "error": error,
    }


_PAGE = (
    "publication_number string, patent_number string, application_number string, title string, abstract string, kind string, filing_date string, publication_date string, grant_date string, status string,"
    " specification_text string, pdf_url string, inventors array<string>, assignee string, claims array<string>, error string"
)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Records of landed patent pages; what can't be read has an error, and fails no job."""

    @F.pandas_udf(_PAGE)
    def parse(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x) for x in html], columns=[f.split()[0] for f in _PAGE.split(", ")])

    return pages.select("path", parse("html").alias("r")).select("path", "r.*")


def find_key(json: Column, *keys: str) -> Column:
    """First non-empty value of any of the keys at any depth of a JSON text, the keys in order of preference."""
    found = [F.nullif(F.regexp_extract(json, rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")) for k in keys]
    return F.coalesce(*found, F.lit(""))


def specification_document(bags: DataFrame, latest: bool = False) -> DataFrame:
    """The earliest (or latest) SPEC document of each application, the first in order where dates tie."""
    pick = F.max_by if latest else F.min_by
    order = F.struct("official_date", (-F.col("pos")) if latest else F.col("pos"))
    return bags.where(F.upper("code") == "SPEC").groupBy("application").agg(pick("document", order).alias("document"))


def download_url(options: Column) -> Column:
    """URL of the first PDF option, else of the first option that has one."""
    has = F.filter(options, lambda o: o["url"].isNotNull())
    return F.coalesce(F.get(F.filter(has, lambda o: F.upper(o["mime"]) == "PDF"), F.lit(0))["url"], F.get(has, F.lit(0))["url"])


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON. Reports are aggregates of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def response(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("response"))


def write_keyed(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A keyed store as a table, partitioned for overwrites by partition."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
