"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausegrid.functions.constants import ABBREVIATION_END, DEFAULT_HITS, HIGHLIGHT_STOP_WORDS, MAX_HITS, PAGE_BREAK, SIMILARITY_STOP_WORDS

SENTENCE_BREAK = "\x01"


def paragraphs(text: Column, separator: str = r"\n\s*\n+") -> Column:
    """Trimmed paragraphs, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


#: A break after an abbreviation (letters beyond ASCII belong to words) before what may go on from it.
_ABBREVIATION = ABBREVIATION_END.removesuffix(r"\s*$").replace(r"\b", r"(?<![\p{L}\p{N}_])")
_NO_BREAK = f"(?i)({_ABBREVIATION}){SENTENCE_BREAK}(?=[A-Za-z0-9,:;]|\\([0-9A-Za-z]+\\))"


def sentences(text: Column, merge: bool = False) -> Column:
    """Trimmed sentences: text up to a full stop, exclamation or question mark and white space; if merge, not after an
    abbreviation. Line breaks and runs of blanks inside are one space."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\f\x0B]+", " "), r"\s*\n\s*", " ")
    marked = F.regexp_replace(flat, r"([.!?])\s+", f"$1{SENTENCE_BREAK}")
    if merge:
        marked = F.regexp_replace(marked, _NO_BREAK, "$1 ")
    return F.filter(F.transform(F.split(marked, SENTENCE_BREAK), lambda x: F.trim(x)), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct words of three or more characters in order of appearance, stop words left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    stop = F.array(*map(F.lit, HIGHLIGHT_STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def matched_terms(passage: Column, query: Column) -> Column:
    """Terms of a query that a passage holds."""
    return F.array_intersect(query_terms(query), query_terms(passage))


def squash(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\D+", "")


def unwrap(text: Column) -> Column:
    """Lines of scanned text joined into paragraphs: hyphens at line ends undone, [0001] begins a paragraph, page breaks none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, rf"\s*{PAGE_BREAK}\s*", " __PB__ ")
    t = F.regexp_replace(t, r"\[\s*(\d{3,5})\s*\]", "\n\n[$1] ")
    blocks = F.filter(F.transform(F.split(t, r"\n\s*\n+"), _strip), lambda b: b != "")
    blocks = F.transform(blocks, lambda b: _strip(F.regexp_replace(F.replace(F.regexp_replace(b, r"\s*\n\s*", " "), F.lit("__PB__"), F.lit(" ")), r"\s{2,}", " ")))
    return F.array_join(blocks, "\n\n")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def limitations(claim: Column) -> Column:
    """Parts of a claim between semicolons (with an optional "and") and colons, without marks at their ends."""
    parts = F.split(squash(claim), r"\s*;\s*(?:and\s+)?|\s*:\s*")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" ,.;"))), lambda x: x != "")


def numbered_claim(claims_text: Column, number: Column) -> Column:
    """The claim of this number in a text of numbered lines, up to the next number; null if there is none."""
    pattern = F.concat(F.lit(r"(?s)(?:^|\n)"), number.cast("string"), F.lit(r"\.\s+(.*?)(?=\n"), (number + 1).cast("string"), F.lit(r"\.\s|\z)"))
    found = F.regexp_extract_all(claims_text, pattern, F.lit(1))
    return F.when(F.size(found) > 0, F.concat(number.cast("string"), F.lit(". "), _strip(F.get(found, F.lit(0)))))


def claim_summary(claim: Column) -> Column:
    """Preamble and at most two steps as a sentence."""
    parts = limitations(claim)
    preamble = F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"^\d+\.\s*", ""))
    actions = F.transform(F.slice(parts, 2, 2), lambda x: F.regexp_replace(x, r"(?i)^and\s+", ""))
    return F.when(F.size(parts) == 0, F.lit("No claim language was available.")).when(F.size(actions) == 0, preamble).otherwise(F.concat(preamble, F.lit(". Principal steps include "), F.array_join(actions, "; "), F.lit(".")))


def diff_tokens(text: Column) -> Column:
    """White space, words (with apostrophes) and runs of marks."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\s+|\w+(?:['’]\w+)*|[^\w\s]+"), F.lit(0))


def similarity_terms(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
    return F.array_except(F.filter(words, lambda w: w != ""), F.array(*map(F.lit, SIMILARITY_STOP_WORDS)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two term arrays; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def patent_date(text: Column) -> Column:
    """ISO date of "Jan. 2, 2020", "Jan 2, 2020" or "January 2, 2020", else the squashed text."""
    parsed = F.coalesce(*(F.try_to_date(squash(text), f) for f in ("MMM. d, yyyy", "MMM d, yyyy", "MMMM d, yyyy")))
    return F.coalesce(parsed.cast("string"), squash(text))


def identifier_error(kind: Column, value: Column) -> Column:
    """Null for an application number of 8 digits or a patent number of 6 to 8."""
    n = F.length(digits(value))
    return F.when(kind == "application", F.when(n != 8, "application number needs 8 digits")).when(kind == "patent", F.when(~n.between(6, 8), "patent number needs 6 to 8 digits")).otherwise("unknown identifier type")


def format_application(value: Column) -> Column:
    """NN/NNN,NNN of eight digits, other digits as they are, a dash for none."""
    n = digits(value)
    return F.when(F.length(n) == 8, F.regexp_replace(n, r"^(\d{2})(\d{3})(\d{3})$", "$1/$2,$3")).otherwise(F.coalesce(F.nullif(n, F.lit("")), F.lit("—")))


def format_patent(value: Column) -> Column:
    """Digits with thousands parted, a dash for none. More digits than a number holds stay as they are."""
    n = digits(value)
    return F.coalesce(F.format_number(n.try_cast("decimal(38,0)"), 0), F.nullif(n, F.lit("")), F.lit("—"))


def display_date(value: Column) -> Column:
    """January 2, 2020 for an ISO date; anything else as it is, null as empty."""
    return F.coalesce(F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "MMMM d, yyyy"), value, F.lit(""))


def highlight_passage(paragraph: Column, sentence: Column) -> Column:
    """A passage as HTML with the first exact occurrence of a sentence marked."""
    whole, part = F.coalesce(paragraph, sentence, F.lit("")), F.coalesce(sentence, F.lit(""))
    at = F.locate(part, whole) if isinstance(part, str) else F.call_function("locate", part, whole)
    behind = F.substring(whole, at + F.length(part), F.length(whole))
    marked = F.concat(html_escape(F.substring(whole, F.lit(1), at - 1)), F.lit("<mark>"), html_escape(part), F.lit("</mark>"), html_escape(behind))
    return F.when((part != "") & (at > 0), marked).otherwise(html_escape(whole))


def cache_key(record_id: Column, tool: Column, queries: Column, top_n: Column) -> Column:
    """record::tool::input; a search's input is its queries and hits asked for."""
    asked = F.to_json(F.struct(F.coalesce(queries, F.array().cast("array<string>")).alias("queries"), F.coalesce(top_n, F.lit(5)).alias("top_n")))
    return F.concat_ws("::", F.coalesce(record_id, F.lit("no-record")), tool, F.when(tool == "support", asked).otherwise("record"))


def conclusion(changed: Column, added: Column, removed: Column) -> Column:
    """What a pair of claims comes to: counts other than zero."""
    parts = F.filter(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"))) for n, word in ((changed, "modified"), (added, "added"), (removed, "removed")))), lambda x: x.isNotNull())
    blocks = F.when(changed + added + removed == 1, " limitation block").otherwise(" limitation blocks")
    return F.when(F.size(parts) == 0, "No material limitation-block change").otherwise(F.concat(F.array_join(parts, ", "), blocks))


def log_line(event: str, **fields: Column) -> Column:
    """A structured log line: JSON with sorted keys."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted({"event": F.lit(event), **fields}.items()))))


def coverage_document(limitations_: Column) -> Column:
    """Limitations of all claims as the paragraphs of one document."""
    return F.array_join(limitations_, "\n\n")


def coverage_hits(claims: Column, most: int = MAX_HITS) -> Column:
    """How many hits of a concept are asked for, by the number of claims."""
    return F.least(F.lit(most), F.greatest(F.lit(8), 4 * claims))


def hits_asked(top_n: Column) -> Column:
    return F.coalesce(top_n, F.lit(DEFAULT_HITS))


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def strip_tags(html: Column) -> Column:
    """Page text by patterns alone: scripts and styles out, tags to spaces, common references decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def retry_delay_ms(retry_after: Column, jitter: Column) -> Column:
    """Milliseconds to wait: the header's seconds (2 if it is none), at most 30, and up to a quarter more."""
    seconds = F.least(F.greatest(F.coalesce(retry_after.try_cast("double"), F.lit(2.0)), F.lit(0.0)), F.lit(30.0))
    return F.ceil(seconds * 1000 * (1 + 0.25 * jitter))


def request_cost(text: Column, queries: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) + F.aggregate(queries, F.lit(0), lambda a, q: a + F.length(q))


def clamp_percent(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def bar_percent(rate: Column, full: float = 20.0) -> Column:
    """Height of a bar as a share of `full` percent, a hundred at most."""
    return F.least(F.lit(100.0), rate / full * 100)


def line_position(at: Column, n: Column, left: float, width: float) -> Column:
    """Horizontal place of a series' value, evenly spread; the first place for a series of one."""
    return left + F.coalesce(F.try_divide(at.cast("double"), (n - 1).cast("double")), F.lit(0.0)) * width
