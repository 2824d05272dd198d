"""Benchmark decontamination by winnowing.

Texts become words (A-Z lower-cased). A window of an item is SPAN consecutive words; an item of fewer words, but not
none, is one window. Documents and items are fingerprinted alike: the least hash of GRAM-word grams in each run of
SPAN - GRAM + 1 grams. Any shared span of SPAN words holds a run whose least gram is selected on both sides, so the
join of document and item fingerprints misses none. Each joined fingerprint is a seed, extended over the windows
around it: a window hash looks up the item windows, whose words are then compared. Windows shorter than SPAN (of
short items) are looked up directly by their own length.

Items are read in blocks of at most BLOCK_BYTES; each block is sent to the executors, and all documents are read
against it. Up to one block, one pass does; beyond, each block's findings are written to the shared folder and
merged by document, so memory is bounded whatever the benchmark's size.

Defined cases: null or wordless texts have no words and no hits; wordless items and items with a null id have no
windows; repeated items count once by id; the same id with several texts has the windows of all; repeated document
rows give a row each; a row is dropped for its own text, whatever rows share its doc_id or lack one too; an empty
benchmark gives no hits; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import drop_rows, fold, materialize, text_bytes, text_slices
from clausegrid.llm.exact_dedup import sha256_bytes

SPAN = 10
GRAM = 5
BLOCK_BYTES = 16_000_000

#: Bytes outside words: 0-2F, 3A-60 and 7B-7F once A-Z are lower-cased. Bytes of 80 and over belong to words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = bytes(_LOWER[b] if _WORD[_LOWER[b]] else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1342543DE82EF95)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Hasher:
    """64-bit hashes of the words of a text by prefix sums, in array operations; powers are kept between calls."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1), _powers(1)

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each word."""
        raw = np.frombuffer(text.translate(_FOLD), np.uint8)
        if len(raw) >= len(self.up):
            n = 2 * len(raw) + 16
            self.up = _powers(n)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _inverse(int(_BASE)), np.uint64)]), dtype=np.uint64)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = raw != 32
        edges = np.diff(inside)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * self.up[: len(raw)], dtype=np.uint64)])
        return start, end, mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : i + n]
    return mix(out)


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    width = 1
    while 2 * width <= w:
        a, width = np.minimum(a[:-width], a[width:]), 2 * width
    return np.minimum(a[: len(a) - (w - width)], a[w - width :]) if w > width else a


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least gram hash of every w consecutive ones (all that tie)."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = _least(g, w)
    ends = np.zeros(w - 1, np.uint64)
    over = np.concatenate([ends, low, ends])  # the windows that cover position i are i .. i + w - 1 here
    return np.flatnonzero(~_least(~over, w) == g)


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple], span: int = SPAN, gram: int = GRAM) -> None:
        self.span, self.gram, self.run = span, gram, span - gram + 1
        self.hasher = Hasher()
        texts: dict[bytes, set] = defaultdict(set)
        for item_id, text in items:
            if item_id is not None and (w := words(text or b"")):
                texts[b" ".join(w)].add(item_id)
        prints: set[int] = set()
        #: By window length, window hash: [(words of the window, ids of the items that have it)].
        self.windows: dict[int, dict[int, list[tuple[bytes, set]]]] = defaultdict(dict)
        for text, ids in texts.items():
            w = text.split()
            _, _, h = self.hasher.words(text)
            n = min(span, len(w))
            if n == span:
                g = grams(h, gram)
                prints.update(g[winnow(g, self.run)].tolist())
            for i, x in enumerate(grams(h, n).tolist()):
                self._add(self.windows[n].setdefault(x, []), b" ".join(w[i : i + n]), ids)
        self.prints = np.sort(np.fromiter(prints, np.uint64, len(prints)))
        self.short = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.windows.items() if n < span}

    @staticmethod
    def _add(slot: list, window: bytes, ids: set) -> None:
        for words_, old in slot:
            if words_ == window:
                old |= ids
                return
        slot.append((window, set(ids)))

    def match(self, text: bytes) -> tuple[int, np.ndarray, set]:
        """(words of the text, 0/1 for each: hit, ids of the items found)."""
        start, end, h = self.hasher.words(text)
        hit, ids = np.zeros(len(h) + 1, np.int64), set()
        if len(h) >= self.span and len(self.prints):
            g = grams(h, self.gram)
            at = winnow(g, self.run)
            seeds = at[_among(g[at], self.prints)]
            if len(seeds):
                windows = grams(h, self.span)
                near = np.unique((seeds[:, None] - np.arange(self.run)[None, :]).ravel())
                near = near[(near >= 0) & (near < len(windows))]
                self._verify(self.span, text, near, windows, start, end, hit, ids)
        for n, known in self.short.items():
            if len(h) >= n:
                windows = grams(h, n)
                self._verify(n, text, np.flatnonzero(_among(windows, known)), windows, start, end, hit, ids)
        return len(h), np.cumsum(hit[:-1]) > 0, ids

    def _verify(self, n: int, text: bytes, at: np.ndarray, windows: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray, ids: set) -> None:
        known = self.windows[n]
        for i, x in zip(at.tolist(), windows[at].tolist()):
            if x in known:
                window = b" ".join(words(text[start[i] : end[i + n - 1]]))
                for words_, own in known[x]:
                    if words_ == window:
                        hit[i] += 1
                        hit[i + n] -= 1
                        ids |= own


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _ranges(flags: np.ndarray) -> list[int]:
    """Flat [start, end, start, end ...] of the runs of true."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


_SCHEMA = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("also", pa.binary()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])


def _matcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in text_slices(batches):
            found = [own.match(x) for x in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").cast(pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("also"), pa.array([n for n, _, _ in found], pa.int64()), pa.array([_ranges(f) for _, f, _ in found], pa.list_(pa.int32())), pa.array([sorted(s) for _, _, s in found], pa.list_(pa.int64()))],
                schema=_SCHEMA,
            )

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Items in lists of at most limit bytes, one item at least."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), fold(F.col(text_col)).cast("binary").alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > limit:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t) + 64
    yield block


def find_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, also: Column | None = None) -> DataFrame:
    """A row per document: doc_id, also (a binary column of docs, or null), n_words, n_hit, items (sorted ids), spans (word positions of the hits)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None).cast("binary") if also is None else also).alias("also"))
    schema = "uid long, doc_id long, also binary, n_words long, spans array<int>, items array<long>"
    size = benchmark.agg(F.sum(F.octet_length(fold(F.col(item_text_col))) + 64)).first()[0] or 0
    if size > block_bytes:
        rows = materialize(rows, "decontaminate-texts")  # uid has to be the same for each block
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        index = spark.sparkContext.broadcast(Index(block, span, gram))  # of at most block_bytes of items
        found = rows.mapInArrow(_matcher(index), schema)
        if size <= block_bytes:
            parts.append(found)
            break
        parts.append(materialize(found, "decontaminate-block"))
        index.unpersist()
    if len(parts) == 1:
        merged = parts[0]
    else:
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        # A row per document and block; only the rows with hits carry arrays.
        merged = every.groupBy("uid", "doc_id", "also", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", _merged_spans(F.col("spans")))
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("spans").cast("int"), F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.element_at(F.col("spans"), i + 1) - F.element_at(F.col("spans"), i))
    return merged.select("doc_id", "also", "n_words", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"), "items", "spans")


def _merged_spans(spans):
    """Union of the half-open ranges in a flat array."""
    pairs = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(spans)), lambda i: (i % 2 == 0) & (i < F.size(spans))), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b"))))
    zero = F.array().cast("array<int>")

    def add(acc, p):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(last, p["b"])))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) >= p["a"]), joined).otherwise(F.concat(acc, F.array(p["a"], p["b"])))

    return F.aggregate(pairs, zero, add)



def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """find_overlap with n_items, the digest of the items and the verdict."""
    found = find_overlap(docs, benchmark, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a window of an item; all columns as they came."""
    digest = sha256_bytes(fold(F.col(text_col)))
    prints = find_overlap(docs, benchmark, id_col=id_col, text_col=text_col, also=digest)
    gone = materialize(prints.where("n_hit > 0").select(F.col("doc_id").alias("id"), "also").distinct(), "decontaminate-dropped")
    return drop_rows(docs, gone, id_col, digest)


def op1_decontaminate(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    prepare(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP1_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
iwin AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
ns AS (SELECT DISTINCT n FROM sized),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM low, ns WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM dwin AS d JOIN iwin AS x ON d.n = x.n AND d.win = x.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(low.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN pos ON low.doc_id = pos.doc_id LEFT JOIN its ON low.doc_id = its.doc_id
"""
