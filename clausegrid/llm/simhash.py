"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has 64 bits: 8 bytes, each at its position. Two fingerprints that differ in at most 4 bits differ in at
most 4 bytes, so they share at least 4 positional bytes: that is the guaranteed minimum number of matches. Postings of
single bytes would pair a 32nd of all fingerprints with each other. The index therefore keeps the postings of each
set of positional bytes whose intersection is asked for: a pair's tally reaches 4 if and only if the pair meets in a
posting list of 4 positions (70 sets, 32-bit keys). Pairs met there are verified on all 64 bits.

Lists hold distinct fingerprints and are never expanded into all pairs. What is sought is the classes, so each list
yields a spanning forest of its links: at most one link less than members. Before that, fingerprints that share 6
positional bytes (28 sets; a list there has at most 65,536 members, as 16 bits are left) are joined into classes.
In the second round, lists whose members are all of one class already are passed over. The rows of lists longer than
CHUNK pass through the task unheld; those that have several classes are dealt as pairs of chunks, so that no task
holds a whole list.

Classes are found by alternating star contraction, each round a table in the shared folder.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; texts of fewer than 4 words
are one shingle; repeated rows give a row each; a null doc_id is never smallest and its class may have a null
component_id; the row to keep of a class is the least by doc_id and the text's digest, so rows that share a doc_id, or
have none, stay or go each by its own text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import discard, drop_rows, fold, materialize, one_of_repeated, text_bytes, text_slices
from clausegrid.llm.exact_dedup import sha256_bytes

SHINGLE = 4
SEED = 42
MAX_BITS = 4
POSITIONS = 8
#: Members of a posting list that one task compares at a time; lists of 6 positions are bounded by 65,536 as they are.
CHUNK = 8192


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `size` words, joined by one space; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    h = shingle_hashes(text, size, seed)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        prints = np.array([fingerprint(x) for x in text_bytes(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        prints = np.array([fingerprint(x) for x in text_bytes(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64)), batch.column("digest")], names=["doc_id", "fp", "digest"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def postings(prints: DataFrame, shared: int) -> DataFrame:
    """The inverted index: key (number of the set of positions, and the bytes there), fp, root."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)) if p else F.col("fp").bitwiseAND(F.lit(0xFF)) for p in range(POSITIONS)]
    keys = []
    for at, chosen in enumerate(combinations(range(POSITIONS), shared)):
        key = F.lit(at << 8 * shared)
        for i, p in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(byte[p], 8 * i) if i else byte[p])
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp", "root")


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs within max_bits) that connect what all such links connect. Each member is compared with those not yet reached."""
    left = fps
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links_of(keys: np.ndarray, fps: np.ndarray, roots: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of whole lists, one after the other by key; lists of one class are passed over."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(cuts[1:], len(keys))
    mixed = np.minimum.reduceat(roots, cuts) != np.maximum.reduceat(roots, cuts)
    pairs = cuts[mixed & (ends - cuts == 2)]
    near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= max_bits]
    longer = mixed & (ends - cuts > 2)
    return [(fps[near], fps[near + 1]), *(_forest(fps[i:j], max_bits) for i, j in zip(cuts[longer].tolist(), ends[longer].tolist()))]


def _walk(max_bits: int, limit: int):
    """Over partitions sorted by key: links (a, b) of lists up to limit; the members of longer ones as they are (key, a = fp, b = root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, passing = none, None

        def links(rows) -> pa.RecordBatch:
            found = _links_of(*rows, max_bits)
            sides = [np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in found)]).view(np.int64) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.nulls(len(sides[0]), pa.int64()), pa.array(sides[0]), pa.array(sides[1])], names=["key", "a", "b"])

        def members(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].view(np.int64)), pa.array(rows[2])], names=["key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            root = batch.column("root")
            root = np.where(root.is_null().to_numpy(zero_copy_only=False), fp, root.fill_null(0).to_numpy(zero_copy_only=False))
            rows = batch.column("key").to_numpy(zero_copy_only=False), fp.view(np.uint64), root
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
            if passing is not None:
                n = int(np.searchsorted(rows[0], passing, side="right"))
                yield members([x[:n] for x in rows])
                rows = tuple(x[n:] for x in rows)
                passing = passing if not len(rows[0]) else None
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last list may go on
            # Lists that end in this batch.
            done, held = tuple(x[:cut] for x in rows), tuple(x[cut:] for x in rows)
            yield links(done)
            if len(held[0]) > limit:
                passing = held[0][0]
                yield members(held)
                held = none
        yield links(held)

    return run


def list_links(index: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Links (a, b) that connect the members of each posting list, given what classes (root) connect already."""
    found = materialize(_sorted(index, "key").mapInArrow(_walk(max_bits, limit), "key long, a long, b long"), "simhash-links")
    links = found.where("key IS NULL").select("a", "b")
    long = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("b").alias("root"))
    lists = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2")
    lists = materialize(lists.select("key", "n"), "simhash-long-lists")
    if lists.isEmpty():
        return links
    # Chunks i <= j of a list meet in part (i, j).
    rows = long.join(lists, "key").withColumn("m", F.ceil(F.col("n") * 2 / limit).cast("int")).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: (F.least(F.col("i"), j) * F.col("m") + F.greatest(F.col("i"), j)).cast("long"))
    dealt = rows.select("key", "fp", "root", F.explode(parts).alias("part")).select(F.xxhash64("key", "part").alias("key"), "fp", "root")
    more = _sorted(dealt, "key").mapInArrow(_walk(max_bits, 1 << 62), "key long, a long, b long")
    return links.unionByName(more.select("a", "b"))


def _spread(prints: DataFrame) -> DataFrame:
    """In as many partitions as a shuffle has, small as the rows are: each becomes a row per set of positions."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _sorted(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def classes(links: DataFrame) -> DataFrame:
    """node, root (the least node it is linked to through any chain), for the nodes of links other than roots."""
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-stars")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.unionByName(least.where("m != a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "simhash-stars")
        discard(before)


def near_classes(prints: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """fp, root for fingerprints (distinct, column fp) that are linked to a lesser one."""
    if max_bits > MAX_BITS:
        raise ValueError(f"at most {MAX_BITS} bits: beyond, 4 shared bytes aren't guaranteed")
    # What two bytes can tell apart: a list of 6 positions never is longer.
    close = list_links(postings(_spread(prints).withColumn("root", F.lit(None).cast("long")), POSITIONS - 2), max_bits, 1 << 16)
    roots = classes(close)
    roots = materialize(roots, "simhash-roots")
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "root")
    far = list_links(postings(_spread(rooted), POSITIONS - MAX_BITS), max_bits, chunk)
    # The links of the first round are stars by now; those of the second join them.
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return classes(stars.unionByName(far)).select(F.col("node").alias("fp"), "root")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """A row per document: doc_id, fp, component_id (the smallest doc_id of its class)."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    of = _least_of_class(rows, F.col("doc_id"), max_bits, chunk)
    return rows.join(of, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def _least_of_class(rows: DataFrame, key: Column, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """fp, least (the least key of the rows of its class)."""
    prints = materialize(rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    roots = materialize(near_classes(prints.select("fp"), max_bits, chunk), "simhash-roots")
    rooted = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    return rooted.join(smallest, "root").select("fp", F.col("smallest").alias("least"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class (the smallest doc_id, of these the least digest), all columns as they came."""
    digest = sha256_bytes(fold(F.col(text_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest"))
    rows = materialize(rows.mapInArrow(_keyed_fingerprints, "doc_id long, fp long, digest binary"), "simhash-prints")
    of = _least_of_class(rows, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    found = rows.join(of, "fp").select(F.col("doc_id").alias("id"), F.col("digest").alias("also"), kept.alias("kept"))
    times = materialize(found.groupBy("id", "also", "kept").agg(F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), "simhash-dropped")
    out = drop_rows(docs, times.where("not kept"), id_col, digest)
    return one_of_repeated(out, times.where("kept"), id_col, digest)


def op7_simhash_dedup(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    groups = near_groups(table(prepare(spark), sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
