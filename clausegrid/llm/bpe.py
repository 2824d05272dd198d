"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into pieces by the vocabulary's pattern. The distinct pieces of a batch lie end to end as one row of
byte tokens. An inverted index holds, for each merge (by rank), the positions whose pair it joins. Merges are applied
in rank order at all positions at once; each application touches only the two neighbours, whose new pairs enter the
index. A new pair of lower rank than the merge under way goes first, as in a piece taken alone. A piece that is a
token as it stands is that token. Encoded pieces are kept for later batches, up to KEPT pieces of a worker.

Defined cases: null text counts as empty; an empty text has no ids and decodes to an empty text; ids of no token
raise; texts of any length are whole (their pieces are encoded in slices of bounded size); repeated rows give a row
each; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import text_slices
from clausegrid.llm.unicode_pieces import finder

#: Encoded pieces that a worker keeps.
KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encoder for one set of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = KEPT) -> None:
        self.ranks, self.limit = ranks, limit
        self.tokens = {r: t for t, r in ranks.items()}
        self.cutter = finder(pattern)
        #: Ranks of the merges of two tokens: by the left one and then the right one, and the other way round.
        self.rightward: dict[int, dict[int, int]] = {r: {} for r in ranks.values()}
        self.leftward: dict[int, dict[int, int]] = {r: {} for r in ranks.values()}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    self.rightward[a][b] = self.leftward[b][a] = r
        self.of_byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        self.of_bytes = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int64)
        #: Ids of each piece, in decimal and joined by spaces; the bytes that such ids stand for.
        self.kept: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def _first_index(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Rank -> ascending positions of the pairs of bytes that it joins."""
        ranks = self.of_bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        ranks[ends[:-1] - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[at], prepend=-1))
        return {r: places.tolist() for r, places in zip(ranks[at[cuts]].tolist(), np.split(at, cuts[1:]))} if len(at) else {}

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece (none empty), by one replay over all of them."""
        if not pieces:
            return []
        rightward, leftward = self.rightward, self.leftward
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        row = self.of_byte[raw].tolist()
        after, before = list(range(1, len(row) + 1)), list(range(-1, len(row) - 1))
        for end in ends.tolist():
            after[end - 1] = -1
            if end < len(row):
                before[end] = -1
        index = self._first_index(raw, ends)
        due = list(index)
        heapq.heapify(due)
        while due:
            rank = heapq.heappop(due)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            to_right, to_left = rightward[rank].get, leftward[rank].get
            for k, p in enumerate(places):
                q = after[p]
                if q < 0 or rightward[row[p]].get(row[q]) != rank:
                    continue  # an earlier merge took one of the two
                row[p], row[q] = rank, -1
                after[p] = right = after[q]
                after[q] = -1
                lowest = rank
                if right >= 0:
                    before[right] = p
                    r = to_right(row[right])
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(due, r)
                        if r < lowest:
                            lowest = r
                left = before[p]
                if left >= 0:
                    r = to_left(row[left])
                    if r is not None:
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            heapq.heappush(due, r)
                        if r < lowest:
                            lowest = r
                if lowest < rank and k + 1 < len(places):
                    index[rank] = places[k + 1 :]
                    heapq.heappush(due, rank)
                    break
        out, start = [], 0
        for end in ends.tolist():
            out.append([i for i in row[start:end] if i >= 0])
            start = end
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, str]:
        """Make sure that the kept pieces have all of these; they are returned."""
        asked = set(pieces)
        fresh = [x for x in asked if x not in self.kept]
        if len(self.kept) + len(fresh) > self.limit:
            self.kept, self.decoded = {}, {}
            fresh = asked
        todo = []
        for x in fresh:
            raw = x.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.kept[x] = str(r)
            else:
                todo.append((x, raw))
        for (x, _), ids in zip(todo, self.replay([raw for _, raw in todo])):
            self.kept[x] = " ".join(map(str, ids))
        return self.kept

    def encode_parts(self, texts: list[str]) -> list[list[str]]:
        """For each text the ids of its pieces, those of a piece in decimal and joined by spaces."""
        cut = [self.cutter(x).findall(x) for x in texts]
        kept = self.learn(chain.from_iterable(cut))
        return [[kept[p] for p in x] for x in cut]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for part in x for i in part.split(" ")] for x in self.encode_parts(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_parts(self, parts: list[str]) -> bytes:
        """Bytes of ids as encode_parts gives them; what a part stands for is looked up once."""
        decoded = self.decoded
        for part in parts:
            if part not in decoded:
                decoded[part] = self.decode(map(int, part.split(" ")))
        return b"".join(map(decoded.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, kept: int = KEPT) -> MergeReplay:
    """The worker's own encoder for a vocabulary file, which every node has at the same path."""
    return MergeReplay(read_ranks(path), pattern, kept)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.encode_batch(_texts(batch)), pa.list_(pa.int32()))], schema=_ENCODED)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) of doc_id, ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, in one pass.

    kept bounds the encoded pieces that a worker keeps: it trades memory for time and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, kept)
        sha = hashlib.sha256
        for batch in text_slices(batches):
            encoded = own.encode_parts(_texts(batch))
            ids = [" ".join(x).encode() for x in encoded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.count(b" ") + 1 if x else 0 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(own.decode_parts(x)).hexdigest() for x in encoded], pa.string())],
                schema=_DIGESTS,
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    from clausegrid.llm.common import prepare, table

    return round_trip_digests(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
