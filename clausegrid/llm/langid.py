"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy, with a calibrated rejection.

A text (A-Z lower-cased, other ASCII made blank) has the byte n-grams of NGRAMS lengths, hashed into
BUCKETS rows of an embedding table. Their mean goes through a linear layer and a softmax. Training takes at most
SAMPLE labelled documents, those first by a hash of their ids, whole texts; the driver gets their bucket counts, not
the texts. A fifth of them is held back to calibrate: a temperature, and the least score below which a text is
rejected, set so that REJECTED of the correctly labelled held-back texts would go. As the table and the layer are linear, they are
folded into one row of scores per bucket, so prediction is a sum over a text's n-grams.

Defined cases: null texts and texts without a letter are `und` with score 0 and are rejected; null labels are not
learned; with one label all get it, with none all are `und`; repeated rows give a row each; long texts are whole (summed in parts); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import bucket_of, release, text_bytes, text_slices

NGRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 14
DIMENSIONS = 16
#: Most labelled documents that training takes.
SAMPLE = 4000
#: Share of right held-back texts that the threshold may reject, and the threshold's own bound.
REJECTED, HIGHEST = 0.0005, 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: A-Z to lower case; controls, blanks and ASCII other than letters to a blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_PART = 1 << 20


def _parts(text: bytes) -> Iterator[np.ndarray]:
    """The folded text in parts that overlap by the longest n-gram less one."""
    for start in range(0, max(1, len(text)), _PART):
        raw = _FOLD[np.frombuffer(text[start : start + _PART + max(NGRAMS) - 1], np.uint8)]
        yield raw


def buckets(raw: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each n-gram of `length` bytes."""
    n = max(0, len(raw) - length + 1)
    h = np.full(n, length, np.uint32)
    for i in range(length):
        h = h * np.uint32(16777619) ^ raw[i : i + n]
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64) & (BUCKETS - 1)


def _firsts(raw: np.ndarray, length: int, more: bool) -> np.ndarray:
    """Buckets of the n-grams that begin in this part: all, or without those that begin in the next part's text."""
    b = buckets(raw, length)
    return b[:_PART] if more else b


def counts(text: bytes) -> np.ndarray:
    """How many n-grams of a text fall in each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for i, raw in enumerate(_parts(text)):
        whole = raw
        more = len(text) > (i + 1) * _PART
        for n in NGRAMS:
            out += np.bincount(_firsts(whole, n, more), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS x languages: embedding times layer; the layer's bias.
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for i, raw in enumerate(_parts(text)):
            more = len(text) > (i + 1) * _PART
            for length in NGRAMS:
                b = _firsts(raw, length, more)
                total += np.array([self.columns[k][b].sum(dtype=np.float64) for k in range(len(self.languages))])
                n += len(b)
        return softmax((total / max(1, n) + self.bias)[None, :] / self.temperature)[0]

    def __post_init__(self) -> None:
        self.columns = np.ascontiguousarray(self.scores.T, np.float32)

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """(language, its probability, rejected)."""
        if not self.languages or not _LETTER.search(text.decode()):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], rate: float = 0.5, seed: int = 7) -> Model:
    """SGD over (bucket numbers, shares) of each text. Every fifth text is held back to calibrate."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    held = [i for i in range(len(y)) if i % 5 == 4]
    learned = np.array([i for i in range(len(y)) if i % 5 != 4])
    epochs = min(60, max(8, 30_000 // max(1, len(learned))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(learned), max(1, len(learned) // 32)):
            shares = np.zeros((len(batch), BUCKETS), np.float32)
            for row, i in enumerate(batch):
                shares[row, features[i][0]] = features[i][1]
            mean = shares @ table
            error = softmax(mean @ layer + bias).astype(np.float32)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ layer.T
            layer -= step * 4 / len(batch) * (mean.T @ error)
            bias -= step * error.mean(axis=0)
            table -= step * 40 / len(batch) * (shares.T @ back)
    model = Model(languages, table @ layer, bias)
    if held:
        logits = np.array([(model.scores[features[i][0]] * features[i][1][:, None]).sum(axis=0) + bias for i in held])
        grid = np.geomspace(0.05, 20, 80)
        losses = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            model.threshold = float(min(HIGHEST, np.quantile(p.max(axis=1)[right], REJECTED)))
    return model


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = [counts(x) for x in text_bytes(batch)]
        at = [np.flatnonzero(c).astype(np.int16) for c in found]  # BUCKETS are less than 2^15
        shares = [(c[i] / max(1, c.sum())).astype(np.float32) for c, i in zip(found, at)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), pa.array(at, pa.list_(pa.int16())), pa.array(shares, pa.list_(pa.float32()))], names=["label", "order", "at", "share"])


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Train on at most `sample` documents that have a label and a letter."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(label_col).cast("string").alias("label"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The order by hash and id makes the sample the same on every run; the driver gets counts of at most `sample` ids' texts.
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample)
    # Of an id with several texts the first by a hash is taken.
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("label", F.xxhash64("h", "text").alias("order"), "text"), F.xxhash64("text", "label")).alias("r"))
    sampled = one.select("r.*")
    taken = sampled.mapInArrow(_sparse, "label string, order long, at array<short>, share array<float>").toArrow().combine_chunks()
    labels = taken.column("label").to_pylist()
    order = sorted(range(len(labels)), key=lambda i, o=taken.column("order").to_pylist(): (o[i], labels[i]))[:sample]
    features = []
    for i in order:
        features.append((taken.column("at")[i].values.to_numpy(), taken.column("share")[i].values.to_numpy()))
    model = train(features, [labels[i] for i in order], seed=seed)
    del taken, features
    release()  # the driver lives on through the stages that follow
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches):
            found = [own.predict(x) for x in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_unknown(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rejected ones, all columns as they came: the predictor runs over the texts alone, and its verdict joins back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts):
        import pandas as pd

        return pd.Series([shared.value.predict((x or "").encode())[2] for x in texts])

    return docs.where(~rejected(F.col(text_col)))


def held_out(key: Column) -> Column:
    """The fold that isn't learned from; a null id isn't in it."""
    return F.coalesce(bucket_of(key, 3) == 1, F.lit(False))


def op6_language_id(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    docs = table(prepare(spark), sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
