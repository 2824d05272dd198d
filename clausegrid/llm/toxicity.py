"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that part quotation from abuse.

The lexicon is learned from labelled documents: words, and beginnings of words, that mark the toxic ones beyond
chance. It is a trie. Each word of a text gives a Levenshtein automaton (bit-parallel, one error); walking the trie
with it finds every entry within one edit, so misspelled terms are caught. Around each find a window of characters
is read: inside quotation marks, or after a word of reporting, it counts as quoted. A document's score is a logistic
function of its finds' weights, exact, misspelled and quoted ones apart, fitted on the labelled sample.

At most SAMPLE labelled documents are taken, those first by a hash of their ids, whole texts; of an id with several
texts the one that is first by a hash. Only terms that pass every test of an entry, and the sample's finds of the
lexicon, reach the driver: what the sample's texts hold bounds them, and none is cut.

Defined cases: null texts count as empty and get the score of no find; null labels aren't learned; an id labelled
twice is toxic if any row says so; a null id is held out of nothing and learned from by nobody; without toxic (or without clean) labels every score is the share of toxic ones;
repeated document rows give a row each; texts of any length are whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import bucket_of, materialize, text_slices

SAMPLE = 12_000
#: Beginnings of words that may be entries, by length; least length of a word that may be one.
STEMS = range(4, 9)
LEAST_WORD = 4
#: Least length of an entry that may be misspelled.
LEAST_FUZZY = 5
#: Least share of toxic documents among those that have an entry, and least number of them.
PURITY, LEAST_COUNT = 0.9, 3
#: Least share of the toxic documents that an entry is in.
LEAST_SHARE = 0.02
#: Characters to each side of a find that its context is read from.
WINDOW = 120
THRESHOLD = 0.3
KEPT = 400_000

#: Words, with signs inside that may stand for letters.
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")
_OPENING, _CLOSING = '"“„«‘', '"”“»’'
#: Words that announce what somebody else said.
_REPORTING = re.compile(r"\b(?:said|says|wrote|writes|called|calls|quote|quoted|quoting|word|term|insult)\W+(?:\w+\W+){0,3}$")


@dataclass
class Lexicon:
    """Entries (text, whether it is a beginning of words) as a trie, with finds kept by word."""

    entries: list[tuple[str, bool]]
    trie: dict = field(init=False, repr=False)
    kept: dict = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = {}
        for i, (text, stem) in enumerate(self.entries):
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((i, stem, len(text) >= LEAST_FUZZY))

    def __getstate__(self) -> dict:
        return {"entries": self.entries}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["entries"])

    def _keep(self, word: str, out: tuple) -> tuple:
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[word] = out
        return out

    def find(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, 0 or 1 errors) of each entry that the word is, begins with, or misses by one edit. Exact ones hide others."""
        out = self.kept.get(word)
        return self._walk(word) if out is None else out

    def _walk(self, word: str) -> tuple[tuple[int, int], ...]:
        n = len(word)
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        whole, best = 1 << n, {}
        # A state is two sets of places in the word: reached without, and with at most one error.
        stack = [(self.trie, 1, 3 & (2 * whole - 1))]
        while stack:
            node, exact, near = stack.pop()
            for c, below in node.items():
                if c == "":
                    for i, stem, fuzzy in below:
                        if exact & whole or stem and exact:
                            best[i] = 0
                        elif fuzzy and n >= LEAST_FUZZY and (near & whole or stem and near):
                            best.setdefault(i, 1)
                    continue
                at = places.get(c, 0)
                straight = (exact & at) << 1
                wrong = ((near & at) << 1 | exact | exact << 1 | straight << 1 | straight) & (2 * whole - 1)
                if wrong:
                    stack.append((below, straight, wrong))
        if 0 in best.values():
            best = {i: e for i, e in best.items() if not e}
        return self._keep(word, tuple(sorted(best.items())))

    def finds(self, text: str) -> list[tuple[int, int, bool]]:
        """(entry, errors, quoted) of each word of a text that finds one."""
        out, kept = [], self.kept
        low = text.lower()
        for m in _TOKEN.finditer(low):
            word = m[0]
            found = kept.get(word)
            if found is None:
                found = self._walk(word)
            if found:
                q = quoted(low, m.start(), m.end())
                out += [(i, e, q) for i, e in found]
        return out


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around text[start:end] says that it is somebody else's words."""
    before, behind = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    opened = max((before.rfind(c) for c in _OPENING), default=-1)
    if opened >= 0 and any(c in behind for c in _CLOSING):
        mark = before[opened]
        if mark != '"' or before.count('"') % 2:
            if not any(c in before[opened + 1 :] for c in _CLOSING):
                return True
    return bool(_REPORTING.search(before))


def terms(text: str) -> Counter:
    """Candidate entries of a text: words (once), and beginnings of longer words marked by * (as many as such words)."""
    out: Counter = Counter()
    for word in set(_TOKEN.findall(text.lower())):
        if LEAST_WORD <= len(word) <= 40 and word.isalpha():
            out[word] += 1
            out.update(word[:k] + "*" for k in STEMS if k < len(word))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    #: Weight of each entry, found exactly and misspelled.
    weights: np.ndarray
    #: Of the logistic function: exact, misspelled, quoted, constant.
    parameters: np.ndarray

    def features(self, finds: list[tuple[int, int, bool]]) -> np.ndarray:
        out = np.zeros(4)
        out[3] = 1
        for i, e, q in set(finds):
            out[2 if q else e] += self.weights[i, e]
        out[:3] = np.log1p(out[:3])
        return out

    def score(self, text: str) -> float:
        x = float(self.features(self.lexicon.finds(text)) @ self.parameters)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def least_words(toxic: int, clean: int, candidates: int) -> float:
    """So many words of toxic documents, and none of clean ones, are unlikely by chance for any of the candidates."""
    return math.log(max(10, candidates)) / -math.log(toxic / (toxic + clean))


def choose_entries(rows: list[tuple[str, int, int, int]], toxic: int, clean: int, candidates: int) -> list[tuple[str, bool]]:
    """Entries from (term, toxic documents, clean documents, different words of them in toxic documents)."""
    if not toxic or not clean:
        return []
    least = least_words(toxic, clean, candidates)
    good = {t: (p, n) for t, p, n, words in rows if p >= max(LEAST_COUNT, LEAST_SHARE * toxic) and p >= PURITY * (p + n) and words >= least + 3 * n}
    chosen = []
    for t, (p, n) in good.items():
        # A shorter beginning that is as pure and in more documents stands for this one.
        stem = t.rstrip("*")
        if not any((s := good.get(stem[:k] + "*")) and s[1] <= n and s[0] > p for k in range(STEMS.start, len(stem) + (t[-1] != "*"))):
            chosen.append((p, t))
    # Of terms with the same documents the longest is kept, which is least likely to begin other words.
    chosen.sort(key=lambda x: (-x[0], -len(x[1].rstrip("*")), x[1]))
    out: list[str] = []
    counts = dict((t, p) for p, t in chosen)
    for p, t in chosen:
        stem = t.rstrip("*")
        longer = any(o.startswith(stem) and o != t and len(o.rstrip("*")) >= len(stem) and counts[o] >= 0.98 * p for o in out)
        if not longer:
            out.append(t)
    return [(t.rstrip("*"), t[-1] == "*") for t in out]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for term, words in terms(text or "").items():
                slot = counts.setdefault(term, [0, 0, 0])
                slot[0 if toxic else 1] += 1
                slot[2] += words if toxic else 0
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([x[k] for x in counts.values()], pa.int64()) for k in range(3))], names=["term", "p", "n", "words"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn lexicon, weights and logistic function from at most `sample` labelled documents."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    # Copies would make any of their words seem telling; one row per text and label remains.
    rows = materialize(rows.groupBy("text", "toxic").agg(F.lit(1).alias("one")).select("text", "toxic"), "toxicity-sample")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    # Each task sends a term once per slice; only terms that are pure and frequent come to the driver.
    counted = materialize(rows.mapInArrow(_count_terms, "term string, p long, n long, words long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("words").alias("words")), "toxicity-terms")
    candidates = counted.where(F.col("p") + F.col("n") >= LEAST_COUNT).count()
    lexicon = Lexicon([])
    if toxic and clean:
        fit_ = (F.col("p") >= max(LEAST_COUNT, LEAST_SHARE * toxic)) & (F.col("p") >= PURITY * (F.col("p") + F.col("n"))) & (F.col("words") >= least_words(toxic, clean, candidates) + 3 * F.col("n"))
        lexicon = Lexicon(choose_entries([tuple(r) for r in counted.where(fit_).collect()], toxic, clean, candidates))

    shared = spark.sparkContext.broadcast(lexicon)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches):
            finds = [sorted(set(own.finds(x or ""))) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([[4 * i + 2 * e + q for i, e, q in f] for f in finds], pa.list_(pa.int32()))], names=["toxic", "finds"])

    found = [(r.toxic, [(f >> 2, f >> 1 & 1, bool(f & 1)) for f in r.finds]) for r in rows.mapInArrow(find, "toxic int, finds array<int>").collect()]
    return calibrate(lexicon, found)


def calibrate(lexicon: Lexicon, found: list[tuple[int, list[tuple[int, int, bool]]]]) -> Model:
    y = np.array([t for t, _ in found], float)
    toxic, clean = y.sum(), len(y) - y.sum()
    counts = np.zeros((len(lexicon.entries), 2, 2))
    for t, finds in found:
        for i, e in {(i, e) for i, e, _ in finds}:
            counts[i, e, t] += 1
    rate = (counts + 0.5) / (np.array([clean, toxic]) + 1)
    weights = np.maximum(0, np.log(rate[:, :, 1] / rate[:, :, 0])) if len(y) else np.zeros((0, 2))
    # A misspelling that was seldom seen is taken for half of what its entry tells; one often seen, for what it told.
    seen = counts[:, 1].sum(axis=1)
    if len(weights):
        weights[:, 1] = np.where(seen >= 3, weights[:, 1], weights[:, 0] / 2)
    prior = (toxic + 0.5) / (len(y) + 1)
    model = Model(lexicon, weights, np.array([0, 0, 0, math.log(prior / (1 - prior))]))
    if not toxic or not clean:
        return model
    x = np.array([model.features(f) for _, f in found])
    # Newton steps; where the labels say nothing, quoted finds weigh a third, misspelled ones as much as exact ones.
    theta, pull = np.array([2.0, 2.0, 0.7, -4.0]), np.array([0.5, 0.5, 0.5, 0.01])
    prior_theta = theta.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - y) + pull * (theta - prior_theta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-6 * np.eye(4)
        step = np.linalg.solve(hessian, gradient)
        theta -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    theta[:3] = np.maximum(theta[:3], 0)  # a find never speaks for a text
    model.parameters = theta
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_finds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # entries of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches):
            scores, n = [], []
            for text in batch.column("text").to_pylist():
                finds = own.lexicon.finds(text or "")
                x = float(own.features(finds) @ own.parameters)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                n.append(len(finds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "n_finds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_finds long").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(bucket_of(F.col("doc_id"), 4) != 2))
    return score(docs, model).withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)))
