"""LM scoring by a hidden Markov language model.

Tokens are a text's words and one end. A word of at least HEAD of all training tokens is a symbol of its own (at most
1 / HEAD words are); any other word is the symbol of its class, by its last bytes, and within the class has its share
of the class's training tokens (add one; the unseen words of a class share one more). STATES latent states emit the
symbols. Baum-Welch starts from the corpus's symbol shares, spread by a seed, and each round is a pass over all
training texts, every token of them: each task adds up its expected counts and the cluster sums them by symbol; the
driver gets one row per symbol. There are ROUNDS of them, fewer only where one gains nothing (GAIN) in the mean log10
likelihood of a training token. The texts are encoded once, and every round and the scoring read the symbols.

Recursions run over many sequences at once, a token of each in a step. A text of more than WINDOW tokens is cut in
windows that run side by side: the product of a window's transition and emission matrices takes what is known before
it to what is known after it, so one walk over a text's windows gives each the exact state before and behind it. Counts
and likelihoods are those of the whole text, and memory is bounded by BLOCK tokens beside the symbols of HELD or of one text.
A task's recursions write to the same arrays again.

Words that have no symbol aren't sent to the tasks: a text's such words are joined with the vocabulary's counts by
word, and summed by text; AQE splits the rows of a word that many texts have. What is broadcast is bounded by 1 / HEAD
words.

Defined cases: null text counts as empty, with the end as its only token; without training texts every base score is
that of N = V = 0 and the model has one class and one state's share each; repeated rows give a row each, and count
each in training; a null id is in no fold and trains; of equal texts every one has the same scores, and words that tie
in count are told apart by their bytes; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import bucket_of, materialize, release, text_slices

END = b""
HEAD = 2e-6
CLASSES = 1024
STATES = 8
#: Rounds of Baum-Welch; the gain in log10 likelihood of a token below which they end before.
ROUNDS, GAIN = 13, 0.0
#: Chance at the start that a state goes on, and how far the start's emissions are spread around the shares.
STAY, SPREAD = 0.99, 0.5
WINDOW = 2048
#: Values that a recursion hasn't scaled yet may shrink to ten to the minus DIGITS; single precision holds 37.
DIGITS = 24
#: Tokens' worth of the corpus's own symbol shares that each state's emissions are smoothed with.
SMOOTHING = 20.0
SLICE = 6_000_000
#: Tokens that a recursion works on at a time, and tokens (4 bytes each) from which those of like length are taken.
BLOCK, HELD = 800_000, 4_000_000
#: Training tokens of a task at least: it hands on up to a row per symbol, which should be less than what it reads.
TASK = 8_000_000
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Words' counts of single slices that a task keeps before it adds them up.
KEPT = 800_000


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, and the end."""
    return [*text.lower().split(), END]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts as `tokens` has them, without ends; where each text's begin, and where the last one's end)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().cast(pa.binary())
    bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
    # Blanks at either end of a text leave an empty word.
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[bounds]


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def word_classes(words: pa.Array) -> np.ndarray:
    """word_class of each."""
    last = pc.binary_slice(words, -3, 1 << 30).dictionary_encode()
    return np.fromiter(map(word_class, last.dictionary.to_pylist()), np.int64, len(last.dictionary)).take(last.indices.to_numpy())


@dataclass
class Model:
    #: Words with a symbol of their own, which is their place here, and log10(c + 1) of each; classes follow.
    head: list[bytes]
    head_log: np.ndarray
    #: log10 of a class's training tokens, distinct words and one.
    class_log: np.ndarray
    #: Training tokens, distinct ones.
    n: int
    v: int
    start: np.ndarray
    move: np.ndarray
    #: Symbols x states.
    emit: np.ndarray
    symbols: dict = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.symbols = {w: i for i, w in enumerate(self.head)}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(symbols, the words that have none of their own)."""
        found = np.fromiter(map(self.symbols.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(found < 0)
        rare = [words[i] for i in at.tolist()]
        found[at] = [len(self.head) + word_class(w) for w in rare]
        return found, rare

    def forward(self, texts: list[np.ndarray], window: int = WINDOW, room: _Room | None = None) -> np.ndarray:
        """log10 of the likelihood of each sequence of symbols. None is empty."""
        return _cut(self, texts, window, room=room)[0]


class _Room:
    """Arrays of a task that are used again: touching new memory takes longer than what is done with it."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def empty(self, name: str, shape: tuple[int, ...], kind) -> np.ndarray:
        """An array of any content, which the next one of its name overwrites."""
        n = math.prod(shape)
        a = self.held.get(name)
        if a is None or len(a) < n or a.dtype != kind:
            a = self.held[name] = np.empty(n, kind)
        return a[:n].reshape(shape)


def _steps(sequences: list[np.ndarray], room: _Room, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """(order of the sequences, longest first; all symbols, those of each step together; where each step begins; the
    sum of the symbols' log10 scales of each sequence, in that order). The symbols are in the room."""
    lengths = np.array([len(x) for x in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    n, starts = int(lengths.sum()), np.cumsum(lengths) - lengths
    flat = np.concatenate([sequences[i] for i in order], out=room.empty("flat", (n,), np.intp))
    logs = np.add.reduceat(scale.take(flat, out=room.empty("logs", (n,), scale.dtype), mode="clip"), starts)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    cuts = np.concatenate([[0], np.cumsum(alive)]).tolist()
    symbols = room.empty("symbols", (n,), np.intp)
    for i, j in zip(cuts, cuts[1:]):
        flat.take(starts[: j - i], out=symbols[i:j], mode="clip")
        starts += 1
    return order, symbols, cuts, logs


def _batches(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of the sequences, the longest first, in runs of at most BLOCK tokens (or one sequence).

    Sequences of like length share their steps.
    """
    lengths = np.array([len(x) for x in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield order[at:end]
        at = end


def _relative(model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """(emissions of each symbol relative to its greatest one, log10 of that, steps from one scaling to the next).

    With these emissions a step leaves at least the least odds of an emission or of a move, whichever is more.
    """
    most = model.emit.max(axis=1)
    seen = model.emit / most[:, None]
    least = max(float(seen.min()), float(model.move.min()), 1e-30)
    return seen, np.log10(most, dtype=np.float64), int(min(8, max(1, DIGITS / max(1e-9, -math.log10(least)))))


class _Scale:
    """log10 of products of scales by sequence; the logarithm is taken of several at once."""

    def __init__(self, n: int) -> None:
        self.logs, self.product, self.held = np.zeros(n), np.ones(n), 0

    def add(self, s: np.ndarray) -> None:
        self.product[: len(s)] *= s
        self.held += 1
        # A scale is at least 1e-30 a step of at most 8, or one step's.
        if self.held == 6:
            self.close()

    def close(self) -> np.ndarray:
        self.logs += np.log10(self.product)
        self.product[:] = 1.0
        self.held = 0
        return self.logs


def _forward(model: Model, relative: tuple[np.ndarray, np.ndarray, int], sequences: list[np.ndarray], priors: np.ndarray, room: _Room):
    """Scaled forward recursion from what is known before each sequence (a row of priors).

    (log10 likelihoods, order, symbols, cuts, emissions, forward values, rows of the last tokens). Values are scaled
    to a sum of one after as many steps as `relative` allows, and the emissions there with them. Symbols, emissions and
    forward values are in the room.
    """
    order, symbols, cuts, logs = _steps(sequences, room, relative[1])
    k = len(model.start)
    seen = relative[0].take(symbols, axis=0, out=room.empty("seen", (len(symbols), k), relative[0].dtype), mode="clip")
    forward, ones = room.empty("forward", seen.shape, seen.dtype), np.ones((k, k), seen.dtype)
    sums, a = np.empty((len(sequences), k), seen.dtype), None
    scale, every = _Scale(len(sequences)), relative[2]
    for t, (i, j) in enumerate(zip(cuts, cuts[1:])):
        now, e = forward[i:j], seen[i:j]
        if a is None:
            np.multiply(priors[order], e, out=now)
        else:
            np.matmul(a[: j - i], model.move, out=now)
            now *= e
        if t % every == 0:
            s = np.matmul(now, ones, out=sums[: j - i])
            now /= s
            e /= s
            scale.add(s[:, 0])
        a = now
    lengths = np.array([len(sequences[i]) for i in order])
    last = np.array(cuts)[lengths - 1] + np.arange(len(order))
    total = np.empty(len(order))
    total[order] = scale.close() + np.log10(forward[last].sum(axis=1, dtype=np.float64)) + logs
    return total, order, symbols, cuts, seen, forward, last


def _through(move: np.ndarray, relative: tuple[np.ndarray, np.ndarray, int], sequences: list[np.ndarray], first: np.ndarray, room: _Room) -> tuple[np.ndarray, np.ndarray]:
    """(what each sequence makes of the rows of `first`, states at its first token; log10 of the scale)."""
    r, k = first.shape
    out, logs = np.empty((len(sequences), r, k)), np.zeros(len(sequences))
    ones = np.ones(k, relative[0].dtype)
    for part in _batches(sequences):
        own = [sequences[i] for i in part]
        order, symbols, cuts, own_logs = _steps(own, room, relative[1])
        scale = _Scale(len(part))
        # Row, sequence, state: a step's emissions go along the sequences.
        a, spare = room.empty("a", (r, len(part), k), ones.dtype), room.empty("spare", (r, len(part), k), ones.dtype)
        for t, (i, j) in enumerate(zip(cuts, cuts[1:])):
            n, e = j - i, relative[0].take(symbols[i:j], axis=0)
            if t == 0:
                np.multiply(first[:, None, :], e, out=a)
                continue
            now = np.matmul(a[:, :n], move, out=spare[:, :n])
            now = np.multiply(now, e, out=a[:, :n])
            if t % relative[2] == 0:
                s = now.sum(axis=0) @ ones
                now /= s[:, None]
                scale.add(s)
        out[part[order]], logs[part[order]] = a.transpose(1, 0, 2), scale.close() + own_logs
    return out, logs


def _cut(model: Model, texts: list[np.ndarray], window: int, counts: bool = False, room: _Room | None = None):
    """(log10 likelihood of each text; or, if counts are asked for, that of the long texts alone, the sequences of at
    most `window` tokens, short texts first, how many these are, the chances of the states before each and weights of
    the states after it, which of them begin a text, and the expected moves from one sequence to the next)."""
    k = len(model.start)
    total, relative, room = np.zeros(len(texts)), _relative(model), room or _Room()
    short = [i for i, x in enumerate(texts) if len(x) <= window]
    long = [i for i, x in enumerate(texts) if len(x) > window]
    sequences = [texts[i] for i in short]
    priors, exits = [np.tile(model.start, (len(short), 1))], [np.ones((len(short), k), model.emit.dtype)]
    begins, moves = [True] * len(short), np.zeros((k, k))
    if not counts:
        for part in _batches(sequences):
            own = [sequences[i] for i in part]
            total[np.array(short)[part]] = _forward(model, relative, own, np.tile(model.start, (len(own), 1)), room)[0]
    parts = [[texts[i][at : at + window] for at in range(0, len(texts[i]), window)] for i in long]
    # A first window begins with the start and a last one ends with nothing behind it, so vectors do for them.
    heads, head_logs = _through(model.move, relative, [p[0] for p in parts], model.start[None, :], room)
    tails, tail_logs = _through(np.ascontiguousarray(model.move.T), relative, [p[-1][::-1] for p in parts], np.ones((1, k), model.emit.dtype), room)
    inner, inner_logs = _through(model.move, relative, [w for p in parts for w in p[1:-1]], np.eye(k, dtype=model.emit.dtype), room)
    at, move = 0, model.move.astype(np.float64)
    for i, own, head, tail, head_log, tail_log in zip(long, parts, heads[:, 0], tails[:, 0], head_logs, tail_logs):
        n = len(own)
        m, middle_log = inner[at : at + n - 2], inner_logs[at : at + n - 2].sum()
        at += n - 2
        total[i] = head_log + math.log10(head.sum()) + middle_log + tail_log
        ends = [head / head.sum()]
        before = [model.start.astype(np.float64), ends[-1] @ move]
        for x in m:
            a = before[-1] @ x
            total[i] += math.log10(a.sum())
            ends.append(a / a.sum())
            before.append(ends[-1] @ move)
        total[i] += math.log10(before[-1] @ tail)
        if not counts:
            continue
        firsts = [tail / tail.sum()]
        after = [np.ones(k), move @ firsts[-1]]
        for x in m[::-1]:
            w = x @ after[-1]
            firsts.append(w / w.sum())
            after.append(move @ firsts[-1])
        for a, w in zip(ends, firsts[::-1]):
            joint = a[:, None] * move * w
            moves += joint / joint.sum()
        sequences += own
        priors.append(np.array(before, model.emit.dtype))
        exits.append(np.array(after[::-1], model.emit.dtype))
        begins += [True] + [False] * (n - 1)
    return (total, sequences, len(short), np.concatenate(priors), np.concatenate(exits), np.array(begins, bool), moves) if counts else (total,)


def expected_counts(model: Model, texts: list[np.ndarray], window: int = WINDOW, room: _Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected (starts by state, moves from and to a state, emissions by symbol and state), and the log10 likelihood."""
    k = len(model.start)
    starts, inner, emitted, log = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k)), 0.0
    if not texts:
        return starts, inner, emitted, log
    room = room or _Room()
    total, sequences, short, priors, exits, begins, moves = _cut(model, texts, window, True, room)
    log = float(total.sum())
    back, relative = np.ascontiguousarray(model.move.T), _relative(model)
    for part in _batches(sequences):
        own = [sequences[i] for i in part]
        logs, order, symbols, cuts, seen, forward, last = _forward(model, relative, own, priors[part], room)
        log += float(logs[part < short].sum())
        b, held = exits[part][order], np.empty((len(own), k), seen.dtype)
        # With this scale the forward and backward values of a token are its states' chances.
        b /= (forward[last] * b).sum(axis=1, keepdims=True)
        forward[cuts[-2] :] *= b[: cuts[-1] - cuts[-2]]
        for i, j, end in zip(cuts[-3::-1], cuts[-2:0:-1], cuts[:1:-1]):
            n = end - j
            now = forward[i:j]
            weighted = np.multiply(seen[j:end], b[:n], out=held[:n])
            inner += now[:n].T @ weighted
            np.matmul(weighted, back, out=b[:n])
            now *= b[: j - i]
        by_state = room.empty("by state", (k, len(symbols)), np.float64)
        for i in range(0, len(symbols), 8192):  # turned over within the processor's cache
            by_state[:, i : i + 8192] = forward[i : i + 8192].T
        for s in range(k):
            emitted[:, s] += np.bincount(symbols, weights=by_state[s], minlength=len(emitted))
        starts += forward[: cuts[1]][begins[part][order]].sum(axis=0, dtype=np.float64)
    return starts, inner * model.move + moves, emitted, log


def maximise(model: Model, starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, shares: np.ndarray) -> None:
    """New parameters from expected counts, smoothed."""
    model.start = ((starts + 0.1) / (starts + 0.1).sum()).astype(np.float32)
    moves = moves + 0.1
    model.move = (moves / moves.sum(axis=1, keepdims=True)).astype(np.float32)
    emitted = emitted + SMOOTHING * shares[:, None]
    model.emit = np.ascontiguousarray(emitted / emitted.sum(axis=0, keepdims=True), np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n, ends = [], 0, 0

    def added() -> pa.Table:
        return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in text_slices(batches, limit=SLICE):
        words, ends = words_of(batch.column("text"))[0], ends + batch.num_rows
        counts = words.value_counts()
        kept.append(pa.table([counts.field("values"), counts.field("counts")], names=["word", "n"]))
        n += len(counts)
        if n > KEPT:
            kept = [added()]
            n = kept[0].num_rows
            if n > COUNTED:
                yield from kept[0].to_batches()
                kept, n = [], 0
    if ends:
        kept.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"]))
        yield from added().to_batches()
    release()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, c over all texts (column text); the end is the empty word."""
    return docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _first_model(vocab: DataFrame, states: int, head: float) -> tuple[Model, np.ndarray]:
    """The model before training, and the corpus's shares of its symbols."""
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(2.0, n * head)
    # At most 1 / head words reach that count. The end always has its symbol.
    own = vocab.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).toArrow()
    words, c = own.column("word").to_pylist(), own.column("c").to_numpy()
    order = sorted(range(len(words)), key=words.__getitem__)
    words, c = [words[i] for i in order], c[order] if len(order) else np.zeros(0, np.int64)
    if END not in words:
        words, c = [END, *words], np.concatenate([[0], c])

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 2), np.int64)
        for batch in batches:
            at = word_classes(batch.column("word"))
            total[:, 0] += np.bincount(at, weights=batch.column("c").to_numpy(), minlength=CLASSES).astype(np.int64)
            total[:, 1] += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["class", "n", "v"])

    rest = vocab.where((F.col("c") < least) & (F.col("word") != F.lit(END)))
    rare = np.zeros((CLASSES, 2))
    for r in rest.mapInArrow(by_class, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        rare[r["class"]] = r.n, r.v
    shares = np.concatenate([c, rare[:, 0]]) + 0.5
    shares = shares / shares.sum()
    rng = np.random.default_rng(5)
    emit = shares[:, None] * rng.uniform(1 - SPREAD, 1 + SPREAD, (len(shares), states))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    model = Model(words, np.log10(c + 1.0), np.log10(rare.sum(axis=1) + 1), int(n), int(v), np.full(states, 1 / states, np.float32), move.astype(np.float32), np.ascontiguousarray(emit / emit.sum(axis=0), np.float32))
    return model, shares


def _kind(symbols: int) -> type:
    """How a symbol is written, if there are so many."""
    return np.uint16 if symbols <= 1 << 16 else np.int32


_ENCODED = "uid long, doc_id long, held_out boolean, symbols binary, words array<binary>, times array<long>"


def _encoded(model: Model, rows: DataFrame) -> DataFrame:
    """uid, doc_id, held_out of each text, its symbols (of `_kind`), and its words that have none of their own, with their times."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(model), _kind(len(model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        head, end = pa.array(own.head, pa.binary()), own.symbols[END]
        for batch in text_slices(batches, limit=SLICE):
            words, bounds = words_of(batch.column("text"))
            found = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy().astype(np.int64)
            at = np.flatnonzero(found < 0)
            rare = words.take(pa.array(at)).dictionary_encode()
            codes, distinct = rare.indices.to_numpy(), rare.dictionary
            found[at] = len(own.head) + word_classes(distinct).take(codes)
            symbols = np.insert(found, bounds[1:], end).astype(kind)
            starts = (bounds + np.arange(len(bounds))) * symbols.itemsize
            # A text's number and its word, together; there are fewer words than tokens in a slice.
            of, times = np.unique((np.searchsorted(bounds, at, side="right") - 1) * max(1, len(distinct)) + codes, return_counts=True)
            text, code = np.divmod(of, max(1, len(distinct)))
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("uid", "doc_id", "held_out")),
                    pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.array(starts, pa.int32()).buffers()[1], pa.py_buffer(symbols)]),
                    pa.ListArray.from_arrays(ends, distinct.take(pa.array(code))),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                ],
                names=["uid", "doc_id", "held_out", "symbols", "words", "times"],
            )

    table = materialize(rows.select("uid", "doc_id", "held_out", "text").mapInArrow(run, _ENCODED), "lm-symbols")
    shared.unpersist()
    return table


def _held(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[list[np.ndarray]]:
    """Texts' symbols in lists of at most HELD tokens, or one text."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column("symbols").to_pylist():
            x = np.frombuffer(x, kind)
            if held and size + len(x) > HELD:
                yield held
                held, size = [], 0
            held.append(x)
            size += len(x)
    if held:
        yield held


def _baum_welch(model: Model, shares: np.ndarray, encoded: DataFrame) -> float:
    """One pass over all texts: expected counts by task, summed by symbol, then new parameters. The log10 likelihood before."""
    spark, k = encoded.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(Model([], np.zeros(0), np.zeros(0), 0, 0, model.start, model.move, model.emit))
    columns = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, room = shared.value, _Room()
        n = len(own.emit)
        total = np.zeros((n + k + 2, k))  # emissions by symbol; moves by origin; starts; the likelihood
        for held in _held(batches, _kind(n)):
            starts, moves, emitted, log = expected_counts(own, held, room=room)
            total[:n] += emitted
            total[n : n + k] += moves
            total[n + k] += starts
            total[n + k + 1, 0] += log
        room.held.clear()
        release()
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, i]) for i in range(k))], names=["symbol", *columns])

    summed = encoded.select("symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    shared.destroy()
    n = len(model.emit)
    total = np.zeros((n + k + 2, k))
    if summed.num_rows:
        total[summed.column("symbol").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in columns], axis=1)
        maximise(model, total[n + k], total[n : n + k], total[:n], shares)
    return float(total[n + k + 1, 0])


def train(rows: DataFrame, states: int = STATES, head: float = HEAD, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Model, DataFrame, DataFrame]:
    """(model, vocabulary, all texts encoded) from rows (uid, doc_id, held_out, text). Every text that isn't held out takes part in every round."""
    vocab = materialize(vocabulary(rows.where("not held_out").select("text")), "lm-vocabulary")
    model, shares = _first_model(vocab, states, head)
    encoded = _encoded(model, rows)
    last, learned = -math.inf, encoded.where("not held_out").coalesce(1 + model.n // TASK)
    for _ in range(rounds):
        now = _baum_welch(model, shares, learned) / max(1, model.n)
        if now - last < gain:
            break
        last = now
    return model, vocab, encoded


def score(encoded: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, n_known, base_score, score of each text of `_encoded`.

    uid only ties a text's rare words to it within that table, so it needn't be the same on another read.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, room, kind = shared.value, _Room(), _kind(len(shared.value.emit))
        # By symbol: what it adds to the base score, to the known words, and to the shares of words within classes.
        rare = np.zeros(CLASSES)
        base_of = np.concatenate([own.head_log, rare])
        known_of = np.concatenate([own.head_log > 0, rare]).astype(np.int64)
        inside_of = np.concatenate([np.zeros(len(own.head)), own.class_log])
        for batch in batches:
            symbols = [np.frombuffer(x, kind) for x in batch.column("symbols").to_pylist()]
            if not symbols:
                continue
            likely = np.zeros(len(symbols))
            for part in _batches(symbols):
                likely[part] = own.forward([symbols[i] for i in part], room=room)
            flat, starts = np.concatenate(symbols, dtype=np.intp), np.cumsum([0, *map(len, symbols[:-1])])
            base, head_known, inside = (np.add.reduceat(x.take(flat), starts) for x in (base_of, known_of, inside_of))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "doc_id", "held_out")), pa.array(map(len, symbols), pa.int64()), pa.array(head_known, pa.int64()), pa.array(base, pa.float64()), pa.array(likely - inside)],
                names=["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"],
            )

    done = encoded.select("uid", "doc_id", "held_out", "symbols").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double")
    # Each rare word of a text meets its count; a word here has fewer than HEAD of all training tokens.
    rest = encoded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counted = rest.join(vocab, "word").groupBy("uid").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"))
    zero = F.lit(0.0)
    return done.join(counted, "uid", "left").select(
        "uid",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("head_base") + F.coalesce("rare_log", zero) - F.col("n_tokens") * math.log10(model.n + model.v + 1)).alias("base_score"),
        (F.col("head_score") + F.coalesce("rare_log", zero)).alias("score"),
    )


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on the texts that aren't held out, score all."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, vocab, encoded = train(rows, **options)
    return score(encoded, model, vocab).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_score(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    return score_documents(table(prepare(spark), sf_dir, "documents"), bucket_of(F.col("doc_id"), 7) == 2)
