"""Exact token counts by prefix dynamic programming, for a BPE vocabulary with word ends (.json).

A word's BPE encoding is the one sequence of tokens in which each adjacent pair is stable: replaying the merges over
the two tokens' symbols would not join across their border. So the last token of every prefix follows from the
prefixes before it: it is the suffix token whose border with the last token of the rest is stable. One pass over a
word stores count and last token of each prefix, both with the word still open and with it ended there. A text's
prefixes add up over its words, which answers counts, truncation and budgets without encoding again.

Prefixes are those of the normalised text (NFC, white space to one space, lower case), by code points. Strings of the
special tokens inside a text are one token each, as by the library's default; a prefix that ends inside one is
ordinary text.

Defined cases: null text counts as empty, with no tokens; repeated rows give a row each; texts of any length are
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import fold, text_slices
from clausegrid.llm.unicode_pieces import finder

#: Words, and borders of tokens, that a worker keeps.
KEPT = 400_000
#: Stands for a word end in the finder; no byte's symbol.
_END = "\n"


def _byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("not a BPE vocabulary with word ends, lower case and byte-level symbols")
        self.end = model["end_of_word_suffix"]
        self.table = _byte_symbols()
        #: Tokens by number, symbols first; a merge's number is the time at which its token comes into being.
        symbols = set(self.table.values())
        names = [*symbols, *(x + self.end for x in symbols)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first = len(names)
        names += [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(names)}
        if len(number) < len(names) or number.keys() != model["vocab"].keys():
            raise ValueError("not each token is a symbol or made by one merge")
        self.halves = [(0, 0)] * self.first + [(number[a], number[b]) for a, b in merges]
        self.joined = {number[a] << 20 | number[b]: self.first + time for time, (a, b) in enumerate(merges)}
        #: Finds every token that ends at a place; word ends are one character there.
        self.finder = ahocorasick.Automaton()
        for t, i in number.items():
            key = t[: -len(self.end)] + _END if t.endswith(self.end) else t
            self.finder.add_word(key, (len(key), i))
        self.finder.make_automaton()
        self.ended = {t[: -len(self.end)]: i for t, i in number.items() if t.endswith(self.end)}
        self.cutter = finder(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.white = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.kept: dict[str, int] = {}
        self.borders: dict[int, bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when the merges are replayed over their symbols.

        Undo the merges next to the border, latest first; at no time may the two tokens then at the border have a
        merge of their own that came before the one undone last.
        """
        x, y, joined, halves, first = a, b, self.joined, self.halves, self.first
        until = 1 << 30  # a merge of the border pair from this time on comes too late
        while True:
            if joined.get(x << 20 | y, until) < until:
                out = False
                break
            if x < first and y < first:
                out = True
                break
            if x > y:  # of the same token twice the left one is made first, so the right one is undone first
                until, x = x, halves[x][1]
            else:
                until, y = y + 1, halves[y][0]
        if len(self.borders) >= KEPT:
            self.borders.clear()
        self.borders[a << 20 | b] = out
        return out

    def _symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    def _open(self, symbols: str) -> tuple[list[int], list[int]]:
        """Last token and count of each prefix, by the symbols; of all symbols if they end in a word end."""
        last, counts = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        borders, stable = self.borders, self.stable
        for at, (length, token) in self.finder.iter(symbols):
            at += 1
            if last[at] < 0:
                j = at - length
                if j:
                    before = last[j]
                    known = borders.get(before << 20 | token)
                    if not (stable(before, token) if known is None else known):
                        continue
                last[at], counts[at] = token, counts[j] + 1
        return last, counts

    def word(self, word: str) -> int:
        """Tokens of a word."""
        return self._open(self._symbols(word) + _END)[1][-1]

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2] ... each as a word."""
        symbols = self._symbols(word)
        last, counts = self._open(symbols)
        out, at = [], 0
        for c in word:
            at += len(c.encode())
            fits = (j for j in range(at) if (t := self.ended.get(symbols[j:at])) is not None and (not j or self.stable(last[j], t)))
            out.append(counts[next(fits)] + 1)
        return out

    def normalise(self, text: str) -> str:
        # Each code point is lower-cased by itself, so a final sigma is as any other.
        return self.white.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def _segments(self, text: str) -> Iterator[tuple[str, str]]:
        """(normalised text, special string that follows or '')."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield self.normalise(text[at : m.start()]), m[0]
            at = m.end()
        yield self.normalise(text[at:]), ""

    def count(self, text: str) -> int:
        """Tokens of a text."""
        kept, total = self.kept, 0
        for part, special in self._segments(text):
            words = self.cutter(part).findall(part)
            try:
                total += sum(map(kept.__getitem__, words))
            except KeyError:
                fresh = {w for w in words if w not in kept}
                if len(kept) + len(fresh) > KEPT:
                    kept.clear()
                    fresh = set(words)
                for w in fresh:
                    kept[w] = self.word(w)
                total += sum(map(kept.__getitem__, words))
            total += bool(special)
        return total

    def prefixes(self, text: str) -> "Prefixes":
        return Prefixes(self, text)


class Prefixes:
    """The token count of every prefix of one normalised text: counts[k] for text[:k]."""

    def __init__(self, counter: PrefixCounter, text: str) -> None:
        self.text, self.counts = "", [0]
        for part, special in counter._segments(text):
            base, at, run = self.counts[-1], 0, part + special[:-1]
            inside = []
            for m in counter.cutter(run).finditer(run):
                so_far = inside[-1] if inside else base
                inside += [so_far] * (m.start() - at)
                inside += [so_far + n for n in self._of_word(counter, m[0])]
                at = m.end()
            inside += [inside[-1] if inside else base] * (len(run) - at)
            if special:
                # A word that runs on into the special string ends before it: count the part by itself.
                inside.append((inside[len(part) - 1] if part else base) + 1)
            self.counts += inside
            self.text += part + special
        assert len(self.counts) == len(self.text) + 1

    @staticmethod
    def _of_word(counter: PrefixCounter, word: str) -> list[int]:
        if word[0] == "'" and len(word) == 3:  # of 're, 've and 'll, a shorter prefix is two words
            return [sum(counter.word(w) for w in counter.cutter(word).findall(word[:k])) for k in (1, 2, 3)]
        return counter.word_prefixes(word)

    def fits(self, budget: int) -> bool:
        return self.counts[-1] <= budget

    def truncate(self, budget: int) -> str:
        """The longest prefix of at most budget tokens before the first prefix that exceeds it."""
        high, peak = [], 0
        for c in self.counts:
            peak = max(peak, c)
            high.append(peak)
        return self.text[: bisect_right(high, budget) - 1]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """The worker's own counter for a vocabulary file, which every node has at the same path."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in text_slices(batches):
            counts = [own.count(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(fold(F.col(text_col))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (normalised) cut to the budget, n_tokens of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in text_slices(batches):
            found = [own.prefixes(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p.truncate(budget) for p in found], pa.string()), pa.array([p.counts[-1] for p in found], pa.int64())], names=["doc_id", "text", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string, n_tokens long")


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    from clausegrid.llm.common import prepare, table

    return token_counts(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
