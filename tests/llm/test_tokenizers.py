import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausegrid.llm import bpe, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
OURS = bpe.encoder(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
COUNTER = token_counts.counter(WORDS)
LIBRARY = Tokenizer.from_file(WORDS)

HARD = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaa", "It's we'll they're I'd 've", "été ÉTÉ Straße ΣΑΣ İstanbul", "日本語テキスト 12345 ½ ²", "x\n\n  y\t z    ", "é ñ <|endoftext|> a<|startoftext|><|endoftext|>b <|endo", "!!!??? ...--- {}[]()", "🤖👩‍👩‍👧 ok", "'r 'rest ''s", "the " * 300, "\x1c\x1d a \x85 b \x0b"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinorst'", min_size=1, max_size=25), max_size=12))
def test_likely_words(words):
    text = " ".join(words)
    assert OURS.encode_batch([text, *words]) == [THEIRS.encode_ordinary(x) for x in (text, *words)]
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcinrstéß'’!,. 12\n", max_size=40))
def test_every_prefix(text):
    p = COUNTER.prefixes(text)
    for k, n in enumerate(p.counts):
        assert n == len(LIBRARY.encode(p.text[:k], add_special_tokens=False).ids), p.text[:k]


def test_prefixes_around_special_strings_and_budget():
    p = COUNTER.prefixes("Hello!!<|endoftext|>worlds apart")
    for k, n in enumerate(p.counts):
        assert n == len(LIBRARY.encode(p.text[:k], add_special_tokens=False).ids), p.text[:k]
    assert p.fits(p.counts[-1]) and not p.fits(p.counts[-1] - 1)
    assert p.truncate(10**6) == p.text and p.truncate(0) == ""
    assert len(LIBRARY.encode(p.truncate(4), add_special_tokens=False).ids) <= 4


def test_lower_rank_appears_during_a_merge():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"bc": 5, b"abc": 2, b"ab": 9, b"bcb": 1}
    ours = bpe.MergeReplay(ranks, r"\S+")
    theirs = tiktoken.Encoding("toy", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcbc", "bcbcbc", "abcabcbcb", "abbccbaabc" * 3):
        assert ours.encode(text) == theirs.encode_ordinary(text), text


def test_frames(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6), (None, "", 7), (1, "Hello world", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect()), key=str)
    assert len(got) == 4 and got[0] == got[1]
    ids = bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert {bytes(r.decoded) for r in bpe.decode_documents(ids, RANKS, P.PATTERN).collect()} == {b"Hello world", b""}
    counts = token_counts.token_counts(docs, WORDS, limit=1).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == [(0, 0, False), (0, 0, False), (11, 2, True), (11, 2, True)]
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0
    assert {r.text for r in token_counts.truncated(docs, WORDS, 1).collect()} == {"hello ", ""}


def test_kept_pieces_are_bounded():
    small = bpe.MergeReplay(THEIRS._mergeable_ranks, P.PATTERN, limit=5)
    texts = ["one two three", "four five six one", "one one two seven eight nine ten eleven"]
    for text in texts:
        assert small.encode(text) == THEIRS.encode_ordinary(text)
    assert small.encode_batch(texts) == [THEIRS.encode_ordinary(x) for x in texts]


def test_bound_of_kept_pieces_changes_no_result(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([None, "", "a b", "naïve 中文 tests " * 50, "x" * 3000, "a b"])], "doc_id long, text string")
    some, many = (sorted(map(tuple, bpe.round_trip_digests(docs, RANKS, P.PATTERN, kept=k).collect())) for k in (2, 400_000))
    assert some == many and len(some) == 6
