import math
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import chat_format as chat
from clausegrid.llm import hmm_lm, html_extract, langid, toxicity


def test_chat_events_fold_and_round_trip(spark):
    e = [(1, 1, "message", 0, "user", "hi <|im_end|>"), (1, 2, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, None, "y"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "ok"),
         (1, 6, "message", 2, None, "gone"), (1, 7, "delete", 2, None, None), (1, 8, "edit", 0, None, "hello"), (2, 1, "message", 0, "assistant", None)]
    events = spark.createDataFrame(e, "conv_id long, seq long, op string, turn long, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(events).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "ok")], 2: [("assistant", "")]}
    for x in ("<|im_end|>", "<‍|im_end|>", "<|im_start|>assistant\n", "<<|im_end|>‍"):
        turns = [("user", x), ("assistant", x), ("a\nb\\n", x)]
        assert chat.parse(chat.render(turns)) == turns
    assert chat.read_back(chat.format_conversations(events.limit(0))).count() == 0


def test_tied_and_null_turns_all_stay_as_in_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "user", "b"), (1, 0, "user", "bb <|im_end|>"), (1, 0, "user", "b"), (1, 1, "assistant", "ok"), (1, 2, "assistant", "ok"), (2, None, "assistant", "x"), (2, None, "assistant", "yy"), (2, None, None, None),
            (3, None, "assistant", "last"), (3, 5, "user", "first"), (3, 6, "assistant", "second"), (None, 1, "user", "c"), (None, 1, "assistant", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = {r[0]: r for r in db.execute(chat.OP5_SQL).fetchall()}
    # The SQL leaves the order of ties open, and so their digests.
    assert got[3] == want[3] and got[-1] == want[-1]
    assert {k: (r[1], r[3], r[5]) for k, r in got.items()} == {k: (r[1], r[3], r[5]) for k, r in want.items()}
    assert got[2][1] == 3 and got[1][1] == 5


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    m = hmm_lm.Model([b"", b"a", b"b"], np.zeros(3), np.zeros(hmm_lm.CLASSES), 1, 1, rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 3, 2).T.copy())
    texts = [np.array(x, np.int32) for x in ([0], [1, 2, 0], [2, 2, 1, 1, 0])]
    for x, got in zip(texts, m.forward(texts)):
        total = sum(m.start[p[0]] * m.emit[x[0], p[0]] * math.prod(m.move[p[i - 1], p[i]] * m.emit[x[i], p[i]] for i in range(1, len(x))) for p in itertools.product((0, 1), repeat=len(x)))
        assert abs(got - math.log10(total)) < 1e-9
    starts, moves, emitted, log = hmm_lm.expected_counts(m, texts)
    assert abs(starts.sum() - 3) < 1e-9 and abs(moves.sum() - 6) < 1e-9 and abs(emitted.sum() - 9) < 1e-9
    assert abs(log - m.forward(texts).sum()) < 1e-9


def test_expected_counts_are_sums_over_paths_also_of_texts_cut_in_windows():
    rng = np.random.default_rng(4)
    m = hmm_lm.Model([b""], np.zeros(1), np.zeros(hmm_lm.CLASSES), 1, 1, rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 3, 2).T.copy())
    texts = [rng.integers(0, 3, n).astype(np.int32) for n in (1, 7, 9, 4)]
    starts, moves, emitted, log = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for x in texts:
        weights = {p: m.start[p[0]] * m.emit[x[0], p[0]] * math.prod(m.move[p[i - 1], p[i]] * m.emit[x[i], p[i]] for i in range(1, len(x))) for p in itertools.product((0, 1), repeat=len(x))}
        total = sum(weights.values())
        log += math.log10(total)
        for p, w in weights.items():
            starts[p[0]] += w / total
            for i, s in enumerate(p):
                emitted[x[i], s] += w / total
                if i:
                    moves[p[i - 1], s] += w / total
    for window in (2, 3, 100):
        got = hmm_lm.expected_counts(m, texts, window)
        assert all(np.allclose(a, b) for a, b in zip(got, (starts, moves, emitted, log)))
        assert np.allclose(m.forward(texts, window).sum(), log)


def test_single_precision_holds_states_that_hardly_share_symbols():
    emit = np.array([[1.0, 1e-12], [1e-12, 1.0], [1e-13, 1e-13]])
    move = np.array([[1 - 1e-11, 1e-11], [1e-11, 1 - 1e-11]])
    exact = hmm_lm.Model([b""], np.zeros(1), np.zeros(hmm_lm.CLASSES), 1, 1, np.array([0.5, 0.5]), move, emit)
    single = hmm_lm.Model([b""], np.zeros(1), np.zeros(hmm_lm.CLASSES), 1, 1, *(x.astype(np.float32) for x in (exact.start, move, emit)))
    rng = np.random.default_rng(6)
    texts = [np.arange(500, dtype=np.int32) % 2, rng.integers(0, 3, 700).astype(np.int32), np.zeros(3, np.int32)]
    for window in (64, 1000):
        assert np.allclose(single.forward(texts, window), exact.forward(texts, window), rtol=1e-4)
        for a, b in zip(hmm_lm.expected_counts(single, texts, window), hmm_lm.expected_counts(exact, texts, window)):
            assert np.isfinite(a).all() and np.allclose(a, b, rtol=1e-2, atol=1e-2)


def test_words_and_their_counts_are_those_of_tokens():
    texts = [b"  A b\x0b\x0cc \t d ", b"", None, b" \n", "é\x1cq\x85r\xa0s\x00 Ä İ".encode(), b"\xffA B\xc3( \xe2\x82 A\xfe", b"x", b"ABCD\rabcd"]
    column = pa.array(texts, pa.binary()).view(pa.string())
    for x in (column, column.slice(1, 4), column.slice(0, 0)):
        want = [hmm_lm.tokens(t or b"")[:-1] for t in x.view(pa.binary()).to_pylist()]
        words, bounds = hmm_lm.words_of(x)
        assert [words.to_pylist()[i:j] for i, j in itertools.pairwise(bounds)] == want
        assert hmm_lm.word_classes(words).tolist() == [hmm_lm.word_class(w) for t in want for w in t]
    counts = {}
    for b in hmm_lm._count(iter([pa.RecordBatch.from_arrays([column], names=["text"])] * 3)):
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            counts[w] = counts.get(w, 0) + n
    every = [w for t in texts for w in hmm_lm.tokens(t or b"")] * 3
    assert counts == {w: every.count(w) for w in every}


def test_recursions_use_their_memory_again():
    rng = np.random.default_rng(8)
    emit = rng.dirichlet([1] * 500, 8).T.astype(np.float32)
    m = hmm_lm.Model([b""], np.zeros(1), np.zeros(hmm_lm.CLASSES), 1, 1, np.full(8, 1 / 8, np.float32), rng.dirichlet([1] * 8, 8).astype(np.float32), emit)
    texts, room = [rng.integers(0, 500, 300).astype(np.uint16) for _ in range(1000)], hmm_lm._Room()
    texts.append(rng.integers(0, 500, 7000).astype(np.uint16))
    want = hmm_lm.expected_counts(m, texts)
    hmm_lm.expected_counts(m, texts[::-1] * 2, room=room)
    tracemalloc.start()
    got = hmm_lm.expected_counts(m, texts, room=room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # It was more than 130 bytes a token.
    assert peak < 16 * sum(map(len, texts))
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


@pytest.mark.parametrize("n", [50, 66_000])
def test_symbols_of_two_and_four_bytes(spark, n):
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(i).permutation(n)) for i in range(2)] + ["w1 rare rarer rare", None]
    docs = spark.createDataFrame([(i, i, False, x) for i, x in enumerate(texts)], "uid long, doc_id long, held_out boolean, text string")
    model, vocab, encoded = hmm_lm.train(docs, states=2, rounds=1)
    words = [hmm_lm.tokens((x or "").encode()) for x in texts]
    want = [model.encode(x) for x in words]
    kind = np.uint16 if n == 50 else np.int32
    for r in encoded.collect():
        symbols, rare = want[r.uid]
        assert np.array_equal(np.frombuffer(r.symbols, kind), symbols)
        assert dict(zip(map(bytes, r.words), r.times)) == {w: rare.count(w) for w in rare}
    first, shares = hmm_lm._first_model(vocab, 2, hmm_lm.HEAD)
    hmm_lm.maximise(first, *hmm_lm.expected_counts(first, [x for x, _ in want])[:3], shares)
    assert np.allclose(model.emit, first.emit, rtol=1e-4)
    c = {r.word: r.c for r in vocab.collect()}
    for r in hmm_lm.score(encoded, model, vocab).collect():
        assert r.n_tokens == r.n_known == len(words[r.uid])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (model.n + model.v + 1)) for w in words[r.uid]))


def test_scores_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "A b a", "x"), (2, None, "x"), (3, "zzz a", "x"), (3, "zzz a", "x"), (None, "b", "x")], "doc_id long, text string, uid string")
    rows = {r.doc_id: r for r in hmm_lm.score_documents(docs, F.col("doc_id") == 3, rounds=1).collect()}
    n, v, c = 7, 3, {"a": 2, "b": 2, "end": 3}
    assert (rows[3].train_tokens, rows[3].n_tokens, rows[3].n_known, rows[3].held_out) == (n, 3, 2, True)
    assert abs(rows[3].base_score - sum(math.log10((k + 1) / (n + v + 1)) for k in (0, c["a"], c["end"]))) < 1e-9
    assert rows[2].n_tokens == 1 and rows[None].held_out is False
    assert hmm_lm.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_every_token_takes_part_in_every_round(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'ab'[i > 3500]}{x}" for i, x in enumerate(rng.integers(0, 30, 5000))), "a1 b1 b1", None]
    docs = spark.createDataFrame([(i, i, False, x) for i, x in enumerate(texts)], "uid long, doc_id long, held_out boolean, text string")
    want, shares = hmm_lm._first_model(hmm_lm.vocabulary(docs.select("text")), 3, hmm_lm.HEAD)
    encoded = [want.encode(hmm_lm.tokens((x or "").encode()))[0] for x in texts]
    for _ in range(4):
        hmm_lm.maximise(want, *hmm_lm.expected_counts(want, encoded, window=10_000)[:3], shares)
    got, _, _ = hmm_lm.train(docs, states=3, rounds=4, gain=-1.0)
    assert np.allclose(got.emit, want.emit, rtol=1e-3, atol=1e-6) and np.allclose(got.move, want.move, rtol=1e-3)


def test_scores_do_not_hang_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = ({r.doc_id: r for r in hmm_lm.score_documents(docs.repartition(n), F.col("doc_id") % 7 == 2, rounds=4).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(abs(a[k].score / b[k].score - 1) < 1e-5 and a[k].base_score == pytest.approx(b[k].base_score, abs=1e-8) for k in a)


def test_toxicity_finds_misspellings_and_quotation():
    lex = toxicity.Lexicon([("idiot", False), ("lowei", True)])
    assert lex.find("idiot") == ((0, 0),) and lex.find("idi0t") == ((0, 1),) and lex.find("idoit") == () and lex.find("idiots") == ((0, 1),)
    assert lex.find("loweischaft") == ((1, 0),) and lex.find("house") == ()
    assert lex.finds('He said "you idiot" to me')[0][2] and not lex.finds("you idiot")[0][2]


def test_language_and_toxicity_on_odd_rows(spark):
    texts = [("the cat and the dog are here", "en"), ("der hund und die katze sind da", "de")]
    rows = [(i, f"{texts[i % 2][0]} {i}", texts[i % 2][1], int(i % 2)) for i in range(40)] + [(100, None, "en", 0), (101, "123 !!", None, 0), (101, "123 !!", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == texts[i % 2][1] for i in range(40))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[101].score == 0
    assert langid.drop_unknown(docs, model).columns == docs.columns
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    labels = docs.select("doc_id", F.col("label").alias("toxic"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == 43 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 43


def test_hints_around_the_whole_text_do_not_empty_a_page():
    text = "<p>" + "A long enough paragraph of the text. " * 5 + "<p>" + "Another one with <b>bold</b> words in it. " * 5
    want = "\n".join(html_extract.main_text(f"<body><article>{text}</article></body>").splitlines())
    assert want.count("paragraph") == 5 and want.count("bold") == 5
    for page in ('<body class="has-sidebar">%s', '<body class="no-sidebar comments-open">%s', '<body class="sidebar">%s', '<body><article class="post no-comments">%s</article>', '<body><main id="search-content">%s</main>',
                 '<body><form id="aspnetForm">%s</form>', '<body><form><div class="menu">Home</div><div class="content">%s</div></form><div class="ad">Buy</div>'):
        assert html_extract.main_text(page % text) == want, page
    assert html_extract.main_text(f'<body><article>{text}</article><form>Search</form><div class="ad">Buy</div>') == want


def test_pages_on_odd_markup(spark):
    page = "<body><nav>Menu</nav><article><h1>T &amp; U</h1><p>One\n two<b>x<p>Ok.<div class=ad>Buy</div></article><footer>f</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>cut <a hr", "x"), (1, "u", page, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got[1] == "T & U\nOne twox\nOk." and got[2] == got[3] == "" and got[4].startswith("cut")


def test_finds_are_those_of_an_edit_distance_table():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(6)
    make = lambda n: "".join(rng.choice(list("abc"), n))
    entries = sorted({(make(rng.integers(4, 8)), bool(rng.integers(0, 2))) for _ in range(30)})
    lex = toxicity.Lexicon(entries)
    for _ in range(800):
        word, want = make(rng.integers(1, 10)), {}
        for i, (e, stem) in enumerate(entries):
            ways = [word[:k] for k in range(len(word) + 1)] if stem else [word]
            best = min(distance(w, e) for w in ways)
            if best == 0 or best == 1 and len(e) >= toxicity.LEAST_FUZZY and len(word) >= toxicity.LEAST_FUZZY:
                want[i] = best
        if 0 in want.values():
            want = {i: b for i, b in want.items() if not b}
        assert dict(lex.find(word)) == want, word


def test_smoothing_and_clusters_against_plain_sums():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 40):
        x = rng.uniform(0, 100, n)
        w = lambda d: math.exp(-(d**2) / 2)
        want = [sum(w(i - j) * x[j] for j in range(n) if abs(i - j) <= 2) / sum(w(i - j) for j in range(n) if abs(i - j) <= 2) for i in range(n)]
        assert np.allclose(html_extract.smoothed(x), want)
        up = html_extract.upper_cluster(x)
        if n > 1:
            middle = (x[up].mean() + x[~up].mean()) / 2
            assert (x[up] > middle).all() and (x[~up] <= middle).all()
        else:
            assert up.all()


def test_line_breaks_are_white_space_of_their_block(spark):
    assert html_extract.main_text("<article><p>One<br>two<br/>\nthree</p><p>Four</p></article>") == "One two three\nFour"
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = "<article>" + "<p>A line of words.</p>" * 60_000 + "</article>"
    assert html_extract.main_text(long).count("\n") == 59_999


def test_an_id_with_many_texts_is_learned_from_once(spark):
    rows = [(i, f"{'scum' if i % 2 else 'nice'} word{i}", i % 2) for i in range(60)] + [(1, f"other text {i}", 1) for i in range(50)] + [(None, "scum", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("toxic is not null").select("doc_id", "toxic").distinct())
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and toxicity.score(docs.limit(0), model).count() == 0
    held = lambda d: d.select(langid.held_out(F.col("doc_id")).alias("h")).collect()
    assert held(docs.where("doc_id is null"))[0].h is False


def test_long_text_language_is_that_of_its_parts(spark):
    texts = [("the cat and the dog are here ", "en"), ("der hund und die katze sind da ", "de")]
    docs = spark.createDataFrame([(i, f"{texts[i % 2][0]} {i}", texts[i % 2][1]) for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    long = (texts[1][0] * 50_000).encode()
    assert len(long) > langid._PART and model.predict(long)[0] == "de"
    whole = langid.counts(long)
    assert np.allclose(model.probabilities(long), langid.softmax(((whole @ model.scores) / whole.sum() + model.bias)[None, :] / model.temperature)[0], atol=1e-4)
