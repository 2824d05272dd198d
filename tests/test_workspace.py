import pytest
from pyspark.sql import functions as F

from clausegrid.functions import sequence
from clausegrid.functions import text as X
from clausegrid.operators import claims as C
from clausegrid.operators import retrieval as R
from clausegrid.plans import catalog, workspace  # noqa: F401
from clausegrid.sources import io, records
from clausegrid.streaming import runtime


def test_semicolons_in_listings_and_starters():
    assert [s["text"] for s in sequence.segments("A kit having at least\none of a pump; a valve; wherein x (a; b); whenever y.")] == ["A kit having at least one of a pump; a valve", "wherein x (a; b)", "whenever y."]
    assert [s["text"] for s in sequence.segments("at least one of a pump; and a valve")] == ["at least one of a pump", "a valve"]
    s = sequence.segments("A rig comprising: a bit; for use in wells.")
    assert [(x["start"], x["end"], x["starter"], x["kind"]) for x in s] == [(0, 16, "", "preamble"), (17, 23, "", "limitation"), (24, 42, "for", "limitation")]
    assert sequence.redline("a  b\nc", "a b c")["blocks"] == 0


def test_highlights_keep_the_first_and_longest_as_the_fold_in_rows(spark):
    text = "A pump and a valve. The pump opens the valve and the lid. Said pump."
    m = spark.createDataFrame([(1, text)], "claim_id long, claim_text string").transform(C.mentions)
    got = [(r.start, r.end) for r in C.highlight_marks(m, C.antecedent_issues(m)).orderBy("mark").collect()]
    spans = [(r.start, r.end) for r in m.collect()]
    assert got == sorted(s for s, k in zip(spans, sequence.highlights(spans)) if k)
    assert sequence.highlights([(0, 5), (0, 9), (4, 6), (9, 12)]) == [False, True, False, True]


def test_dependencies_out_of_range_are_an_error_and_no_failure(spark):
    row = spark.createDataFrame([("claim 99999999999 and claims 1-2000000000 and claims 3 to 1",)], "t string").select(C.dependencies(F.col("t")).alias("d"), C.dependency_error(F.col("t")).alias("e")).first()
    assert row.d == [1, 2, 3] and row.e == "dependency out of range"
    assert spark.createDataFrame([("",)], "t string").select(X.format_patent(F.col("t")).alias("x")).first().x == "—"


def test_unwrap_and_limitations(spark):
    row = spark.createDataFrame([("A hy-  \n phen [ 0001 ] one\ntwo <<<PAGE_BREAK>>>\n\n three\n\nfour", "1. A x: a; and b; c.")], "a string, b string").select(X.unwrap(F.col("a")).alias("a"), X.limitations(F.col("b")).alias("b")).first()
    assert row.a == "A hyphen\n\n[0001] one two three\n\nfour" and row.b == ["1. A x", "a", "b", "c"]


def test_bm25_against_the_formula():
    import math

    s = ["a pump pump", "a valve", "", "the pump a"]
    got = R.bm25_of(s, ["pump pump", "zzz", "a"])
    idf = {t: math.log(4 - d + 0.5) - math.log(d + 0.5) for t, d in {"a": 3, "pump": 2, "valve": 1, "the": 1}.items()}
    mean, avg = sum(idf.values()) / 4, 8 / 4
    weight = lambda t: idf[t] if idf[t] >= 0 else 0.25 * mean
    one = lambda t, x: weight(t) * x.split().count(t) * 2.5 / (x.split().count(t) + 1.5 * (0.25 + 0.75 * len(x.split()) / avg)) if t in x.split() else 0.0
    for i, x in enumerate(s):
        assert got[0][i] == pytest.approx(2 * one("pump", x)) and got[1][i] == 0 and got[2][i] == pytest.approx(one("a", x))
    assert R.bm25_of([], ["a"]) == [[]] and R.bm25_of(["", ""], ["a"]) == [[0.0, 0.0]]


def test_batch_of_requests_gives_what_each_alone_gives(spark):
    rows = [("r1", "A pump moves oil.\n\nThe valve is shut. It is red.", ["valve"], 1), ("r2", "Oil is hot. A pump runs.", ["pump", "oil"], 5), ("r3", " ", ["x"], 5), ("r4", "Oil is hot. A pump runs.", ["pump"], 99)]
    requests = spark.createDataFrame(rows, "request_id string, patent_text string, queries array<string>, top_n int")
    key = lambda df: sorted((r.request_id, r.query, r["rank"], r.sentence, r.paragraph) for r in df.collect())
    both = key(runtime.analyze_batch(requests))
    assert both == sorted(key(runtime.analyze_batch(requests.where("request_id = 'r1'"))) + key(runtime.analyze_batch(requests.where("request_id = 'r2'"))))
    assert both[0] == ("r1", "valve", 1, "The valve is shut.", "The valve is shut. It is red.") and {r[0] for r in both} == {"r1", "r2"}
    errors = {r.request_id: r.error for r in runtime.validate_requests(requests).collect()}
    assert errors["r3"].endswith("blank") and errors["r4"].endswith("top_n") and errors["r1"] is None


def test_stream_of_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request_id": "r", "patent_text": "A pump runs. Oil is hot. It is red.", "queries": ["oil"], "top_n": 1, "arrived_at": "2024-01-01T00:00:00Z"}\n')
    q = runtime.search_stream(runtime.request_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [r.sentence for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["Oil is hot."] and runtime.stream_metrics(q)["rows"] == 1


PAGE = """<article class="result"><meta itemprop="numberWithoutCodes" content="9922200"><meta itemprop="kindCode" content="B2"><span itemprop="applicationNumber">US14/123,456</span><span itemprop="publicationNumber">US9922200B2</span>
<span itemprop="title">Pump</span><time itemprop="publicationDate" datetime="2018-03-20">x</time><section itemprop="description"><div class="description-paragraph" num="1">A pump.</div></section>
<section itemprop="claims"><div class="claim" id="CLM-1">1. A pump comprising: a rotor.</div><div class="claim" id="CLM-2">2. The pump of claim 1.</div></section></article>"""


def test_records_from_pages_and_their_lookup(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", "<p>x"), ("c", None)], "path string, html string")
    parsed = io.parse_pages(pages)
    assert {r.path: r.error for r in parsed.collect()} == {"a": None, "b": "record identifiers missing", "c": "record identifiers missing"}
    apps = spark.createDataFrame([("15000001", "", "t", "Text.\nWhat is claimed is:\n1. A valve.\n2. The valve of claim 1.")], "application_number string, patent_number string, title string, specification string")
    loaded = records.load_records(parsed, apps)
    got = {r.record_id: r for r in loaded.collect()}
    assert got["grant:9922200"].principal_claim_text == "1. A pump comprising: a rotor." and got["grant:9922200"].specification_text == "Detailed description\n\n[0001] A pump."
    assert got["application:15000001"].independent_claim_numbers == [1] and got["application:15000001"].claim_count == 2
    asked = spark.createDataFrame([(1, "patent", "US 9,922,200"), (2, "application", "15/000,001"), (3, "patent", "7"), (4, "patent", "1234567")], "request_id int, identifier_type string, identifier string")
    found = {r.request_id: (r.record_id, r.error) for r in records.lookup(loaded, asked).collect()}
    assert found == {1: ("grant:9922200", None), 2: ("application:15000001", None), 3: (None, "invalid_request: patent number needs 6 to 8 digits"), 4: (None, "patent_data_unavailable")}


def test_json_and_sections(spark, tmp_path):
    assert records.find_first({"a": {"k": "deep"}, "k": ""}, ["k"]) == "deep" and records.find_first([{"x": 1}, {"b": 2, "k": 3}], ["k", "b"]) == 3
    html = "<h3> Abstract </h3><p> </p><p>One<br> two  x</p><h3>Claims</h3><div>d</div><p>1. a</p>"
    row = spark.createDataFrame([("p", html)], "path string, html string").transform(records.four_sections).first()
    assert (row.abstract, row.claims, row.error) == ("One\n\ntwo x", "1. a", "missing: background, description")
    docs = spark.createDataFrame([('{"x": {"documentBag": [{"documentCode": "spec", "officialDate": "2020"}]}}',), ("{",), (None,)], "j string").select(records.documents_of(F.col("j")).alias("d"))
    assert [[x.code for x in r.d] for r in docs.collect()] == [["spec"], [], []]
    page = spark.createDataFrame([('<section itemprop="description">' + "a&eacute; <b>b</b> " * 1200 + "</section>",), ("<p>",)], "html string")
    assert [(r.error, r.description[:4]) for r in records.description_text(page).collect()] == [(None, "aé b"), ("description not found", "")]
    pairs = spark.createDataFrame([("q1", "p1"), ("q2", "p2"), (None, "p3")], "anchor string, positive string")
    got = records.requests_of_pairs(pairs, 1, 2).collect()
    assert len(got) == 1 and got[0].request_id == "load-0" and sorted(got[0].patent_text.split("\n\n")) == ["p1", "p2"]
    (tmp_path / "d.js").write_text('window.demo = {"a": 1};')
    assert io.read_script_json(spark, f"{tmp_path}/d.js", "a int").first().a == 1
    assert io.load_pairs(spark.createDataFrame([("a", "b")], "anchor string, positive string").sparkSession, _written(pairs, tmp_path)).count() == 2


def _written(df, tmp_path):
    df.write.parquet(f"{tmp_path}/pairs")
    return f"{tmp_path}/pairs"


def _claims(spark):
    text = "A pump and a valve, a hose. The pump opens the valve and the lid. A rod or a seal; said pump."
    rows = [(7, 1, text), (8, 1, None), (9, 2, "The lid."), (10, 2, "A wheel.  " * 40), (11, 2, text.upper())]
    return spark.createDataFrame(rows, "claim_id long, set_id int, claim_text string").selectExpr("*", "1 AS claim_number", "'x' AS label", "'y' AS document_number")


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_issues_of_a_claims_row_in_bounded_batches_as_by_windows(spark, monkeypatch):
    monkeypatch.setattr(C, "MADE_ROWS", 3)
    claims = _claims(spark)
    found = C.antecedent_issues(C.mentions(claims)).join(claims.drop("claim_text"), "claim_id")
    got = C.antecedent(claims)
    assert _rows(got.drop("title", "message", "confidence_label")) == _rows(C.number_issues(found)) and got.count() > 3
    # One shuffle, for the numbers: neither mentions nor texts are.
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_enumerations_of_a_claims_row_as_by_windows(spark, monkeypatch):
    monkeypatch.setattr(C, "MADE_ROWS", 1)
    claims = _claims(spark)
    by_windows = C.enumeration_groups(C.mentions(claims), claims.selectExpr("claim_id", "claim_text")).select("claim_id", "island", F.transform("members", lambda x: x["text"]).alias("members"))
    got = C.enumerations(claims)
    assert _rows(got) == _rows(by_windows) and {r.claim_id for r in got.collect()} == {7, 11}
    # The registered query shuffles neither mentions nor texts.
    assert "Exchange" not in catalog.QUERIES["enumeration_islands_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_marks_of_a_claims_row_as_by_windows(spark, monkeypatch):
    monkeypatch.setattr(C, "MADE_ROWS", 3)
    claims = _claims(spark)
    m = C.mentions(claims)
    assert _rows(C.marks(claims)) == _rows(C.highlight_marks(m, C.antecedent_issues(m)))
    # The registered query finds mentions once and shuffles none.
    plan = catalog.QUERIES["highlight_marks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_batched_search_is_compared_in_one_run_of_each(spark):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "a string")
    for a, b in (("x", "x", "y", None), ("x", "z", None)), (("x",), ("x",)):
        both, each = rows(*a), rows(*b)
        assert R.differing(both, each).first().differing == both.exceptAll(each).count() + each.exceptAll(both).count()
    assert R.differing(rows("x").limit(0), rows("x").limit(0)).first().differing == 0
    # Three searches, each of which counts terms once; not six.
    plan = catalog.QUERIES["batched_equals_sequential"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3


def test_letter_embedding_by_its_formula(spark):
    got = spark.createDataFrame([(1, ["Abba 7", "", "é"]), (2, []), (3, None)], "i int, s array<string>").select("i", R.letter_embedding("ab7")(F.col("s")).alias("v")).orderBy("i").collect()
    assert [[round(x, 6) for x in v] for v in got[0].v] == [[0.666667, 0.666667, 0.333333], [0, 0, 0], [0, 0, 0]] and got[1].v == [] and got[2].v is None
