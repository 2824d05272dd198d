from decimal import Decimal

import duckdb
import pytest

from clausegrid.functions import sequence
from clausegrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

LEFT = "1. A method for cooling a battery comprising: measuring a temperature of the battery; comparing the temperature with a threshold; and starting a pump when the temperature exceeds the threshold."
RIGHT = "1. A method for cooling a battery comprising: measuring a temperature of the battery; comparing the temperature with a stored upper limit; opening a valve; and logging the temperature."


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    return f"{float(value):.9g}" if isinstance(value, (float, Decimal)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_has_the_columns_and_values_of_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.execute(catalog.ORACLE_SQL[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in rows)


def test_redline_of_the_fixture():
    d = sequence.redline("storing encrypted content on a processor;", "storing the encrypted content on a selected processor;")
    assert [(s["operation"], s["text"]) for s in d["segments"]] == [("equal", "storing"), ("insert", " the"), ("equal", " encrypted content on a "), ("insert", "selected "), ("equal", "processor;")]
    assert (d["before"], d["after"], d["unchanged"], d["inserted"], d["deleted"], d["blocks"]) == (7, 9, 7, 2, 0, 2)


def test_alignment_of_the_fixture(spark):
    from pyspark.sql import functions as F

    from clausegrid.functions import text as X

    row = spark.createDataFrame([(LEFT, RIGHT)], "a string, b string").select(X.limitations(F.col("a")).alias("a"), X.limitations(F.col("b")).alias("b")).first()
    items = sequence.align(row.a, row.b)
    assert [(i["left_index"], i["right_index"], i["similarity"], i["changed"]) for i in items if i["kind"] == "shared"] == [(0, 0, 1.0, False), (1, 1, 1.0, False), (2, 2, 0.796, True)]
    assert [i["left_index"] for i in items if i["kind"] == "removed"] == [3] and [i["right_index"] for i in items if i["kind"] == "added"] == [3, 4]


def test_batches_carry_over_what_exceeds_the_budget():
    assert sequence.batches([(0, 3), (0, 3)], 8, 4, 1) == [0, 1]
    assert sequence.batches([(0, 9), (0, 1)], 8, 4, 1) == [0, 1]


def test_mentions_and_segments():
    assert [(m["kind"], m["key"]) for m in sequence.mentions("A pump is coupled to the valve.")] == [("intro", "pump"), ("ref", "valve")]
    assert [s["kind"] for s in sequence.segments(LEFT)] == ["preamble", "limitation", "limitation", "limitation"]


def _unintroduced(text):
    seen, out = set(), []
    for m in sequence.mentions(text):
        if m["kind"] != "ref":
            seen.add(m["key"])
        elif m["key"] not in seen:
            out.append(m["text"])
    return out


def test_mentions_key_on_compounds_and_take_bare_nouns():
    assert _unintroduced("A system comprising a processor and the memory coupled to the processor.") == ["the memory"]
    assert _unintroduced("A method for storing content, the method comprising: receiving encrypted content; and storing the encrypted content.") == []
    assert _unintroduced("Coolant flows through a pipe, and the coolant is heated.") == []
    assert _unintroduced("A car with a battery pump, wherein the fuel pump is on.") == ["the fuel pump"]
    assert _unintroduced("A car with a fuel pump, wherein the electric fuel pump is on.") == []
    found = sequence.mentions("Coolant cools a cell.")
    assert found[0]["kind"] == "bare" and found[0]["key"] == "coolant" and all(found[i]["start"] < found[i + 1]["start"] for i in range(len(found) - 1))


def test_search_keeps_sentences_whole_after_abbreviations(spark):
    from clausegrid.operators import retrieval

    docs = spark.createDataFrame([(1, "See FIG. 2 for details. Smith et al. describe it. FIG. No. 5 is (old). Next one. (a) first.")], "doc_id long, text string")
    split = retrieval.split_sentences(docs, "\n", merge=True)
    merged = retrieval.merge_abbreviations(retrieval.split_sentences(docs, "\n"))
    assert sorted(r.sentence for r in split.collect()) == sorted(r.sentence for r in merged.collect())
    assert [r.sentence for r in split.orderBy("sentence_global_idx").collect()][:3] == ["See FIG. 2 for details.", "Smith et al. describe it.", "FIG. No. 5 is (old)."]


def test_enumerations_of_a_whole_table(spark):
    got = catalog.QUERIES["enumeration_islands_documents"](spark, SF)
    assert got.columns == ["claim_id", "island", "members"] and got.where("members NOT LIKE '%|%'").isEmpty()
