import pytest
from pyspark.sql import functions as F
from test_plans import plan

from brisktill.functions.text import has_term
from brisktill.operators import search

ROWS = [
    (1, "Café Crème", "A-100"), (2, "cafe creme", None), (3, None, None), (4, "", "x"), (5, "100% Wool", "a_b"),
    (6, "STRASSE", "ß"), (7, "Straße", "123"), (8, "日本 茶", "日"), (9, "Smørrebrød", "z"), (10, "ab", "abcabc"),
    (11, "éclair", "q"), (12, "Éclair au café", "q"), (13, "tab\there", "new\nline"), (14, "İstanbul", "I"),
]
TERMS = ["cafe", "CAFÉ", "é", "%", "_", "a", "ab", "abc", "strasse", "straße", "日", "茶 ", "o", "ø", "eclair", "É", "wool", "100", "zzz", "tab\t", "nothing here", "i", "ss"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, name string, barcode string")


def terms_of(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def test_matches_equal_a_scan_per_term(spark, table):
    index = search.gram_index(table, ["name", "barcode"])
    found = {tuple(r) for r in search.matches(terms_of(spark, TERMS), index, table, ["name", "barcode"]).collect()}
    expected = set()
    for term in TERMS:
        hit = table.filter(has_term(F.col("name"), term) | has_term(F.col("barcode"), term))
        expected |= {(term, r["id"]) for r in hit.collect()}
    assert found == expected


def test_null_empty_and_repeated_terms(spark, table):
    index = search.gram_index(table, ["name"])
    found = search.matches(terms_of(spark, [None, "", "ab", "ab"]), index, table, ["name"]).collect()
    assert sorted((r["term"], r["id"]) for r in found) == sorted([("", r[0]) for r in ROWS if r[1] is not None] + [("ab", 10), ("ab", 13)])
    assert search.matches(terms_of(spark, []), index, table, ["name"]).count() == 0
    none = table.limit(0)
    assert search.matches(terms_of(spark, TERMS), search.gram_index(none, ["name"]), none, ["name"]).count() == 0


def test_changed_rows_join_the_index(spark, table):
    index = search.gram_index(table, ["name", "barcode"])
    changed = spark.createDataFrame([(2, "tea", None), (99, "green tea", None)], table.schema)
    after = table.join(changed, "id", "left_anti").unionByName(changed)
    both = index.unionByName(search.gram_index(changed, ["name", "barcode"]))
    found = search.matches(terms_of(spark, ["tea", "crem"]), both, after, ["name", "barcode"]).collect()
    assert sorted(tuple(r) for r in found) == [("crem", 1), ("tea", 2), ("tea", 99)]


def test_too_many_terms_to_scan_for_are_refused(spark, table, monkeypatch):
    monkeypatch.setattr(search, "SCANNED_TERMS", 2)
    index = search.gram_index(table, ["name"])
    with pytest.raises(Exception, match="more than 2 terms"):
        search.matches(terms_of(spark, ["日", "茶", "本"]), index, table, ["name"]).collect()


def test_latin_terms_meet_the_index_by_equal_groups(spark, folder):
    from brisktill.registry.queries import QUERIES

    text = plan(QUERIES["bill_search_terms"](spark, folder))
    assert "NestedLoop" not in text and "Cartesian" not in text and "gram" in text


def test_index_is_taken_apart_by_many_tasks_and_never_shuffled_by_group(spark):
    text = F.concat(F.lit("common words "), F.col("id").cast("string"))
    table = spark.range(0, 60000, 1, 1).select("id", text.alias("name"))
    index = search.gram_index(table, ["name"])
    assert "hashpartitioning(id" in plan(index)
    asked = terms_of(spark, ["common", "words 7"])
    found = search.matches(asked, index, table, ["name"])
    joins = [line for line in plan(found).split("\n") if "Exchange hashpartitioning(gram" in line]
    assert not joins
    counts = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    assert counts == {"common": 60000, "words 7": table.filter("name like '%words 7%'").count()}
