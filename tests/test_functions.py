"""Golden rows worked out by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

W = ["king", "of", "land", "be", "big", "town", "this", "it", "go"]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, n, bad, punct",
    [("Rome be big town", 4, [], 0), ("king of Paris; ROME abc1", 5, ["Paris", "ROME", "abc"], 1), ("", 0, [], 0), ("étage A", 2, ["tage", "A"], 1)],
)
def test_check(spark, text, n, bad, punct):
    r = one(spark, text, tx.check("text", W, ["Rome"]))
    assert (r["n_words"], r["bad"], r["bad_punct"]) == (n, bad, punct)
    assert r["oov_rate"] == len(bad) / max(n, 1)


def test_normalize(spark):
    assert one(spark, "This king go. It be Rome", tx.normalize("text", W, ["Rome"])) == "this king go. it be Rome"


@pytest.mark.parametrize("text, want", [("He said: go -- now!!", "He said. go now!"), ("a  ;b", "a.b"), ("a\n \n\n b ", "a\n\nb"), ("", "")])
def test_fix_punct(spark, text, want):
    assert one(spark, text, tx.fix_punct(F.col("text"))) == want


def test_apply_map(spark):
    assert one(spark, "seine, be big", tx.apply_map("text", {"seine": "big town"})) == "big town, be big"
    assert one(spark, "it's a", tx.apply_map("text", {"s": "", "a": "it's"})) == "it' it's"


def test_drop_bad_sentences(spark):
    r = one(spark, "king go. paris go! be big", tx.drop_bad_sentences("text", W))
    assert (r["text"], r["kept"], r["dropped"]) == ("king go. be big", 2, 1)
    r = one(spark, "paris.\n\n. . king!", tx.drop_bad_sentences("text", W))
    assert r["dropped"] == 1 and "paris" not in r["text"]


def test_chunks(spark):
    parts = ["a" * n for n in (5, 4, 3, 20, 2)]
    got = one(spark, "\n\n".join(parts), tx.pack_chunks(F.col("text"), 10))
    assert [[len(p) for p in c.split("\n\n")] for c in got] == [[5, 4], [3], [20], [2]]


def test_clean(spark):
    long_ = "x" * 70
    assert one(spark, f"Short\n  {long_}\n\nSee also\n{long_}y", tx.clean(F.col("text"))) == long_
    assert one(spark, "See also\nNo.", tx.clean(F.col("text"))) == ""


@pytest.mark.parametrize("title, n, want", [("List of X", 5000, False), ("X", 3000, True), ("X", 2999, False), ("X", 40001, False)])
def test_keep_article(spark, title, n, want):
    assert one(spark, "a" * n, tx.keep_article(F.lit(title), F.col("text"))) is want


def test_subject_names(spark):
    c = tx.subject_names("title", "text", [*W, "battle"])
    df = spark.createDataFrame([("Battle of Hastings (Ban)", "At Hastings it was"), ("Sun", "the sun Sun")], "title string, text string")
    assert [r["x"] for r in df.select(c.alias("x")).collect()] == [["Hastings"], []]


def test_lists_are_bounded():
    with pytest.raises(ValueError):
        tx.member("w", [str(i) for i in range(tx.MOST_WORDS + 1)])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab.,!;: \n?", max_size=30), min_size=1, max_size=5))
def test_fix_punct_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(tx.fix_punct(F.col("text")).alias("x")).collect():
        assert not re.search(r"[;:]|([.,?!])\1|[ \t]{2}|\s[.,?!]", r["x"])


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule", [lambda: tx.apply_map("text", {"The": "x", "the": "y"}, "allowed"), lambda: tx.check("text", ["the"], ["La"], "allowed")["bad"], lambda: tx.bad_words("text", ["the"], (), "allowed"),
                                  lambda: tx.normalize("text", ["the"], (), "allowed"), lambda: tx.drop_bad_sentences("text", ["the"], (), "allowed")["text"]])
def test_a_rows_allowed_names_are_found_once(spark, rule):
    """The array's expression stands outside the lambdas over words, so it is not evaluated for each of them."""
    df = spark.createDataFrame([("The the La Le. Der",), ("",), (None,)], "text string")
    derived = df.withColumn("allowed", F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 1)))
    out = derived.select(rule().alias("r"))
    plan = optimized(out)
    assert "array_contains(lambda" in plan and "array_contains(array_distinct" not in plan
    assert out.collect() == derived.localCheckpoint().select(rule().alias("r")).collect()


def test_allowed_names_stay(spark):
    df = spark.createDataFrame([("The the La.", ["The"]), ("The the La.", []), ("The the", None)], "text string, allowed array<string>")
    got = df.select(tx.apply_map("text", {"The": "x", "the": "y"}, "allowed").alias("m"), tx.check("text", ["the"], ["La"], "allowed")["bad"].alias("b")).collect()
    assert [r["m"] for r in got] == ["The y La.", "x y La.", "The the"] and [r["b"] for r in got[:2]] == [[], ["The"]]
