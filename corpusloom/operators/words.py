"""Word and token statistics: one pass over the texts, then tables of word types."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import MONTHS_DAYS, extract

LETTERS = "[A-Za-z]+"
TOKEN = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\s]+"


def exploded(docs: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """One row for each match in the texts, as `w`."""
    return docs.select(*keep, F.explode(extract(F.col("text"), pattern)).alias("w"))


def counts(docs: DataFrame, pattern: str = LETTERS) -> DataFrame:
    return exploded(docs, pattern).groupBy("w").agg(F.count("*").alias("n"))


def top_words(docs: DataFrame, k: int, pattern: str = LETTERS) -> DataFrame:
    return counts(docs, pattern).orderBy(F.desc("n"), "w").limit(k)


def closed_list(docs: DataFrame, k: int) -> list[str]:
    """The k most frequent lower-case words: a bounded list for the driver."""
    return [r["w"] for r in top_words(docs, k, "[A-Za-z]+").select("w", "n").collect() if r["w"].islower()]


#: Whole words: lower-case ones, and capitalised ones that start no sentence (the two characters before say so).
CASED = (
    r"(?<![\p{L}\p{N}_])(?:[a-z]+|(?!^)(?<![.!?\n])(?<![.!?\n]\s)(?<!\n[\s\S])[A-Z][a-z]+)(?![\p{L}\p{N}_])"
)


def whole_word_cases(docs: DataFrame) -> DataFrame:
    """Per word type in lower case: low (lower-case uses), cap (capitalised uses inside sentences), df (documents with such a use)."""
    each = exploded(docs, CASED, "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    is_low = F.col("w").rlike("^[a-z]+$")
    return each.groupBy(F.lower("w").alias("w")).agg(
        F.sum(F.when(is_low, F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(is_low, 0).otherwise(F.col("n"))).alias("cap"),
        F.count_if(~is_low).alias("df"),
    )


def core_names(docs: DataFrame, words: Collection[str], least_df: int = 50) -> DataFrame:
    """Names: capitalised inside sentences in at least `least_df` documents, seldom in lower case, no list word, month or day."""
    t = whole_word_cases(docs)
    t = t.filter((F.col("df") >= least_df) & (F.col("low") * 10 <= F.col("cap")) & ~F.col("w").isin([m.lower() for m in MONTHS_DAYS]))
    if words:
        t = t.filter(~F.col("w").isin(list(words)))
    return t.select(F.initcap("w").alias("name"), "df", "cap", "low")


def histogram(counted: DataFrame) -> DataFrame:
    """(n, types): how many word types occur n times; small, since counts repeat."""
    return counted.groupBy("n").agg(F.count("*").alias("types"))


def coverage_levels(counted: DataFrame) -> DataFrame:
    """For each count, highest first: types and tokens before it, and the total. The window runs over distinct counts only."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("n"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = histogram(counted)
    return h.select(
        "n", "types",
        F.coalesce(F.sum("types").over(before), F.lit(0)).alias("types_before"),
        F.coalesce(F.sum(F.col("n") * F.col("types")).over(before), F.lit(0)).alias("tokens_before"),
        F.sum(F.col("n") * F.col("types")).over(Window.partitionBy()).alias("total"),
    )


def ids_for_share(counted: DataFrame, percents: list[int]) -> DataFrame:
    """(percent, ids): how many of the most frequent types cover the share; whole numbers only, so no ties by rounding."""
    levels = coverage_levels(counted).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    need = F.ceil(F.col("total") * F.col("percent") / 100).cast("long")
    inside = (F.col("tokens_before") < need) & (need <= F.col("tokens_before") + F.col("n") * F.col("types"))
    return levels.filter(inside).select("percent", (F.col("types_before") + F.ceil((need - F.col("tokens_before")) / F.col("n"))).cast("long").alias("ids"))


def coverage_at(counted: DataFrame, points: list[int]) -> DataFrame:
    """(k, tokens, total): tokens that the k most frequent types cover; k beyond the last type is the last."""
    levels = coverage_levels(counted).withColumn("k", F.explode(F.array(*map(F.lit, points))))
    end = F.col("types_before") + F.col("types")
    own = levels.withColumn("covered", F.col("tokens_before") + F.col("n") * F.greatest(F.lit(0), F.least(F.col("k"), end) - F.col("types_before")))
    return own.filter(F.col("types_before") < F.col("k")).groupBy("k").agg(F.max("covered").alias("tokens"), F.max("total").alias("total"))


def pairs_in_words(words: DataFrame) -> DataFrame:
    """From (w, n): adjacent character pairs inside words, weighted by n, counted over word types."""
    two = F.expr("transform(sequence(1, length(w) - 1), i -> struct(substring(w, i, 1) AS a, substring(w, i + 1, 1) AS b))")
    return words.filter(F.length("w") > 1).select(F.explode(two).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def in_set(c: Column, words: Collection[str]) -> Column:
    return c.isin(list(words)) if words else F.lit(False)
