"""The same rules over lists that are tables of any size: words meet their list by a join over word types, not occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import LETTER_SEGMENTS, extract
from corpusloom.operators.words import exploded


def off_list_words(docs: DataFrame, words: DataFrame, names: DataFrame) -> DataFrame:
    """(w, n): word types that break the rules, with their occurrences. words(w) and names(w) are tables."""
    types = exploded(docs, "[A-Za-z]+").groupBy("w").agg(F.count("*").alias("n"))
    low = types.filter(F.col("w").rlike("^[a-z]+$")).join(words.select("w").distinct(), "w", "left_anti")
    cap = types.filter(F.col("w").rlike("^[A-Z][a-z]*$")).join(names.select("w").distinct(), "w", "left_anti")
    odd = types.filter(~F.col("w").rlike("^([a-z]+|[A-Z][a-z]*)$"))
    return low.unionByName(cap).unionByName(odd)


def replace_words(docs: DataFrame, key: str, replace: DataFrame) -> DataFrame:
    """docs(key, text) with each run of letters replaced by its row in replace(word, repl), which has a word once; one pass, no re-scan.

    A row's distinct words meet the table, only those that are in it come back, by the key and a 128-bit hash of the text, and the text is rewritten where it
    stands. So what moves is the texts once, and the distinct words only if the table is too large to be sent to all. Rows that share a key, null or not, are
    texts of their own; rows that share both share their replacements and stay as many.
    """
    texts = docs.select(key, "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(7), "text").alias("_h2"))
    found = texts.select(F.col(key).alias("_k"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), F.explode(F.array_distinct(extract(F.col("text"), "[A-Za-z]+"))).alias("word"))
    hits = found.join(replace.filter("repl IS NOT NULL").select("word", "repl"), "word")
    hits = hits.groupBy("_k", "_g1", "_g2").agg(F.collect_set(F.struct("word", "repl")).alias("hits"))
    both = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    # a map is searched from end to end: a row's replacements are dealt over maps of about 16, by the word's hash
    of = "pmod(hash({}), 1 + size(hits) div 16)"
    parts = f"transform(sequence(0, size(hits) div 16), k -> map_from_entries(filter(hits, h -> {of.format('h.word')} = k)))"
    new = f"array_join(transform(regexp_extract_all(text, '{LETTER_SEGMENTS}', 0), x -> coalesce(try_element_at(ms[{of.format('x')}], x), x)), '')"
    joined = texts.join(hits, both, "left")
    return joined.select(key, F.expr(f"CASE WHEN hits IS NULL THEN text ELSE transform(array({parts}), ms -> {new})[0] END").alias("text"))


def valid_replacements(replace: DataFrame, words: DataFrame) -> DataFrame:
    """Entries whose replacement has only listed words; an empty one deletes and is valid."""
    each = replace.select("word", F.explode(extract(F.col("repl"), "[A-Za-z]+")).alias("w"))
    bad = each.join(words.select("w").distinct(), "w", "left_anti").select("word").distinct()
    return replace.join(bad, "word", "left_anti")


def parse_labels(answers: DataFrame, key: str, text: str, labels: tuple[str, ...], size: str) -> DataFrame:
    """(key, number, label) from answer lines like `3) nature`; numbers within 1..size, known labels, the last line of a number counts."""
    pattern = r"^\s*(\d+)[\s.:)-]+([a-z_0-9]+)"
    lines = answers.select(key, size, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    found = lines.select(key, size, "pos", F.expr(f"try_cast(regexp_extract(line, '{pattern.replace(chr(92), chr(92) * 2)}', 1) AS int)").alias("number"), F.regexp_extract("line", pattern, 2).alias("label"))
    return found.filter(F.col("number").between(F.lit(1), F.col(size)) & F.col("label").isin(*labels)).groupBy(key, "number").agg(F.max_by("label", "pos").alias("label"))


def parse_map(answers: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """(word, repl) from lines like `word => other`; words that were asked only; `-` or nothing deletes; the last line of a word counts."""
    lines = answers.select(F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.contains("line", F.lit("=>")))
    half = F.split("line", "=>", 2)
    pairs = lines.select("pos", F.trim(half[0]).alias("word"), F.lower(F.trim(half[1])).alias("r"))
    pairs = pairs.join(asked.select("word").distinct(), "word", "left_semi")
    return pairs.groupBy("word").agg(F.max_by(F.when(F.col("r") == "-", "").otherwise(F.col("r")), "pos").alias("repl"))


def complete_documents(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Documents from chunks(doc_id, k, split) and done(doc_id, k, text): text in chunk order; held ones only if no chunk is missing."""
    all_ = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("split").alias("split"))
    parts = done.groupBy("doc_id").agg(F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    out = all_.join(parts, "doc_id").withColumn("complete", F.col("chunks") == F.col("parts"))
    return out.filter((F.col("split") == "train") | F.col("complete"))
