"""Readers and writers over whole tables: what is written is read back and must be what it was."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import LETTER_SEGMENTS
from corpusloom.operators import tokenizers, words
from corpusloom.plans.catalog import register
from corpusloom.plans.common import COUNTS, WORDS
from corpusloom.session import table
from corpusloom.sources import checkpoints, files
from corpusloom.streaming.resume import resume_stream

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
SAME = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def digest(df):
    return df.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("jsonl_round_trip", SAME)
def jsonl_round_trip(spark, d):
    path = checkpoints.new_path(spark)
    files.write_jsonl(docs(spark, d), path)
    return digest(files.read_jsonl(spark, path, ROW))


@register("resumed_append", SAME)
def resumed_append(spark, d):
    """Two runs: the first is given a part, the second all; each appends what is missing."""
    path = checkpoints.new_path(spark)
    files.append_missing(docs(spark, d).filter("doc_id % 3 = 0"), path, "doc_id")
    files.append_missing(docs(spark, d), path, "doc_id")
    return digest(spark.read.parquet(path))


@register("resumed_stream", SAME)
def resumed_stream(spark, d):
    """The same as a stream of JSON lines: ids that came before are passed over."""
    top = checkpoints.new_path(spark)
    for some in ("doc_id % 3 = 0", "true"):
        files.write_jsonl(docs(spark, d).filter(some), f"{top}/in", "append")
        resume_stream(spark, f"{top}/in", ROW, "doc_id", f"{top}/out", f"{top}/log")
    return digest(spark.read.schema(ROW).parquet(f"{top}/out"))


@register("cached_lengths", f"SELECT w, length(w) AS n FROM (SELECT DISTINCT w FROM ({WORDS}))")
def cached_lengths(spark, d):
    """A cached table of word types: asked for some, then for all."""
    path = checkpoints.new_path(spark)
    asked = words.counts(docs(spark, d)).select("w")
    make = lambda df: df.withColumn("n", F.length("w").cast("long"))
    files.cached_table(spark, path, asked.filter("w < 'n'"), "w", make)
    return files.cached_table(spark, path, asked, "w", make)


@register("word_list_round_trip", f"SELECT w FROM ({COUNTS}) WHERE n >= 3")
def word_list_round_trip(spark, d):
    path = checkpoints.new_path(spark)
    files.write_words(words.counts(docs(spark, d)).filter("n >= 3"), "w", path)
    return files.read_words(spark, path)


@register("json_array_round_trip", f"SELECT row_number() OVER (ORDER BY n DESC, w) - 1 AS pos, w AS value FROM (SELECT w, n FROM ({COUNTS}) ORDER BY n DESC, w LIMIT 500)")
def json_array_round_trip(spark, d):
    path = checkpoints.new_path(spark)
    top = words.top_words(docs(spark, d), 500)
    files.write_json_array(top.withColumn("o", F.struct(-F.col("n"), "w")), "w", "o", path)
    return files.read_json_array(spark, path).select(F.col("pos").cast("long").alias("pos"), "value")


@register("saved_tables", "SELECT vec_id, len(embedding) AS dim FROM embeddings")
def saved_tables(spark, d):
    """A checkpoint of tables, saved and loaded."""
    path = checkpoints.new_path(spark)
    checkpoints.save_tables({"vectors": table(spark, d, "embeddings")}, path)
    return checkpoints.load_tables(spark, path, ["vectors"])["vectors"].select("vec_id", F.size("embedding").cast("long").alias("dim"))


@register("byte_alphabet", r"SELECT doc_id, strlen(text) AS n_bytes, true AS exact FROM documents")
def byte_alphabet(spark, d):
    """Texts as byte-level characters, one for each byte, and back."""
    b = tokenizers.as_bytes(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(b).cast("long").alias("n_bytes"), (tokenizers.from_bytes(b) == F.col("text")).alias("exact"))


@register("segments_cover_texts", "SELECT doc_id, length(text) AS n_chars FROM documents")
def segments_cover_texts(spark, d):
    """Letter segments put together again are the text."""
    parts = F.regexp_extract_all("text", F.lit(LETTER_SEGMENTS), F.lit(0))
    return docs(spark, d).select("doc_id", F.length(F.array_join(parts, "")).cast("long").alias("n_chars"))
