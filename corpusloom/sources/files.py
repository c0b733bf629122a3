"""Readers and writers: Parquet columns, JSON lines, JSON arrays, text lists, resumable appends and cached tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "text")])
TOPIC = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "topic")])
CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "article_id", "split", "topic", "title")]
    + [T.StructField("k", T.IntegerType()), T.StructField("subject", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]
)
REWRITE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "article_id", "split", "topic", "title")]
    + [T.StructField("subject", T.ArrayType(T.StringType())), T.StructField("caveman", T.StringType()), T.StructField("attempts", T.IntegerType())]
    + [T.StructField("oov_rate", T.DoubleType()), T.StructField("bad", T.ArrayType(T.StringType())), T.StructField("bad_punct", T.IntegerType())]
    + [T.StructField("len_ratio", T.DoubleType()), T.StructField("usage", T.MapType(T.StringType(), T.LongType()))]
    + [T.StructField("first_oov", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
)


def parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def pick_shards(shards: list[str], k: int, seed: int = 0) -> list[str]:
    """k shard paths in a seeded order that doesn't depend on the list's."""
    import hashlib

    return sorted(sorted(shards, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))[:k])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def local_dataset(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there: a local copy first, then remote ones."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a JSON array of strings; such a file is one record, whatever the engine."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))


def write_json_array(df: DataFrame, column: str, order: str, path: str) -> None:
    """One JSON array in the given order. Such a file is one record, so this is for small tables (lists of words, labels); write_jsonl is for large ones."""
    ordered = df.select(order, F.to_json(F.array(column)).alias("j")).orderBy(order)
    body = ordered.select(F.expr("substring(j, 2, length(j) - 2)").alias("value"))
    whole = body.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    whole.write.text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(w): distinct words of a text file; none if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "w string")
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).filter("w <> ''").distinct()


def write_words(df: DataFrame, column: str, path: str) -> None:
    df.select(column).orderBy(column).coalesce(1).write.text(path)


def append_missing(work: DataFrame, path: str, key: str, make=lambda df: df) -> int:
    """Appends make(rows whose key is not at the path yet) as Parquet; how many were missing."""
    from corpusloom.operators.splits import remaining

    spark = work.sparkSession
    try:
        done = spark.read.parquet(path)
        work = remaining(work, done, key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    n = work.count()
    if n:
        make(work).write.mode("append").parquet(path)
    return n


def cached_table(spark: SparkSession, path: str, asked: DataFrame, key: str, make) -> DataFrame:
    """The table at the path, with make(missing keys) added to it first."""
    append_missing(asked.select(key).distinct(), path, key, make)
    return spark.read.parquet(path)


def write_results(results: dict, path: str) -> None:
    """Small nested results as indented JSON on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(results, f, indent=1, default=str, ensure_ascii=False)


def render(template: str, values: dict, formats: dict[str, str] | None = None) -> str:
    """A report from results: {name} with an optional format each."""
    for k, v in values.items():
        spec = (formats or {}).get(k)
        template = template.replace("{" + k + "}", format(v, spec) if spec else str(v))
    return template


def percent(x: float, digits: int = 1) -> str:
    return f"{100 * x:.{digits}f} %"
