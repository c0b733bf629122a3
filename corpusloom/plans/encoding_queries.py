"""Public tokenizers over the documents; their files' place is a parameter, and without them the queries are not registered."""

from pyspark.sql import functions as F

from corpusloom.operators import encodings, splits, tokenizers, words
from corpusloom.plans.catalog import register
from corpusloom.plans.common import HELD, TRAIN
from corpusloom.session import table

try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None


def docs(spark, d):
    return table(spark, d, "documents")


if public_tokenizers:

    @register("tokenizer_comparison")
    def tokenizer_comparison(spark, d):
        """For each rank file: tokens, distinct ids, bytes per token and the ids that cover 99 %."""
        size = docs(spark, d).agg(F.sum(F.octet_length("text"))).first()[0]
        out = None
        for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
            use = encodings.rank_file_usage(docs(spark, d), public_tokenizers.path(name), public_tokenizers.PATTERN).withColumnRenamed("token_id", "w")
            levels = words.ids_for_share(use, [99]).select(F.col("ids").alias("ids_99"))
            row = use.agg(F.sum("n").alias("n_tokens"), F.count("*").alias("distinct_ids")).select(F.lit(name).alias("tokenizer"), "*", F.round(F.lit(size) / F.col("n_tokens"), 4).alias("bytes_per_token"))
            row = row.withColumn("ids_99", F.lit(levels.first()["ids_99"]))
            out = row if out is None else out.unionByName(row)
        return out

    @register("prune_sweep")
    def prune_sweep(spark, d):
        """A public tokenizer pruned at several thresholds to what the train split uses, held against the original on both splits."""
        rows = docs(spark, d).select("doc_id", "text", F.octet_length("text").cast("long").alias("b"))
        rows = splits.budget_split(rows, "doc_id", "b", HELD, TRAIN).filter("split <> 'dropped'").select("split", "text")
        return encodings.sweep(rows, tokenizers.load_json(public_tokenizers.path("byte_bpe_50k.json")), [1, 5, 20, 100])
