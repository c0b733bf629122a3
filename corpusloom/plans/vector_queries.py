"""Embedding rows: gather, pad, means, deviations, parameter counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import vectors
from corpusloom.plans.catalog import register
from corpusloom.session import table

DIM = 64


def rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("id"), "embedding")


NUMBERS = "n AS (SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE vec_id % 3 = 0)"


@register(
    "embedding_slice_pad",
    f"""WITH {NUMBERS}, p AS (SELECT new_id AS id, embedding FROM n JOIN embeddings ON vec_id = old_id UNION ALL
SELECT r.i, list_transform(range(0, {DIM}), lambda x: 0.0::FLOAT) FROM range((SELECT count(*) FROM n), (SELECT (count(*) + 63) // 64 * 64 FROM n)) r(i))
SELECT id::INT AS id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM p""",
)
def embedding_slice_pad(spark, d):
    v = rows(spark, d)
    numbers = v.filter("id % 3 = 0").select(F.col("id").alias("old_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("new_id"))
    out = vectors.sliced(v, numbers, DIM)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("id", F.size("embedding").cast("long").alias("dim"), F.round(total, 4).alias("total"))


@register(
    "mean_pieces",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL)
SELECT label, count(*) AS dim, round(sum(x), 4) AS total, round(max(x), 4) AS most FROM m GROUP BY label""",
)
def mean_pieces(spark, d):
    """Each label's vector as the mean of its members'."""
    e = table(spark, d, "embeddings")
    pieces = e.select(F.col("label").cast("string").alias("token"), F.col("vec_id").cast("int").alias("id"))
    m = vectors.mean_of_pieces(pieces, rows(spark, d))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return m.select(F.col("token").cast("int").alias("label"), F.size("embedding").cast("long").alias("dim"), F.round(total, 4).alias("total"), F.round(F.array_max("embedding"), 4).alias("most"))


@register("weight_std", "SELECT round(stddev_samp(x), 6) AS std, count(*) AS weights FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def weight_std(spark, d):
    return vectors.weight_std(rows(spark, d)).select(F.round("std", 6).alias("std"), "weights")


@register("random_rows")
def random_rows(spark, d):
    std = vectors.weight_std(rows(spark, d)).first()["std"]
    return vectors.random_rows(spark, 100, DIM, std)


@register(
    "param_accounting",
    f"WITH {NUMBERS}, c AS (SELECT count(*) AS kept, (SELECT count(*) FROM embeddings) AS had FROM n) SELECT had * {DIM} AS params, had * {DIM} - {DIM} * (had - (kept + 63) // 64 * 64) AS pruned FROM c",
)
def param_accounting(spark, d):
    v = rows(spark, d)
    r = v.agg(F.count("*").alias("had"), F.count_if(F.col("id") % 3 == 0).alias("kept")).first()
    return spark.createDataFrame([(r["had"] * DIM, vectors.pruned_params(r["had"] * DIM, DIM, r["had"], r["kept"]))], "params long, pruned long")


@register("embedding_finetune")
def embedding_finetune(spark, d):
    """Letter vectors fitted to the letters' neighbours in words: the mean loss before each step."""
    from corpusloom.operators import words

    p = words.pairs_in_words(words.counts(table(spark, d, "documents"))).filter("a RLIKE '^[a-z]$' AND b RLIKE '^[a-z]$'")
    p = p.select((F.ascii("a") - 97).alias("a"), (F.ascii("b") - 97).alias("b"), "n")
    _, losses = vectors.finetune(p, rows(spark, d).filter("id < 26"), 10, 0.05)
    return spark.createDataFrame(list(enumerate(losses)), "step int, loss double")
