"""Embedding tables (id, embedding): gather, pad, mean of pieces, parameter counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pad_to(n: int, multiple: int = 64) -> int:
    return -(-n // multiple) * multiple


def sliced(vectors: DataFrame, numbers: DataFrame, dim: int, multiple: int = 64) -> DataFrame:
    """(id, embedding): rows of vectors(id, embedding) under their new ids, zero rows for ids without one and up to a multiple."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    own = numbers.join(vectors, numbers["old_id"] == vectors["id"], "left").select(F.col("new_id").alias("id"), F.coalesce("embedding", zeros).alias("embedding"))
    n = numbers.agg(F.max("new_id")).first()[0]
    n = 0 if n is None else n + 1
    padding = numbers.sparkSession.range(n, pad_to(n, multiple)).select(F.col("id").cast("int"), zeros.alias("embedding"))
    return own.unionByName(padding)


def mean_of_pieces(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """From pieces(token, id): the mean of each token's piece vectors, by dimension."""
    each = pieces.join(vectors, "id").select("token", F.posexplode("embedding").alias("dim", "x"))
    means = each.groupBy("token", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("embedding"))


def weight_std(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.explode("embedding").alias("x")).agg(F.stddev_samp(F.col("x").cast("double")).alias("std"), F.count("*").alias("weights"))


def random_rows(spark, ids: int, dim: int, std: float, seed: int = 0) -> DataFrame:
    """Normal vectors with the given deviation."""
    row = F.array(*[(F.randn(seed * 1000 + i) * std).cast("float") for i in range(dim)])
    return spark.range(ids).select(F.col("id").cast("int"), row.alias("embedding"))


def pruned_params(params: int, hidden: int, rows: int, kept: int, multiple: int = 64) -> int:
    """Parameters after slicing a tied embedding."""
    return params - hidden * (rows - pad_to(kept, multiple))


#: Weights (rows x dimensions) that the driver may hold for fine-tuning.
MOST_WEIGHTS = 50_000_000
#: Bytes of gradients gathered at once.
MOST_GATHERED = 128 << 20


def finetune(pairs: DataFrame, vectors: DataFrame, steps: int = 20, rate: float = 1e-2, decay: float = 0.01, b1: float = 0.9, b2: float = 0.999):
    """Fits tied vectors (id, embedding) to neighbour counts pairs(a, b, n): P(b | a) is a softmax of dot products, other weights don't move.

    Each step sums the gradient over the partitions of `pairs`, in double precision, and makes one AdamW update on the driver's copy; a step whose
    gradient is not finite is skipped. Returns the new vectors and the mean loss before each step.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    weights = vectors.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    if weights > MOST_WEIGHTS:
        raise ValueError("too many weights for one driver")
    rows = vectors.orderBy("id").collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    w = np.array([r["embedding"] for r in rows], np.float64)
    known = spark.createDataFrame([(int(i),) for i in ids], "id long")
    own = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n").join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    own = own.groupBy("a", "b").agg(F.sum("n").alias("n")).cache()

    def gradient(sent):
        def run(batches):
            e = sent.value
            g, loss, total = np.zeros_like(e), 0.0, 0
            for batch in batches:
                a, b = (np.searchsorted(ids, batch.column(i).to_numpy()) for i in (0, 1))
                n = batch.column(2).to_numpy().astype(np.float64)
                for s in range(0, len(a), 512):
                    x, y, k = a[s : s + 512], b[s : s + 512], n[s : s + 512]
                    z = e[x] @ e.T
                    z -= z.max(1, keepdims=True)
                    p = np.exp(z)
                    p /= p.sum(1, keepdims=True)
                    loss -= float((k * np.log(p[np.arange(len(x)), y])).sum())
                    total += int(k.sum())
                    p[np.arange(len(x)), y] -= 1
                    p *= k[:, None]
                    np.add.at(g, x, p @ e)
                    g += p.T @ e[x]
            if total:
                yield pa.RecordBatch.from_pydict({"loss": [loss], "n": pa.array([total], pa.int64()), "g": pa.array([g.tobytes()], pa.binary())})

        return run

    n_parts = own.rdd.getNumPartitions()
    m, v, t, losses = np.zeros_like(w), np.zeros_like(w), 0, []
    try:
        for _ in range(steps):
            g, loss, total = np.zeros_like(w), 0.0, 0
            parts = own.mapInArrow(gradient(spark.sparkContext.broadcast(w)), "loss double, n long, g binary")
            # one gradient a partition: together if they are small, else one after the other
            for r in parts.collect() if w.nbytes * n_parts <= MOST_GATHERED else parts.toLocalIterator():
                g, loss, total = g + np.frombuffer(r["g"]).reshape(w.shape), loss + r["loss"], total + r["n"]
            if not total:
                break
            losses.append(loss / total)
            g /= total
            if not np.isfinite(g).all():
                continue
            t += 1
            m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
            w = w - rate * (m / (1 - b1**t) / (np.sqrt(v / (1 - b2**t)) + 1e-8) + decay * w)
    finally:
        own.unpersist()
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, w)], "id int, embedding array<float>"), losses
