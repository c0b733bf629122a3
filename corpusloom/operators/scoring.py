"""Windows, language-model scores in bits per byte, agreement of two tokenizations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(ids: Column, size: int = 512) -> Column:
    """Array of windows that overlap by one id, so that each target is scored once; windows of one id are left out."""
    n = F.size(ids)
    starts = F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(ids, s + 1, size))


def unigram_nll(counts: DataFrame, held: DataFrame, k: float = 1.0) -> DataFrame:
    """(tokens, nll) of held counts(w, n) under add-k unigrams of counts(w, n); unseen words share one more type."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count("*").alias("v")).first()
    room = total["t"] + k * (total["v"] + 1)
    own = held.join(counts.withColumnRenamed("n", "c"), "w", "left")
    return own.agg(F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.ln((F.coalesce("c", F.lit(0)) + k) / F.lit(float(room)))).alias("nll"))


def window_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): neighbours inside windows of rows(ids); as windows overlap by one id, each neighbour of a document is there once."""
    n = F.greatest(F.size("ids") - 1, F.lit(0))
    return rows.select(F.explode(F.zip_with(F.slice("ids", F.lit(1), n), F.slice("ids", 2, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))).alias("p")).select("p.a", "p.b")


def bigram_nll(train: DataFrame, held: DataFrame, counts: DataFrame, k: float = 1.0) -> DataFrame:
    """(tokens, nll) of held pairs(a, b) under bigrams of train pairs(a, b) that fall back, by k, on add-one unigrams of counts(w, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count("*").alias("v")).first()
    room = float(total["t"] + total["v"] + 1)
    two = train.groupBy("a", "b").agg(F.count("*").alias("ab"))
    one = two.groupBy("a").agg(F.sum("ab").alias("a_n"))
    asked = held.groupBy("a", "b").agg(F.count("*").alias("n"))
    own = asked.join(two, ["a", "b"], "left").join(one, "a", "left").join(counts.select(F.col("w").alias("b"), F.col("n").alias("c")), "b", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = (zero("ab") + k * (zero("c") + 1) / F.lit(room)) / (zero("a_n") + k)
    return own.agg(F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.ln(p)).alias("nll"))


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    return nll / F.ln(F.lit(2.0)) / n_bytes


def restricted(counts: DataFrame, keep: DataFrame) -> DataFrame:
    """(w, p): the unigram softmax over kept words only."""
    kept = counts.join(keep.select("w").distinct(), "w", "left_semi")
    total = kept.agg(F.sum("n")).first()[0]
    return kept.select("w", (F.col("n") / F.lit(float(total or 1))).alias("p"))


def score_windows(rows: DataFrame, scorer: Callable[[list[list[int]]], list[float]], batch: int = 64) -> DataFrame:
    """rows(doc_id, win, ids) with nll by any scorer of id lists; a partition's windows go in batches of similar length."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            order = f["ids"].map(len).sort_values().index
            out = pd.Series(0.0, index=f.index)
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                out.loc[part] = scorer([list(x) for x in f.loc[part, "ids"]])
            yield pd.DataFrame({"doc_id": f["doc_id"], "win": f["win"], "targets": f["ids"].map(len) - 1, "nll": out})

    return rows.select("doc_id", "win", "ids").mapInPandas(run, "doc_id long, win int, targets long, nll double")


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(docs, identical, length_ratio): shares and means over documents, unweighted."""
    return pairs.agg(
        F.count("*").alias("docs"),
        F.avg((F.col(a) == F.col(b)).cast("int")).alias("identical"),
        F.avg(F.size(b) / F.greatest(F.size(a), F.lit(1))).alias("length_ratio"),
    )


def missing_tokens(pairs: DataFrame, vocab: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent tokens of `a` that the vocabulary lacks, in documents whose tokenizations differ."""
    gone = pairs.filter(F.col("a") != F.col("b")).select(F.explode("a").alias("token")).join(vocab.select("token").distinct(), "token", "left_anti")
    return gone.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


#: Bytes of text whose pairs are counted together.
CHUNK = 8 << 20


def bigrams(docs: DataFrame, text: str, tokens: Column) -> DataFrame:
    """(a, b, n): neighbours inside each row's token array, which is made of the text column.

    Texts are dealt to chunks of about `CHUNK` bytes, a task each; pairs are counted inside a chunk, where no shuffle is needed, then over chunks in as many parts as there
    are chunks. So a task's table of pairs grows neither with the table nor with the size of file splits, and a frequent pair is one row a chunk.
    """
    n = max((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // CHUNK + 1, docs.sparkSession.sparkContext.defaultParallelism)
    dealt = docs.select(text, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("_chunk")).repartitionById(n, "_chunk").select("_chunk", tokens.alias("t"))
    less = F.greatest(F.size("t") - 1, F.lit(0))
    two = F.zip_with(F.slice("t", F.lit(1), less), F.slice("t", F.lit(2), less), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    inside = dealt.select("_chunk", F.explode(two).alias("p")).groupBy("_chunk", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    return inside.repartition(n, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def greedy(pairs: DataFrame, start: str, n: int) -> list[str]:
    """The most frequent continuation again and again; ties by the least token. One row a step reaches the driver."""
    best = pairs.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("b")).cache()
    out = [start]
    try:
        for _ in range(n):
            r = best.filter(F.col("a") == out[-1]).select("b").first()
            if r is None:
                break
            out.append(r["b"])
    finally:
        best.unpersist()
    return out
