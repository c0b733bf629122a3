"""Library tokenizers over documents: usage, pruning reports and threshold sweeps. Tokenizer files are parameters."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import tokenizers


#: Code points of the texts that are encoded together; their ids and the library's records of them are what a worker holds.
SLICE = 1 << 20


def _slices(batches):
    """(rows, texts) of Arrow batches whose last column is the text, up to `SLICE` code points or one text at a time; null texts are empty."""
    for b in batches:
        column = b.column(b.num_columns - 1)
        start, size, texts = 0, 0, []
        for i in range(b.num_rows):
            t = column[i].as_py() or ""
            if texts and size + len(t) > SLICE:
                yield b.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        if texts:
            yield b.slice(start), texts


def _counted(batches, most: int, encode):
    """(token_id, n) of a task: the ids of encode(texts) are added up text by text, in one array as long as the vocabulary in use."""
    total = np.zeros(most, np.int64)
    for _, texts in _slices(batches):
        for ids in encode(texts):
            if len(ids):
                n = np.bincount(ids)
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["token_id", "n"])


def rank_file_usage(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(token_id, n): counts of each id, summed within tasks before anything is shuffled."""

    def rows(batches):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        most = max(ranks.values(), default=-1) + 1
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        del ranks
        yield from _counted(batches, most, lambda texts: (np.array(enc.encode_ordinary(t), np.int32) for t in texts))

    return docs.select("text").mapInArrow(rows, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def json_usage(docs: DataFrame, tok: dict) -> DataFrame:
    """The same for a tokenizer JSON."""
    sent = docs.sparkSession.sparkContext.broadcast(json.dumps(tok))

    def rows(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(sent.value)
        t.encode_special_tokens = True
        yield from _counted(batches, 0, lambda texts: (np.array(c.ids, np.int32) for c in t.encode_batch(texts, add_special_tokens=False)))

    return docs.select("text").mapInArrow(rows, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def compare(docs: DataFrame, old: dict, new: dict, *keep: str) -> DataFrame:
    """For each row whether both tokenizers give the same token strings, how many each gives, and whether the new one's ids decode to the text."""
    sent = docs.sparkSession.sparkContext.broadcast((json.dumps(old), json.dumps(new)))
    given = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def rows(batches):
        from tokenizers import Tokenizer

        a, b = map(Tokenizer.from_str, sent.value)
        a.encode_special_tokens = b.encode_special_tokens = True
        for batch, text in _slices(batches):
            x, y = (t.encode_batch(text, add_special_tokens=False) for t in (a, b))
            back = b.decode_batch([e.ids for e in y], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([p.tokens == q.tokens for p, q in zip(x, y)], pa.bool_()),
                    pa.array([len(p.ids) for p in x], pa.int64()),
                    pa.array([len(q.ids) for q in y], pa.int64()),
                    pa.array([p == q for p, q in zip(text, back)], pa.bool_()),
                ],
                [*keep, "same", "n_old", "n_new", "exact"],
            )

    return given.mapInArrow(rows, f"{schema}, same boolean, n_old long, n_new long, exact boolean")


def pruned(spark, tok: dict, ids: list[int], which: str = "all", close: bool = True) -> dict:
    """The tokenizer JSON pruned to the used ids and what they need."""
    vocab, merges, added = tokenizers.as_tables(spark, tok)
    used = vocab.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "id int")), "id", "left_semi")
    return tokenizers.to_json(tok, *tokenizers.prune(vocab, merges, added, used, which, close))


def sweep(docs: DataFrame, tok: dict, thresholds: list[int], train: str = "train") -> DataFrame:
    """One row for each threshold and split: vocabulary and merges left, share of documents cut the same, mean length ratio, exact round trips.

    docs(split, text); ids are counted on the train split only, once for all thresholds; what reaches the driver is one count for each id.
    """
    spark = docs.sparkSession
    usage = json_usage(docs.filter(F.col("split") == train), tok).collect()
    out = None
    for m in thresholds:
        new = pruned(spark, tok, [r["token_id"] for r in usage if r["n"] >= m])
        rows = compare(docs, tok, new, "split").groupBy("split").agg(
            F.count("*").alias("docs"), F.avg(F.col("same").cast("int")).alias("identical"),
            F.avg(F.col("n_new") / F.greatest(F.col("n_old"), F.lit(1))).alias("length_ratio"), F.bool_and("exact").alias("exact"),
        )
        rows = rows.select(F.lit(m).alias("m"), F.lit(len(new["model"]["vocab"])).alias("vocab"), F.lit(len(new["model"]["merges"])).alias("merges"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
