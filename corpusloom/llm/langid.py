"""Language identification: multinomial naive Bayes over hashed character n-grams.

The characters of a text are lower-cased, everything but letters becomes one space, and the 1- to 3-grams of the
result are hashed into a fixed number of buckets. Training counts them by language on a bounded sample of the labelled texts:
about `most_rows` distinct texts in all, an equal share for each language, picked by a hash of the text (a language that has fewer gives all it
has). Counts are sums by language and bucket in the JVM, so their result does not depend on the layout of the files. The log-probability matrix
is broadcast in blocks of at most `MOST_LANGS` languages (64 MB); batches of whole texts are scored as sparse rows in numpy, one block
after the other where there are several. Priors are the languages' shares of all labelled rows.

Defined cases: a null text or one without a letter is `und` with score 0; without any training row, or in an empty table, all are `und`;
rows whose lang is null, or whose text is null or has no letter, teach nothing; ties go to the language first in code-point order. Equal texts of a
language teach once, however often and under whatever doc_id, null or not, they occur. Very long texts are scored whole. The columns that are kept may have any name
but `lang_pred` and `score`, whose place is taken.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import runs, staged
from corpusloom.session import table

#: Log2 of the buckets; orders of the n-grams; added count; sampled training texts; languages of a block.
BITS, ORDERS, ALPHA, MOST_ROWS, MOST_LANGS = 16, (1, 2, 3), 0.5, 60_000, 256
UND = "und"
#: Rows whose texts are Python strings at once.
ROWS = 1024


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point to a 64-bit code of its lower-case letter; 1 for everything that is no letter."""
    import unicodedata

    out = np.ones(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[cp] = ord(low[0]) + 1
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, the texts they belong to (as starts in the buckets), and letters in each."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t) for t in texts], np.int64)
    code = _fold()[raw]
    doc = np.repeat(np.arange(len(texts)), size)
    letter = code > 1
    letters = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()  # one space for each run of others
    keep[1:] |= letter[:-1]
    code, doc = code[keep].astype(np.uint64), doc[keep]
    out, own = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            whole = doc[:m] == doc[n - 1 :]
            with np.errstate(over="ignore"):
                out.append((((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)[whole])
            own.append(doc[:m][whole])
    return (np.concatenate(out), np.concatenate(own), letters) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), letters)


#: Languages whose dense counts a task holds at once, and rows of counts in a batch that it gives.
HELD_LANGS, PIECE = 64, 1 << 16
#: Languages of a count table that may be broadcast for sampling.
MOST_SENT = 100_000


def _counts(batches):
    """(lang, text) to the counts that are not 0 of each language's buckets; bucket -1 counts texts with a letter."""

    def given(held: dict):
        for lang, x in held.items():
            on = np.flatnonzero(x)
            for a in range(0, len(on), PIECE):
                k = on[a : a + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array((k - 1).astype(np.int32)), pa.array(x[k])], ["lang", "bucket", "n"])

    held: dict[str, np.ndarray] = {}
    for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
        text, lang = b.column(1).to_pylist(), np.array(b.column(0).to_pylist(), object)
        size = np.r_[0, np.cumsum([len(t) for t in text])]
        for a, z in runs(size, 1 << 18):
            g, own, letters = _grams(text[a:z])
            for name in sorted(set(lang[a:z])):
                mine = lang[a:z] == name
                x = held.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                x[1:] += np.bincount(g[mine[own]], minlength=1 << BITS)
                x[0] += int((letters[mine] > 0).sum())
            if len(held) > HELD_LANGS:
                yield from given(held)
                held = {}
    yield from given(held)


class Block:
    """Some of the languages, their log priors, and the log-probability matrix, bucket by language."""

    def __init__(self, langs: list[str], share: np.ndarray, counts: np.ndarray):
        self.langs = langs
        self.prior = np.log(share).astype(np.float32)
        p = counts + ALPHA
        self.logp = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the best language's number (-1 without a letter), its log score, and the log of the sum over the block's languages."""
        best, top, total = [], [], []
        size = np.r_[0, np.cumsum([len(t) for t in texts])]
        for a, z in runs(size, 1 << 18):
            g, own, letters = _grams(texts[a:z])
            x = np.stack([np.bincount(own, self.logp[:, i][g], z - a) for i in range(len(self.langs))], 1) + self.prior
            k = x.argmax(1)
            m = x[np.arange(z - a), k]
            best.append(np.where(letters > 0, k, -1))
            top.append(m)
            total.append(m + np.log(np.exp(x - m[:, None]).sum(1)))
        return tuple(np.concatenate(v) if v else np.zeros(0) for v in (best, top, total))


class Model:
    """Languages in code-point order, in blocks."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    @property
    def langs(self) -> list[str]:
        return [x for b in self.blocks for x in b.langs]


def train(labelled: DataFrame, most_rows: int = MOST_ROWS, block: int = MOST_LANGS) -> Model | None:
    """From (text, lang); None if there is nothing to learn from."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = staged(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("texts")))
    langs = sizes.count()
    if not langs:
        return None
    quota = max(1, most_rows // langs)
    known = sizes.select(F.col("lang").alias("_lang"), "texts")
    picked = rows.join(F.broadcast(known) if langs <= MOST_SENT else known, F.col("lang") == F.col("_lang"))
    picked = picked.filter(F.pmod(F.xxhash64(F.lit("langid sample"), "h"), F.greatest("texts", F.lit(1))) < quota)
    counts = picked.select("lang", "text").distinct().mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = staged(counts) if langs > block else counts
    # a name and a few numbers for each language
    seen = {r["lang"]: r["rows"] for r in sizes.toLocalIterator()}
    names = sorted(seen)
    blocks, total = [], sum(seen.values())
    for a in range(0, langs, block):
        own = names[a : a + block]
        # at most `block` x 65,537 rows of numbers
        got = (counts if langs <= block else counts.filter(F.col("lang").between(own[0], own[-1]))).toArrow()
        at = {x: i for i, x in enumerate(own)}
        lang = got.column("lang").combine_chunks().dictionary_encode()
        number = np.array([at[x] for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()] if got.num_rows else np.zeros(0, np.int64)
        dense = np.zeros((len(own), (1 << BITS) + 1), np.int64)
        dense[number, got.column("bucket").to_numpy() + 1] = got.column("n").to_numpy()
        keep = np.flatnonzero(dense[:, 0])
        if len(keep):
            blocks.append(Block([own[i] for i in keep], np.array([seen[own[i]] for i in keep]) / total, dense[keep, 1:]))
    return Model(blocks) if blocks else None


_STATE = "__langid_name string, __langid_best double, __langid_sum double"


def _scored(sent, names: list[str]):
    """Columns, the text, and what the blocks before found, with this block's findings taken in."""

    def rows(batches):
        m = sent.value
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            n = b.num_columns
            k, top, total = m.score([t or "" for t in b.column(n - 4).to_pylist()])
            name, best, all_ = b.column(n - 3).to_pylist(), b.column(n - 2).to_numpy(zero_copy_only=False), b.column(n - 1).to_numpy(zero_copy_only=False)
            name = [m.langs[i] if i >= 0 and x > y else old for i, x, y, old in zip(k.astype(int).tolist(), top, best, name)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(name, pa.string()), pa.array(np.maximum(best, top)), pa.array(np.logaddexp(all_, total))], names)

    return rows


def _told(docs: DataFrame, model: Model, keep: list[str]) -> tuple[DataFrame, Column, Column]:
    """The `keep` columns and internal ones, and the prediction (null for und) and score as columns of these."""
    none = F.lit(float("-inf"))
    given = docs.select(*keep, F.col("text").alias("__langid_text"), F.lit(None).cast("string").alias("__langid_name"), none.alias("__langid_best"), none.alias("__langid_sum"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-3])
    for block in model.blocks:
        given = given.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(block), given.columns), f"{schema}, {_STATE}")
    name = F.col("__langid_name")
    return given, name, F.when(name.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("__langid_best") - F.col("__langid_sum"))))


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The `keep` columns with lang_pred and score, which take the place of columns of these names."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    told, name, score = _told(docs, model, keep)
    return told.select(*keep, F.coalesce(name, F.lit(UND)).alias("lang_pred"), score.alias("score"))


def with_known_language(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows whose prediction is a language at a score of `least` or more; their columns as they were, whatever their names."""
    if model is None:
        return docs.limit(0)
    told, name, score = _told(docs, model, docs.columns)
    return told.filter(name.isNotNull() & (score >= least)).select(*docs.columns)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs, train(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])
