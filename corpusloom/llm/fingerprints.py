"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Every word 5-shingle is hashed once; the top bits of the hash name its bin and a bin keeps its least hash. An empty bin
borrows from the first full bin in its own pseudo-random order of all bins (optimal densification); the fingerprint is
the low byte of each bin's hash, and likeness corrects the share of equal bytes for chance (1 in 256).

Per document this is one expression over arrays: words, word hashes, shingle hashes, a sort, and the first hash of
each bin, so a fingerprint needs no shuffle. Words are runs of other than ASCII white space, in lower case.

The document that follows in ascending doc_id is found on rows of keys alone (doc_id and a 128-bit text hash), dealt by sampled ranges of as many rows
(`RANGE`) whatever the table's size, so no window holds a text. What a document needs of the next one (its fingerprint, and its beginning) is then fetched by that
key, and meets the document by its own; both joins read one exchange of the texts.

Defined cases: a text of one to four words is one shingle; null, empty and blank texts have the shingle of the empty
string, so they are alike among themselves and to nothing else; equal texts have equal fingerprints; very long texts are taken whole. Rows that repeat a doc_id
follow one another, ordered by a hash of their text; those that repeat the text too are one document with one result for each row; a null doc_id comes first in the
order (the least long counts as null); a single document follows itself; an empty table gives none. Columns other than doc_id and text may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusloom.llm.common import NO_ID, row_key, spread, staged
from corpusloom.session import table

#: Words in a shingle; log2 of the bins; probes made one by one; rows of keys in a range.
WORDS, BIN_BITS, TRIES, RANGE = 5, 7, 6, 200_000
KEY = ["k0", "k1", "k2"]
BINS = 1 << BIN_BITS


def _words(text: str) -> str:
    return f"transform(filter(split(lower(coalesce({text}, '')), '\\\\s+'), x -> x <> ''), x -> xxhash64(x))"


def _shingles(w: str) -> str:
    """Hashes of the shingles of an array of word hashes."""
    of = ", ".join(f"{w}[i + {k}]" for k in range(WORDS))
    short = ", ".join(f"get({w}, {k})" for k in range(WORDS - 1))
    return f"CASE WHEN size({w}) >= {WORDS} THEN transform(sequence(0, size({w}) - {WORDS}), i -> xxhash64({of})) ELSE array(xxhash64(size({w}), {short})) END"


def _ints(values, kind: str = "") -> str:
    return "array(" + ", ".join(f"{v}{kind}" for v in values) + ")"


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, an array of the low byte of each bin (less 128), for a text column. The steps are columns of their own, so that none is computed twice."""
    w, h, s = (f"_{out}_{x}" for x in "whs")
    shift, low = 64 - BIN_BITS, (1 << 64 - BIN_BITS) - 1
    # each bin gets its greatest value as a mark, so that after sorting every bin has a first element; the mark says it is empty
    marks = _ints(((j << shift) | low for j in range(-BINS // 2, BINS // 2)), "L")
    # bin j tries start + t * stride with an odd stride: every bin once, in an order of its own
    start, stride = _ints((j * 40503 >> 3) % BINS for j in range(BINS)), _ints((j * 30345 >> 2) % BINS | 1 for j in range(BINS))

    def probe(t) -> str:
        return f"{s}[({start}[j] + {t} * {stride}[j]) & {BINS - 1}]"

    def full(x: str) -> str:
        return f"({x} & {low}L) <> {low}L"

    tries = " ".join(f"WHEN {full(probe(t))} THEN {probe(t)}" for t in range(TRIES))
    rest = f"filter(transform(sequence({TRIES}, {BINS - 1}), t -> {probe('t')}), y -> {full('y')})[0]"
    steps = {
        w: _words(text),
        h: f"sort_array(concat({_shingles(w)}, {marks}))",
        s: f"filter({h}, (x, i) -> i = 0 OR shiftright(x, {shift}) <> shiftright({h}[greatest(i - 1, 0)], {shift}))",
        out: f"transform({s}, (x, j) -> cast((CASE WHEN {full('x')} THEN x {tries} ELSE {rest} END & 255) - 128 AS tinyint))",
    }
    for name, sql in steps.items():
        df = df.withColumn(name, F.expr(sql))
    return df.drop(w, h, s)


def packed(signature: str) -> Column:
    """A signature's bytes as a hex string."""
    digits = "array(" + ", ".join(f"'{k:02x}'" for k in range(256)) + ")"
    return F.expr(f"array_join(transform({signature}, x -> {digits}[x + 128]), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance of two signature columns, from 0 to 1: equal bytes, less those that agree by chance."""
    return F.expr(f"greatest(0D, (size(filter({a}, (x, i) -> x = {b}[i])) / {BINS}D - 1 / 256D) / (1 - 1 / 256D))")


def following(docs: DataFrame) -> DataFrame:
    """(k0, k1, k2, n0, n1, n2, chars): the key of each distinct (doc_id, text), that of the one that follows (the first follows the last), and its length."""
    keys = staged(docs.select(*row_key(*KEY), F.length("text").cast("long").alias("chars")).distinct())
    ranges = max(spread(docs.sparkSession), keys.count() // RANGE)
    dealt = staged(keys.repartitionByRange(ranges, *KEY).withColumn("_range", F.spark_partition_id()))
    # the first key of each range also ends the range before it, so ranges need nothing from one another: a row for each range
    order = Window.orderBy("_range")
    heads = dealt.groupBy("_range").agg(F.min(F.struct(*KEY)).alias("_first"))
    heads = heads.select("_first.*", F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy())).alias("_range"))
    both = dealt.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)).withColumn("chars", F.lit(0).cast("long")))
    own = Window.partitionBy("_range").orderBy("_head", *KEY)
    return both.select("*", *[F.lead(k).over(own).alias(n) for k, n in zip(KEY, ("n0", "n1", "n2"))]).filter("_head = 0").drop("_range", "_head")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (k0, doc_id, text, own, head, next_own): fingerprint, the next document's first floor(n / 4) code points and its fingerprint."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = with_signature(docs.select(*row_key(*KEY), "text"), "text", "own").select(*KEY, "text", "own")
    asked = following(docs).select(F.struct(*KEY).alias("asks"), "n0", "n1", "n2", F.floor(F.col("chars") / 4).cast("int").alias("need"))
    got = texts.join(asked, [F.col(k) == F.col(n) for k, n in zip(KEY, ("n0", "n1", "n2"))])
    # equal rows answer alike
    got = got.select("asks.*", F.expr("left(text, need)").alias("head"), F.col("own").alias("next_own")).groupBy(*KEY).agg(F.first("head").alias("head"), F.first("next_own").alias("next_own"))
    return texts.join(got, KEY).select(F.nullif("k0", F.lit(NO_ID)).alias("doc_id"), "text", "own", "head", "next_own")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"))
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) AS int))"), "head")
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    return with_signature(pairs, "edited", "other").select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed("own").alias("fingerprint"),
        packed("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
