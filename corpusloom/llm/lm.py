"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(sub | class, context) * P(token | sub). The class is a hash of the token's last two bytes (the
end token has its own), the sub-class within it a hash of the whole token. Both are softmaxes over hashed n-gram and skip features: for the class the token before,
the one before that (skip), and both as a pair; for the sub-class each of these two tokens together with the class. P(token | sub) has the closed form of a softmax
with one weight a token: counts over the training documents, plus one, with one more share in each sub-class for all unseen tokens. So the
probabilities of all known tokens and the unseen shares sum to one.

Plan: text is cut into blocks of about `BLOCK` bytes, and a block keeps its tokens as numbers in its own sorted list of
distinct 64-bit token hashes. Token counts over the corpus are summed by ranges of the hash: a block sends one packed
row for each range, and gets one packed row of counts back. As a token is at most once in a block's list, a frequent token is
no heavier than others. Ranges are as many as the lists need to stay small, so memory does not grow with the corpus.

Training goes once over all training tokens, in `ROUNDS` rounds; a hash of doc_id and text says which documents belong to a round. A round sums, for each weight, the times that
its feature was seen with its class and what the model expected (the two sides of the gradient); each weight then takes a step whose size is the inverse of these. Expectations are
summed as whole numbers (units of 1 / `ONE`), so the scores are the same, but for the rounding of single precision, however rows are dealt to files and tasks. Sums go
up a tree of `FAN` children for each piece of the weights; the driver gets the sums, and sends the weights (about 4 MB, of fixed size) to the next round. What grows with the
corpus is the counts; the context part has a fixed number of weights.

Defined cases: null text is empty and has the end token only; without training documents all weights are zero and nothing is known; a
null doc_id is a training document; repeated rows count and are scored each; very long texts are scored whole; equal tokens of any length are one; an empty table
gives an empty result. Columns other than doc_id, text and held_out may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, Rolling, mix, runs, spread, staged, utf8, words
from corpusloom.session import table

#: Classes (the last one is the end token's); sub-classes of each; bytes of text in a block; tokens taken at once.
CLASSES, SUBS, BLOCK, BATCH = 32, 32, 2 << 20, 1 << 15
#: Log2 of the buckets of a token, of a pair, and of a token with a class.
BITS, PAIR_BITS, SUB_BITS = 12, 13, 13
#: Rounds of training; step size; what is added to the seen and the expected times of a weight; units of expectation.
ROUNDS, RATE, DAMP, ONE = 4, 0.7, 20.0, 1 << 18
#: Weights in a piece; sums of a piece that are summed at once; bytes of blocks that a training task takes at least; packed bytes that a range of hashes may gather.
PIECE, FAN, TASK_BYTES, RANGE_BYTES = 1 << 14, 32, 256 << 20, 16 << 20
END = np.uint64(0x1F83D9ABFB41BD6B)
#: Where each feature's columns of the weights begin; the last ones are those of no feature. Weights are classes x features.
FIRST = np.cumsum([0, 1 << BITS, 1 << BITS, 1 << PAIR_BITS])
SECOND = np.cumsum([0, 1 << SUB_BITS, 1 << SUB_BITS])
SHAPES = ((CLASSES, int(FIRST[-1]) + 1), (SUBS, int(SECOND[-1]) + CLASSES))


def tokenise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with each row's end token, their leaves (class * SUBS + sub-class), and tokens in each row."""
    low = LOWER[data]
    start, end, count = words(low, off)
    h = Rolling(low).of(start, end) if len(start) else np.zeros(0, np.uint64)
    last = low[end - 1].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
    before = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.uint64) if len(end) else last
    leaf = (mix(last | before << np.uint64(8)) % np.uint64(CLASSES - 1) * np.uint64(SUBS) + (mix(h) >> np.uint64(40)) % np.uint64(SUBS)).astype(np.uint16)
    at = np.cumsum(count)
    return np.insert(h, at, END), np.insert(leaf, at, (CLASSES - 1) * SUBS), count + 1


def _zip(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzip(x, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer() if hasattr(x, "as_buffer") else x), kind)


_BLOCK = "block long, doc_ids array<long>, held binary, rounds binary, sizes binary, stream binary, hashes binary, train binary, classes binary, distinct long"


def _blocks(batches):
    """(doc_id, text, held, round) to blocks."""
    from pyspark import TaskContext

    k = TaskContext.get().partitionId() << 32
    for b in batches:
        data, off = utf8(b.column(1))
        held, turn = b.column(2).to_numpy(zero_copy_only=False).astype(bool), b.column(3).to_numpy().astype(np.uint8)
        for a, z in runs(off, BLOCK):
            h, cls, size = tokenise(data[off[a] : off[z]], off[a : z + 1] - off[a])
            known, first, stream = np.unique(h, return_index=True, return_inverse=True)
            train = np.bincount(stream[np.repeat(~held[a:z], size)], minlength=len(known))
            ids = b.column(0).slice(a, z - a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k], pa.int64()),
                    pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    pa.array([held[a:z].tobytes()], pa.binary()),
                    pa.array([turn[a:z].tobytes()], pa.binary()),
                    pa.array([size.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([_zip(stream.astype(np.uint32))], pa.binary()),
                    pa.array([known.tobytes()], pa.binary()),
                    pa.array([_zip(train.astype(np.int64))], pa.binary()),
                    pa.array([cls[first].tobytes()], pa.binary()),
                    pa.array([len(known)], pa.int64()),
                ],
                [x.split()[0] for x in _BLOCK.split(", ")],
            )
            k += 1


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` (a power of two) equal ranges of the hash begins in a sorted list, and its end."""
    if ranges == 1:
        return np.array([0, len(hashes)])
    return np.r_[np.searchsorted(hashes, np.arange(ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length())), len(hashes)]


def _requests(ranges: int):
    def rows(batches):
        for b in batches:
            for block, hashes, train, cls in zip(*(b.column(i) for i in range(4))):
                h, t, c = np.frombuffer(hashes.as_buffer(), np.uint64), _unzip(train, np.int64), np.frombuffer(cls.as_buffer(), np.uint16)
                cut = _cuts(h, ranges)
                on = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(on, pa.int64()),
                        pa.array(np.full(len(on), block.as_py()), pa.int64()),
                        pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in on], pa.binary()),
                        pa.array([_zip(t[cut[i] : cut[i + 1]]) for i in on], pa.binary()),
                        pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in on], pa.binary()),
                    ],
                    ["range", "block", "hashes", "train", "classes"],
                )

    return rows


_ANSWER = "block long, range long, counts binary, class_n binary, class_v binary"


def _answer(rows: list) -> pa.RecordBatch:
    """All requests of one range to one answer for each block, and one row (block -1) of the leaves' totals."""
    h, t, c = (np.concatenate(x) for x in zip(*((np.frombuffer(r[2], np.uint64), _unzip(r[3], np.int64), np.frombuffer(r[4], np.uint16)) for r in rows)))
    known, first, at = np.unique(h, return_index=True, return_inverse=True)
    total = np.bincount(at, t, len(known)).astype(np.int64)
    cut = np.r_[0, np.cumsum([len(r[2]) // 8 for r in rows])]
    seen = total > 0
    cls = c[first]
    n = np.bincount(cls, total, CLASSES * SUBS).astype(np.int64)
    v = np.bincount(cls[seen], minlength=CLASSES * SUBS).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[1] for r in rows] + [-1], pa.int64()),
            pa.array([rows[0][0]] * (len(rows) + 1), pa.int64()),
            pa.array([_zip(total[at[a:z]]) for a, z in zip(cut[:-1], cut[1:])] + [b""], pa.binary()),
            pa.array([None] * len(rows) + [n.tobytes()], pa.binary()),
            pa.array([None] * len(rows) + [v.tobytes()], pa.binary()),
        ],
        [x.split()[0] for x in _ANSWER.split(", ")],
    )


def _answers(batches):
    """Requests sorted by range; one range is held at a time."""
    now: list = []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(5))):
            if now and r[0] != now[0][0]:
                yield _answer(now)
                now = []
            now.append(r)
    if now:
        yield _answer(now)


def features(bucket: np.ndarray, leaf: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of each token's features for the class and, given the class, for the sub-class; a place before the text has bucket 0. The last of each is that of no feature."""
    place = np.arange(len(leaf)) - np.repeat(np.cumsum(size) - size, size)

    def back(k):
        out = np.zeros(len(leaf), np.int64)
        out[k:] = bucket[:-k] if k < len(leaf) else 0
        out[place < k] = 0
        return out

    b1, b2, cls = back(1), back(2), leaf // SUBS
    pair = (b1 * 40503 + b2 * 30011 >> 3) & ((1 << PAIR_BITS) - 1)
    with_class = lambda b: (b * 0x9E3779B1 + cls * 0x85EBCA6B >> 7) & ((1 << SUB_BITS) - 1)
    first = [x + s for x, s in zip((b1, b2, pair), FIRST)] + [np.full(len(leaf), FIRST[-1])]
    return first, [with_class(b1) + SECOND[0], with_class(b2) + SECOND[1], cls + SECOND[-1]]


def _logits(w: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Sums of the features' weights, classes x tokens. Steps are bounded, so they are far from the limits of exp()."""
    z = np.take(w, columns[0], axis=1)
    for c in columns[1:]:
        z += np.take(w, c, axis=1)
    return z


def log_share(w: np.ndarray, columns: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Log probability of each token's target."""
    z = _logits(w, columns)
    return z[target, np.arange(len(target))] - np.log(np.exp(z).sum(0))


def add_seen(seen: np.ndarray, columns: list[np.ndarray], target: np.ndarray) -> None:
    """Adds the times that each feature was seen with each class."""
    for c in columns:
        seen += np.bincount(target * seen.shape[1] + c, minlength=seen.size).reshape(seen.shape)


def add_expected(w: np.ndarray, expected: np.ndarray, columns: list[np.ndarray]) -> None:
    """Adds the times that the model expects, in units of 1 / ONE: whole numbers, so sums of doubles are exact."""
    e = np.exp(_logits(w, columns))
    p = np.rint(e * (np.float32(ONE) / e.sum(0))).astype(np.float64)
    for c in columns:
        low = int(c.min())
        own, size = c - low, int(c.max()) - low + 1
        for k in range(len(p)):
            expected[k, low : low + size] += np.bincount(own, p[k], size)


def step(w: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The weights after a step along the gradient, seen less expected times, at a size of the inverse of both for each weight."""
    e = expected / ONE
    return (w + RATE * 2 * (seen - e) / (seen + e + DAMP)).astype(np.float32)


def start(n_leaf: np.ndarray) -> list[np.ndarray]:
    """Weights of a model without context: the shares of classes and sub-classes."""
    n = n_leaf.reshape(CLASSES, SUBS).astype(np.float64) + 0.5
    w = [np.zeros(x, np.float32) for x in SHAPES]
    if n_leaf.any():
        w[0][:, -1] = np.log(n.sum(1) / n.sum())
        w[1][:, SECOND[-1] :] = np.log(n / n.sum(1, keepdims=True)).T
    return w


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1


def _token_columns(b: pa.RecordBatch, i: int):
    """held, rounds, sizes, leaves and buckets of a block's tokens, in text order, and the tokens' numbers."""
    col = lambda name: b.column(b.schema.names.index(name))[i]
    held, turn, size = np.frombuffer(col("held").as_buffer(), bool), np.frombuffer(col("rounds").as_buffer(), np.uint8), np.frombuffer(col("sizes").as_buffer(), np.int64)
    stream = _unzip(col("stream"), np.uint32)
    return held, turn, size, np.frombuffer(col("classes").as_buffer(), np.uint16)[stream].astype(np.int64), _bucket(np.frombuffer(col("hashes").as_buffer(), np.uint64))[stream], stream


_SUMS = "piece long, part int, seen binary, expected binary"


def _times(sent, turn: int):
    """The sums of a task over the training documents of a round, in pieces; pieces that no feature touched are left out."""

    def rows(batches):
        from pyspark import TaskContext

        w = sent.value
        seen, expected = ([np.zeros(x.shape, kind) for x in w] for kind in (np.int64, np.float64))
        for b in batches:
            for i in range(b.num_rows):
                held, own, size, leaf, bucket, _ = _token_columns(b, i)
                on = ~held & (own == turn)
                mine = np.repeat(on, size)
                leaf, bucket, size = leaf[mine], bucket[mine], size[on]
                if not len(leaf):
                    continue
                one, two = features(bucket, leaf, size)
                add_seen(seen[0], one, leaf // SUBS)
                add_seen(seen[1], two, leaf % SUBS)
                for a in range(0, len(leaf), BATCH):
                    add_expected(w[0], expected[0], [x[a : a + BATCH] for x in one])
                    add_expected(w[1], expected[1], [x[a : a + BATCH] for x in two])
        s, e = (np.concatenate([x.reshape(-1) for x in v]).astype(np.int64) for v in (seen, expected))
        parts = [a for a in range(0, len(e), PIECE) if e[a : a + PIECE].any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([a // PIECE for a in parts], pa.int64()), pa.array([part] * len(parts), pa.int32()), *(pa.array([_zip(x[a : a + PIECE]) for a in parts], pa.binary()) for x in (s, e))],
            [x.split()[0] for x in _SUMS.split(", ")],
        )

    return rows


def _total(key, t):
    """The sum of at most FAN rows of a piece, one after the other."""
    sums = [sum(_unzip(x, np.int64) for x in t.column(c)) for c in ("seen", "expected")]
    return pa.table({"piece": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([_zip(x)], pa.binary()) for c, x in zip(("seen", "expected"), sums)}})


def fit(blocks: DataFrame, n_leaf: np.ndarray) -> list[np.ndarray]:
    """Weights for classes and for sub-classes, each classes x features."""
    spark = blocks.sparkSession
    w = start(n_leaf)
    own = blocks.select("held", "rounds", "sizes", "stream", "hashes", "classes")
    # tasks give sums of a fixed size, so they take many blocks each
    rows = blocks.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, rows * BLOCK // TASK_BYTES)
    for turn in range(ROUNDS if n_leaf.any() else 0):
        sent = spark.sparkContext.broadcast(w)
        sums = own.coalesce(tasks).mapInArrow(_times(sent, turn), _SUMS)
        left = tasks
        while left > 1:  # a tree of sums
            sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("piece", "part").applyInArrow(_total, _SUMS)
            left = -(-left // FAN)
        got = sums.collect()
        flat = [np.concatenate([x.reshape(-1) for x in w]).astype(np.float64), *(np.zeros(sum(x.size for x in w), np.int64) for _ in range(2))]
        for r in got:
            at = r["piece"] * PIECE
            for x, c in zip(flat[1:], ("seen", "expected")):
                part = _unzip(r[c], np.int64)
                x[at : at + len(part)] = part
        new = step(*flat)
        w = [x.reshape(y.shape) for x, y in zip(np.split(new, [w[0].size]), w)]
        sent.destroy()
    return w


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(sent):
    def rows(batches):
        w, n_leaf, v_leaf = sent.value
        total, kinds = int(n_leaf.sum()), int(v_leaf.sum())
        base_room, room = np.log10(total + kinds + 1.0), np.log10(n_leaf + v_leaf + 1.0)
        for b in batches:
            for i in range(b.num_rows):
                held, _, size, leaf, bucket, stream = _token_columns(b, i)
                parts = sorted(b.column(b.schema.names.index("answers"))[i].as_py(), key=lambda r: r["range"])
                count = np.concatenate([_unzip(r["counts"], np.int64) for r in parts])[stream]
                told = np.empty(len(leaf))
                one, two = features(bucket, leaf, size)
                for a in range(0, len(leaf), BATCH):
                    k = slice(a, a + BATCH)
                    told[k] = log_share(w[0], [c[k] for c in one], leaf[k] // SUBS) + log_share(w[1], [c[k] for c in two], leaf[k] % SUBS)
                up = np.log10(count + 1.0)
                first = np.cumsum(size) - size
                sums = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.column(b.schema.names.index("doc_ids"))[i].as_py(), pa.int64()),
                        pa.array(held, pa.bool_()),
                        pa.array(size, pa.int64()),
                        pa.array(sums((count > 0).astype(np.int64)), pa.int64()),
                        pa.array(np.full(len(size), total), pa.int64()),
                        pa.array(sums(up - base_room), pa.float64()),
                        pa.array(sums(told / np.log(10) + up - room[leaf]), pa.float64()),
                    ],
                    [x.split()[0] for x in _SCORE.split(", ")],
                )

    return rows


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, held_out) to `_SCORE`: learns from the rows that are not held out and scores all."""
    spark = docs.sparkSession
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int")
    blocks = staged(docs.select("doc_id", "text", F.col("held_out").alias("held"), turn.alias("round")).mapInArrow(_blocks, _BLOCK))
    entries = blocks.agg(F.sum("distinct")).first()[0] or 0
    # 17 packed bytes for each entry of a list, at most; a power of two of ranges
    ranges = 1 << max(5, (entries * 17 // RANGE_BYTES).bit_length())
    asked = blocks.select("block", "hashes", "train", "classes").mapInArrow(_requests(ranges), "range long, block long, hashes binary, train binary, classes binary")
    answers = staged(asked.repartition(max(spread(spark), min(ranges, 4096)), "range").sortWithinPartitions("range").mapInArrow(_answers, _ANSWER))
    n_leaf, v_leaf = np.zeros(CLASSES * SUBS, np.int64), np.zeros(CLASSES * SUBS, np.int64)
    for r in answers.filter("block = -1").select("class_n", "class_v").toLocalIterator():
        n_leaf, v_leaf = n_leaf + np.frombuffer(r[0], np.int64), v_leaf + np.frombuffer(r[1], np.int64)
    sent = spark.sparkContext.broadcast((fit(blocks, n_leaf), n_leaf, v_leaf))
    told = answers.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("range", "counts")).alias("answers"))
    return blocks.drop("train", "distinct").join(told, "block").mapInArrow(_score(sent), _SCORE)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))
