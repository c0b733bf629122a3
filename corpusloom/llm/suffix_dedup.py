"""Removal of repeated long byte strings (exact substring de-duplication).

Every byte that a string of `LENGTH` bytes covers which also starts anywhere else goes. Such a string is found where it
stands by content alone: of its `GRAM`-byte grams the one with the least hash (the leftmost of equals) is its anchor, so equal strings
have their anchors at the same place. All that such strings can cover lies in the anchor's context, the bytes from LENGTH - GRAM
before the anchor to LENGTH after its start.

1. Each document gives its anchors: hash of the gram, hash of the context, place. They meet by the gram's hash (those that
   repeat within one buffer of documents are settled there and don't). Equal contexts are one class; if there are two of them, all their strings repeat. A gram with several contexts sends one of each class on.
2. These contexts are cut from the texts and dealt by the gram with half of what must surround it, on either side
   (one of the two is in any string that repeats), so a common gram alone brings nothing together.
3. Each task builds the collection's Burrows-Wheeler transform and common prefixes column by column: from the right, each round
   inserts one symbol of every context before its suffix, orders the suffixes stably by it, and gets each common prefix
   with the neighbour as one more than the least between the two before. Contexts stand aligned at the anchor, so equal strings are in the same
   column, and only suffixes of one column are kept. Where they are many, columns are read one after the other from a scratch file of the task
   (nothing else sees it, and it goes with the task), and a round's state is its order and prefixes. Neighbours with LENGTH or more in common are repeats.

Defined cases: null text counts as empty; matches never cross documents; a document shorter than LENGTH loses nothing, and very long ones are taken whole; rows that
repeat a doc_id are texts of their own, and equal rows repeat each other; a null doc_id stays null, and such rows are told apart by 128 bits of hashes of their text
(others by doc_id and 64 of them); an empty table gives an empty result. Columns other than doc_id and text may have any name.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Rolling, mix, row_key, runs, spread, staged, utf8
from corpusloom.session import table

LENGTH, GRAM = 200, 50
LEFT, RIGHT = LENGTH - GRAM, LENGTH
HALF, WINDOW, WIDTH = LEFT // 2, LENGTH - GRAM + 1, LENGTH - GRAM + LENGTH
#: Contexts of a collection before it is built; bytes of a collection from which its columns are in a file.
COLLECT, IN_MEMORY = 20_000, 64 << 20


def anchors(roll: Rolling, off: np.ndarray) -> np.ndarray:
    """Starts of all anchors in a buffer of documents."""
    n = int(off[-1])
    size = np.diff(off)
    if n < LENGTH or not (size >= LENGTH).any():
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    v = roll.of(at, at + GRAM)
    idx = at.astype(np.int32)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        less = v[step:] < v[:-step]
        v, idx = np.where(less, v[step:], v[:-step]), np.where(less, idx[step:], idx[:-step])
        span += step
    # string starts whose string ends in the same document
    edge = np.repeat(off[1:], size)[: len(idx)]
    inside = np.arange(len(idx)) + LENGTH <= edge
    got = idx[inside]
    return got[np.r_[True, got[1:] != got[:-1]]].astype(np.int64) if len(got) else np.zeros(0, np.int64)


_ANCHOR = "h long, ctx long, doc_id long, row long, pos int, sure boolean"


def _anchor_rows(batches):
    for b in batches:
        data, off = utf8(b.column(2))
        doc, row = b.column(0).to_numpy(), b.column(1).to_numpy()
        for a, z in runs(off):
            own = off[a : z + 1] - off[a]
            roll = Rolling(data[off[a] : off[z]])
            at = anchors(roll, own)
            if not len(at):
                continue
            k = np.searchsorted(own, at, "right") - 1
            lo, hi = np.maximum(at - LEFT, own[k]), np.minimum(at + RIGHT, own[k + 1])
            h, ctx = roll.of(at, at + GRAM), roll.of(lo, hi) ^ mix((at - lo).astype(np.uint64))
            # contexts that repeat within the buffer are settled here: one goes on to meet others, the rest are dealt at random
            order = np.lexsort((ctx, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])]
            sure, spare = np.zeros(len(at), bool), np.zeros(len(at), bool)
            sure[order] = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
            spare[order] = ~new
            h[spare] = mix(h[spare] ^ mix(at[spare].astype(np.uint64) ^ doc[a + k[spare]].astype(np.uint64)))
            for s in range(0, len(at), 1 << 17):
                e = slice(s, s + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[e].view(np.int64)),
                        pa.array(ctx[e].view(np.int64)),
                        pa.array(doc[a + k[e]]),
                        pa.array(row[a + k[e]]),
                        pa.array((at[e] - own[k[e]]).astype(np.int32)),
                        pa.array(sure[e]),
                    ],
                    ["h", "ctx", "doc_id", "row", "pos", "sure"],
                )


_MARK = "doc_id long, row long, pos int, sure boolean"


class Marks:
    """Takes rows sorted by (h, ctx); gives the places whose context repeats (sure), and one of each context of a gram that has several, to be compared.

    What waits from batch to batch is the last row, and the first row of a gram that has one context so far.
    """

    def __init__(self):
        self.last: pa.Table | None = None
        self.like_before = False  # the last row's context is that of the row before
        self.first: pa.Table | None = None  # of the last row's gram, not given yet

    def take(self, t: pa.Table, end: bool = False) -> pa.RecordBatch:
        began = self.last is None
        t = t if began else pa.concat_tables([self.last, t]).combine_chunks()
        h, ctx = t.column("h").to_numpy(), t.column("ctx").to_numpy()
        new_h = np.r_[began, h[1:] != h[:-1]]
        new_c = new_h | np.r_[began or not self.like_before, ctx[1:] != ctx[:-1]]
        sure = ~new_c | np.r_[~new_c[1:], False] | t.column("sure").to_numpy(zero_copy_only=False)
        if not began:
            # the row that waited was looked at as a new context before
            new_c[0] = False
        more = new_c & ~new_h  # a gram's second context and those after it
        gram = np.cumsum(new_h) - 1 + (not new_h[0])
        several = np.bincount(gram[more], minlength=gram[-1] + 1) > 0
        given = [t.slice(0, 0)]
        if self.first is not None and several[0] and not new_h[0]:
            given.append(self.first)
        if new_h[1:].any() or several[0] or new_h[0]:
            self.first = None
        begins = np.flatnonzero(new_h & several[gram])
        alone = np.flatnonzero(new_h & ~several[gram] & (gram == gram[-1]))
        if len(alone):
            self.first = t.slice(int(alone[-1]), 1)
        stop = len(h) if end else len(h) - 1
        a, b = np.flatnonzero(sure[:stop]), np.r_[begins, np.flatnonzero(more)]
        self.last, self.like_before = t.slice(len(h) - 1), bool(sure[-1] and not new_c[-1]) if len(h) > 1 or began else self.like_before
        rows = pa.concat_tables([t.take(pa.array(a, pa.int64())), t.take(pa.array(b, pa.int64())), *given]).select(["doc_id", "row", "pos"]).combine_chunks()
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(rows.num_rows) < len(a))], ["doc_id", "row", "pos", "sure"])


def _marks(batches):
    marks, waiting = Marks(), None
    for b in batches:
        if not b.num_rows:
            continue
        if waiting is not None:
            yield marks.take(waiting)
        waiting = pa.Table.from_batches([b])
    if waiting is not None:
        yield marks.take(waiting, True)


_CONTEXT = "key long, doc_id long, row long, pos int, before int, bytes binary"


def _contexts(batches):
    """(doc_id, row, text, pos list) to the contexts at these places, each under the keys of either half."""
    before = None
    for b in batches:
        for d, r, t, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if (d, r) == before:  # equal rows give their contexts once
                continue
            before = (d, r)
            raw = (t or "").encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, np.uint8)
            at = np.array(sorted(set(ps)), np.int64)
            roll = Rolling(data)
            lo, hi = np.maximum(at - LEFT, 0), np.minimum(at + RIGHT, len(raw))
            right, left = at + GRAM + HALF <= len(raw), at >= HALF
            on = np.r_[np.flatnonzero(right), np.flatnonzero(left)]
            key = np.r_[roll.of(at[right], at[right] + GRAM + HALF), roll.of(at[left] - HALF, at[left] + GRAM) ^ np.uint64(0x5851F42D4C957F2D)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(np.full(len(on), d, np.int64)),
                    pa.array(np.full(len(on), r, np.int64)),
                    pa.array(at[on].astype(np.int32)),
                    pa.array((at - lo)[on].astype(np.int32)),
                    pa.array([raw[lo[i] : hi[i]] for i in on], pa.binary()),
                ],
                ["key", "doc_id", "row", "pos", "before", "bytes"],
            )


def repeated_columns(contexts: list[bytes], before: np.ndarray, bwt: list | None = None) -> np.ndarray:
    """For aligned contexts (anchor `before` bytes after the start) and each string start in them (columns 0 to LEFT) whether the
    string of LENGTH bytes is in another context as well. `bwt` gets the symbols before each column's ordered suffixes, rightmost column first.
    """
    n = len(contexts)
    size = np.array([len(x) for x in contexts])
    begin = LEFT - before
    file = tempfile.TemporaryFile() if n * WIDTH > IN_MEMORY else None
    cols = np.memmap(file, np.uint8, "w+", shape=(WIDTH, n)) if file else np.zeros((WIDTH, n), np.uint8)
    for a in range(0, n, 4096):  # written by stripes, read column after column
        part = np.zeros((min(4096, n - a), WIDTH), np.uint8)
        for i, x in enumerate(contexts[a : a + 4096]):
            part[i, begin[a + i] : begin[a + i] + len(x)] = np.frombuffer(x, np.uint8)
        cols[:, a : a + len(part)] = part.T
    hit = np.zeros((LEFT + 1, n), bool)
    order, common = np.arange(n), np.zeros(n, np.int16)
    for q in range(WIDTH - 1, -1, -1):
        c = cols[q][order].astype(np.uint16)
        c[(q < begin[order]) | (q >= (begin + size)[order])] = 256
        if bwt is not None:
            bwt.append(c)
        perm = np.argsort(c, kind="stable")
        s = c[perm]
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        now = np.zeros(n, np.int16)
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), n]):
            if z - a > 1 and s[a] < 256:
                at = perm[a:z]
                now[a + 1 : z] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) + 1
        order, common = order[perm], now
        if q <= LEFT:
            far = np.flatnonzero(common >= LENGTH)
            hit[q, order[far]] = True
            hit[q, order[far - 1]] = True
    return hit


_SPAN = "doc_id long, row long, lo int, hi int"


def _spans(doc, row, pos, hit) -> pa.RecordBatch:
    """Starts of repeated strings as byte ranges, joined where they overlap."""
    col, ctx = np.nonzero(hit)
    order = np.lexsort((col, ctx))
    col, ctx = col[order], ctx[order]
    first = np.r_[True, (ctx[1:] != ctx[:-1]) | (col[1:] > col[:-1] + LENGTH)] if len(ctx) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(ctx) else first
    k = ctx[first]
    lo, hi = pos[k] - LEFT + col[first], pos[k] - LEFT + col[last] + LENGTH
    return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(row[k]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc_id", "row", "lo", "hi"])


def _collections(batches):
    """Contexts sorted by key; builds a collection from whole keys, at least COLLECT contexts at a time."""

    def build(held: list):
        t = pa.Table.from_batches(held).combine_chunks()
        key, doc, row, pos, before = (t.column(i).to_numpy() for i in range(5))
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[cut, len(key)])
        on = np.flatnonzero(np.repeat(count, count) > 1)
        if not len(on):
            return None
        # a place that is there under both its keys counts once
        order = on[np.lexsort((pos[on], row[on], doc[on]))]
        d, r, p = doc[order], row[order], pos[order]
        order = order[np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])]]
        hit = repeated_columns(t.column(5).take(pa.array(order)).to_pylist(), before[order].astype(np.int64))
        return _spans(doc[order], row[order], pos[order].astype(np.int64), hit)

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        if held and size >= COLLECT:
            same = int(np.searchsorted(key, key[0], "right")) if key[0] == held[-1].column(0)[-1].as_py() else 0
            if same < len(key):
                if same:
                    held.append(b.slice(0, same))
                if (out := build(held)) is not None:
                    yield out
                held, size, b = [], 0, b.slice(same)
        held.append(b)
        size += b.num_rows
    if held and (out := build(held)) is not None:
        yield out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spans) of docs(doc_id, row, text): byte ranges that repeated strings cover, unordered; ends may lie beyond the text."""
    n = spread(docs.sparkSession)
    marks = staged(docs.mapInArrow(_anchor_rows, _ANCHOR).repartition(n, "h").sortWithinPartitions("h", "ctx").mapInArrow(_marks, _MARK))
    places = marks.filter("NOT sure").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("places"))
    contexts = docs.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places").mapInArrow(_contexts, _CONTEXT)
    compared = contexts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_collections, _SPAN)
    whole = marks.filter("sure").select("doc_id", "row", F.greatest(F.col("pos") - LEFT, F.lit(0)).alias("lo"), (F.col("pos") + RIGHT).alias("hi"))
    return compared.union(whole).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of the bytes, and how many maximal runs went."""
    edge = np.zeros(len(raw) + 1, np.int32)
    lo, hi = (np.array(x, np.int64) for x in zip(*spans))
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi, len(raw)), -1)
    gone = np.cumsum(edge)[:-1] > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int((gone & ~np.r_[False, gone[:-1]]).sum())


def with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of docs, spans null where nothing repeats. Rows are told apart by doc_id, or a hash of the text, and another hash of the text."""
    _, one, two = row_key("_id", "_row", "_other")
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), two).alias("_id"), one)
    spans = repeated_spans(keyed.select(F.col("_id").alias("doc_id"), F.col("_row").alias("row"), "text"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "spans")
    return keyed.join(spans, ["_id", "_row"], "left").drop("_id", "_row")


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches):
    for b in batches:
        out: list[list] = [[], [], [], []]
        spans = b.column(2)
        for i, t in enumerate(b.column(1).to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            left, n = cut(raw, [(x["lo"], x["hi"]) for x in spans[i].as_py()]) if spans[i].is_valid else (raw, 0)
            for x, y in zip(out, (len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest())):
                x.append(y)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], [x.split()[0] for x in _DIGEST.split(", ")])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated strings: `text` holds what is left, with U+FFFD where a cut split a character; `kept` its exact bytes."""

    def rows(batches):
        for b in batches:
            kept = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                kept.append(cut(raw, [(x["lo"], x["hi"]) for x in s])[0] if s else raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()), pa.array(kept, pa.binary())], ["doc_id", "text", "kept"])

    return with_spans(docs.select("doc_id", "text")).select("doc_id", "text", "spans").mapInArrow(rows, "doc_id long, text string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", "spans").mapInArrow(_digests, _DIGEST)
