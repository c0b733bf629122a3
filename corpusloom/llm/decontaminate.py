"""Benchmark decontamination: passages of documents within a share of edits of a benchmark item.

Texts are compared as UTF-8 bytes with A-Z lower-cased and ASCII white space as a space. An item-sized window of a
document is tied to an item at an anchor. Anchors are places that a rule on their own three bytes picks (one of `ONE_IN`), in items and documents
alike, so they need no words, and those of an item do not depend on the other items. From the anchor both
sides take the same CGK walk (at each step a random bit, which depends on the step and the byte read, says whether to
move on), which turns few edits into few differing steps. A repetition samples `SAMPLES` steps of one walk; windows
and items that agree in all of them are candidates. Samples are looked up four first, so that nearly all windows
leave after a dozen steps. All anchors of an item, times `REPEATS` repetitions, bring recall to its target (0.9 at `EDITS`, one edit in
five bytes at random places; tests measure it); an exact copy agrees in every walk, so it is always found. An item with fewer than `ANCHORS` anchors is
tied at every byte instead: wherever `GRAM` bytes of a document are bytes of it (`SMALL_GRAM` for an item under `SMALL` bytes). An item of
under `SHORT` bytes is matched up to one edit in ten bytes only; such a passage always has one of these grams left whole, so none is
missed. Candidates are confirmed by edit distance (Myers' bit vectors, free ends), first of the item's parts of one machine word, many at once, then of the
whole.

The benchmark is collected only in blocks of at most `BLOCK` bytes, one pass over the documents for each block; of several blocks each one's
result is written before the next is sent, and its broadcast is dropped.

Defined cases: null, empty and blank items match nothing; null and empty texts hold nothing; very long texts are taken whole, and a passage is found
wherever it stands in them; repeated items and repeated rows each give their own rows (one row for each distinct
(doc_id, item_id), the one with fewest edits); a null doc_id or item_id stays null in the result; an empty table of documents or items gives an
empty result, or drops nothing. Other columns may have any name. without_leaks decides by row: of rows that share a doc_id, null or
not, only those whose own text holds an item go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, SPACE, forget_at_exit, runs, shared_dir, utf8
from corpusloom.session import table

#: Most edits as a share of an item's bytes, and of those of an item of under SHORT bytes.
EDITS, SHORT_EDITS, SHORT = 0.2, 0.1, 56
#: An anchor is a place in so many; anchors of an item, at least; repetitions; bytes of items in a block.
ONE_IN, ANCHORS, REPEATS, BLOCK = 6, 14, 3, 8 << 20
#: Bytes of a gram at any position, and those for an item of under SMALL bytes, which is never under LEAST unless it is searched as it is.
GRAM, SMALL_GRAM, SMALL, LEAST = 8, 5, 40, 10
#: Bytes of an item whose candidates are all confirmed at once; candidates held at once.
WORD, HELD = 64, 1 << 18
#: Ranges of steps that one sample each is drawn from.
RANGES = ((0, 2), (2, 5), (5, 8), (8, 12), (12, 16), (16, 21), (21, 26), (26, 32))
SAMPLES, STEPS = len(RANGES), RANGES[-1][1]
#: Steps of a candidate's walk that are compared, as far as the item goes, and the share of them that must agree.
LONG, AGREE = 96, 0.42
PLAIN = LOWER.copy()
PLAIN[SPACE] = 0x20


def _walks(repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each repetition, step and byte; the sampled steps of each repetition."""
    rng = np.random.default_rng(411)
    bits = rng.integers(0, 2, (repeats, LONG, 256)).astype(np.int32)
    return bits, np.array([[rng.integers(a, b) for a, b in RANGES] for _ in range(repeats)])


def _grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """The first `n` of the 8 bytes at each position, as a number."""
    out = np.zeros(max(0, len(data) - 7), np.uint64)
    raw = np.ascontiguousarray(data)
    for i in range(min(8, len(out))):
        out[i::8] = np.frombuffer(raw, "<u8", (len(raw) - i) // 8, i)
    return out & np.uint64((1 << 8 * n) - 1)


def anchors_of(data: np.ndarray) -> np.ndarray:
    """The places that the rule picks: a hash of the three bytes there."""
    x = data.astype(np.uint32)
    h = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    return np.flatnonzero((h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77) < np.uint32((1 << 32) // ONE_IN))


class Items:
    """A block of items with the hash tables of their anchors."""

    def __init__(self, rows: list[tuple], repeats: int = REPEATS, edits: float = EDITS):
        self.ids = [r[0] for r in rows]
        self.bytes = [PLAIN[np.frombuffer((r[1] or "").encode("utf-8", "surrogatepass"), np.uint8)].tobytes().strip() for r in rows]
        self.most = [int(len(b) * (edits if len(b) >= SHORT else min(edits, SHORT_EDITS))) for b in self.bytes]
        self.bits, self.steps = _walks(repeats)
        self.plain, picked, sparse, small = [], [], [], []
        for k, b in enumerate(self.bytes):
            if len(b) < LEAST:
                self.plain += [k] if b else []
                continue
            at = anchors_of(np.frombuffer(b, np.uint8))
            at = at[at <= len(b) - STEPS]
            if len(at) >= ANCHORS:
                picked.append((k, at))
            elif len(b) < SMALL:
                small.append((k, np.arange(len(b) - SMALL_GRAM + 1)))
            else:
                sparse.append((k, np.arange(len(b) - GRAM + 1)))
        self.own, self.offset = self._anchors(picked)
        flat = np.frombuffer(b"".join(self.bytes) + bytes(LONG), np.uint8)
        begin = np.r_[0, np.cumsum([len(b) for b in self.bytes])][:-1].astype(np.int64)
        self.flat, self.begin, self.size = flat, begin, np.array([len(b) for b in self.bytes], np.int64)
        # an item in parts of one machine word: a passage within the edits has a part within the part's share of them
        cuts = [(k, a, min(a + WORD, n)) for k, n in enumerate(self.size.tolist()) for a in range(0, n, WORD)]
        self.parts = [self.bytes[k][a:z] for k, a, z in cuts]
        own, self.part_from, self.part_to = (np.array(x, np.int64) for x in (zip(*cuts) if cuts else ((), (), ())))
        self.part_first, self.part_count = np.searchsorted(own, np.arange(len(rows))), np.bincount(own, minlength=len(rows))
        self.part_most = np.array(self.most, np.int64)[own] * (self.part_to - self.part_from) // np.maximum(self.size[own], 1)
        at = begin[self.own] + self.offset
        self.grams = [self._table(flat, x, n) for x, n in ((sparse, GRAM), (small, SMALL_GRAM)) if x]
        self.first, self.tables, self.walks = [], [], []
        self.bits_seen = max(20, int(16 * len(at)).bit_length())
        for r in range(repeats):
            code = self._code(flat, at, r, 0, SAMPLES)
            seen = np.zeros(1 << self.bits_seen, bool)
            seen[self._slot(code & np.uint64(0xFFFFFFFF), self.bits_seen)] = True
            order = np.argsort(code, kind="stable")
            self.first.append(seen)
            walk, stood = self._walk(flat, at, r)
            left = self.size[self.own] - self.offset
            self.walks.append((walk, stood < left[:, None]))
            self.tables.append((code[order], order))

    @staticmethod
    def _anchors(picked: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.array([k for k, _ in picked], np.int64), [len(at) for _, at in picked])
        return own, np.concatenate([np.zeros(0, np.int64), *(at for _, at in picked)])

    def _table(self, flat: np.ndarray, tied: list[tuple[int, np.ndarray]], n: int) -> tuple:
        """The grams of items that are tied at every byte, sorted, with their items and offsets, and a set of slots to look at first."""
        own, offset = self._anchors(tied)
        gram = _grams(flat, n)[self.begin[own] + offset]
        order = np.argsort(gram, kind="stable")
        bits = max(20, int(8 * len(gram)).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[self._slot(gram, bits)] = True
        return n, gram[order], own[order].astype(np.int32), offset[order].astype(np.int32), bits, seen

    @staticmethod
    def _slot(code: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _code(self, data: np.ndarray, at: np.ndarray, r: int, a: int, b: int, state=None):
        """Samples a to b of the walks from positions `at`, 8 bits each."""
        pos, step, code = (at.astype(np.int32), 0, np.zeros(len(at), np.uint64)) if state is None else state
        for k in range(a, b):
            while True:
                c = np.take(data, pos)
                taken = step == self.steps[r, k]
                if taken:
                    code = code | c.astype(np.uint64) << np.uint64(8 * k)
                pos = pos + np.take(self.bits[r, step], c)
                step += 1
                if taken:
                    break
        self._state = (pos, step, code)
        return code

    def _walk(self, data: np.ndarray, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the walks read, and where they stand at each step; positions x steps."""
        at = at.astype(np.int32)
        out, pos, stood = np.zeros((LONG, len(at)), np.uint8), at.copy(), np.zeros((LONG, len(at)), np.int32)
        for step in range(LONG):
            np.take(data, pos, out=out[step])
            np.subtract(pos, at, out=stood[step])
            pos += np.take(self.bits[r, step], out[step])
        return out.T, stood.T

    def candidates(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(window start, item) of windows that agree with an item's anchor; `ends`: no walk is taken beyond."""
        out = []
        at = at[at + STEPS <= ends] if len(self.own) else at[:0]
        for r in range(len(self.tables)):
            code = self._code(data, at, r, 0, 4)
            on = np.flatnonzero(self.first[r][self._slot(code, self.bits_seen)])
            if not len(on):
                continue
            pos, step, code = self._state
            code = self._code(data, at[on], r, 4, SAMPLES, (pos[on], step, code[on]))
            table_, order = self.tables[r]
            lo, hi = np.searchsorted(table_, code, "left"), np.searchsorted(table_, code, "right")
            n = hi - lo
            if n.any():
                k = np.repeat(np.arange(len(on)), n)
                anchor = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                walk, inside = self.walks[r][0][anchor], self.walks[r][1][anchor]
                near = ((self._walk(data, at[on][k], r)[0] == walk) & inside).sum(1) >= AGREE * inside.sum(1)
                k, anchor = k[near], anchor[near]
                out.append(np.stack([at[on][k] - self.offset[anchor], self.own[anchor]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def gram_candidates(self, data: np.ndarray, off: np.ndarray, tied: tuple):
        """(row, window start, item) of windows that share a gram with an item tied at every byte, a few at a time."""
        width, grams, owners, offsets, bits, seen = tied
        gram = _grams(data, width)[: max(0, int(off[-1]) - width + 1)]
        on = np.flatnonzero(seen[self._slot(gram, bits)])
        lo, hi = np.searchsorted(grams, gram[on], "left"), np.searchsorted(grams, gram[on], "right")
        on, lo, n = on[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        total, a = np.cumsum(n), 0
        while a < len(on):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD, "right")))
            pos, m = np.repeat(on[a:b], n[a:b]), n[a:b]
            seed = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            k, offset = owners[seed].astype(np.int64), offsets[seed].astype(np.int64)
            row, w = np.searchsorted(off, pos, "right") - 1, pos - offset
            keep = np.ones(len(k), bool)
            long = np.flatnonzero(self.size[k] > WORD)
            for some in np.array_split(long, len(long) // 16384 + 1):
                p, own = self.begin[k[some]] + offset[some], k[some]
                walk, stood = self._walk(self.flat, p, 0)
                inside = stood < (self.size[own] - offset[some])[:, None]
                keep[some] = ((self._walk(data, pos[some], 0)[0] == walk) & inside).sum(1) >= AGREE * inside.sum(1)
            row, w, k = row[keep], w[keep], k[keep]
            # of windows of an item that overlap but for a few bytes, one is enough
            step = np.maximum(1, np.array(self.most, np.int64)[k] // 2)
            _, one = np.unique(np.stack([row, k, w // step], 1), axis=0, return_index=True)
            row, w, k = row[one], w[one], k[one]
            yield row, w, k
            a = b


def edit_distances(patterns: list[bytes], which: np.ndarray, data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """edit_distance() of patterns of 1 to 64 bytes, `which` of them for each part a to z of the data, at once."""
    out = np.zeros(len(which), np.int64)
    for lo in range(0, len(which), 4096):
        part = slice(lo, lo + 4096)
        kinds, kind = np.unique(which[part], return_inverse=True)
        masks = np.zeros((len(kinds), 256), np.uint64)
        for j, k in enumerate(kinds.tolist()):
            for i, c in enumerate(patterns[k]):
                masks[j, c] |= np.uint64(1 << i)
        m = np.array([len(patterns[k]) for k in kinds.tolist()], np.int64)[kind]
        top, one = np.uint64(1) << (m - 1).astype(np.uint64), np.uint64(1)
        pv, mv, score, best = np.full(len(m), ~np.uint64(0)), np.zeros(len(m), np.uint64), m.copy(), m.copy()
        first, last = a[part], z[part]
        with np.errstate(over="ignore"):
            for t in range(int((last - first).max(initial=0))):
                eq = masks[kind, data[np.minimum(first + t, last - 1)]]
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
                np.minimum(best, score, out=best, where=first + t < last)
                ph, mh = ph << one, mh << one
                pv, mv = mh | ~(xv | ph), ph & xv
        out[part] = best
    return out


def edit_distance(pattern: bytes, text: bytes, most: int) -> int | None:
    """Fewest edits between the pattern and any part of the text, or None if more than `most`: Myers' bit vectors."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best if best <= most else None


class Search:
    """Finds a block's items in texts."""

    def __init__(self, items: Items):
        self.items = items

    def likely(self, row: np.ndarray, w: np.ndarray, k: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which windows have a part of their item within its share of the edits; no passage within the edits is without one."""
        it = self.items
        n = it.part_count[k]
        own = np.repeat(np.arange(len(k)), n)
        part = np.repeat(it.part_first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        most = np.array(it.most, np.int64)[k][own]
        a = np.clip(w[own] + it.part_from[part] - most, off[row[own]], off[row[own] + 1])
        z = np.clip(w[own] + it.part_to[part] + most, off[row[own]], off[row[own] + 1])
        good = edit_distances(it.parts, part, data, a, z) <= it.part_most[part]
        return np.bincount(own[good], minlength=len(k)) > 0

    def hits(self, data: np.ndarray, off: np.ndarray):
        """(row, item, start, edits) for the rows of one chunk."""
        it = self.items
        plain = np.r_[PLAIN[data], np.zeros(LONG + 8, np.uint8)]
        start = anchors_of(plain[: len(data) + 2]) if len(it.own) else np.zeros(0, np.int64)
        ends = off[np.searchsorted(off, start, "right")] if len(start) else start
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        sized, most_ = it.size, np.array(it.most, np.int64)
        others = []
        for row, w, k in (x for tied in it.grams for x in it.gram_candidates(plain, off, tied)):
            short = sized[k] <= WORD
            others += zip(row[~short].tolist(), w[~short].tolist(), k[~short].tolist())
            row, w, k = row[short], w[short], k[short]
            a, z = np.maximum(w - most_[k], off[row]), np.minimum(w + sized[k] + most_[k] + most_[k] // 2, off[row + 1])
            edits = edit_distances(it.bytes, k, plain, a, z)
            good = edits <= most_[k]
            for r, x, i, e in zip(row[good].tolist(), w[good].tolist(), k[good].tolist(), edits[good].tolist()):
                if (r, i) not in seen or e < seen[r, i][1]:
                    seen[r, i] = (max(x - int(off[r]), 0), e)
        found = it.candidates(plain, start, ends)
        # a window may begin before its row, or end after it, by edits: its middle lies in it
        row = np.searchsorted(off, np.clip(found[:, 0] + sized[found[:, 1]] // 2, 0, max(len(data) - 1, 0)), "right") - 1
        row, w, k = (np.r_[x, y].astype(np.int64) for x, y in zip((row, *found.T), zip(*others) if others else ((), (), ())))
        # of windows of an item that overlap but for a few bytes, one is enough
        near = w // np.maximum(1, most_[k] // 2) if len(k) else w
        _, one = np.unique(np.stack([row, k, near], 1), axis=0, return_index=True)
        row, w, k = row[one], w[one], k[one]
        keep = self.likely(row, w, k, plain, off) if len(k) else np.zeros(0, bool)
        for row, w, k in sorted(zip(row[keep].tolist(), w[keep].tolist(), k[keep].tolist())):
            m, most = len(it.bytes[k]), it.most[k]
            a, z = max(w - most, int(off[row])), min(w + m + most, int(off[row + 1]))
            if (row, k) in seen and seen[row, k][1] == 0 or done.get((row, k), -1 << 40) >= w - most // 2:
                continue
            done[row, k] = w
            e = edit_distance(it.bytes[k], plain[a:z].tobytes(), most)
            if e is not None and ((row, k) not in seen or e < seen[row, k][1]):
                seen[row, k] = (max(w - int(off[row]), 0), e)
        for k in it.plain:
            text, b = plain[: len(data)].tobytes(), it.bytes[k]
            at = text.find(b)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                if at + len(b) <= off[row + 1]:
                    seen.setdefault((row, k), (at - int(off[row]), 0))
                at = text.find(b, at + 1)
        return [(row, k, s, e) for (row, k), (s, e) in seen.items()]


_HIT = "doc_id long, item_id long, start long, edits long, item_bytes long"


def _scan(items):
    def rows(batches):
        search = Search(items.value)
        ids = items.value.ids
        for b in batches:
            data, off = utf8(b.column(1))
            docs = b.column(0)
            for a, z in runs(off):
                got = search.hits(data[off[a] : off[z]], off[a : z + 1] - off[a])
                if got:
                    row, item, start, edits = map(list, zip(*got))
                    yield pa.RecordBatch.from_arrays(
                        [docs.take(pa.array([r + a for r in row])), pa.array([ids[k] for k in item], pa.int64()), pa.array(start, pa.int64()), pa.array(edits, pa.int64()), pa.array([len(items.value.bytes[k]) for k in item], pa.int64())],
                        ["doc_id", "item_id", "start", "edits", "item_bytes"],
                    )

    return rows


def blocks(benchmark: DataFrame, size: int = BLOCK):
    """The items in blocks of at most `size` bytes, or of one longer item."""
    now, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if now and held + n > size:
            yield now
            now, held = [], 0
        now.append((r["item_id"], r["text"]))
        held += n
    if now:
        yield now


def _passes(docs: DataFrame, benchmark: DataFrame, edits: float, repeats: int, one):
    """one(rows, items) for each block of items, given the result before it; results of all blocks but a single one are written to the shared folder."""
    spark = docs.sparkSession
    waiting = blocks(benchmark)
    rows, k = next(waiting, None), 0
    while rows:
        after = next(waiting, None)
        sent = spark.sparkContext.broadcast(Items(rows, repeats, edits))
        got = one(sent)
        if k or after:
            path = shared_dir(spark)
            got.write.parquet(path)
            forget_at_exit(spark, path)
            sent.destroy()
            got = spark.read.schema(got.schema).parquet(path)
        yield got
        rows, k = after, k + 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, item_id, start, edits, item_bytes): a row for each document and item it holds; start in bytes, edits the fewest."""
    given = docs.select("doc_id", "text")
    out = None
    for got in _passes(docs, benchmark, edits, repeats, lambda sent: given.mapInArrow(_scan(sent), _HIT)):
        out = got if out is None else out.union(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], _HIT)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "item_bytes")).alias("m")).select("doc_id", "item_id", "m.start", "m.edits", "m.item_bytes")


def _clean(items, text: int):
    def rows(batches):
        search = Search(items.value)
        for b in batches:
            data, off = utf8(b.column(text))
            for a, z in runs(off):
                keep = np.ones(z - a, bool)
                keep[[r for r, *_ in search.hits(data[off[a] : off[z]], off[a : z + 1] - off[a])]] = False
                yield b.slice(a, z - a).filter(pa.array(keep))

    return rows


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, repeats: int = REPEATS) -> DataFrame:
    """The rows whose text holds no item; they go where they are read, so nothing is exchanged or joined."""
    left = [docs]
    for got in _passes(docs, benchmark, edits, repeats, lambda sent: left[-1].mapInArrow(_clean(sent, docs.columns.index("text")), docs.schema)):
        left.append(got)
    return left[-1]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
