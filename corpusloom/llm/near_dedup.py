"""Near-duplicate documents by a signature-coordinate inverted join, links confirmed on full shingle sets.

Every document has K MinHash coordinates. A pair whose resemblance is at least the limit agrees in at least T of them
but for a chance below one in a million (T lies 5.2 standard deviations below the mean). A pair that agrees in
T of K must share one of the first K - T + 1 (the prefix); so documents are posted under these coordinate-value pairs only,
and a posting list counts the other collisions from the 1-byte coordinates its rows carry, skipping documents whose
sizes rule out a link.

Equal sets are one class with one representative before anything is posted, so copies meet in a groupBy with partial
aggregation. Lists of up to `SHORT` classes give their candidate pairs at once; these are joined to the sets by doc_id and
intersected. A longer list (a passage many documents share, a large group of near copies) never gives its pairs. It is cut
by runs of equal further coordinates, in such a way that every candidate pair shares one, and gives a
spanning forest of its candidate graph: at most one row for each member. The components of all forests are candidate
groups. A group of up to `GROUP` members is one task, which counts all intersections as products of incidence matrices and
gives a spanning forest of the confirmed links. In a larger one all members are held against a few pivots first; the members outside the
largest part that this connects are then dealt in blocks, each pair of such blocks and each pair with a block of that part to a
task. So memory is bounded by the block, and the work is in proportion to the group where its members are close to one another, and grows with the
square of the members that are not.

Components are found by repeated minimum labels with shortcuts, checkpointed to the shared folder.

Defined cases: a document without words (null, empty, blank) has an empty set, links with nothing and is kept; fewer words than a shingle are
one shingle; very long texts are taken whole. In near_duplicates rows that repeat a doc_id are one node of the graph, with the links of each, and each row is
returned with the id's component; a row with a null doc_id is a node of its own (with those of the same text), its component_id is the least id that
it reaches, null if there is none, and it is kept only if there is none and it has the component's least hash. without_near_duplicates, which drops rows, has a
node for each (doc_id, text), so that no text goes for another one's links; the one with the least doc_id stays (null before all), and of rows that repeat both
doc_id and text one stays, unless the text has no words. An empty table gives none. Columns other than doc_id and text may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, Rolling, mix, runs, staged, spread, utf8, words
from corpusloom.session import table

#: Coordinates; standard deviations below the mean that still count; classes in a short list; members of a block.
K, SIGMAS, SHORT, GROUP = 64, 5.2, 16, 512
#: Members of a large group that all others are held against first, and tasks that a large group is dealt to then.
PIVOTS, SALTS = 4, 16
#: Parts of a group of equal sets.
COPY_SALTS = 64
#: Columns of an incidence matrix held at once; ids (8 bytes each) that may be broadcast.
WIDTH, MOST_SENT = 4096, 2_000_000
_A = np.random.default_rng(7).integers(1, 1 << 62, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(1, 1 << 62, 128, dtype=np.uint64)


def least_matches(limit: float, k: int = K) -> int:
    return max(1, int(k * limit - SIGMAS * (k * limit * (1 - limit)) ** 0.5))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and their len + 1 offsets."""
    low = LOWER[data]
    start, end, count = words(low, off)
    h = Rolling(low).of(start, end) if len(start) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.r_[0, np.cumsum(count)]
    with np.errstate(over="ignore"):
        acc, m = np.zeros(max(0, len(h) - n + 1), np.uint64), max(0, len(h) - n + 1)
        for i in range(n):
            acc = mix(acc + h[i : i + m]) if m else acc
    own = doc[:m]
    whole = own == doc[n - 1 :] if m else np.zeros(0, bool)
    acc, own = acc[whole], own[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for d in short:
            x = np.uint64(count[d])
            for y in h[at[d] : at[d + 1]]:
                x = mix(np.array([x ^ y]))[0]
            extra.append(x)
        acc, own = np.r_[acc, np.array(extra, np.uint64)], np.r_[own, short]
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    if len(acc):
        new = np.ones(len(acc), bool)
        new[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
        acc, own = acc[new], own[new]
    return acc, np.searchsorted(own, np.arange(len(count) + 1))


def signatures(sets: np.ndarray, off: np.ndarray, k: int = K) -> np.ndarray:
    """k least values of each non-empty row; rows x k."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = sets * _A[j] + _B[j]
            x ^= x >> np.uint64(31)
            if len(full):
                out[full, j] = np.minimum.reduceat(x, off[full])
    return out


def _per_doc(n: int, prefix: int):
    def rows(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for a, z in runs(off):
                sets, so = shingle_sets(data[off[a] : off[z]], off[a : z + 1] - off[a], n)
                size = np.diff(so)
                sig = signatures(sets, so)
                # a set's own 128 bits: sums of two mixes of its members
                with np.errstate(over="ignore"):
                    c1, c2 = (np.r_[np.uint64(0), np.cumsum(mix(sets ^ np.uint64(s)), dtype=np.uint64)] for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                    h1, h2 = c1[so[1:]] - c1[so[:-1]], c2[so[1:]] - c2[so[:-1]]
                    keys = mix(sig[:, :prefix] + np.arange(prefix, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                low = np.ascontiguousarray((sig >> np.uint64(40)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(a, z - a),
                        pa.array(size, pa.int64()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * prefix), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "n", "h1", "h2", "sig", "keys"],
                )

    return rows


_DOC = "doc_id long, n long, h1 long, h2 long, sig binary, keys array<long>"


def _lists(batches, width: int):
    """Sorted rows (key first) as whole lists: the columns' arrays from row to row of the same key; lists of one are passed over."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        t = t.combine_chunks()
        key = t.column(0).to_numpy()
        if not len(key):
            continue
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[cut[1:], len(key)]
        cols = None
        for a, z in zip(cut[:-1], ends[:-1]):
            if z - a > 1:
                cols = cols or _columns(t, width)
                yield tuple(c[a:z] for c in cols)
        rest = t.slice(cut[-1])
    if rest is not None and rest.num_rows > 1:
        yield tuple(_columns(rest.combine_chunks(), width))


def _columns(t: pa.Table, width: int) -> list[np.ndarray]:
    out = []
    for name in t.column_names:
        c = t.column(name)
        if pa.types.is_binary(c.type):
            data, _ = utf8(c)
            out.append(data.reshape(-1, width))
        else:
            out.append(c.to_numpy())
    return out


def _candidates(i: int, others: np.ndarray, sig: np.ndarray, n: np.ndarray, t: int, limit: int) -> np.ndarray:
    """Those of `others` that agree with row i in t coordinates and whose sizes don't rule out a link."""
    others = others[100 * np.minimum(n[i], n[others]) >= limit * np.maximum(n[i], n[others])]
    return others[(sig[others] == sig[i]).sum(1) >= t] if len(others) else others


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def spanning(sig: np.ndarray, n: np.ndarray, t: int, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the candidate graph of one list.

    A pair that agrees in t of K coordinates agrees in all of at least one of any K - t + 1 groups of them; so only members with
    an equal group are compared, and of these only members that are not connected yet.
    """
    root, edges = np.arange(len(n)), []
    for cols in np.array_split(np.arange(sig.shape[1]), sig.shape[1] - t + 1):
        code = np.zeros(len(n), np.int64)
        for c in cols:
            code = code << 8 | sig[:, c]
        order = np.argsort(code, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        ends = np.r_[cut[1:], len(n)]
        for a, z in zip(cut[ends - cut > 1], ends[ends - cut > 1]):
            run = order[a:z]
            for i in run:
                others = run[root[run] != root[i]]
                if not len(others):
                    if (root[run] == root[run[0]]).all():
                        break
                    continue
                for j in _candidates(i, others, sig, n, t, limit):
                    if root[i] != root[j]:
                        edges.append((i, j))
                        root[root == root[j]] = root[i]
    return edges


_FOUND = "a long, b long, long boolean"


def _found(a: list, b: list, far: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(np.concatenate(far) if far else np.zeros(0, bool), pa.bool_())], ["a", "b", "long"]
    )


def _posting_lists(t: int, limit: int):
    """From (key, doc_id, n, sig): candidate pairs of short lists, spanning forests of long ones."""

    def rows(batches):
        a, b, far, held = [], [], [], 0
        for _, doc, n, sig in _lists(batches, K):
            if len(doc) > SHORT:
                pairs = np.array(spanning(sig, n, t, limit), np.int64).reshape(-1, 2)
            else:
                pairs = np.array([(i, j) for i in range(len(doc) - 1) for j in _candidates(i, np.arange(i + 1, len(doc)), sig, n, t, limit)], np.int64).reshape(-1, 2)
            if len(pairs):
                a.append(doc[pairs[:, 0]])
                b.append(doc[pairs[:, 1]])
                far.append(np.full(len(pairs), len(doc) > SHORT))
                held += len(pairs)
            if held > 50_000:
                yield _found(a, b, far)
                a, b, far, held = [], [], [], 0
        yield _found(a, b, far)

    return rows


def forest(sets: list[np.ndarray], limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, by all intersections at once."""
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    col = (np.cumsum(common) - 1)[at]
    keep = common[at]
    row, col = row[keep], col[keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(common.sum()), WIDTH):
        a, z = np.searchsorted(col, [first, first + WIDTH])
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[row[a:z], col[a:z] - first] = 1
        both += m @ m.T
    linked = 100 * both >= limit * (size[:, None] + size[None, :] - both)
    edges, free = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not free[start]:
            continue
        free[start], queue = False, [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & free)
            free[new] = False
            edges += [(i, j) for j in new]
            queue += new.tolist()
    return edges


def _blocks(limit: int):
    """From (key, doc_id, shingles) sorted by key, a pair of blocks for each key: confirmed links."""

    def links(doc: list, sets: list) -> pa.RecordBatch:
        pairs = np.array(forest(sets, limit), np.int64).reshape(-1, 2)
        ids = np.array(doc, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    def rows(batches):
        now, doc, sets = None, [], []
        for b in batches:
            for key, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if key != now:
                    if doc:
                        yield links(doc, sets)
                    now, doc, sets = key, [], []
                doc.append(d)
                sets.append(np.frombuffer(x.as_buffer(), np.uint64))
        if doc:
            yield links(doc, sets)

    return rows


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(spread(df.sparkSession), "key").sortWithinPartitions("key")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles as binary) of the documents in ids(doc_id)."""

    def rows(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for a, z in runs(off):
                sets, so = shingle_sets(data[off[a] : off[z]], off[a : z + 1] - off[a], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([sets[x:y].tobytes() for x, y in zip(so[:-1], so[1:])], pa.binary())], ["doc_id", "shingles"])

    # so that the texts stay where they are while the ids are few; beyond the bound both sides are dealt by id
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(rows, "doc_id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= limit * union of their sets."""

    def rows(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                o = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * o >= limit * (len(p) + len(q) - o))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): the least id reachable, for every id that an edge (a, b) has.

    A round gives each id the least label of its neighbours and then that label's own label; each is one aggregation over the
    edges, and the number of rounds grows with the logarithm of the longest path. Labels are checkpointed.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("label")).select("doc_id", F.least("doc_id", "label").alias("label"))
    labels, before = labels.checkpoint(), None
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the old label learns of the new one as well, so that whole trees are hooked; then labels jump
        hook = low.groupBy(F.col("old").alias("doc_id")).agg(F.min("label").alias("up"))
        low = low.join(hook, "doc_id", "left").select("doc_id", F.least("label", F.coalesce("up", "label")).alias("label")).checkpoint()
        up = low.select(F.col("doc_id").alias("label"), F.col("label").alias("up"))
        labels = low.join(up, "label", "left").select("doc_id", F.coalesce("up", "label").alias("label")).checkpoint()
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    if docs.filter("doc_id IS NULL").isEmpty():
        got, labels = _linked(docs, n, percent)
        out = got.select("doc_id", "n").join(labels, "doc_id", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
        )
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    # nodes are hashes of the ids, or of the texts where there is none
    node = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null id"), "text")).otherwise(F.xxhash64("doc_id"))
    got, labels = _linked(docs.select(node.alias("doc_id"), "text"), n, percent)
    names = staged(docs.select(node.alias("node"), F.col("doc_id").alias("own")).distinct())
    labels = labels.select(F.col("doc_id").alias("node"), "label")
    first = names.join(labels, "node").groupBy("label").agg(F.min("own").alias("component_id"))
    out = got.select(F.col("doc_id").alias("node"), F.col("n").alias("n_shingles")).join(names, "node")
    out = out.join(labels, "node", "left").join(first, "label", "left")
    alone = F.col("own").isNull() & F.col("component_id").isNull() & ((F.col("label") == F.col("node")) | F.col("label").isNull())
    component = F.coalesce("component_id", "own")
    return out.select(F.col("own").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("own") == component, alone).alias("kept"))


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What _per_doc gives for docs(doc_id, text), no id null, and (doc_id, label) of the ids that are linked."""
    t = least_matches(percent / 100)
    got = staged(docs.select("doc_id", "text").mapInArrow(_per_doc(n, K - t + 1), _DOC))
    full = got.filter("n > 0")
    # one representative for each distinct set, met by way of up to COPY_SALTS others, so that many copies are not dealt to one task
    salted = full.select("doc_id", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS)).alias("salt"))
    parts = salted.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("part"), F.count("*").alias("rows"))
    reps = parts.groupBy("h1", "h2").agg(F.min("part").alias("rep"), F.sum("rows").alias("rows"))
    same = salted.join(parts.filter("rows > 1"), ["h1", "h2", "salt"]).select(F.col("part").alias("a"), F.col("doc_id").alias("b"))
    same = same.union(parts.select("h1", "h2", "part").join(reps.filter("rows > 1"), ["h1", "h2"]).select(F.col("rep").alias("a"), F.col("part").alias("b"))).filter("a <> b")
    own = full.join(reps.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    own = own.select("doc_id", "n", "sig", F.explode("keys").alias("key"))
    post = _dealt(own.select("key", "doc_id", "n", "sig"))
    found = staged(post.mapInArrow(_posting_lists(t, percent), _FOUND).distinct())
    pairs, far = found.filter("NOT long").select("a", "b"), found.filter("long").select("a", "b")
    ids = staged(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = staged(_sets(docs, ids, n))
    links = _confirmed(pairs, sets, percent)
    if not far.isEmpty():
        links = links.union(_group_links(components(far), sets, percent))
    links = staged(links)
    edges = same.union(links)
    return got, components(edges)


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose doc_id is the least of their component, null before all; columns as they were.

    Nodes are 64-bit hashes of (doc_id, text), so of rows that share a doc_id each goes or stays by its own text (of two that are linked
    with one another, one stays); of rows that repeat both, one stays.
    """
    node = F.xxhash64("doc_id", "text")
    got, labels = _linked(docs.select(node.alias("doc_id"), "text"), n, percent)
    members = docs.select(node.alias("node"), F.col("doc_id").alias("own")).join(labels.select(F.col("doc_id").alias("node"), "label"), "node").distinct()
    first = members.groupBy("label").agg(F.min(F.struct("own", "node")).getField("node").alias("node"))
    gone = labels.select(F.col("doc_id").alias("_gone")).join(first.select(F.col("node").alias("_gone")), "_gone", "left_anti")
    again = got.filter("n > 0").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("rows")).filter("rows > 1").select("_again")
    again = staged(again.join(gone, again["_again"] == gone["_gone"], "left_anti"))
    if again.isEmpty():
        return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["_gone"], "left_anti")
    gone = staged(gone.union(again))
    single = docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["_gone"], "left_anti")
    # copies meet in a partial aggregation
    copies = docs.select(node.alias("_node"), F.struct(*[docs[c] for c in docs.columns]).alias("_row")).join(again, F.col("_node") == F.col("_again"), "left_semi")
    return single.union(copies.groupBy("_node").agg(F.first("_row").alias("_row")).select("_row.*"))


def _star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of the members of candidate groups (doc_id, label) with `PIVOTS` members of their group."""
    picks = [F.min(F.struct(F.xxhash64("doc_id", F.lit(i)).alias("o"), "doc_id")).getField("doc_id").alias(f"p{i}") for i in range(PIVOTS)]
    chosen = members.groupBy("label").agg(*picks).select("label", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("doc_id"))
    pivots = chosen.join(sets, "doc_id").groupBy("label").agg(F.collect_list(F.struct("doc_id", "shingles")).alias("pivots"))
    # a group's members are dealt to SALTS tasks, and its pivots to each of them
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))

    def rows(batches):
        for b in batches:
            a, z = [], []
            for d, x, ps in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                for p in ps:
                    other = np.frombuffer(p["shingles"], np.uint64)
                    o = len(np.intersect1d(own, other, assume_unique=True)) if p["doc_id"] != d else -1
                    if 100 * o >= percent * (len(own) + len(other) - o):
                        a.append(min(d, p["doc_id"]))
                        z.append(max(d, p["doc_id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return members.join(sets, "doc_id").join(pivots, ["label", "salt"]).select("doc_id", "shingles", "pivots").mapInArrow(rows, "a long, b long")


def _group_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links, enough to connect what is connected, within candidate groups (doc_id, label)."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    sized = groups.join(sizes, "label")
    keyed = sized.filter(F.col("size") <= GROUP).select("doc_id", F.xxhash64("label").alias("key"))
    large = staged(sized.filter(F.col("size") > GROUP).select("doc_id", "label"))
    star = None
    if not large.isEmpty():
        star = staged(_star_links(large, sets, percent))
        # a row of a few numbers for each large group: broadcast while they are few, so that members are not dealt by group
        few = F.broadcast if large.select("label").distinct().count() <= MOST_SENT // 4 else lambda df: df
        parts = large.join(components(star).withColumnRenamed("label", "part"), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        main = parts.groupBy("label", "part").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
        parts = parts.join(few(main), "label").select("doc_id", "label", (F.col("part") == F.col("main")).alias("inside"))
        # the part that the pivots connect is met by the others only; those in blocks of half the size, so that a task has one block of each
        blocks = parts.groupBy("label").agg(
            F.ceil(F.count_if(~F.col("inside")) * 2 / GROUP).cast("int").alias("rest"), F.ceil(F.count_if("inside") / GROUP).cast("int").alias("mains")
        )
        h = "pmod(xxhash64(doc_id), greatest({}, 1))"
        inside = f"transform(sequence(0, rest - 1), i -> xxhash64(label, 1, i, cast({h.format('mains')} AS int)))"
        own = f"cast({h.format('rest')} AS int)"
        outside = (
            f"concat(transform(filter(sequence(0, rest - 1), j -> rest = 1 OR j <> {own}), j -> xxhash64(label, 0, least(j, {own}), greatest(j, {own}))), "
            f"transform(sequence(0, mains - 1), j -> xxhash64(label, 1, {own}, j)))"
        )
        met = parts.join(few(blocks), "label").filter("rest > 0")
        keyed = keyed.unionByName(met.select("doc_id", F.explode(F.expr(f"CASE WHEN inside THEN {inside} ELSE {outside} END")).alias("key")))
    rows = keyed.join(sets, "doc_id").select("key", "doc_id", "shingles")
    links = _dealt(rows).mapInArrow(_blocks(percent), "a long, b long")
    return links if star is None else links.union(star)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
 ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = d.doc_id"""
