"""Exact line de-duplication over all documents.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least `least_chars` code
points that are in at least `least_docs` documents lose all their lines, except in the largest doc_id that has it.

Plan: every row gives one row (128-bit key hash, doc_id, 128-bit text hash, line positions) for each distinct long key. These
are range-partitioned by (hash, doc_id descending, text hash), so that the rows of one very common line are dealt to many
partitions, and sorted by hash, document and position. Each partition is then streamed once: the first document of a
hash is its keeper, the others are drops. A hash that crosses partitions is settled by what each partition says of its
first and last hash (two rows a partition, the only thing that reaches the driver). Drops return as one compressed
keep bitmap for each row, which is joined to the text by doc_id and text hash.

Defined cases: null or empty text is one empty line (``\\n`` splits, so n newlines make n + 1 lines). Rows that repeat a doc_id
are one document: it counts once for a key, and where it is the keeper it keeps the line in all its rows; each row loses lines by
its own positions. Rows with a null doc_id are documents of their own, smaller than any id and ordered by a hash of the text;
those whose texts are equal too are one. An empty table gives an empty result; very long texts and lines are taken whole; columns
of the input other than doc_id and text may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import NO_ID, row_key, shared_dir, spread
from corpusloom.session import table

STRIP = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Rows whose texts are Python strings at once.
ROWS = 512


def _long_keys(text: str | None, least: int) -> dict[bytes, list[int]]:
    """128-bit hash of each key of at least `least` code points, with the positions of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) < least:
            continue
        key = line.strip(STRIP).lower()  # bytes.lower() takes A-Z only
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least):
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
    return found


#: What names a row: doc_id (NO_ID for null) and a 128-bit hash of its text.
ROW = ["row_id", "row_1", "row_2"]
_LINES = "h1 long, h2 long, row_id long, row_1 long, row_2 long, pos array<int>"


def _line_rows(least: int):
    def rows(batches):
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            h1, h2, own, pos = [], [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                for h, p in _long_keys(t, least).items():
                    x, y = struct.unpack("<qq", h)
                    h1.append(x)
                    h2.append(y)
                    own.append(i)
                    pos.append(p)
            key = [b.column(k).take(pa.array(own, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *key, pa.array(pos, pa.list_(pa.int32()))], [x.split()[0] for x in _LINES.split(", ")])

    return rows


def _documents(b: pa.RecordBatch) -> np.ndarray:
    """Rows (h1, h2, id, text hash), the text hash 0 where the id alone names the document."""
    out = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], 1)
    out[out[:, 2] != NO_ID, 3:] = 0
    return out


def _fresh(rows: np.ndarray, last: tuple | None, width: int) -> np.ndarray:
    """Where the first `width` columns differ from the row before."""
    out = np.ones(len(rows), bool)
    out[1:] = (rows[1:, :width] != rows[:-1, :width]).any(1)
    if last is not None:
        out[0] = tuple(rows[0, :width].tolist()) != last[:width]
    return out


_EDGE = "pid int, at int, h array<long>, n long, lo array<long>, hi array<long>"


def _edges(batches):
    """For the partition's first and last hash: documents counted, and the documents at either end."""
    from pyspark import TaskContext

    first = run = last = None  # [hash, documents, first one, last one]
    for b in batches:
        if not b.num_rows:
            continue
        rows = _documents(b)
        fresh = _fresh(rows, last, 5)
        cut = np.flatnonzero(_fresh(rows, None, 2))
        for a, z in zip(cut, np.r_[cut[1:], len(rows)]):
            n, h = int(fresh[a:z].sum()), rows[a, :2].tolist()
            if run is not None and run[0] == h:
                run[1] += n
                run[3] = rows[z - 1, 2:].tolist()
            else:
                if first is None and run is not None:
                    first = list(run)
                run = [h, n, rows[a, 2:].tolist(), rows[z - 1, 2:].tolist()]
        last = tuple(rows[-1].tolist())
    if run is not None:
        got = [run] if first is None else [first, run]
        pid = TaskContext.get().partitionId()
        many = pa.list_(pa.int64())
        kinds = {"pid": pa.int32(), "at": pa.int32(), "h": many, "n": pa.int64(), "lo": many, "hi": many}
        yield pa.RecordBatch.from_pylist([dict(zip(kinds, [pid, i, *g])) for i, g in enumerate(got)], pa.schema(kinds.items()))


def _carry(edges: list) -> dict[int, dict[tuple, tuple[int, int, tuple | None]]]:
    """For each partition and edge hash: all documents of that hash, those in earlier partitions, and the last one before."""
    total: dict[tuple, int] = {}
    before: dict[int, dict] = {}
    end: dict[tuple, tuple] = {}
    for r in sorted(edges, key=lambda r: (r["pid"], r["at"])):
        h = tuple(r["h"])
        seen, prev = total.get(h, 0), end.get(h)
        n = r["n"] - (prev == tuple(r["lo"]))  # a document whose rows were cut apart
        before.setdefault(r["pid"], {})[h] = (seen, prev)
        total[h], end[h] = seen + n, tuple(r["hi"])
    return {p: {h: (total[h], s, prev) for h, (s, prev) in x.items()} for p, x in before.items()}


def _drops(carry: dict, least_docs: int):
    """Streams a sorted partition; gives the lines that go, by row and position. Rows of at most least_docs documents wait."""

    def rows(batches):
        from pyspark import TaskContext

        own = carry.get(TaskContext.get().partitionId(), {})
        hash_, keeper, n, known, waiting, prev = None, None, 0, False, [], None
        for b in batches:
            if not b.num_rows:
                continue
            docs = _documents(b)
            out_row: list[int] = []
            late: list[pa.RecordBatch] = []
            # rows whose hash has no equal neighbour are single: only the rest are looked at
            same = (docs[1:, :2] == docs[:-1, :2]).all(1)
            busy = np.zeros(len(docs), bool)
            busy[1:] |= same
            busy[:-1] |= same
            busy[[0, -1]] = True
            for i in np.flatnonzero(busy).tolist():
                x = docs[i].tolist()
                h, d = tuple(x[:2]), tuple(x[2:])
                if h != hash_:
                    all_, seen, end = own.get(h, (0, 0, None))
                    hash_, n, known, waiting, prev = h, seen, all_ >= least_docs, [], end
                    keeper = "before" if seen else None
                if d != prev:
                    n, prev = n + 1, d
                    if keeper is None:
                        keeper = d
                if d == keeper or (keeper == "before" and d == own[h][2] and own[h][1] == 1):
                    continue
                if known or n >= least_docs:
                    late += waiting
                    waiting, known = [], True
                    out_row.append(i)
                else:
                    waiting.append(b.slice(i, 1).select([*ROW, "pos"]))
            if out_row or late:
                yield from late
                yield b.select([*ROW, "pos"]).take(pa.array(out_row, pa.int64()))

    return rows


def kept_lines(lines: list, bitmap: bytes | None) -> list:
    """The lines whose bit is 1, or that lie beyond the bitmap."""
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    keep = np.ones(len(lines), bool)
    k = min(len(bits), len(lines))
    keep[:k] = bits[:k].astype(bool)
    return [x for x, y in zip(lines, keep) if y]


def _bitmaps(batches):
    """Rows of a row key and its lists of positions to the key, the number of lines dropped, and the bitmap."""
    for b in batches:
        maps, n = [], []
        for ps in b.column(3).to_pylist():
            flat = sorted({x for p in ps for x in p})
            keep = np.ones(-(-(flat[-1] + 1) // 8) * 8, np.uint8)
            keep[flat] = 0
            n.append(len(flat))
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(maps, pa.binary())], [*ROW, "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row_id, row_1, row_2, n_dropped, keep) for the rows that lose lines; the first three are common.row_key()."""
    spark = docs.sparkSession
    lines = docs.select(*row_key(*ROW), "text").mapInArrow(_line_rows(least_chars), _LINES)
    by = [F.col("h1"), F.col("h2"), F.col("row_id").desc(), F.col("row_1"), F.col("row_2")]
    dealt = lines.repartitionByRange(spread(spark), *by).sortWithinPartitions(*by, F.col("pos")[0])
    shared_dir(spark)  # sets the checkpoint folder where it is unset
    dealt = dealt.checkpoint()  # keeps the partitions and their order for both passes
    edges = dealt.drop("pos").mapInArrow(_edges, _EDGE).collect()
    drops = dealt.mapInArrow(_drops(_carry(edges), least_docs), "row_id long, row_1 long, row_2 long, pos array<int>")
    return drops.groupBy(*ROW).agg(F.collect_list("pos").alias("pos")).mapInArrow(_bitmaps, "row_id long, row_1 long, row_2 long, n_dropped long, keep binary")


def _with_keep(docs: DataFrame, columns: list[str], out: str, **kw) -> DataFrame:
    """The columns with each row's bitmap, null where no line goes."""
    names = [f"__line_{c}" for c in ROW]
    maps = line_bitmaps(docs.select("doc_id", "text"), **kw).select(*[F.col(c).alias(n) for c, n in zip(ROW, names)], F.col("keep").alias("__line_keep"))
    keyed = docs.select(*columns, *row_key(*names))
    return keyed.join(maps, names, "left").select(*columns, F.col("__line_keep").alias(out))


def with_bitmaps(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, text, keep) of docs."""
    return _with_keep(docs, ["doc_id", "text"], "keep", **kw)


def _apply(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    left = kept_lines(lines, keep)
    return len(lines), len(lines) - len(left), "\n".join(left)


def _cut(names: list[str]):
    """Columns and the bitmap (last) to the columns without the dropped lines; a few rows' texts at a time."""
    text = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def rows(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                cols = b.columns[:-1]
                keep = b.columns[-1]
                if keep.null_count < len(keep):
                    new = [t if k is None else _apply(t, k)[2] for t, k in zip(cols[text].to_pylist(), keep.to_pylist())]
                    if count is not None:
                        cols[count] = pa.array([n if k is None else len(t) for n, k, t in zip(cols[count].to_pylist(), keep.to_pylist(), new)], cols[count].type)
                    cols[text] = pa.array(new, cols[text].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows


def dedup_lines(docs: DataFrame, **kw) -> DataFrame:
    """The documents without their dropped lines; other columns as they were. n_chars, if there, is counted anew where lines went."""
    return _with_keep(docs, docs.columns, "__line_keep", **kw).mapInArrow(_cut(docs.columns), docs.schema)


def _digest(batches):
    for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
        n, gone, sha = [], [], []
        for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            x, y, s = _apply(t, k)
            n.append(x)
            gone.append(y)
            sha.append(hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", "keep").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT doc_id, pos, line, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id"""
