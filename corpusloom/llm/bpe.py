"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece the encoding has exactly one valid last token: of the vocabulary's tokens that end the
prefix, the one that may follow the last token of the prefix before it. So the state of a text is one token id for
each byte position; appending extends it, and after an edit only the positions from the edit on are redone, until as
many states as the longest token has bytes agree with the old ones.

Two tokens may stand side by side if no merge across their border would have come before the merges that made them;
this is read off the tokens' last merges (`Ranks.may_follow`). A piece that is itself a token is that token.

A column is encoded in batches: the distinct new pieces of a batch go through the same recurrence in numpy, one byte
position of all pieces at a time; long pieces go through it alone. Pieces seen before are kept in a bounded cache.

Defined cases: null text counts as empty, and an empty text has no tokens. Text is UTF-8; decoding gives its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Rolling
from corpusloom.session import table

#: Rows whose tokens are held at once where they are returned.
ROWS = 1024
#: Pieces of more bytes are encoded alone; pieces kept by a Python worker between batches; code points taken at once.
ALONE, CACHE, AT_ONCE = 48, 500_000, 1 << 22


class Lookup:
    """64-bit keys to small integers, -1 for others: open addressing, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.most = 1
        for k, v in zip(keys.tolist(), values.tolist()):
            i, n = ((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - bits), 1
            while self.values[i] >= 0:
                i, n = (i + 1) & self.mask, n + 1
            self.keys[i], self.values[i], self.most = k, v, max(self.most, n)

    def get(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            i = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        v = self.values[i]
        out = np.where(self.keys[i] == keys, v, -1)
        on = np.flatnonzero((out < 0) & (v >= 0))
        for _ in range(self.most - 1):
            if not len(on):
                break
            i[on] = (i[on] + 1) & self.mask
            v = self.values[i[on]]
            out[on] = np.where(self.keys[i[on]] == keys[on], v, -1)
            on = on[(v >= 0) & (out[on] < 0)]
        return out


class Ranks:
    """A rank file's tokens, their last merges, and tables for the recurrence."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.token = [b""] * n
        for t, i in ranks.items():
            self.token[i] = t
        self.longest = max(map(len, ranks))
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.zeros(n, bool)  # tokens that merges make; another is one only as a whole piece
        pairs = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.made[i] = True
            elif p := self._last_merge(t):
                self.made[i], self.left[i], self.right[i] = True, *p
                pairs[p] = i
        self.pairs = pairs
        self.pair_table = Lookup(np.array([a << 32 | b for a, b in pairs], np.uint64), np.fromiter(pairs.values(), np.int32, len(pairs)))
        able = [i for i in range(n) if self.made[i]]
        flat = np.frombuffer(b"".join(self.token[i] for i in able), np.uint8)
        ends = np.cumsum(self.size[able])
        self.hash_table = Lookup(Rolling(flat).of(ends - self.size[able], ends), np.array(able, np.int32))
        self.lengths = set(self.size[able].tolist())
        self._memo: dict[tuple[int, int], bool] = {}

    def _last_merge(self, t: bytes) -> tuple[int, int] | None:
        """The pair whose merge makes t out of its own bytes, if merging lower ranks first makes it."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                return None
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether b may stand right after a."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40)
        on = np.arange(len(a))
        while len(on):
            made = self.pair_table.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            bad = (made >= 0) & (made < limit)
            ok[on[bad]] = False
            # undo the later of the two last merges: the part at the border stands there before it
            first = a > b
            can_a, can_b = self.right[a] != a, self.left[b] != b
            undo_a = np.where(first, can_a, ~can_b & can_a)
            undo_b = ~undo_a & can_b
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            stay = ~bad & (undo_a | undo_b)
            a, b, limit, on = a[stay], b[stay], limit[stay], on[stay]
        return ok

    def follows(self, a: int, b: int) -> bool:
        if (k := (a, b)) not in self._memo:
            if len(self._memo) > 500_000:
                self._memo.clear()
            self._memo[k] = bool(self.may_follow(np.array([a]), np.array([b]))[0])
        return self._memo[k]


@lru_cache(2)
def load(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class PrefixState:
    """One piece's bytes with the last token of each of its prefixes; exact appends and edits."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def _step(self, j: int, last: list[int]) -> int:
        r = self.ranks
        for n in range(min(j, r.longest), 0, -1):
            t = r.ranks.get(self.data[j - n : j])
            if t is not None and r.made[t] and (n == j or r.follows(last[j - n - 1], t)):
                return t
        raise ValueError("a byte is missing from the vocabulary")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for j in range(at + 1, len(self.data) + 1):
            self.last.append(self._step(j, self.last))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """data[start:end] becomes new; returns how many states were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        agree = 0
        for j in range(start + 1, len(self.data) + 1):
            self.last.append(self._step(j, self.last))
            agree = agree + 1 if j > start + len(new) and self.last[-1] == old[j - 1 - shift] else 0
            if agree >= self.ranks.longest:
                self.last += old[j - shift :]
                return j - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        if (whole := self.ranks.ranks.get(self.data)) is not None:
            return [whole]
        out, j = [], len(self.data)
        while j:
            out.append(self.last[j - 1])
            j -= len(self.ranks.token[out[-1]])
        return out[::-1]


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    by: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if (whole := ranks.ranks.get(p)) is not None:
            out[k] = whole.to_bytes(4, "little")
        elif len(p) > ALONE:
            out[k] = np.array(PrefixState(ranks, p).ids(), "<u4").tobytes()
        elif p:
            by.setdefault(len(p), []).append(k)
    for n, own in by.items():
        rows = len(own)
        roll = Rolling(np.frombuffer(b"".join(pieces[k] for k in own), np.uint8))
        at = np.arange(rows, dtype=np.int64) * n
        last = np.full((n + 1, rows), -1, np.int64)
        for j in range(1, n + 1):
            on = np.arange(rows)
            for m in range(min(j, ranks.longest), 0, -1):
                if m not in ranks.lengths:
                    continue
                t = ranks.hash_table.get(roll.of(at[on] + (j - m), at[on] + j))
                hit = np.flatnonzero(t >= 0)
                if m < j and len(hit):
                    hit = hit[ranks.may_follow(last[j - m, on[hit]], t[hit])]
                last[j, on[hit]] = t[hit]
                if len(hit):
                    rest = np.ones(len(on), bool)
                    rest[hit] = False
                    on = on[rest]
                    if not len(on):
                        break
        ids = np.zeros((rows, n), "<u4")
        count = np.zeros(rows, np.int64)
        j, on = np.full(rows, n), np.arange(rows)
        while len(on):
            t = last[j[on], on]
            count[on] += 1
            ids[on, n - count[on]] = t
            j[on] -= ranks.size[t]
            on = on[j[on] > 0]
        for k, row, c in zip(own, ids, count.tolist()):
            out[k] = row[n - c :].tobytes()
    return out


class Encoder:
    """Texts to ids; keeps a bounded number of pieces."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.find, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            group, size = [], 0
            while k < len(texts) and (not group or size + len(texts[k] or "") <= AT_ONCE):
                group.append(self.find(texts[k] or ""))
                size += len(texts[k] or "")
                k += 1
            if len(self.known) > CACHE:
                self.known.clear()
            new = list({p for g in group for p in g if p not in self.known})
            self.known.update(zip(new, encode_pieces(self.ranks, [p.encode("utf-8", "surrogatepass") for p in new])))
            get = self.known.__getitem__
            out += [b"".join(map(get, g)) for g in group]
        return out


def decode(ranks: Ranks, ids: bytes) -> bytes:
    t = np.frombuffer(ids, "<u4").astype(np.int64)
    size = ranks.size[t]
    ends = np.cumsum(size)
    if not len(t):
        return b""
    return ranks.bytes[np.repeat(ranks.start[t] - (ends - size), size) + np.arange(ends[-1])].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load(path), pattern)
    return _ENCODERS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows with `ids` (array of int), the tokens of `text`."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def ids(text):
        import pandas as pd

        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in encoder(path, pattern).encode(list(text))], dtype=object)

    return docs.withColumn("ids", ids("text"))


def decode_column(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The rows with `decoded` (binary), the bytes of an ids column; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def back(ids):
        import pandas as pd

        r = load(path)
        return pd.Series([None if x is None else decode(r, np.asarray(x, "<u4").tobytes()) for x in ids], dtype=object)

    return df.withColumn("decoded", back(column))


def _digests(path: str, pattern: str):
    def rows(batches):
        enc = encoder(path, pattern)
        for b in batches:
            n, sha, back = [], [], []
            for ids in enc.encode(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decode(enc.ranks, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows with n_tokens, ids, and exact (whether the ids decode to the text's bytes), which take the place of columns of these names. A null text is empty."""
    docs = docs.drop("n_tokens", "ids", "exact")
    names = docs.columns

    def rows(batches):
        enc = encoder(path, pattern)
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            text = b.column(names.index("text")).to_pylist()
            coded = enc.encode(text)
            exact = [decode(enc.ranks, x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(coded, text)]
            size = np.array([len(x) // 4 for x in coded], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), ids, pa.array(exact, pa.bool_())], [*names, "n_tokens", "ids", "exact"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{schema}, n_tokens long, ids array<int>, exact boolean")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
