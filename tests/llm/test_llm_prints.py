"""Fingerprints: every column of the query by plain Python, on awkward rows and many ranges."""

import hashlib
import random

from pyspark.sql import functions as F
from test_llm_ops import EDGES, frame, odd

from corpusloom.llm import fingerprints as fp


def brute_print(words, hash_of):
    """One permutation: the top bits of a shingle's hash name its bin, the least of a bin stays, an empty bin takes the first full one in its own order."""
    n = fp.WORDS
    shingles = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}
    bins = {}
    for s in shingles:
        h = hash_of[s]
        j = (h >> (64 - fp.BIN_BITS)) + fp.BINS // 2
        bins[j] = min(h, bins.get(j, h))
    out = []
    for j in range(fp.BINS):
        start, stride = (j * 40503 >> 3) % fp.BINS, (j * 30345 >> 2) % fp.BINS | 1
        t = 0
        k = j
        while k not in bins:
            k = (start + t * stride) % fp.BINS
            t += 1
        out.append(bins[k] & 255)
    return bytes(out)


def words_of(text):
    return [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text.lower()).split(" ") if w]


def spark_hashes(spark, texts):
    """xxhash64 of all shingles, by Spark: of word hashes, or of the number of words and their hashes padded with nulls."""
    n, out = fp.WORDS, {}
    shingles = set()
    for t in texts:
        w = words_of(t)
        shingles |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    rows = [(list(s),) for s in shingles]
    df = frame(spark, rows, "s array<string>").withColumn("h", F.expr("transform(s, x -> xxhash64(x))"))
    short = ", ".join(f"get(h, {k})" for k in range(n - 1))
    df = df.select("s", F.expr(f"CASE WHEN size(h) >= {n} THEN xxhash64({', '.join(f'get(h, {k})' for k in range(n))}) ELSE xxhash64(size(h), {short}) END").alias("x"))
    for r in df.collect():
        out[tuple(r["s"])] = r["x"]
    return out


def likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / fp.BINS - 1 / 256) / (1 - 1 / 256))


def query(spark, rows, folder):
    odd(frame(spark, rows)).write.parquet(f"{folder}/documents.parquet")
    return fp.op6_fingerprints(spark, str(folder)).collect()


def check(spark, rows, got):
    """Documents are distinct (doc_id, text); among those of one id the order is the operator's own, so it is read off the result."""
    plain = sorted({(d if d is not None else -(1 << 63), t or "") for d, t in rows})
    by_id = {}
    for d, t in plain:
        by_id.setdefault(d, []).append(t)
    ids = sorted(by_id)
    edits = {}
    for i, d in enumerate(ids):
        after = by_id[ids[(i + 1) % len(ids)]]
        for t in by_id[d]:
            g = len(t) // 4
            options = [*(x for x in by_id[d] if x != t), *after]
            edits[d, t] = {t[: len(t) - g] + x[:g]: x for x in options}
    hashes = spark_hashes(spark, {t for _, t in plain} | {e for x in edits.values() for e in x})
    prints = {}
    make = lambda t: prints.setdefault(t, brute_print(words_of(t), hashes))
    assert len(got) == len(rows)
    for r in got:
        d = r["doc_id"] if r["doc_id"] is not None else -(1 << 63)
        fits = [(t, e, x) for t in by_id[d] for e, x in edits[d, t].items() if make(t).hex() == r["fingerprint"] and len(t) == r["n_chars"] and hashlib.sha256(e.encode()).hexdigest() == r["edited_sha256"]]
        assert any(make(e).hex() == r["edited_fingerprint"] and abs(likeness(make(t), make(e)) - r["near_edited"]) < 1e-9 for t, e, _ in fits), r
        # texts of fewer than four code points take nothing from the next one, so any may be it
        assert any(abs(likeness(make(t), make(x)) - r["near_next"]) < 1e-9 for t in by_id[d] for x in [*by_id[d], *by_id[ids[(ids.index(d) + 1) % len(ids)]]]), r


def test_every_column(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(("Wort", "word", "é", "mot", "x")) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i * 37 % 101, say(rng.choice((0, 1, 3, 4, 5, 6, 30, 200)))) for i in range(101)]
    check(spark, rows, query(spark, rows, tmp_path))


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    long_ = say(30_000)
    rows = [*EDGES, (None, say(20)), (None, say(20)), (None, "a null id"), (7, say(9)), (7, say(9)), (8, long_), (9, long_), (10, None), (2**62, say(8)), (-5, say(8))]
    got = query(spark, rows, tmp_path / "a")
    check(spark, rows, got)
    same = {}
    for r in got:
        same.setdefault((r["n_chars"], r["fingerprint"]), set()).add(r["near_next"])
    assert len({r["fingerprint"] for r in got if r["n_chars"] == len(long_)}) == 1
    assert query(spark, [], tmp_path / "b") == []
    (one,) = query(spark, [(7, "a b c d e f g h")], tmp_path / "c")
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert len(query(spark, [(7, "a b")] * 3, tmp_path / "d")) == 3


def test_many_ranges(spark, monkeypatch):
    """Ranges follow one another whatever their number, and their number follows the rows'."""
    rows = [(i * 7919 % 5003, f"t {i}") for i in range(5003)]
    monkeypatch.setattr(fp, "RANGE", 100)
    got = {r["k0"]: r["n0"] for r in fp.following(frame(spark, rows)).collect()}
    assert got == {i: (i + 1) % 5003 for i in range(5003)}
