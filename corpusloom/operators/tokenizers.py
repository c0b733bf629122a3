"""Tokenizers as tables: vocab(token, id), merges(rank, left, right, product), added(id, content).

Vocabulary-size tables are small against a corpus; what grows with the corpus (token counts) is aggregated before it
meets them. The closure is a loop of joins over its frontier, with checkpoints.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a merge table that the driver may hold; public ones have up to about 500,000.
IN_MEMORY = 1_000_000
#: Merges that are applied anew to the saved symbols of word types in each round of training, before the symbols are saved again.
PENDING = 32
#: Symbols of training are code points, and from here on merges by their rank.
FIRST = 0x110000


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def merge_pairs(merges: list) -> list[tuple[str, str]]:
    """Both formats: "a b", split once at the first space, or [a, b]."""
    return [tuple(m.split(" ", 1)) if isinstance(m, str) else (m[0], m[1]) for m in merges]


def as_tables(spark: SparkSession, tok: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    if tok["model"].get("type", "BPE") != "BPE":
        raise ValueError("not a BPE tokenizer")
    vocab = spark.createDataFrame(list(tok["model"]["vocab"].items()), "token string, id int")
    pairs = merge_pairs(tok["model"]["merges"])
    merges = spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(pairs)], "rank int, left string, right string, product string")
    added = spark.createDataFrame([(a["id"], a["content"]) for a in tok.get("added_tokens", [])], "id int, content string")
    return vocab, merges, added


def base_alphabet(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """Tokens that no merge makes."""
    return vocab.join(merges.select(F.col("product").alias("token")).distinct(), "token", "left_anti")


def producers(merges: DataFrame, which: str = "all") -> DataFrame:
    """Merges that make each product: all of them, the first (highest priority), or the last."""
    if which == "all":
        return merges
    pick = F.min if which == "first" else F.max
    return merges.join(merges.groupBy("product").agg(pick("rank").alias("rank")), ["product", "rank"], "left_semi")


def closure(keep: DataFrame, merges: DataFrame, which: str = "all") -> DataFrame:
    """keep(token) with all inputs of the merges that make kept tokens, over and over.

    A merge table of up to `IN_MEMORY` rows is followed on the driver; a larger one by one join and one anti-join a level.
    """
    from corpusloom.sources.checkpoints import checkpointed

    if merges.limit(IN_MEMORY + 1).count() <= IN_MEMORY:
        made: dict[str, list[str]] = {}
        for r in producers(merges, which).select("product", "left", "right").collect():
            made.setdefault(r["product"], []).extend((r["left"], r["right"]))
        found = {r["token"] for r in keep.select("token").distinct().toLocalIterator()}
        stack = list(found)
        while stack:
            for part in made.get(stack.pop(), ()):
                if part not in found:
                    found.add(part)
                    stack.append(part)
        return keep.sparkSession.createDataFrame([(t,) for t in sorted(found)], "token string")
    parts = producers(merges, which).select(F.col("product").alias("token"), F.explode(F.array("left", "right")).alias("part")).distinct()
    seen = frontier = checkpointed(keep.select("token").distinct())
    while True:
        new = frontier.join(parts, "token").select(F.col("part").alias("token")).distinct()
        frontier = checkpointed(new.join(seen, "token", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(frontier))


def renumbered(vocab: DataFrame, keep: DataFrame) -> DataFrame:
    """(token, old_id, new_id): kept entries numbered from 0 in the order of their old ids. Vocabulary-size, so one window."""
    kept = vocab.join(keep.select("token").distinct(), "token", "left_semi")
    return kept.select("token", F.col("id").alias("old_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("new_id"))


def surviving_merges(merges: DataFrame, keep: DataFrame) -> DataFrame:
    """Merges whose inputs and product are all kept, with a dense new rank in the old order."""
    k = keep.select("token").distinct()
    for side in ("left", "right", "product"):
        merges = merges.join(k.withColumnRenamed("token", side), side, "left_semi")
    return merges.select("rank", "left", "right", "product", (F.row_number().over(Window.orderBy("rank")) - 1).alias("new_rank"))


def added_ids(added: DataFrame, numbers: DataFrame) -> DataFrame:
    """(content, old_id, new_id): an added token's own entry if it is kept, else ids after the vocabulary in id order."""
    size = numbers.agg(F.count("*").alias("n"))
    a = added.join(numbers.select(F.col("token").alias("content"), "new_id"), "content", "left")
    outside = F.row_number().over(Window.partitionBy(F.col("new_id").isNull()).orderBy("id")) - 1
    # the one-row size is a scalar
    n = size.first()["n"]
    return a.select("content", F.col("id").alias("old_id"), F.coalesce("new_id", F.lit(n) + outside).cast("int").alias("new_id"))


def prune(vocab: DataFrame, merges: DataFrame, added: DataFrame, used: DataFrame, which: str = "all", close: bool = True):
    """Keep-set of used(token), added tokens and the base alphabet, closed under merges. Returns numbers, merges and added ids."""
    keep = used.select("token").unionByName(base_alphabet(vocab, merges).select("token"))
    keep = keep.unionByName(added.select(F.col("content").alias("token"))).join(vocab, "token", "left_semi").distinct()
    if close:
        keep = closure(keep, merges, which)
    numbers = renumbered(vocab, keep)
    return numbers, surviving_merges(merges, keep), added_ids(added, numbers)


def prune_byte_fallback(vocab: DataFrame, merges: DataFrame, added: DataFrame, used: DataFrame, unk: str | None = None, which: str = "all", keep_unused: bool = False, keep_chars: bool = False):
    """The variant with byte tokens: base is <0x00>..<0xFF> (and all merge-less entries if keep_chars); `<unused…>` added tokens go unless kept."""
    if not keep_unused:
        added = added.filter(~F.col("content").startswith("<unused"))
    keep = used.select("token").unionByName(added.select(F.col("content").alias("token")))
    keep = keep.unionByName(vocab.filter(F.col("token").rlike("^<0x[0-9A-F]{2}>$")).select("token"))
    if unk:
        keep = keep.unionByName(vocab.filter(F.col("token") == unk).select("token"))
    if keep_chars:
        keep = keep.unionByName(base_alphabet(vocab, merges).select("token"))
    keep = closure(keep.join(vocab, "token", "left_semi").distinct(), merges, which)
    numbers = renumbered(vocab, keep)
    return numbers, surviving_merges(merges, keep), added_ids(added, numbers)


def remap_ids(node, new: dict[int, int], strict: bool = False):
    """A copy of a post-processor or config tree with the ids under special_tokens.*.ids renumbered; unknown ids stay unless strict."""
    get = new.__getitem__ if strict else lambda i: new.get(i, i)
    if isinstance(node, list):
        return [remap_ids(x, new, strict) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: remap_ids(v, new, strict) for k, v in node.items()}
    if isinstance(out.get("special_tokens"), dict):
        out["special_tokens"] = {k: v | {"ids": [get(i) for i in v["ids"]]} if isinstance(v, dict) and "ids" in v else v for k, v in out["special_tokens"].items()}
    return out


def remap_special_ids(config: dict, new: dict[int, int]) -> dict:
    """bos, eos and pad ids, single or lists."""
    one = lambda v: [new[i] for i in v] if isinstance(v, list) else new[v]
    return config | {k: one(config[k]) for k in ("bos_token_id", "eos_token_id", "pad_token_id") if config.get(k) is not None}


def to_json(tok: dict, numbers: DataFrame, merges: DataFrame, added: DataFrame) -> dict:
    """The pruned tokenizer in the format of the one it came from. Driver side, vocabulary size."""
    rows = numbers.orderBy("new_id").collect()
    kept = [(r["left"], r["right"]) for r in merges.orderBy("new_rank").collect()]
    as_text = bool(tok["model"]["merges"]) and isinstance(tok["model"]["merges"][0], str)
    ids = {r["old_id"]: r["new_id"] for r in added.collect()}
    all_ids = {r["old_id"]: r["new_id"] for r in rows} | ids
    out = dict(tok)
    out["model"] = tok["model"] | {"vocab": {r["token"]: r["new_id"] for r in rows}, "merges": [f"{a} {b}" if as_text else [a, b] for a, b in kept]}
    out["added_tokens"] = [a | {"id": ids[a["id"]]} for a in sorted(tok.get("added_tokens", []), key=lambda a: a["id"]) if a["id"] in ids]
    if tok.get("post_processor"):
        out["post_processor"] = remap_ids(tok["post_processor"], all_ids)
    return out


def encode_word(word: tuple[str, ...], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the applicable pair of the lowest rank, again and again."""
    parts = list(word)
    while len(parts) > 1:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if best is None:
            break
        i = best[1]
        pair = (parts[i], parts[i + 1])
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                out.append(pair[0] + pair[1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


def as_bytes(word):
    """A string column's UTF-8 bytes as characters U+0000 to U+00FF, the alphabet of byte-level merges."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def from_bytes(token):
    """The text of a byte-level token; bytes that are no whole character become U+FFFD."""
    return F.decode(F.encode(token, "ISO-8859-1"), "UTF-8")


def library_model(merges: list[tuple[str, str]], characters):
    """A library's BPE model of the merges, with a vocabulary of the characters and the products.

    It has no cache: word types are encoded once each, and the library does not give a cache back when its model goes.
    """
    from tokenizers import models

    pairs = list(dict.fromkeys(merges))
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*sorted(characters), *(x for p in pairs for x in (*p, p[0] + p[1]))]))}
    return models.BPE(vocab=vocab, merges=pairs, cache_capacity=0)


def encode_types(types: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """types(w, …) with `tokens`: word types are encoded once each, in Arrow batches, by a library's BPE."""
    sent = types.sparkSession.sparkContext.broadcast(list(merges))

    @F.pandas_udf("array<string>")
    def tokens(w):
        model = library_model(sent.value, set().union(*w))
        return w.map(lambda x: [t.value for t in model.tokenize(x)] if x else [])

    # the rows are few bytes but much work: dealt by number, so that they are not packed into a few tasks
    n = max(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), types.sparkSession.sparkContext.defaultParallelism)
    return types.repartition(n).withColumn("tokens", tokens("w"))


def train_bpe(words: dict[str, int], merges: int) -> list[tuple[str, str]]:
    """Byte-pair merges over counted word types: the most frequent pair, ties by the pair itself. Driver side; pair counts are kept up to date."""
    parts = {w: list(w) for w in words}
    count: Counter = Counter()
    where: dict[tuple[str, str], set[str]] = {}
    for w, p in parts.items():
        for pair in zip(p, p[1:]):
            count[pair] += words[w]
            where.setdefault(pair, set()).add(w)
    out = []
    while len(out) < merges and count:
        pair, n = min(count.items(), key=lambda x: (-x[1], x[0]))
        if n <= 0:
            break
        out.append(pair)
        for w in where.pop(pair, set()):
            old = parts[w]
            for q in zip(old, old[1:]):
                count[q] -= words[w]
                if count[q] <= 0:
                    del count[q]
            new = parts[w] = encode_step(old, pair)
            for q in zip(new, new[1:]):
                count[q] += words[w]
                where.setdefault(q, set()).add(w)
        count.pop(pair, None)
    return out


def _symbols(batches):
    """Word types (w, n) as one row a batch: symbols, -1 after each type, and the types' counts."""
    for b in batches:
        w = b.column(0).to_pylist()
        flat = np.frombuffer("".join(w).encode("utf-32-le"), np.int32)
        out = np.insert(flat, np.cumsum([len(x) for x in w], dtype=np.int64), -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().astype(np.int64).tobytes()], pa.binary())], ["s", "n"])


def _merged(s: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """Symbols after the merges (left, right, product) in turn, each from left to right."""
    for a, b, product in merges:
        at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
        if a == b and len(at):
            # of a run of overlapping places every second is taken
            head = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
        if len(at):
            s = s.copy()
            s[at] = product
            s = np.delete(s, at + 1)
    return s


def _apply(merges):
    def rows(batches):
        for b in batches:
            new = [_merged(np.frombuffer(x.as_buffer(), np.int32), merges).tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), b.column(1)], ["s", "n"])

    return rows


def _pair_counts(merges):
    """Counts of the pairs of neighbours after the merges: the sums of a task."""

    def rows(batches):
        total: Counter = Counter()
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                s = _merged(np.frombuffer(x.as_buffer(), np.int32), merges)
                n = np.frombuffer(y.as_buffer(), np.int64)
                own = n[np.minimum(np.cumsum(s < 0), len(n) - 1)]
                inside = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                code = s[inside].astype(np.int64) << 32 | s[inside + 1]
                order = np.argsort(code, kind="stable")
                code, own = code[order], own[inside][order]
                cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
                if len(cut):
                    for c, k in zip(code[cut].tolist(), np.add.reduceat(own, cut).tolist()):
                        total[c] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

    return rows


def settled(counts: list[tuple[tuple[str, str], int]], most: int, known=()) -> list[int]:
    """The places of the pairs that are sure to be merged next, in order, by counts((left, right), n) in order of merging.

    Merging (a, b) changes only pairs that end in a or begin with b, and each pair it makes occurs at most as often as one of these. So the next
    pair is settled as long as it is none of these and occurs more often than all of them. A product that is in `known` or made twice adds to
    pairs that are there already, so nothing is settled after it.
    """
    out: list[int] = []
    ends, begins, made = set(), set(), set(known)
    for i, ((a, b), n) in enumerate(counts):
        if len(out) == most:
            break
        j = i
        while out and j < len(counts) and counts[j][1] == n:
            if counts[j][0][1] in ends or counts[j][0][0] in begins:
                return out
            j += 1
        # a pair of one symbol twice overlaps itself: it is merged in a round of its own
        if a == b:
            return out or [i]
        out.append(i)
        ends.add(a)
        begins.add(b)
        if a + b in made:
            break
        made.add(a + b)
    return out


def train_byte_bpe(types: DataFrame, size: int, special: tuple[str, ...] = ()) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary of at most `size` entries and merges, learned from word types (w, n) as bytes: special tokens first, then all 256 bytes, then products."""
    base = [*special, *(chr(i) for i in range(256))]
    merges = train_bpe_types(types.withColumn("w", as_bytes(F.col("w"))), max(0, size - len(base)))
    return {t: i for i, t in enumerate(dict.fromkeys([*base, *(a + b for a, b in merges)]))}, merges


def train_bpe_types(types: DataFrame, merges: int) -> list[tuple[str, str]]:
    """train_bpe() over a table of counted word types (w, n) of any size.

    The types stay distributed, as symbols in the shared folder; a round sums the pair counts of all types, and takes all merges that
    they settle. What reaches the driver is a row for each distinct pair.
    """
    from corpusloom.sources.checkpoints import checkpointed

    types = checkpointed(types.filter("w IS NOT NULL AND w <> ''").select("w", F.col("n").cast("long").alias("n")))
    # few bytes but much work
    n = max(types.sparkSession.sparkContext.defaultParallelism, types.count() // 100_000 + 1)
    state = checkpointed(types.repartition(n).mapInArrow(_symbols, "s binary, n binary"))
    names: dict[int, str] = {}
    ids: dict[str, int] = {}
    name = lambda k: names.get(k) or chr(k)
    out: list[tuple[str, str]] = []
    pending: list[tuple[int, int, int]] = []
    while len(out) < merges:
        got = state.mapInArrow(_pair_counts(pending), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        if not got:
            break
        # different merges may give the same string: train_bpe has strings, so it is the same symbol
        ranked = sorted((((name(r["pair"] >> 32), name(r["pair"] & 0xFFFFFFFF)), r["n"]) for r in got), key=lambda x: (-x[1], x[0]))
        for i in settled(ranked, merges - len(out), ids):
            a, b = ranked[i][0]
            number = lambda t: ids[t] if len(t) > 1 else ord(t)
            product = ids.setdefault(a + b, FIRST + len(ids))
            names[product] = a + b
            pending.append((number(a), number(b), product))
            out.append((a, b))
        if len(pending) >= PENDING and len(out) < merges:
            state, pending = checkpointed(state.mapInArrow(_apply(pending), "s binary, n binary")), []
    return out


def encode_step(parts: list[str], pair: tuple[str, str]) -> list[str]:
    out, k = [], 0
    while k < len(parts):
        if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
            out.append(parts[k] + parts[k + 1])
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return out


def extension(candidates: DataFrame, vocab: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """New merges: candidates(rank, left, right, product) whose inputs exist, whose product is new and whose inputs meet; the n most frequent
    (ties by rank), with ids after the last."""
    have = vocab.select("token")
    c = candidates.join(have.withColumnRenamed("token", "left"), "left", "left_semi").join(have.withColumnRenamed("token", "right"), "right", "left_semi")
    c = c.join(have.withColumnRenamed("token", "product"), "product", "left_anti").dropDuplicates(["left", "right"])
    c = c.join(pairs.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("n").alias("pair_count")).filter("n > 0"), ["left", "right"])
    top = c.orderBy(F.desc("pair_count"), "rank").limit(n)
    last = vocab.agg(F.max("id")).first()[0]
    return top.select("left", "right", "product", "pair_count", (F.row_number().over(Window.orderBy(F.desc("pair_count"), "rank")) + F.lit(last)).alias("id"))


def random_keep(vocab: DataFrame, merges: DataFrame, target: int, seed: int = 0) -> list[str]:
    """The base alphabet, then tokens in seeded order with their closure where it fits, up to `target`. Sequential by definition; driver side."""
    from corpusloom.operators.splits import seeded

    made: dict[str, list[tuple[str, str]]] = {}
    for r in merges.orderBy("rank").collect():
        made.setdefault(r["product"], []).append((r["left"], r["right"]))
    keep = {r["token"] for r in base_alphabet(vocab, merges).collect()}
    for r in vocab.withColumn("o", seeded(F.col("token"), seed)).orderBy("o", "token").select("token").collect():
        if len(keep) >= target:
            break
        need, stack = set(), [r["token"]]
        while stack:
            t = stack.pop()
            if t not in keep and t not in need:
                need.add(t)
                stack += [x for p in made.get(t, []) for x in p]
        if len(keep) + len(need) <= target:
            keep |= need
    return sorted(keep)


def merge_tree(token: str, merges: DataFrame, depth: int = 4) -> list[tuple[int, str, int | None]]:
    """(level, token, rank of its merge) in depth-first order."""
    by = {r["product"]: (r["rank"], r["left"], r["right"]) for r in producers(merges, "last").collect()}
    out: list[tuple[int, str, int | None]] = []

    def walk(t: str, level: int) -> None:
        m = by.get(t)
        out.append((level, t, m[0] if m else None))
        if m and level + 1 < depth:
            walk(m[1], level + 1)
            walk(m[2], level + 1)

    walk(token, 0)
    return out
