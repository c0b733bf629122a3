"""Language ID and language model against brute force, on any layout of the rows."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_llm_ops import EDGES, frame, odd

from corpusloom.llm import langid, lm
from corpusloom.llm.common import Rolling, mix

LABELLED = "doc_id long, text string, lang string"
ALL = (1 << 64) - 1


def buckets(text):
    """Hashed 1- to 3-grams of a text, by plain Python."""
    code = []
    for c in text:
        x = ord(c.lower()[0]) + 1 if unicodedata.category(c)[0] == "L" else 1
        if x > 1 or not code or code[-1] > 1:
            code.append(x)
    if code and code[0] == 1 and len(code) == 1:
        code = []
    out = []
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            h = 0
            for x in code[i : i + n]:
                h = (h * 0x100000001B3 + x * 0x9E3779B97F4A7C15) & ALL
            out.append((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & ALL) >> (64 - langid.BITS))
    return out


def brute(train, texts):
    lettered = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    rows = [(t, k) for _, t, k in train if t is not None and k is not None]
    total = Counter(k for _, k in rows)
    counts = {k: Counter() for k in sorted({k for t, k in rows if lettered(t)})}
    for t, k in set(rows):
        if k in counts and lettered(t):
            counts[k].update(buckets(t))
    out = []
    for t in texts:
        if not lettered(t):
            out.append(("und", 0.0))
            continue
        own = buckets(t)
        s = {k: math.log(total[k] / len(rows)) + sum(math.log((c[g] + langid.ALPHA) / (sum(c.values()) + langid.ALPHA * (1 << langid.BITS))) for g in own) for k, c in counts.items()}
        best = max(s, key=lambda k: (s[k], [-ord(x) for x in k]))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


def some_language(rng, k, n=12):
    syllables = [a + b for a in "bcdfgklmnprst"[k : k + 5] for b in "aeiou"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def agrees(got, want):
    for r in got:
        name, p = want[r["text"]]
        assert r["lang_pred"] == name and abs(r["score"] - p) < 1e-3, (r, name, p)


def test_language_by_brute_force(spark):
    rng = random.Random(3)
    train = [(i, some_language(rng, k), f"l{k}") for i in range(25) for k in range(5)]
    train += [(None, some_language(rng, 6), "rare")] * 3 + [(1, None, "l0"), (2, "no label here", None), (3, "12 34", "digits"), (4, "", "empty")]
    texts = [some_language(rng, k % 8, rng.randint(1, 6)) for k in range(60)] + ["12 !!", "", "ba", "!!ba!!"]
    want = dict(zip(texts, brute(train, texts)))
    rows = odd(frame(spark, list(enumerate(texts))))
    model = langid.train(frame(spark, train, LABELLED))
    assert model.langs == ["l0", "l1", "l2", "l3", "l4", "rare"]
    got = langid.predict(rows, model, ["doc_id", "text", "key", "score"]).collect()
    assert len(got) == len(texts)
    agrees(got, want)
    # more languages than a block has, and another layout
    small = langid.train(frame(spark, train, LABELLED).repartition(7), block=2)
    assert len(small.blocks) > 2 and small.langs == model.langs
    agrees(langid.predict(rows.repartition(5), small, ["text"]).collect(), want)


def test_language_sample_is_by_language(spark):
    """Null and repeated ids don't matter, no language is left out, and the sample is bounded."""
    rng = random.Random(5)
    train = [(None, some_language(rng, 0), "often") for _ in range(400)] + [(7, some_language(rng, 7), "seldom") for _ in range(3)] + [(None, "same text again", "often")] * 300
    model = langid.train(frame(spark, train, LABELLED), most_rows=40)
    assert model.langs == ["often", "seldom"]
    told = langid.predict(frame(spark, [(1, some_language(rng, 7, 40)), (2, some_language(rng, 0, 40)), *EDGES]), model, ["doc_id", "text"]).collect()
    assert [r["lang_pred"] for r in told if r["doc_id"] in (1, 2) and r["text"]][:2] == ["seldom", "often"]
    assert len(told) == 2 + len(EDGES)


def test_language_of_more_labelled_rows_than_the_sample(spark):
    rows = spark.range(70_000).select("id", F.concat(F.when(F.col("id") % 2 == 0, "aba kada ").otherwise("zuzu mimo "), F.col("id").cast("string"), F.hex("id")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("z").alias("lang"))
    model = langid.train(rows)
    got = langid.predict(frame(spark, [(1, "aba"), (2, "mimo zuzu")]), model, ["doc_id"]).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "a", 2: "z"}
    assert abs(np.exp(model.blocks[0].prior).sum() - 1) < 1e-6


# language model


def tokens_of(text):
    """(hash, leaf) of each token and of the end."""
    out = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" "):
        if w:
            raw = np.frombuffer(w.encode(), np.uint8)
            h = Rolling(raw).of(np.array([0]), np.array([len(raw)]))
            last = int(raw[-1]) | (int(raw[-2]) << 8 if len(raw) > 1 else 0)
            cls = int(mix(np.array([last], np.uint64))[0]) % (lm.CLASSES - 1)
            out.append((int(h[0]), cls * lm.SUBS + (int(mix(h)[0]) >> 40) % lm.SUBS))
    return [*out, (int(lm.END), (lm.CLASSES - 1) * lm.SUBS)]


class Brute:
    """The same model, one token at a time."""

    def __init__(self):
        self.w = [{}, {}]
        self.bias = [np.zeros((1, lm.CLASSES)), np.zeros((lm.CLASSES, lm.SUBS))]

    def contexts(self, text):
        before = [0, 0]
        for h, leaf in tokens_of(text):
            b1, b2 = before
            cls = leaf // lm.SUBS
            mixed = lambda b: (b * 0x9E3779B1 + cls * 0x85EBCA6B >> 7) % (1 << lm.SUB_BITS)
            pair = (b1 * 40503 + b2 * 30011 >> 3) % (1 << lm.PAIR_BITS)
            yield h, leaf, [(0, b1), (1, b2), (2, pair)], [(0, mixed(b1)), (1, mixed(b2))]
            before = [(h >> 24) % ((1 << lm.BITS) - 1) + 1, b1]

    def share(self, level, features, row):
        z = self.bias[level][row] + sum(self.w[level].get(f, 0) for f in features)
        p = np.exp(z - z.max())
        return p / p.sum()

    def fit(self, texts_by_round, n_leaf):
        n = n_leaf.reshape(lm.CLASSES, lm.SUBS) + 0.5
        self.bias = [np.log(n.sum(1) / n.sum())[None], np.log(n / n.sum(1, keepdims=True))]
        for texts in texts_by_round:
            seen, expected = [{}, {}], [{}, {}]
            for t in texts:
                for _, leaf, one, two in self.contexts(t):
                    cls, sub = divmod(leaf, lm.SUBS)
                    for level, features, row, target in ((0, one, 0, cls), (1, two, cls, sub)):
                        p = self.share(level, features, row)
                        for f in [*features, ("bias", row)]:
                            seen[level].setdefault(f, np.zeros(32))[target] += 1
                            expected[level][f] = expected[level].get(f, 0) + p
            for level in (0, 1):
                for f, s in seen[level].items():
                    e = expected[level][f]
                    d = lm.RATE * 2 * (s - e) / (s + e + lm.DAMP)
                    if f[0] == "bias":
                        self.bias[level][f[1]] += d
                    else:
                        self.w[level][f] = self.w[level].get(f, 0) + d


def some_docs(rng, n):
    voc = [some_language(rng, k % 6, 1) for k in range(60)]
    return [(rng.randrange(40) if i % 9 else None, " ".join(rng.choice(voc[: 1 + i % 60]) for _ in range(rng.randint(0, 25))).title()) for i in range(n)]


def scored(docs):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm.score(docs.withColumn("held_out", lm.held_out(F.col("doc_id")))).collect())


def test_lm_by_brute_force(spark):
    rows = some_docs(random.Random(4), 150)
    docs = frame(spark, rows).withColumn("held_out", lm.held_out(F.col("doc_id"))).withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lm.ROUNDS)))
    table = docs.collect()
    train = [r for r in table if not r["held_out"]]
    count = Counter(t for r in train for t in tokens_of(r["text"]))
    n_leaf, v_leaf = np.zeros(lm.CLASSES * lm.SUBS), np.zeros(lm.CLASSES * lm.SUBS)
    for (_, leaf), n in count.items():
        n_leaf[leaf] += n
        v_leaf[leaf] += 1
    model = Brute()
    model.fit([[r["text"] for r in train if r["round"] == k] for k in range(lm.ROUNDS)], n_leaf)

    def score(text):
        s = 0
        for h, leaf, one, two in model.contexts(text):
            cls, sub = divmod(leaf, lm.SUBS)
            s += math.log10(model.share(0, one, 0)[cls] * model.share(1, two, cls)[sub] * (count[h, leaf] + 1) / (n_leaf[leaf] + v_leaf[leaf] + 1))
        return s

    want = sorted(score(r["text"]) for r in table)
    got = sorted(r["score"] for r in lm.score(odd(docs)).collect())
    assert np.allclose(got, want, rtol=2e-4, atol=1e-3)
    # after any context all known tokens and the unseen shares add up to one
    for text in ("", "a b", rows[5][1]):
        *_, (h, leaf, one, _) = model.contexts(text)
        total = 0.0
        for cls in range(lm.CLASSES):
            two = [[x for x in model.contexts(text)][-1][3]] and [(k, (b * 0x9E3779B1 + cls * 0x85EBCA6B >> 7) % (1 << lm.SUB_BITS)) for k, b in ((0, one[0][1]), (1, one[1][1]))]
            leaves = model.share(0, one, 0)[cls] * model.share(1, two, cls)
            room = (n_leaf + v_leaf + 1)[cls * lm.SUBS : (cls + 1) * lm.SUBS]
            total += (leaves * (n_leaf + v_leaf + 1)[cls * lm.SUBS : (cls + 1) * lm.SUBS] / room).sum()
        assert abs(total - 1) < 1e-9


def test_lm_scores_do_not_depend_on_the_layout(spark):
    docs = frame(spark, [*some_docs(random.Random(6), 600), *EDGES])
    one, many = scored(docs.coalesce(1)), scored(docs.repartition(32))
    assert len(one) == 600 + len(EDGES) and np.allclose(one, many, rtol=1e-6, atol=1e-6)


def test_lm_weights_use_the_context(spark):
    """Words that always follow one another are likelier in this order."""
    rows = [(i, "kila mobo " * 30) for i in range(8)] + [(100 + i, "mobo tafe kila " * 20) for i in range(8)]
    docs = frame(spark, [*rows, (500, "kila mobo kila mobo kila mobo"), (501, "kila kila kila mobo mobo mobo")])
    got = {r["doc_id"]: r["score"] for r in lm.score(docs.withColumn("held_out", F.col("doc_id") >= 500)).collect()}
    assert got[500] > got[501] + 0.5
