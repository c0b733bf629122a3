import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rules, scoring, splits, tokenizers, vectors, words
from corpusloom.plans import tokenizer_queries


def merges(spark):
    rows = [("t", "h"), ("_", "t"), ("_t", "h"), ("i", "s"), ("_th", "is")]
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(rows)], "rank int, left string, right string, product string")


def tokens(df):
    return {r["token"] for r in df.collect()}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_closure(spark, monkeypatch, bound):
    monkeypatch.setattr(tokenizers, "IN_MEMORY", bound)
    keep = spark.createDataFrame([("_this",)], "token string")
    assert tokens(tokenizers.closure(keep, merges(spark))) == {"_this", "_th", "is", "_t", "h", "_", "t", "i", "s"}


def test_first_and_all_producers(spark):
    rows = [(0, "a", "bc", "abc"), (1, "ab", "c", "abc")]
    m = spark.createDataFrame(rows, "rank int, left string, right string, product string")
    keep = spark.createDataFrame([("abc",)], "token string")
    assert tokens(tokenizers.closure(keep, m, "first")) == {"abc", "a", "bc"}
    assert tokens(tokenizers.closure(keep, m, "all")) == {"abc", "a", "bc", "ab", "c"}


def tok_json(n=60):
    text = "the then that this there these theme others another brother mother father gather".split() * 3
    counts = {w: text.count(w) for w in text}
    pairs = tokenizers.train_bpe(counts, n)
    letters = sorted({c for w in counts for c in w})
    vocab = {t: i for i, t in enumerate([*letters, *dict.fromkeys(a + b for a, b in pairs)])}
    added = [{"id": len(vocab) + i, "content": c} for i, c in enumerate(("<s>", "</s>"))]
    post = {"type": "x", "special_tokens": {"<s>": {"ids": [len(vocab)]}}}
    return {"model": {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in pairs]}, "added_tokens": added, "post_processor": post}, counts


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé漢😀b"])
def test_training_over_a_table_is_training_on_the_driver(spark, letters):
    rng = random.Random(len(letters))
    types = {"".join(rng.choices(letters, range(1, len(letters) + 1), k=rng.randint(1, 12))): rng.choice((1, 1, 2, 3, 50)) for _ in range(600)}
    df = spark.createDataFrame(list(types.items()), "w string, n long").repartition(3)
    assert tokenizers.train_bpe_types(df, 80) == tokenizers.train_bpe(types, 80)


def test_merges_are_learned_from_all_types(spark, tmp_path):
    """Rare types outweigh the 5,000 most frequent ones."""
    rng = random.Random(1)
    often = {"".join(rng.choices("abcdefgh", k=6)) for _ in range(5500)}
    rare = {"qz" + "".join(rng.choices("ijklmnop", k=6)) for _ in range(20_000)}
    text = " ".join([*often, *often, *rare])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    types, got = tokenizer_queries.learned(spark, str(tmp_path), 10)
    assert got[0] == ("q", "z") and got == tokenizers.train_bpe({r["w"]: r["n"] for r in types.collect()}, 10)


def test_prune_keeps_what_is_used(spark):
    """With every used token kept, all words are cut as before; ids are dense; merges stay in order."""
    tok, counts = tok_json()
    vocab, m, added = tokenizers.as_tables(spark, tok)
    pairs = tokenizers.merge_pairs(tok["model"]["merges"])
    ranks = {p: i for i, p in enumerate(pairs)}
    words_ = sorted(counts)[:6]
    used = {t for w in words_ for t in tokenizers.encode_word(tuple(w), ranks)}
    numbers, left, extra = tokenizers.prune(vocab, m, added, spark.createDataFrame([(t,) for t in sorted(used)], "token string"))
    new = tokenizers.to_json(tok, numbers, left, extra)
    ids = sorted(new["model"]["vocab"].values())
    assert ids == list(range(len(ids)))
    assert [a["id"] for a in new["added_tokens"]] == [len(ids), len(ids) + 1]
    assert new["post_processor"]["special_tokens"]["<s>"]["ids"] == [len(ids)]
    kept = {p: i for i, p in enumerate(tokenizers.merge_pairs(new["model"]["merges"]))}
    assert [ranks[p] for p in kept] == sorted(ranks[p] for p in kept)
    for w in words_:
        assert tokenizers.encode_word(tuple(w), kept) == tokenizers.encode_word(tuple(w), ranks)


def test_byte_fallback(spark):
    vocab = spark.createDataFrame([("<0x00>", 0), ("a", 1), ("b", 2), ("ab", 3), ("é", 4), ("<unused1>", 5), ("<unk>", 6)], "token string, id int")
    m = spark.createDataFrame([(0, "a", "b", "ab")], "rank int, left string, right string, product string")
    added = spark.createDataFrame([(5, "<unused1>"), (6, "<unk>")], "id int, content string")
    used = spark.createDataFrame([("ab",)], "token string")
    numbers, left, extra = tokenizers.prune_byte_fallback(vocab, m, added, used, "<unk>")
    assert tokens(numbers) == {"<0x00>", "a", "b", "ab", "<unk>"} and left.count() == 1
    numbers, _, _ = tokenizers.prune_byte_fallback(vocab, m, added, used, "<unk>", keep_unused=True, keep_chars=True)
    assert tokens(numbers) >= {"é", "<unused1>"}


def test_encoder_agrees_with_a_library(spark):
    from tokenizers import Tokenizer, models

    tok, counts = tok_json()
    lib = Tokenizer(models.BPE(vocab=tok["model"]["vocab"], merges=tokenizers.merge_pairs(tok["model"]["merges"])))
    ranks = {p: i for i, p in enumerate(tokenizers.merge_pairs(tok["model"]["merges"]))}
    for w in counts:
        assert lib.encode(w).tokens == tokenizers.encode_word(tuple(w), ranks)


def test_random_keep_and_tree(spark):
    tok, _ = tok_json()
    vocab, m, _ = tokenizers.as_tables(spark, tok)
    keep = set(tokenizers.random_keep(vocab, m, 40))
    assert len(keep) <= 40 and keep >= tokens(tokenizers.base_alphabet(vocab, m))
    made = {r["product"]: (r["left"], r["right"]) for r in m.collect()}
    assert all(set(made[t]) <= keep for t in keep if t in made)
    assert tokenizers.merge_tree("_this", merges(spark))[:2] == [(0, "_this", 4), (1, "_th", 2)]


def test_remap():
    assert tokenizers.remap_special_ids({"bos_token_id": 3, "eos_token_id": [3, 4], "x": 1}, {3: 0, 4: 1}) == {"bos_token_id": 0, "eos_token_id": [0, 1], "x": 1}
    with pytest.raises(KeyError):
        tokenizers.remap_ids({"special_tokens": {"a": {"ids": [9]}}}, {}, strict=True)


def test_ids_for_share(spark):
    c = spark.createDataFrame([(str(i), n) for i, n in enumerate((50, 30, 15, 4, 1))], "w string, n long")
    assert words.ids_for_share(c, [99]).first()["ids"] == 4


def test_windows(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1200)).alias("ids"))
    w = df.select(scoring.windows(F.col("ids")).alias("w")).first()["w"]
    assert [len(x) for x in w] == [512, 512, 178] and sum(len(x) - 1 for x in w) == 1199
    short = spark.createDataFrame([([1],), ([],)], "ids array<int>").select(scoring.windows(F.col("ids")).alias("w")).collect()
    assert [r["w"] for r in short] == [[], []]


def test_agreement(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["x", "y", "z"])], "a array<string>, b array<string>")
    assert tuple(scoring.agreement(df).first()) == (2, 0.5, 2.0)


def test_pad_and_params():
    assert vectors.pad_to(6244 + 22) == 6272
    assert vectors.pruned_params(494_032_768, 896, 151_936, 6_266) == 363_517_824


def test_split_is_whole_and_in_order(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("b"))
    rows = splits.budget_split(df, "doc_id", "b", 1000, 3000).orderBy("before").collect()
    assert len(rows) == 500 and [r["before"] for r in rows][1:] == [sum(x["b"] for x in rows[:i]) for i in range(1, 500)]
    assert [r["split"] for r in rows] == sorted((r["split"] for r in rows), key=["held", "train", "dropped"].index)


def test_labels_and_maps(spark):
    a = spark.createDataFrame([(1, "1. nature\n3 earth_places\n2) bogus\n1 science\n99999999999 nature", 2)], "k int, t string, n int")
    got = rules.parse_labels(a, "k", "t", ("nature", "science", "earth_places"), "n").collect()
    assert [tuple(r) for r in got] == [(1, 1, "science")]
    m = spark.createDataFrame([("Vienna => Big Town\nx => -\ny => z",)], "t string")
    asked = spark.createDataFrame([("Vienna",), ("x",)], "word string")
    assert {tuple(r) for r in rules.parse_map(m, "t", asked).collect()} == {("Vienna", "big town"), ("x", "")}


def test_pruning_a_public_tokenizer(spark):
    """At threshold 1 the train split is cut as before, and everything decodes to itself; without the closure it is not."""
    public = pytest.importorskip("public_tokenizers")
    from corpusloom.operators import encodings

    tok = tokenizers.load_json(public.path("byte_bpe_50k.json"))
    rows = [("train", "The quick brown fox jumps over the lazy dog, again and again."), ("held", "Étranges zebras quantify 12 things!")]
    df = spark.createDataFrame(rows, "split string, text string")
    got = {r["split"]: r for r in encodings.sweep(df, tok, [1]).collect()}
    assert got["train"]["identical"] == 1.0 and got["train"]["exact"] and got["held"]["exact"] and got["held"]["length_ratio"] >= 1
    used = [r["token_id"] for r in encodings.json_usage(df.filter("split = 'train'"), tok).collect()]
    bare = encodings.compare(df, tok, encodings.pruned(spark, tok, used, close=False), "split").filter("split = 'train'").first()
    assert not bare["same"]


def test_finetune(spark):
    pairs = spark.createDataFrame([(0, 1, 50), (1, 2, 50), (2, 0, 50), (9, 9, 5)], "a int, b int, n long")
    v = spark.createDataFrame([(i, [float((i + k) % 3) / 3 for k in range(4)]) for i in range(3)], "id int, embedding array<float>")
    new, losses = vectors.finetune(pairs, v, 15, 0.1)
    assert losses[-1] < losses[0] and new.count() == 3
    bad = spark.createDataFrame([(i, [float("inf")] * 2) for i in range(3)], "id int, embedding array<float>")
    assert [r["embedding"] for r in vectors.finetune(pairs, bad, 2)[0].collect()] == [[float("inf")] * 2] * 3


@pytest.mark.parametrize("sent", ["10MB", "-1"])
def test_replacement_by_a_table(spark, sent):
    """Rows that share a key or all, null keys and texts, words with many replacements in a row; broadcast or not, no occurrence of a word is a row."""
    many = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [(1, "The the, THE\n"), (1, "the"), (1, "the"), (None, "the"), (None, "of the x"), (2, None), (3, ""), (4, "..."), (5, " ".join(many * 3)), (6, "none here")]
    replace = {"the": "a b", "of": "", "x": None} | {w: w[::-1] for w in many}
    docs = spark.createDataFrame(texts, "k long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    try:
        df = rules.replace_words(docs, "k", spark.createDataFrame(list(replace.items()), "word string, repl string"))
        assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = lambda t: t and re.sub("[A-Za-z]+", lambda m: m[0] if replace.get(m[0]) is None else replace[m[0]], t)
    assert sorted(got, key=repr) == sorted(((k, plain(t)) for k, t in texts), key=repr)


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_encoding_many_types_keeps_no_memory():
    """A model is made for each batch; batch after batch, nothing of it stays in the worker."""
    rng = random.Random(3)
    pairs = [(a, b) for a in "abcdefgh" for b in "abcdefgh"]

    def batch():
        words_ = ["".join(rng.choices("abcdefghijklmnop", k=10)) for _ in range(10_000)]
        model = tokenizers.library_model(pairs, set().union(*words_))
        for w in words_:
            model.tokenize(w)

    for _ in range(5):
        batch()
    before = resident_mb()
    for _ in range(30):
        batch()
    assert resident_mb() - before < 60


def test_usage_is_counted_in_slices(monkeypatch):
    """A batch's texts are encoded in slices of bounded size; a slice is cut between texts, and a null text is empty."""
    import pyarrow as pa

    from corpusloom.operators import encodings

    monkeypatch.setattr(encodings, "SLICE", 10)
    texts = ["abc", "abcd", None, "", "abcdef", "x" * 25, "y", "z" * 10]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["k", "text"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["k", "text"])]
    got = list(encodings._slices(iter(batches)))
    assert [t for _, s in got for t in s] == [t or "" for t in texts] and [x for b, _ in got for x in b.column(0).to_pylist()] == list(range(8))
    assert all(len(s) == b.num_rows and (len(s) == 1 or sum(map(len, s)) <= 10) for b, s in got) and len(got) == 5
    seen = []
    rows = list(encodings._counted(iter(batches), 0, lambda s: (seen.append(len(s)), ([ord(c) for c in t] for t in s))[1]))
    assert len(rows) == 1 and max(seen) < 8
    want = {ord(c): "".join(t or "" for t in texts).count(c) for c in set("".join(t or "" for t in texts))}
    assert dict(zip(rows[0].column(0).to_pylist(), rows[0].column(1).to_pylist())) == want


def test_pairs_are_counted_in_chunks(spark, monkeypatch):
    """Counts are those of a plain loop, and the parts grow with the text whatever the session's number of partitions."""
    from collections import Counter

    from corpusloom.operators import scoring

    monkeypatch.setattr(scoring, "CHUNK", 100)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "of", "big", "The", "x"], k=rng.randint(0, 12))) for _ in range(200)] + [None, "", "the", "a b " * 100]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    two = scoring.bigrams(df, "text", F.split("text", " "))
    assert two.rdd.getNumPartitions() == sum(len(t or "") for t in texts) // 100 + 1
    split = [t.split(" ") for t in texts if t is not None]
    assert {(r["a"], r["b"]): r["n"] for r in two.collect()} == dict(Counter(p for t in split for p in zip(t, t[1:])))
