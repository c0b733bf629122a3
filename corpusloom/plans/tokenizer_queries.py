"""Tokenizer tables: alphabet, closure, pruning, agreement, extension, encoding.

The SQL-checked queries use a tokenizer that both sides derive from the documents: its vocabulary has the TOP most frequent
lower-case words, all their prefixes, and a..z; each prefix of two or more letters is made of the one before it and its last letter.
Ids and ranks follow (length, token).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import scoring, splits, tokenizers, words
from corpusloom.plans.catalog import register
from corpusloom.plans.common import COUNTS
from corpusloom.session import table
from corpusloom.sources.checkpoints import checkpointed

TOP = 400
TOK = f"""top AS (SELECT w, n FROM ({COUNTS}) WHERE regexp_full_match(w, '[a-z]+') ORDER BY n DESC, w LIMIT {TOP}),
pre AS (SELECT DISTINCT w[1:i] AS token FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM top)),
alpha AS (SELECT chr(c::INT) AS token FROM range(97, 123) t(c)),
vocab AS (SELECT token, (row_number() OVER (ORDER BY length(token), token) - 1)::INT AS id FROM (SELECT token FROM pre UNION SELECT token FROM alpha)),
merges AS (SELECT (row_number() OVER (ORDER BY length(token), token) - 1)::INT AS rank, token[1:-2] AS "left", token[-1:] AS "right", token AS product FROM vocab WHERE length(token) > 1)"""
#: What is kept: words that occur often enough, and their closure.
OFTEN = 100
CLOSED = TOK + f""", used AS (SELECT w AS token FROM top WHERE n >= {OFTEN}),
keep AS (SELECT DISTINCT token[1:i] AS token FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM used) UNION SELECT token[i:i] FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM used) UNION SELECT token FROM alpha)"""


def docs(spark, d):
    return table(spark, d, "documents")


def top_words(spark, d):
    return words.counts(docs(spark, d)).filter(F.col("w").rlike("^[a-z]+$")).orderBy(F.desc("n"), "w").limit(TOP)


def toy(spark, d):
    """vocab, merges and the counted words of the derived tokenizer; the documents are read once, for TOP words."""
    top = checkpointed(top_words(spark, d))
    pre = top.select(F.explode(F.expr("transform(sequence(1, length(w)), i -> substring(w, 1, i))")).alias("token"))
    alpha = spark.range(97, 123).select(F.char("id").alias("token"))
    order = Window.orderBy(F.length("token"), "token")
    vocab = pre.unionByName(alpha).distinct().select("token", (F.row_number().over(order) - 1).alias("id"))
    long_ = vocab.filter(F.length("token") > 1)
    merges = long_.select(
        (F.row_number().over(order) - 1).alias("rank"), F.expr("left(token, length(token) - 1)").alias("left"), F.expr("right(token, 1)").alias("right"), F.col("token").alias("product")
    )
    return vocab, merges, top


def used(top):
    return top.filter(F.col("n") >= OFTEN).select(F.col("w").alias("token"))


def none_added(spark):
    return spark.createDataFrame([], "id int, content string")


@register("base_alphabet", f"WITH {TOK} SELECT token, id FROM vocab WHERE token NOT IN (SELECT product FROM merges)")
def base_alphabet(spark, d):
    vocab, merges, _ = toy(spark, d)
    return tokenizers.base_alphabet(vocab, merges).select("token", "id")


@register("threshold_keep", f"WITH {TOK} SELECT m, count(*) AS kept FROM top, (VALUES (1), (5), (20), (100), (500)) v(m) WHERE n >= m GROUP BY m")
def threshold_keep(spark, d):
    _, _, top = toy(spark, d)
    return top.withColumn("m", F.explode(F.array(*map(F.lit, (1, 5, 20, 100, 500))))).filter("n >= m").groupBy("m").agg(F.count("*").alias("kept"))


@register("merge_closure", f"WITH {CLOSED} SELECT token FROM keep")
def merge_closure(spark, d):
    vocab, merges, top = toy(spark, d)
    base = tokenizers.base_alphabet(vocab, merges).select("token")
    return tokenizers.closure(used(top).unionByName(base), merges)


@register("prune_renumber", f"WITH {CLOSED} SELECT token, id AS old_id, (row_number() OVER (ORDER BY id) - 1)::INT AS new_id FROM vocab WHERE token IN (SELECT token FROM keep)")
def prune_renumber(spark, d):
    vocab, merges, top = toy(spark, d)
    return tokenizers.prune(vocab, merges, none_added(spark), used(top))[0]


@register(
    "merge_filter",
    f"""WITH {CLOSED} SELECT rank, "left", "right", product, (row_number() OVER (ORDER BY rank) - 1)::INT AS new_rank FROM merges WHERE product IN (SELECT token FROM keep)""",
)
def merge_filter(spark, d):
    vocab, merges, top = toy(spark, d)
    return tokenizers.prune(vocab, merges, none_added(spark), used(top))[1]


@register(
    "added_token_ids",
    f"""WITH {CLOSED}, k AS (SELECT count(*) AS n FROM keep), a AS (SELECT id + 1000 AS id, '<' || token || '>' AS content FROM vocab WHERE id < 26 AND id % 5 = 0)
SELECT content, id AS old_id, (n + row_number() OVER (ORDER BY id) - 1)::INT AS new_id FROM a, k""",
)
def added_token_ids(spark, d):
    vocab, merges, top = toy(spark, d)
    added = vocab.filter("id < 26 AND id % 5 = 0").select((F.col("id") + 1000).alias("id"), F.concat(F.lit("<"), "token", F.lit(">")).alias("content"))
    return tokenizers.prune(vocab, merges, added, used(top))[2]


#: Two tokenizations of each document: its lower-case words, and the same with words outside the keep-set cut to letters.
PAIRS = CLOSED + """, d AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS a FROM documents), ks AS (SELECT list(token) AS ks FROM used),
x AS (SELECT doc_id, a, flatten(list_transform(a, lambda w: CASE WHEN list_contains(ks, w) THEN [w] ELSE string_split(w, '') END)) AS b FROM d, ks)"""


def pairs(spark, d):
    _, _, top = toy(spark, d)
    keep = [r["token"] for r in used(top).collect()]
    a = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    b = F.flatten(F.transform(a, lambda w: F.when(w.isin(keep), F.array(w)).otherwise(F.split(w, ""))))
    return docs(spark, d).select("doc_id", a.alias("a"), b.alias("b"))


@register("agreement_metrics", f"WITH {PAIRS} SELECT count(*) AS docs, round(avg((a = b)::INT), 6) AS identical, round(avg(len(b) / greatest(len(a), 1)), 6) AS length_ratio FROM x")
def agreement_metrics(spark, d):
    return scoring.agreement(pairs(spark, d)).select("docs", F.round("identical", 6).alias("identical"), F.round("length_ratio", 6).alias("length_ratio"))


@register(
    "missing_tokens",
    f"WITH {PAIRS}, e AS (SELECT unnest(a) AS token FROM x WHERE a <> b) SELECT token, count(*) AS n FROM e WHERE token NOT IN (SELECT token FROM used) GROUP BY token ORDER BY n DESC, token LIMIT 15",
)
def missing_tokens(spark, d):
    _, _, top = toy(spark, d)
    return scoring.missing_tokens(pairs(spark, d), used(top))


@register("roundtrip_check", f"WITH {PAIRS} SELECT count(*) AS docs, bool_and(array_to_string(a, '') = array_to_string(b, '')) AS exact FROM x")
def roundtrip_check(spark, d):
    return pairs(spark, d).agg(F.count("*").alias("docs"), F.bool_and(F.array_join("a", "") == F.array_join("b", "")).alias("exact"))


@register(
    "vocabulary_extension",
    f"""WITH {TOK}, p AS (SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT w[i:i] AS a, w[i + 1:i + 1] AS b, n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM ({COUNTS}))) GROUP BY ALL),
c AS (SELECT a AS "left", b AS "right", a || b AS product, n AS pair_count FROM p WHERE a IN (SELECT token FROM vocab) AND b IN (SELECT token FROM vocab) AND a || b NOT IN (SELECT token FROM vocab))
SELECT "left", "right", product, pair_count, ((SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY pair_count DESC, product))::INT AS id FROM c ORDER BY pair_count DESC, product LIMIT 30""",
)
def vocabulary_extension(spark, d):
    vocab, _, _ = toy(spark, d)
    p = words.pairs_in_words(words.counts(docs(spark, d)))
    cand = p.select((F.row_number().over(Window.orderBy(F.concat("a", "b"))) - 1).alias("rank"), F.col("a").alias("left"), F.col("b").alias("right"), F.concat("a", "b").alias("product"))
    return tokenizers.extension(cand, vocab, p, 30)


@register("byte_display", f"WITH {TOK} SELECT id, replace(replace('Ġ' || token || 'Ċ', 'Ġ', '␣'), 'Ċ', '⏎') AS shown FROM vocab")
def byte_display(spark, d):
    from corpusloom.functions.text import byte_level_display

    vocab, _, _ = toy(spark, d)
    return vocab.select("id", byte_level_display(F.concat(F.lit("Ġ"), "token", F.lit("Ċ"))).alias("shown"))


@register("example_token", f"WITH {TOK} SELECT max_by(token, length(token) * 100000 - id) AS token FROM vocab WHERE regexp_full_match(token, '[a-z]+')")
def example_token(spark, d):
    """The longest token, the one with the least id of them."""
    vocab, _, _ = toy(spark, d)
    return vocab.filter(F.col("token").rlike("^[a-z]+$")).agg(F.max_by("token", F.length("token") * 100000 - F.col("id")).alias("token"))


@register("vocabulary_overlap", f"WITH {TOK} SELECT count(*) AS both_ FROM vocab WHERE token IN (SELECT product FROM merges)")
def vocabulary_overlap(spark, d):
    vocab, merges, _ = toy(spark, d)
    return vocab.select("token").intersect(merges.select(F.col("product").alias("token"))).agg(F.count("*").alias("both_"))


def learned(spark, d, n: int = 200):
    """Word types as bytes with counts, and merges learned from all of them."""
    types = words.counts(docs(spark, d), r"\p{L}+").withColumn("w", tokenizers.as_bytes(F.col("w")))
    types = checkpointed(types)
    return types, tokenizers.train_bpe_types(types, n)


def learned_usage(types, merges):
    """Each word type is encoded once and weighted by its count."""
    return tokenizers.encode_types(types, merges).select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


@register("bpe_train")
def bpe_train(spark, d):
    _, merges = learned(spark, d)
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string, product string")


@register("bpe_encode")
def bpe_encode(spark, d):
    """Token counts of the learned byte-level BPE; a token's bytes as characters U+0000 to U+00FF."""
    return learned_usage(*learned(spark, d))


@register("unreachable_tokens")
def unreachable_tokens(spark, d):
    """Pruning without the closure: kept tokens that the remaining merges no longer make, for the closed and the unclosed keep-set."""
    types, merges = learned(spark, d)
    usage = learned_usage(types, merges)
    # the types are encoded once; what is kept is at most a vocabulary, and each use of it would encode them anew
    keep = checkpointed(usage.filter("n >= 50").select("token"))
    table_ = spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string, product string")
    out = []
    for name, kept in (("closed", tokenizers.closure(keep, table_)), ("unclosed", keep)):
        left = [(r["left"], r["right"]) for r in tokenizers.surviving_merges(table_, kept).orderBy("rank").collect()]
        again = tokenizers.encode_types(kept.withColumnRenamed("token", "w"), left)
        out.append(again.agg(F.lit(name).alias("keep_set"), F.count("*").alias("tokens"), F.count_if(F.size("tokens") != 1).alias("unreachable")))
    return out[0].unionByName(out[1])


@register(
    "merge_tree",
    f"""WITH {TOK}, o AS (SELECT token AS w FROM vocab ORDER BY length(token) DESC, id LIMIT 1), l AS (SELECT w, unnest(range(0, 4)) AS level FROM o),
n AS (SELECT level, w[1:length(w) - level] AS token FROM l WHERE level < length(w) UNION ALL SELECT level, w[length(w) - level + 1:length(w) - level + 1] FROM l WHERE level > 0 AND level < length(w))
SELECT level::INT AS level, token, rank FROM n LEFT JOIN merges ON token = product""",
)
def merge_tree(spark, d):
    vocab, merges, _ = toy(spark, d)
    word = vocab.orderBy(F.desc(F.length("token")), "id").first()["token"]
    return spark.createDataFrame(tokenizers.merge_tree(word, merges), "level int, token string, rank int")


#: A second merge for products of three or more letters: the first letter and the rest, where the rest is an entry.
BOTH = TOK + """, used AS (SELECT w AS token FROM top WHERE n >= 100),
more AS (SELECT m.*, (SELECT count(*) FROM merges) + row_number() OVER (ORDER BY length(product), product) - 1 AS r2 FROM merges m WHERE length(product) > 2 AND product[2:] IN (SELECT token FROM vocab)),
made AS (SELECT rank, "left", "right", product FROM merges UNION ALL SELECT r2::INT, product[1:1], product[2:], product FROM more)"""


def two_producers(spark, d):
    vocab, merges, top = toy(spark, d)
    rest = F.expr("substring(product, 2)")
    more = merges.filter(F.length("product") > 2).join(vocab.select("token"), rest == F.col("token"), "left_semi")
    n = merges.count()
    more = more.select((F.row_number().over(Window.orderBy(F.length("product"), "product")) - 1 + n).alias("rank"), F.expr("left(product, 1)").alias("left"), rest.alias("right"), "product")
    return merges.unionByName(more), used(top)


def closure_of(pick: str) -> str:
    return f"""WITH RECURSIVE {BOTH}, p AS (SELECT product, unnest(["left", "right"]) AS part FROM made WHERE {pick}),
r AS (SELECT token FROM used UNION SELECT part FROM r JOIN p ON r.token = p.product) SELECT token FROM r"""


@register("closure_all_producers", closure_of("true"))
def closure_all_producers(spark, d):
    merges, keep = two_producers(spark, d)
    return tokenizers.closure(keep, merges)


@register("closure_first_producer", closure_of("rank = (SELECT min(rank) FROM made m WHERE m.product = made.product)"))
def closure_first_producer(spark, d):
    merges, keep = two_producers(spark, d)
    return tokenizers.closure(keep, merges, "first")


@register("closure_last_producer", closure_of("rank = (SELECT max(rank) FROM made m WHERE m.product = made.product)"))
def closure_last_producer(spark, d):
    merges, keep = two_producers(spark, d)
    return tokenizers.closure(keep, merges, "last")


#: The derived tokenizer with byte tokens and placeholders after its entries.
FALLBACK = CLOSED + """, wide AS (SELECT token, id FROM vocab UNION ALL SELECT printf('<0x%02X>', b::INT), ((SELECT count(*) FROM vocab) + b)::INT FROM range(0, 256) t(b)
UNION ALL SELECT token, (SELECT count(*) FROM vocab)::INT + id FROM (VALUES ('<unused0>', 256), ('<unused1>', 257), ('<s>', 258), ('</s>', 259), ('<unk>', 260)) v(token, id)),
stays AS (SELECT * FROM wide WHERE token IN (SELECT token[1:i] FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM used) UNION SELECT token[i:i] FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM used))
 OR token SIMILAR TO '<0x[0-9A-F]{2}>' OR token IN ('<s>', '</s>', '<unk>'))"""


def with_fallback(spark, d):
    vocab, merges, top = toy(spark, d)
    n = vocab.count()
    extra = [*(f"<0x{b:02X}>" for b in range(256)), "<unused0>", "<unused1>", "<s>", "</s>", "<unk>"]
    vocab = vocab.select("token", F.col("id").cast("int").alias("id")).unionByName(spark.createDataFrame([(t, n + i) for i, t in enumerate(extra)], "token string, id int"))
    added = spark.createDataFrame([(n + i, t) for i, t in enumerate(extra) if i >= 256], "id int, content string")
    return tokenizers.prune_byte_fallback(vocab, merges, added, used(top), "<unk>")


@register("prune_byte_fallback", f"WITH {FALLBACK} SELECT token, id AS old_id, (row_number() OVER (ORDER BY id) - 1)::INT AS new_id FROM stays")
def prune_byte_fallback(spark, d):
    return with_fallback(spark, d)[0]


@register(
    "special_id_remap",
    f"""WITH {FALLBACK}, n AS (SELECT token, (row_number() OVER (ORDER BY id) - 1)::INT AS new_id FROM stays)
SELECT name, new_id FROM (VALUES ('bos_token_id', '<s>'), ('eos_token_id', '</s>'), ('pad_token_id', '<unk>'), ('post_processor', '<s>')) v(name, token) JOIN n USING (token)""",
)
def special_id_remap(spark, d):
    """A config's and a post-processor's special ids under the new numbers."""
    numbers, _, added = with_fallback(spark, d)
    old = {r["content"]: r["old_id"] for r in added.collect()}
    new = {r["old_id"]: r["new_id"] for r in added.collect()}
    config = tokenizers.remap_special_ids({"bos_token_id": old["<s>"], "eos_token_id": [old["</s>"]], "pad_token_id": old["<unk>"], "other": 1}, new)
    post = tokenizers.remap_ids({"processors": [{"special_tokens": {"<s>": {"ids": [old["<s>"]]}}}]}, new, strict=True)
    rows = [("bos_token_id", config["bos_token_id"]), ("eos_token_id", config["eos_token_id"][0]), ("pad_token_id", config["pad_token_id"]), ("post_processor", post["processors"][0]["special_tokens"]["<s>"]["ids"][0])]
    return spark.createDataFrame(rows, "name string, new_id int")


@register("seeded_vocabulary_order", f"WITH {TOK} SELECT token FROM vocab ORDER BY md5('0:' || token), token LIMIT 50")
def seeded_vocabulary_order(spark, d):
    vocab, _, _ = toy(spark, d)
    return splits.seeded_sample(vocab, "token", 50).select("token")


@register("random_control")
def random_control(spark, d):
    """A random keep-set of the size of the pruned one: its size, and what share of tokens it leaves whole, beside the frequent one."""
    vocab, merges, top = toy(spark, d)
    numbers, _, _ = tokenizers.prune(vocab, merges, none_added(spark), used(top))
    target = numbers.count()
    sets = {"frequent": [r["token"] for r in numbers.select("token").collect()], "random": tokenizers.random_keep(vocab, merges, target)}
    c = words.counts(docs(spark, d)).filter(F.col("w").rlike("^[a-z]+$"))
    rows = [c.agg(F.lit(k).alias("run"), F.lit(len(v)).alias("vocab"), F.round(F.sum(F.when(F.col("w").isin(v), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("whole_share")) for k, v in sets.items()]
    return rows[0].unionByName(rows[1])
