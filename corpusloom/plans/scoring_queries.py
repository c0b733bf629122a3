"""Windows, bits per byte, threshold sweeps, generation, providers and file round trips."""

from pyspark.sql import functions as F

from corpusloom.functions.text import length_ratio
from corpusloom.operators import scoring, splits, words
from corpusloom.plans.catalog import register
from corpusloom.plans.common import HELD, SPLIT, TRAIN
from corpusloom.session import table
from corpusloom.sources.checkpoints import checkpointed

IDS = "SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w)) AS ids FROM documents"


def docs(spark, d):
    return table(spark, d, "documents")


def ids(spark, d):
    """Stand-in ids: word lengths."""
    return docs(spark, d).select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w)).alias("ids"))


@register(
    "window_slices",
    f"""WITH i AS ({IDS}), w AS (SELECT doc_id, s // 511 AS win, ids[s + 1:s + 512] AS ids FROM (SELECT doc_id, ids, unnest(range(0, len(ids) - 1, 511)) AS s FROM i WHERE len(ids) >= 2))
SELECT doc_id, win::INT AS win, len(ids) AS size, list_sum(ids)::BIGINT AS total FROM w""",
)
def window_slices(spark, d):
    w = ids(spark, d).select("doc_id", F.posexplode(scoring.windows(F.col("ids"))).alias("win", "ids"))
    return w.select("doc_id", "win", F.size("ids").cast("long").alias("size"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("window_targets", f"SELECT doc_id, len(ids) - 1 AS targets FROM ({IDS}) WHERE len(ids) >= 2")
def window_targets(spark, d):
    """Every id but the first is scored exactly once, by a scorer that runs over windows."""
    w = ids(spark, d).select("doc_id", F.posexplode(scoring.windows(F.col("ids"))).alias("win", "ids"))
    s = scoring.score_windows(w, lambda batch: [0.0 for _ in batch])
    return s.groupBy("doc_id").agg(F.sum("targets").alias("targets"))


BITS = f"""WITH s AS ({SPLIT}), t AS (SELECT split, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM s),
tr AS (SELECT w, count(*) AS n FROM t WHERE split = 'train' GROUP BY w), he AS (SELECT w, count(*) AS n FROM t WHERE split = 'held' GROUP BY w),
bytes AS (SELECT sum(b) AS b FROM s WHERE split = 'held')"""


def split_counts(spark, d):
    s = splits.budget_split(docs(spark, d).select("doc_id", "text", F.octet_length("text").cast("long").alias("b")), "doc_id", "b", HELD, TRAIN)
    c = words.exploded(s.filter("split <> 'dropped'"), words.LETTERS, "split").groupBy("split", "w").agg(F.count("*").alias("n"))
    size = s.filter("split = 'held'").agg(F.sum("b")).first()[0]
    return c.filter("split = 'train'").select("w", "n"), c.filter("split = 'held'").select("w", "n"), size


@register(
    "bits_per_byte_unigram",
    BITS
    + """, k AS (SELECT sum(n) + count(*) + 1 AS room FROM tr) SELECT sum(he.n)::BIGINT AS tokens, round(sum(-he.n * ln((coalesce(tr.n, 0) + 1) / room)) / ln(2) / max(b), 5) AS bits_per_byte FROM he LEFT JOIN tr USING (w), k, bytes""",
)
def bits_per_byte_unigram(spark, d):
    train, held, size = split_counts(spark, d)
    return scoring.unigram_nll(train, held).select("tokens", F.round(scoring.bits_per_byte(F.col("nll"), F.lit(float(size))), 5).alias("bits_per_byte"))


@register(
    "bits_per_byte_bigram",
    BITS
    + """, x AS (SELECT split, regexp_extract_all(text, '[A-Za-z]+') AS t FROM s WHERE split <> 'dropped'), p AS (SELECT split, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM x WHERE len(t) > 1),
two AS (SELECT a, b, count(*) AS ab FROM p WHERE split = 'train' GROUP BY ALL), one AS (SELECT a, sum(ab) AS a_n FROM two GROUP BY a), k AS (SELECT sum(n) + count(*) + 1 AS room FROM tr),
h AS (SELECT a, b, count(*) AS n FROM p WHERE split = 'held' GROUP BY ALL)
SELECT sum(h.n)::BIGINT AS tokens, round(sum(-h.n * ln((coalesce(ab, 0) + (coalesce(tr.n, 0) + 1) / room) / (coalesce(a_n, 0) + 1))) / ln(2) / max(bytes.b), 5) AS bits_per_byte
FROM h LEFT JOIN two USING (a, b) LEFT JOIN one USING (a) LEFT JOIN tr ON tr.w = h.b, k, bytes""",
)
def bits_per_byte_bigram(spark, d):
    """An n-gram model scored over windows of 512 words that overlap by one."""
    s = splits.budget_split(docs(spark, d).select("doc_id", "text", F.octet_length("text").cast("long").alias("b")), "doc_id", "b", HELD, TRAIN).filter("split <> 'dropped'")
    w = s.select("split", F.explode(scoring.windows(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("ids"))
    train, _, size = split_counts(spark, d)
    pairs = {k: scoring.window_pairs(w.filter(F.col("split") == k)) for k in ("train", "held")}
    return scoring.bigram_nll(pairs["train"], pairs["held"], train).select("tokens", F.round(scoring.bits_per_byte(F.col("nll"), F.lit(float(size))), 5).alias("bits_per_byte"))


@register(
    "evaluate_keep",
    BITS
    + """, m AS (SELECT * FROM (VALUES (1), (5), (20), (100)) v(m)), d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS t FROM s WHERE split = 'held'),
v AS (SELECT m, count(*) AS vocab, sum(n) AS total FROM tr, m WHERE n >= m GROUP BY m), e AS (SELECT doc_id, unnest(t) AS w FROM d),
c AS (SELECT m, doc_id, count(*) AS n_old, sum(CASE WHEN coalesce(tr.n, 0) >= m THEN 1 ELSE length(e.w) END) AS n_new FROM e LEFT JOIN tr USING (w), m GROUP BY ALL),
g AS (SELECT m, count(*) AS docs, avg((coalesce(n_new, 0) = coalesce(n_old, 0))::INT) AS identical, avg(coalesce(n_new, 0) / greatest(coalesce(n_old, 0), 1)) AS length_ratio FROM (SELECT m, doc_id FROM d, m) LEFT JOIN c USING (m, doc_id) GROUP BY m),
b AS (SELECT m, sum(-he.n * ln(tr.n / v.total)) / ln(2) AS bits FROM he JOIN tr USING (w), v WHERE tr.n >= m GROUP BY m)
SELECT m, vocab, 1000000 - 64 * ((SELECT count(*) FROM tr) - (vocab + 63) // 64 * 64) AS params, round(identical, 6) AS identical, round(length_ratio, 6) AS length_ratio, round(bits / bytes.b, 5) AS bits_per_byte
FROM v JOIN g USING (m) JOIN b USING (m), bytes""",
)
def evaluate_keep(spark, d):
    """One row for each threshold: what is kept, parameters, agreement on held documents and bits per byte. Words that are kept are one token, others their letters; words of one letter stay one."""
    from functools import reduce

    from corpusloom.operators.vectors import pad_to

    s = splits.budget_split(docs(spark, d).select("doc_id", "text", F.octet_length("text").cast("long").alias("b")), "doc_id", "b", HELD, TRAIN)
    train, held, size = (x if isinstance(x, int) else checkpointed(x) for x in split_counts(spark, d))
    texts = s.filter("split = 'held'").select("doc_id", "text")
    each = words.exploded(texts, words.LETTERS, "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("k"))
    each = checkpointed(each.join(train.withColumnRenamed("n", "c"), "w", "left"))
    docs_ = texts.select("doc_id")
    had, out = train.count(), []
    for m in (1, 5, 20, 100):
        kept = train.filter(F.col("n") >= m)
        cuts = each.groupBy("doc_id").agg(F.sum("k").alias("n_old"), F.sum(F.col("k") * F.when(F.coalesce("c", F.lit(0)) >= m, 1).otherwise(F.length("w"))).alias("n_new"))
        cuts = docs_.join(cuts, "doc_id", "left").fillna(0)
        agree = cuts.agg(F.avg((F.col("n_old") == F.col("n_new")).cast("int")).alias("identical"), F.avg(F.col("n_new") / F.greatest("n_old", F.lit(1))).alias("length_ratio"))
        nll = held.join(scoring.restricted(train, kept), "w").agg(F.sum(-F.col("n") * F.ln("p")).alias("nll"))
        n = kept.count()
        out.append(agree.crossJoin(nll).select(F.lit(m).alias("m"), F.lit(n).cast("long").alias("vocab"), F.lit(1_000_000 - 64 * (had - pad_to(n))).cast("long").alias("params"), F.round("identical", 6).alias("identical"), F.round("length_ratio", 6).alias("length_ratio"), F.round(scoring.bits_per_byte(F.col("nll"), F.lit(float(size))), 5).alias("bits_per_byte")))
    return reduce(lambda a, b: a.unionByName(b), out)


@register(
    "bits_per_byte_pruned",
    BITS
    + """, tp AS (SELECT * FROM tr WHERE n >= 20), hp AS (SELECT * FROM he WHERE w IN (SELECT w FROM tp)), k AS (SELECT sum(n) AS total FROM tp)
SELECT sum(hp.n)::BIGINT AS tokens, round(sum(-hp.n * ln(tp.n / total)) / ln(2) / max(b), 5) AS bits_per_byte FROM hp JOIN tp USING (w), k, bytes""",
)
def bits_per_byte_pruned(spark, d):
    """The softmax restricted to words that occur 20 times in train."""
    train, held, size = split_counts(spark, d)
    p = scoring.restricted(train, train.filter("n >= 20"))
    out = held.join(p, "w").agg(F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.ln("p")).alias("nll"))
    return out.select("tokens", F.round(scoring.bits_per_byte(F.col("nll"), F.lit(float(size))), 5).alias("bits_per_byte"))


@register(
    "threshold_sweep",
    BITS
    + """, m AS (SELECT * FROM (VALUES (1), (5), (20), (100), (500)) v(m)), c AS (SELECT w, tr.n AS c, he.n AS h FROM tr FULL JOIN he USING (w)),
r AS (SELECT m, count(*) FILTER (coalesce(c, 0) >= m) AS vocab, sum(h) FILTER (coalesce(c, 0) >= m) AS covered, sum(h) AS total FROM c, m GROUP BY m)
SELECT m, vocab, round(covered / total, 6) AS held_covered FROM r""",
)
def threshold_sweep(spark, d):
    train, held, _ = split_counts(spark, d)
    both = train.withColumnRenamed("n", "c").join(held.withColumnRenamed("n", "h"), "w", "full").withColumn("m", F.explode(F.array(*map(F.lit, (1, 5, 20, 100, 500)))))
    kept = F.coalesce("c", F.lit(0)) >= F.col("m")
    covered = F.sum(F.when(kept, F.coalesce("h", F.lit(0))).otherwise(0))
    return both.groupBy("m").agg(F.count_if(kept).alias("vocab"), F.round(covered / F.sum("h"), 6).alias("held_covered"))


@register("length_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[aeiou]', '', 'g')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def text_length_ratio(spark, d):
    return docs(spark, d).filter(F.length("text") > 0).select("doc_id", F.round(length_ratio(F.regexp_replace("text", "[aeiou]", ""), F.col("text")), 6).alias("ratio"))


def lower_words():
    return F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))


@register(
    "token_bigrams",
    """WITH x AS (SELECT list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)) AS t FROM documents), p AS (SELECT unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM x WHERE len(t) > 1)
SELECT a, b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 5""",
)
def token_bigrams(spark, d):
    return scoring.bigrams(docs(spark, d), "text", lower_words()).filter("n >= 5")


@register(
    "greedy_generation",
    """WITH RECURSIVE x AS (SELECT list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)) AS t FROM documents), p AS (SELECT unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM x WHERE len(t) > 1),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), best AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
r AS (SELECT 0 AS pos, 'the' AS token UNION ALL SELECT pos + 1, b FROM r JOIN best ON a = token WHERE pos < 16) SELECT pos, token FROM r""",
)
def greedy_generation(spark, d):
    said = scoring.greedy(scoring.bigrams(docs(spark, d), "text", lower_words()), "the", 16)
    return spark.createDataFrame(list(enumerate(said)), "pos int, token string")


@register("provider_rewrite")
def provider_rewrite(spark, d):
    """Rewrites of conversation turns by the offline provider, checked and asked again inside the partitions."""
    from corpusloom.sources.providers import offline_provider, rewrite

    c = table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text")
    listed = words.closed_list(docs(spark, d), 300)
    return rewrite(c, offline_provider(listed), listed, [], "Use listed words only.")


@register("json_round_trip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_round_trip(spark, d):
    """Rows through JSON strings with an explicit schema and back."""
    c = table(spark, d, "conversations")
    j = c.select(F.to_json(F.struct(*c.columns)).alias("j"))
    r = j.select(F.from_json("j", c.schema).alias("r")).select("r.*")
    return r.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))
