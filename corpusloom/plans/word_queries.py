"""Token usage, coverage and word types."""

from pyspark.sql import functions as F

from corpusloom.functions.text import extract
from corpusloom.operators import splits, words
from corpusloom.plans.catalog import register
from corpusloom.plans.common import COUNTS, HELD, LIST, LISTED, SEGMENTS, SPLIT, TRAIN, WORDS
from corpusloom.session import table


def docs(spark, d):
    return table(spark, d, "documents")


@register("token_usage", f"SELECT w AS token, n FROM ({COUNTS})")
def token_usage(spark, d):
    return words.counts(docs(spark, d)).select(F.col("w").alias("token"), "n")


@register(
    "usage_totals",
    r"SELECT count(*) AS docs, sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\s]+'))) ::BIGINT AS n_tokens, sum(strlen(text))::BIGINT AS n_bytes FROM documents",
)
def usage_totals(spark, d):
    return docs(spark, d).agg(
        F.count("*").alias("docs"), F.sum(F.size(extract(F.col("text"), words.TOKEN))).cast("long").alias("n_tokens"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes")
    )


COVERAGE = rf"""WITH t AS (SELECT lang, doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents),
a AS (SELECT lang, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM t GROUP BY lang),
b AS (SELECT lang, sum(strlen(text)) AS n_bytes, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS n_words FROM documents GROUP BY lang),
c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k, sum(n) OVER (PARTITION BY lang ORDER BY n DESC, w) AS cum, sum(n) OVER (PARTITION BY lang) AS total FROM c),
i AS (SELECT lang, min(k) AS ids_99 FROM r WHERE cum * 100 >= total * 99 GROUP BY lang)
SELECT lang, n_tokens, n_distinct, n_bytes::BIGINT AS n_bytes, round(n_bytes / n_tokens, 6) AS bytes_per_token, round(n_tokens / n_words, 6) AS fertility, ids_99 FROM a JOIN b USING (lang) JOIN i USING (lang)"""


@register("token_coverage", COVERAGE)
def token_coverage(spark, d):
    """Flagship: for each language tokens, types, bytes per token, tokens per word and the types that cover 99 %.

    Types are counted once by (lang, word); the 99 % point comes from the histogram of counts, so no task sorts all types."""
    from pyspark.sql import Window

    src = docs(spark, d)
    c = words.exploded(src, words.LETTERS, "lang").groupBy("lang", "w").agg(F.count("*").alias("n"))
    levels = c.groupBy("lang", "n").agg(F.count("*").alias("types"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("lang")
    tokens = F.col("n") * F.col("types")
    levels = levels.select(
        "lang", "n", "types",
        F.coalesce(F.sum("types").over(before), F.lit(0)).alias("tb"),
        F.coalesce(F.sum(tokens).over(before), F.lit(0)).alias("cb"),
        F.sum(tokens).over(total).alias("n_tokens"), F.sum("types").over(total).alias("n_distinct"),
    )
    need = F.ceil(F.col("n_tokens") * 99 / 100).cast("long")
    point = levels.filter((F.col("cb") < need) & (need <= F.col("cb") + F.col("n") * F.col("types"))).select(
        "lang", "n_tokens", "n_distinct", (F.col("tb") + F.ceil((need - F.col("cb")) / F.col("n"))).cast("long").alias("ids_99")
    )
    by = src.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("n_words"))
    return point.join(by, "lang").select(
        "lang", "n_tokens", "n_distinct", "n_bytes",
        F.round(F.col("n_bytes") / F.col("n_tokens"), 6).alias("bytes_per_token"), F.round(F.col("n_tokens") / F.col("n_words"), 6).alias("fertility"), "ids_99",
    )


RANKED = f"SELECT n, row_number() OVER (ORDER BY n DESC, w) AS k, sum(n) OVER (ORDER BY n DESC, w) AS cum, sum(n) OVER () AS total FROM ({COUNTS})"
POINTS = sorted({int(100 * (500 ** (i / 59))) for i in range(60)})


@register("ids_for_share", f"SELECT p AS percent, min(k) AS ids FROM ({RANKED}), (VALUES (50), (90), (95), (99)) v(p) WHERE cum * 100 >= total * p GROUP BY p")
def ids_for_share(spark, d):
    return words.ids_for_share(words.counts(docs(spark, d)), [50, 90, 95, 99])


@register(
    "coverage_curve",
    f"SELECT v.k AS k, max(cum)::BIGINT AS tokens, max(total)::BIGINT AS total FROM ({RANKED}) r, (VALUES {', '.join(f'({p})' for p in POINTS)}) v(k) WHERE r.k <= v.k GROUP BY v.k",
)
def coverage_curve(spark, d):
    return words.coverage_at(words.counts(docs(spark, d)), POINTS)


@register("word_types_case", f"SELECT regexp_full_match(w, '[a-z]+') AS lower, count(*) AS types, sum(n)::BIGINT AS tokens FROM ({COUNTS}) GROUP BY 1")
def word_types_case(spark, d):
    return words.counts(docs(spark, d)).groupBy(F.col("w").rlike("^[a-z]+$").alias("lower")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


@register("top_words", f"SELECT w, n FROM ({COUNTS}) ORDER BY n DESC, w LIMIT 25")
def top_words(spark, d):
    return words.top_words(docs(spark, d), 25)


@register(
    "distinct_share",
    f"""WITH t AS (SELECT split, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM ({SPLIT})), c AS (SELECT w, bool_or(split = 'train') AS tr, bool_or(split = 'held') AS he FROM t GROUP BY w)
SELECT count(*) AS types, count(*) FILTER (tr) AS train_types, count(*) FILTER (he) AS held_types, count(*) FILTER (he AND tr) AS both_types, round(count(*) FILTER (he AND tr) / count(*) FILTER (he), 6) AS held_covered FROM c""",
)
def distinct_share(spark, d):
    s = splits.budget_split(docs(spark, d).withColumn("b", F.octet_length("text")), "doc_id", "b", HELD, TRAIN)
    c = words.exploded(s, words.LETTERS, "split").groupBy("w").agg(F.bool_or(F.col("split") == "train").alias("tr"), F.bool_or(F.col("split") == "held").alias("he"))
    both = F.count_if(F.col("tr") & F.col("he"))
    return c.agg(
        F.count("*").alias("types"), F.count_if("tr").alias("train_types"), F.count_if("he").alias("held_types"), both.alias("both_types"),
        F.round(both / F.count_if("he"), 6).alias("held_covered"),
    )


@register(
    "doc_word_frequency",
    f"SELECT w, count(*) AS n, count(DISTINCT doc_id) AS df FROM ({WORDS}) GROUP BY w HAVING count(DISTINCT doc_id) >= 50",
)
def doc_word_frequency(spark, d):
    per = words.exploded(docs(spark, d), words.LETTERS, "doc_id").groupBy("w", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("df")).filter("df >= 50")


CASES = rf"""WITH s AS (SELECT doc_id, {SEGMENTS} AS g FROM documents),
e AS (SELECT doc_id, unnest(g) AS x, unnest(list_concat([NULL], g[:-2])) AS p FROM s),
u AS (SELECT doc_id, x, regexp_full_match(x, '[a-z]+') AS is_low FROM e WHERE regexp_full_match(x, '[a-z]+') OR (regexp_full_match(x, '[A-Z][a-z]+') AND p IS NOT NULL AND NOT regexp_matches(p, '[.!?\n]\s?$') AND NOT regexp_matches(p, '\n(?s:.)$'))),
c AS (SELECT lower(x) AS w, count(*) FILTER (is_low) AS low, count(*) FILTER (NOT is_low) AS cap, count(DISTINCT doc_id) FILTER (NOT is_low) AS df FROM u GROUP BY 1)"""


@register("word_cases", CASES + " SELECT * FROM c WHERE df > 0")
def word_cases(spark, d):
    return words.whole_word_cases(docs(spark, d)).filter("df > 0")


@register("core_names", CASES + f" SELECT upper(w[1]) || w[2:] AS name, df, cap, low FROM c WHERE df >= 2 AND low * 10 <= cap AND w NOT IN ({LIST})")
def core_names(spark, d):
    return words.core_names(docs(spark, d), words.closed_list(docs(spark, d), LISTED), 2)


@register(
    "pretoken_pairs",
    f"SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT w[i] AS a, w[i + 1] AS b, n FROM (SELECT w, n, unnest(range(1, len(w))) AS i FROM ({COUNTS}))) GROUP BY ALL",
)
def pretoken_pairs(spark, d):
    return words.pairs_in_words(words.counts(docs(spark, d)))
