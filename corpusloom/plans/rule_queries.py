"""Rules of a closed vocabulary: checks, normalisation, replacement, dropped sentences, labels and run statistics."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import rules, words
from corpusloom.plans.catalog import register
from corpusloom.plans.common import COUNTS, LIST, LISTED, SEGMENTS
from corpusloom.session import table

#: The queries' allowed names, stand-ins for a names file.
NAMES = ("The", "Der", "La", "El", "Le")
NAME_LIST = "['" + "', '".join(NAMES) + "']"
LISTS = f"l AS (SELECT list(w) AS ws FROM ({LIST}))"
BAD = f"NOT CASE WHEN regexp_full_match(w, '[a-z]+') THEN list_contains(ws, w) WHEN regexp_full_match(w, '[A-Z][a-z]*') THEN list_contains({NAME_LIST}, w) ELSE false END"
CHECK = rf"""WITH {LISTS}, c AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[A-Za-z]+') AS found, ws FROM documents, l),
k AS (SELECT doc_id, lang, text, len(found) AS n_words, list_filter(found, lambda w: {BAD}) AS bad, length(regexp_replace(text, '[\sA-Za-z0-9.,?!]', '', 'g')) AS bad_punct FROM c)"""


def docs(spark, d):
    return table(spark, d, "documents")


def listed(spark, d):
    return words.closed_list(docs(spark, d), LISTED)


def checked(spark, d):
    return docs(spark, d).select("doc_id", "lang", "text", tx.check("text", listed(spark, d), NAMES).alias("c")).select("doc_id", "lang", "text", "c.*")


@register("rule_check", CHECK + " SELECT doc_id, n_words, len(bad) AS n_bad, md5(array_to_string(bad, ' ')) AS bad_md5, round(len(bad) / greatest(n_words, 1), 6) AS oov_rate, bad_punct FROM k")
def rule_check(spark, d):
    return checked(spark, d).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("bad").cast("long").alias("n_bad"), F.md5(F.array_join("bad", " ").cast("binary")).alias("bad_md5"),
        F.round("oov_rate", 6).alias("oov_rate"), F.col("bad_punct").cast("long").alias("bad_punct"),
    )


@register(
    "offlist_rate",
    CHECK + " SELECT lang, sum(n_words)::BIGINT AS n_words, sum(len(bad))::BIGINT AS n_bad, round(sum(len(bad)) / greatest(sum(n_words), 1), 6) AS rate, count(*) FILTER (len(bad) <= 0.03 * n_words) AS accepted FROM k GROUP BY lang",
)
def offlist_rate(spark, d):
    bad = F.size("bad")
    return checked(spark, d).groupBy("lang").agg(
        F.sum("n_words").alias("n_words"), F.sum(bad).alias("n_bad"), F.round(F.sum(bad) / F.greatest(F.sum("n_words"), F.lit(1)), 6).alias("rate"),
        F.count_if(bad <= 0.03 * F.col("n_words")).alias("accepted"),
    )


@register("offlist_types", f"WITH {LISTS} SELECT w, n FROM ({COUNTS}), l WHERE {BAD}")
def offlist_types(spark, d):
    """The same by joins over word types, for lists of any size."""
    lists = spark.createDataFrame([(w,) for w in listed(spark, d)], "w string")
    return rules.off_list_words(docs(spark, d), lists, spark.createDataFrame([(n,) for n in NAMES], "w string"))


@register("repair_word_list", CHECK + " SELECT doc_id, array_to_string(list_sort(list_distinct(bad))[:80], ', ') AS repair FROM k WHERE len(bad) > 0.03 * n_words")
def repair_word_list(spark, d):
    return checked(spark, d).filter(F.size("bad") > 0.03 * F.col("n_words")).select("doc_id", tx.repair_list(F.col("bad")).alias("repair"))


@register(
    "normalize_case",
    rf"""WITH {LISTS} SELECT doc_id, md5(array_to_string(list_transform({SEGMENTS}, lambda x: CASE WHEN regexp_full_match(x, '[A-Z][a-z]*') AND NOT list_contains({NAME_LIST}, x) AND list_contains(ws, lower(x)) THEN lower(x) ELSE x END), '')) AS text_md5 FROM documents, l""",
)
def normalize_case(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.normalize("text", listed(spark, d), NAMES).cast("binary")).alias("text_md5"))


FIXED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '[;:]', '.', 'g'), '[^\sA-Za-z0-9.,?!]', ' ', 'g'), '\s*([.,?!])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\.+', '.', 'g'), ',+', ',', 'g'), '\?+', '?', 'g'), '!+', '!', 'g')"""


@register(
    "fix_punct",
    rf"""SELECT doc_id, md5(coalesce(array_to_string(list_filter(list_transform(string_split_regex({FIXED}, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10)), '')) AS text_md5 FROM documents""",
)
def fix_punct(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.fix_punct(F.col("text")).cast("binary")).alias("text_md5"))


#: Stand-in for a learned dictionary: the 40 most frequent words of 3 letters become their reverse, those of 2 letters go.
REPL = f"SELECT w AS word, CASE WHEN length(w) = 2 THEN '' ELSE reverse(w) END AS repl FROM ({COUNTS}) WHERE length(w) IN (2, 3) ORDER BY n DESC, w LIMIT 40"
REPLACED = f"""r AS (SELECT map_from_entries(list((word, repl))) AS m FROM ({REPL})),
a AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda x: coalesce(m[x], x)), ''), '[ \\t]+', ' ', 'g') AS text FROM documents, r)"""


def replacements(spark, d):
    top = words.counts(docs(spark, d)).filter(F.length("w").isin(2, 3)).orderBy(F.desc("n"), "w").limit(40)
    return top.select(F.col("w").alias("word"), F.when(F.length("w") == 2, "").otherwise(F.reverse("w")).alias("repl"))


@register("apply_replacements", f"WITH {REPLACED} SELECT doc_id, md5(text) AS text_md5 FROM a")
def apply_replacements(spark, d):
    table_ = {r["word"]: r["repl"] for r in replacements(spark, d).collect()}
    return docs(spark, d).select("doc_id", F.md5(tx.squeeze(tx.apply_map("text", table_)).cast("binary")).alias("text_md5"))


@register("apply_replacements_joined", f"WITH {REPLACED} SELECT doc_id, md5(text) AS text_md5 FROM a")
def apply_replacements_joined(spark, d):
    out = rules.replace_words(docs(spark, d), "doc_id", replacements(spark, d))
    return out.select("doc_id", F.md5(tx.squeeze(F.col("text")).cast("binary")).alias("text_md5"))


#: Names that a row allows: its first words, as a title's would be.
ALLOWED = r"list_distinct(regexp_extract_all(text, '[A-Za-z]+')[:12])"


def with_allowed(spark, d):
    return docs(spark, d).withColumn("allowed", F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 12)))


@register(
    "apply_replacements_allowed",
    f"""WITH r AS (SELECT map_from_entries(list((word, repl))) AS m FROM ({REPL})),
a AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda x: CASE WHEN list_contains(ok, x) THEN x ELSE coalesce(m[x], x) END), ''), '[ \\t]+', ' ', 'g') AS text
FROM (SELECT doc_id, text, {ALLOWED} AS ok FROM documents), r) SELECT doc_id, md5(text) AS text_md5 FROM a""",
)
def apply_replacements_allowed(spark, d):
    """The dictionary without the names that a row allows."""
    table_ = {r["word"]: r["repl"] for r in replacements(spark, d).collect()}
    return with_allowed(spark, d).select("doc_id", F.md5(tx.squeeze(tx.apply_map("text", table_, "allowed")).cast("binary")).alias("text_md5"))


@register(
    "rule_check_allowed",
    rf"""WITH {LISTS}, c AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS found, ws, {ALLOWED} AS ok FROM documents, l)
SELECT doc_id, len(list_filter(found, lambda w: NOT CASE WHEN regexp_full_match(w, '[a-z]+') THEN list_contains(ws, w) WHEN regexp_full_match(w, '[A-Z][a-z]*') THEN list_contains({NAME_LIST}, w) OR list_contains(ok, w) ELSE false END)) AS n_bad FROM c""",
)
def rule_check_allowed(spark, d):
    """Capitalised words are good if they are on the list of names or among the row's own."""
    return with_allowed(spark, d).select("doc_id", F.size(tx.check("text", listed(spark, d), NAMES, "allowed")["bad"]).cast("long").alias("n_bad"))


@register("valid_replacements", f"WITH {LISTS} SELECT word, repl FROM ({REPL}), l WHERE len(list_filter(regexp_extract_all(repl, '[A-Za-z]+'), lambda w: NOT list_contains(ws, w))) = 0")
def valid_replacements(spark, d):
    return rules.valid_replacements(replacements(spark, d), spark.createDataFrame([(w,) for w in listed(spark, d)], "w string"))


@register(
    "drop_bad_sentences",
    rf"""WITH {LISTS}, p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS par, generate_subscripts(string_split(text, chr(10)), 1) AS i, ws FROM documents, l),
s AS (SELECT doc_id, i, ws, list_filter(regexp_extract_all(par, '[^.?!]+[.?!]*'), lambda s: regexp_matches(s, '\S')) AS ss FROM p),
g AS (SELECT doc_id, i, len(ss) AS n, list_filter(ss, lambda s: len(list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: {BAD})) = 0) AS ok FROM s),
j AS (SELECT doc_id, i, n, len(ok) AS kept, coalesce(array_to_string(list_transform(ok, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), ' '), '') AS t FROM g)
SELECT doc_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '')) AS text_md5, sum(kept)::BIGINT AS kept, sum(n - kept)::BIGINT AS dropped FROM j GROUP BY doc_id""",
)
def drop_bad_sentences(spark, d):
    c = tx.drop_bad_sentences("text", listed(spark, d), NAMES, separator="\\n")
    return docs(spark, d).select("doc_id", c.alias("c")).select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("text_md5"), F.col("c.kept").cast("long").alias("kept"), F.col("c.dropped").cast("long").alias("dropped"))


TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


@register(
    "subject_names",
    rf"""WITH {LISTS}, t AS (SELECT page_id, html, list_filter(regexp_extract_all(regexp_replace({TITLE}, '\(.*?\)', ' ', 'g'), '[A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND NOT list_contains(ws, lower(w))) AS c FROM pages, l),
e AS (SELECT page_id, html, unnest(c) AS w, generate_subscripts(c, 1) AS i FROM t), f AS (SELECT page_id, any_value(html) AS html, w, min(i) AS i FROM e GROUP BY page_id, w),
g AS (SELECT page_id, w, i, regexp_extract_all(html, '[\p{{L}}\p{{N}}_]+') AS ts FROM f),
k AS (SELECT page_id, w, i FROM g WHERE len(list_filter(ts, lambda x: x = lower(w))) * 10 <= greatest(len(list_filter(ts, lambda x: x = w)), 1))
SELECT page_id, coalesce(n, '') AS names FROM pages LEFT JOIN (SELECT page_id, string_agg(w, ' ' ORDER BY i) AS n FROM k GROUP BY 1) USING (page_id)""",
)
def subject_names(spark, d):
    p = table(spark, d, "pages").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", F.array_join(tx.subject_names("title", "html", listed(spark, d)), " ").alias("names"))


@register(
    "user_messages",
    rf"""SELECT page_id, 'TITLE: ' || {TITLE} || chr(10) || 'SUBJECT NAMES: ' || coalesce(nullif(array_to_string(regexp_extract_all({TITLE}, '[A-Z][a-z]+'), ', '), ''), '(none)') || chr(10) || 'TEXT:' || chr(10) || html AS message FROM pages""",
)
def user_messages(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    names = tx.extract(title, "[A-Z][a-z]+")
    return table(spark, d, "pages").select("page_id", tx.user_message(title, names, F.col("html")).alias("message"))


#: Label answers made of each conversation's turns: "<turn>. <role>".
LABELS = ("user", "assistant")


@register(
    "label_parse",
    """SELECT conv_id, turn AS number, max_by(role, turn) AS label FROM (SELECT conv_id, turn::INT AS turn, role FROM conversations WHERE turn >= 1 AND role IN ('user', 'assistant')) GROUP BY ALL""",
)
def label_parse(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat(F.col("turn").cast("string"), F.lit(") "), F.col("role"))
    answers = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("answer"), F.max("turn").cast("int").alias("n"))
    return rules.parse_labels(answers, "conv_id", "answer", LABELS, "n")


@register(
    "map_parse",
    f"""SELECT word, CASE WHEN repl = '' THEN '' ELSE lower(repl) END AS repl FROM ({REPL})""",
)
def map_parse(spark, d):
    """Answers of the form `word => repl`, `-` for a deletion, with words among them that nobody asked for."""
    r = replacements(spark, d)
    line = F.concat("word", F.lit(" => "), F.when(F.col("repl") == "", "-").otherwise(F.upper("repl")))
    answers = r.agg(F.array_join(F.array_append(F.collect_list(line), F.lit("zzzz => x")), "\n").alias("answer"))
    return rules.parse_map(answers, "answer", r.select("word"))


@register(
    "generation_stats",
    r"""WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS words,
 sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS chars_in, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS chars_out FROM conversations GROUP BY 1)
SELECT count(*) AS chunks, count(*) FILTER (answers > 0) AS done, round(avg((answers > 0)::INT), 6) AS accepted, round(avg((answers > 1)::INT), 6) AS repaired, sum(words)::BIGINT AS words,
 round(avg(chars_out / greatest(chars_in, 1)), 6) AS length_ratio, sum(chars_in)::BIGINT AS chars_in, round(sum(chars_out) / greatest(sum(chars_in), 1), 6) AS out_share FROM c""",
)
def generation_stats(spark, d):
    n = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("words"),
        n("user").alias("chars_in"), n("assistant").alias("chars_out"),
    )
    return c.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("answers") > 0).alias("done"),
        F.round(F.avg((F.col("answers") > 0).cast("int")), 6).alias("accepted"), F.round(F.avg((F.col("answers") > 1).cast("int")), 6).alias("repaired"), F.sum("words").alias("words"),
        F.round(F.avg(F.col("chars_out") / F.greatest(F.col("chars_in"), F.lit(1))), 6).alias("length_ratio"), F.sum("chars_in").alias("chars_in"),
        F.round(F.sum("chars_out") / F.greatest(F.sum("chars_in"), F.lit(1)), 6).alias("out_share"),
    )


@register(
    "usage_map_sums",
    """SELECT role, sum(length(text))::BIGINT AS in_, sum(CASE WHEN turn > 1 THEN turn ELSE 0 END)::BIGINT AS cached, round(sum(CASE WHEN turn > 1 THEN turn ELSE 0 END) / greatest(sum(length(text)), 1), 6) AS cached_share FROM conversations GROUP BY role""",
)
def usage_map_sums(spark, d):
    """Sums of map entries with 0 for missing keys."""
    usage = F.map_filter(F.create_map(F.lit("in"), F.length("text").cast("long"), F.lit("cached"), F.when(F.col("turn") > 1, F.col("turn"))), lambda k, v: v.isNotNull())
    u = table(spark, d, "conversations").select("role", usage.alias("u"))
    total = lambda k: F.sum(F.coalesce(F.try_element_at("u", F.lit(k)), F.lit(0)))
    return u.groupBy("role").agg(total("in").alias("in_"), total("cached").alias("cached"), F.round(total("cached") / F.greatest(total("in"), F.lit(1)), 6).alias("cached_share"))
