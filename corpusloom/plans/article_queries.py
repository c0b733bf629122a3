"""Articles: cleaning, filters, labels, samples, splits and chunks."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import rules, splits
from corpusloom.plans.catalog import register
from corpusloom.plans.common import HELD, ORDERED, SPLIT, TRAIN
from corpusloom.session import table

STOPS = ", ".join(f"'{s}'" for s in tx.STOP_SECTIONS)
TRIMMED = r"list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


def docs(spark, d):
    return table(spark, d, "documents")


@register(
    "clean_articles",
    rf"""WITH l AS (SELECT doc_id, {TRIMMED} AS ls FROM documents), s AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: x IN ({STOPS})), true) AS p FROM l)
SELECT doc_id, coalesce(array_to_string(list_filter(CASE WHEN p > 0 THEN ls[:p - 1] ELSE ls END, lambda x: x <> '' AND (length(x) >= {tx.LEAST_LINE} OR regexp_matches(x, '[.!?]$'))), chr(10) || chr(10)), '') AS text FROM s""",
)
def clean_articles(spark, d):
    return docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text"))


@register("non_ascii_ratio", r"SELECT doc_id, round(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def non_ascii_ratio(spark, d):
    return docs(spark, d).filter(F.length("text") > 0).select("doc_id", F.round(tx.non_ascii_ratio(F.col("text")), 6).alias("ratio"))


@register(
    "keep_article_filter",
    r"SELECT doc_id FROM documents WHERE length(text) BETWEEN 3000 AND 40000 AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text) < 0.03 AND NOT (source LIKE 'List of%')",
)
def keep_article_filter(spark, d):
    return docs(spark, d).filter(tx.keep_article(F.col("source"), F.col("text"))).select("doc_id")


@register("topic_counts", "SELECT lang AS topic, count(*) AS n FROM documents GROUP BY 1")
def topic_counts(spark, d):
    return docs(spark, d).groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@register(
    "topic_left_join_default",
    """SELECT doc_id, coalesce(l.topic, 'other') AS topic FROM documents LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'science' ELSE 'nature' END) AS topic FROM labels GROUP BY 1) l USING (doc_id)""",
)
def topic_left_join_default(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "science").otherwise("nature").alias("topic"))
    return splits.with_default(docs(spark, d).select("doc_id"), lab, "doc_id", "topic", "topic", "other")


@register(
    "drop_other",
    """SELECT doc_id FROM documents WHERE coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = documents.doc_id), 1) <> 1""",
)
def drop_other(spark, d):
    """A missing label counts as the one that goes."""
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    return splits.with_default(docs(spark, d).select("doc_id"), lab, "doc_id", "toxic", "toxic", 1).filter("toxic <> 1").select("doc_id")


@register("seeded_sample", f"SELECT doc_id FROM ({ORDERED}) ORDER BY o, doc_id LIMIT 60")
def seeded_sample(spark, d):
    return splits.seeded_sample(docs(spark, d).select("doc_id"), "doc_id", 60)


def split(spark, d):
    rows = docs(spark, d).select("doc_id", "text", F.octet_length("text").cast("long").alias("b"))
    return splits.budget_split(rows, "doc_id", "b", HELD, TRAIN)


@register("byte_budget_split", f"SELECT doc_id, before::BIGINT AS before, split FROM ({SPLIT})")
def byte_budget_split(spark, d):
    return split(spark, d).select("doc_id", "before", "split")


@register("split_totals", f"SELECT split, count(*) AS docs, sum(b)::BIGINT AS bytes FROM ({SPLIT}) GROUP BY split")
def split_totals(spark, d):
    return split(spark, d).groupBy("split").agg(F.count("*").alias("docs"), F.sum("b").alias("bytes"))


CHUNKS = """WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS par, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, i, 0 AS k, length(par) AS n FROM p WHERE i = 1 UNION ALL
 SELECT p.doc_id, p.i, CASE WHEN r.n + length(par) > 1000 THEN r.k + 1 ELSE r.k END, CASE WHEN r.n + length(par) > 1000 THEN length(par) ELSE r.n + length(par) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
c AS (SELECT doc_id, k, string_agg(par, chr(10) ORDER BY i) AS text FROM r JOIN p USING (doc_id, i) GROUP BY ALL)"""


def chunk_rows(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(tx.pack_chunks(F.col("text"), 1000, "\n")).alias("k", "text"))
    return rows.withColumn("chunk_id", tx.chunk_id(F.col("doc_id"), F.col("k")))


@register("chunk_pack", CHUNKS + " SELECT doc_id || '_' || k AS chunk_id, md5(text) AS text_md5, length(text) AS chars FROM c")
def chunk_pack(spark, d):
    return chunk_rows(spark, d).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars"))


@register(
    "chunk_counts_complete",
    CHUNKS
    + """, d AS (SELECT c.*, doc_id % 3 = 0 AS held FROM c), o AS (SELECT * FROM d WHERE NOT (k % 4 = 3))
SELECT doc_id, a.chunks, b.parts, a.chunks = b.parts AS complete, b.h AS text_md5 FROM (SELECT doc_id, count(*) AS chunks, bool_or(held) AS held FROM d GROUP BY 1) a
JOIN (SELECT doc_id, count(*) AS parts, md5(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS h FROM o GROUP BY 1) b USING (doc_id) WHERE NOT held OR a.chunks = b.parts""",
)
def chunk_counts_complete(spark, d):
    """Every fourth chunk of a document is missing here; held documents (every third) must be complete."""
    rows = chunk_rows(spark, d).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "held").otherwise("train"))
    out = rules.complete_documents(rows.select("doc_id", "k", "split"), rows.filter("k % 4 <> 3").select("doc_id", "k", "text"))
    return out.select("doc_id", "chunks", "parts", "complete", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("paragraph_explode", "SELECT doc_id, count(*) AS paragraphs, max(length(p)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1")
def paragraph_explode(spark, d):
    p = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("p")).cast("long").alias("longest"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@register("head_snippets", f"SELECT page_id, page_id || '. ' || {TITLE} || ' | ' || replace(substr(html, 1, 400), chr(10), ' ') AS line FROM pages")
def head_snippets(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", tx.head_snippet(F.col("page_id"), title, F.col("html")).alias("line"))


@register("english_probe", f"SELECT doc_id, substr(text, 1, 4000) AS head FROM ({ORDERED}) WHERE lang = 'en' ORDER BY o, doc_id LIMIT 60")
def english_probe(spark, d):
    top = splits.seeded_sample(docs(spark, d).filter("lang = 'en'"), "doc_id", 60)
    return top.select("doc_id", F.substring("text", 1, 4000).alias("head"))


@register("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark, d):
    return splits.remaining(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@register(
    "work_batches",
    f"SELECT doc_id, substr(o, 1, 2) || '-' || ((row_number() OVER (PARTITION BY substr(o, 1, 2) ORDER BY o, doc_id) - 1) // 3) AS batch FROM ({ORDERED})",
)
def work_batches(spark, d):
    return splits.batches(docs(spark, d).select("doc_id"), "doc_id", 3)


@register("article_meta", "SELECT doc_id || '_0' AS chunk_id, 'https://en.wikipedia.org/?curid=' || doc_id AS url, 0 AS k FROM documents")
def article_meta(spark, d):
    cid = tx.chunk_id(F.col("doc_id"), F.lit(0))
    return docs(spark, d).select(cid.alias("chunk_id"), tx.article_url(F.col("doc_id")).alias("url"), tx.chunk_number(cid).alias("k"))


@register("train_pilot", f"SELECT doc_id FROM ({SPLIT}) WHERE split = 'train' ORDER BY o, doc_id LIMIT 20")
def train_pilot(spark, d):
    """A seeded sample of the train split for looking at by eye."""
    return splits.seeded_sample(split(spark, d).filter("split = 'train'").select("doc_id"), "doc_id", 20)
