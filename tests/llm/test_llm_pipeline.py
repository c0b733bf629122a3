"""The pipeline on awkward tables: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import random
from collections import Counter

import pytest
from test_llm_models import some_language
from test_llm_ops import odd

import corpus_pipeline as p

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda k, n=40: some_language(rng, k, n)
    item, shared, twin = say(0, 30), "a line that is shared by many of these", say(1)
    docs = [(i, say(i % 3), f"l{i % 3}", "web", 5) for i in range(60)]
    docs += [
        (None, say(0), "l0", None, None), (None, say(1) + "\n" + shared, None, "x", 1), (None, f"{say(0)} {item} {say(0)}", "l0", "x", 1),
        (200, None, "l0", "x", 0), (201, "", "l1", "x", 0), (202, " \n\n", None, None, None), (203, "12 34 !!", "l2", "x", 1),
        (204, say(2, 60_000), "l2", "x", 1), (205, twin, "l1", "x", 1), (205, twin, "l1", "x", 1), (205, twin, "l1", "x", 1),
        (206, twin, "l1", "x", 1), (205, say(0), "l0", "x", 1), (207, say(1) + "\n" + shared, "l1", "x", 1), (208, shared + "\n" + say(1), "l1", "x", 1),
        (209, f"{say(0)} {item}", "l0", "x", 1), (209, say(0), "l0", "x", 1),
    ]
    top = str(tmp_path_factory.mktemp("pipeline"))
    odd(spark.createDataFrame(docs, DOCS)).coalesce(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, docs, item, shared, twin


def test_awkward_documents(spark, tables):
    top, docs, item, shared, twin = tables
    out = p.run(spark, top)
    names = spark.read.parquet(f"{top}/documents.parquet").columns
    assert out.columns == [*names, "n_tokens", "ids", "exact"]
    got = out.collect()
    assert all(r["exact"] and r["key"] == "x" and r["score"] == "x" and r["text"] for r in got)
    want = Counter()
    for d, t, *_ in docs:
        if d in (200, 201, 202, 203) or item in t or d == 206:
            continue
        # 208 is the largest id that has the shared line
        text = t if d == 208 else t.replace("\n" + shared, "")
        want[d, text] = 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert {r["n_chars"] for r in got if r["doc_id"] == 207} == {len(next(t for d, t, *_ in docs if d == 207)) - len(shared) - 1}


def test_empty_documents(spark, tables, tmp_path):
    top = tables[0]
    none = spark.read.parquet(f"{top}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{top}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for name, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert dict(p.STAGES)["decontaminate"](spark, docs, str(tmp_path)).count() == docs.count()


def test_run_does_not_depend_on_the_layout(spark, tables, tmp_path):
    top = tables[0]
    spark.read.parquet(f"{top}/documents.parquet").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{top}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda d: Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in p.run(spark, d).collect())
    assert rows(top) == rows(str(tmp_path))
