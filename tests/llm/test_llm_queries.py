"""The registered queries with their SQL, and the pipeline against its stages' brute force."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, same  # noqa: E402

from corpusloom.llm import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, con, name):
    same(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_pipeline(spark, sf):
    """Stage by stage: what goes, by plain Python."""
    from test_llm_ops import brute_lines, brute_near

    import corpus_pipeline as p
    import public_tokenizers
    import tiktoken

    from corpusloom.llm import bpe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    assert [k for k, _ in p.STAGES] == ["language", "lines", "near_duplicates", "decontaminate", "encode"]
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    one = stages["language"](spark, docs, sf).cache()
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    two = stages["lines"](spark, one, sf).cache()
    want = {(d, n) for d, n, _, _ in brute_lines(rows(one))}
    gone = {d: g for d, _, g, _ in brute_lines(rows(one))}
    assert {(d, len(t.split("\n")) + gone[d]) for d, t in rows(two) if t or not gone[d]} <= want
    three = stages["near_duplicates"](spark, two, sf).cache()
    assert {d for d, _ in rows(three)} == {d for d, _, _, kept in brute_near(rows(two), 5, 80) if kept}
    four = stages["decontaminate"](spark, three, sf).cache()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {d for d, t in rows(three) if any(i in t for i in items)}
    left = {d for d, _ in rows(four)}
    assert not held & left and len(rows(three)) - len(left) <= len(held) + 2
    five = stages["encode"](spark, four, sf).collect()
    ranks = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    assert all(list(r["ids"]) == lib.encode_ordinary(r["text"]) and r["exact"] for r in five)
    assert {r["doc_id"] for r in p.run(spark, sf).collect()} == left
