"""Repeated strings: rows told apart by their text, and marks that stream."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from test_llm_ops import brute_repeats, repeats_of

from corpusloom.llm import suffix_dedup


def test_null_ids_are_told_apart(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghijk ") for _ in range(n))
    shared = some(300)
    rows = [(None, some(rng.randint(0, 400)) + shared * (i % 3 == 0) + some(50)) for i in range(60)] + [(None, None), (None, ""), (None, some(500))]
    rows += [(7, some(400)), (7, shared), (7, some(100))] + [(None, rows[0][1])] * 3
    assert repeats_of(spark, rows) == brute_repeats(rows)


def test_marks_stream():
    """Whatever the batches, the same places: all of contexts that repeat, and one of each context of a gram with several."""
    rng = random.Random(3)
    for _ in range(60):
        rows = sorted((rng.randrange(6), rng.randrange(4), i, rng.random() < 0.1) for i in range(rng.randint(1, 40)))
        size, kinds = Counter(r[:2] for r in rows), {h: {c for g, c, *_ in rows if g == h} for h, *_ in rows}
        sure = sorted(i for h, c, i, s in rows if size[h, c] > 1 or s)
        one = Counter((h, c) for h, c in size if len(kinds[h]) > 1)
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randint(0, 12)))})
        batches = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            h, c, i, s = (list(x) for x in zip(*rows[a:z]))
            batches.append(pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "ctx": pa.array(c, pa.int64()), "doc_id": pa.array(i, pa.int64()), "row": pa.array(i, pa.int64()), "pos": pa.array(i, pa.int32()), "sure": s}))
        got = pa.Table.from_batches(list(suffix_dedup._marks(iter(batches)))).to_pylist()
        named = {i: (h, c) for h, c, i, _ in rows}
        assert sorted(r["doc_id"] for r in got if r["sure"]) == sure, (rows, cuts)
        assert Counter(named[r["doc_id"]] for r in got if not r["sure"]) == one, (rows, cuts)


def test_a_gram_with_very_many_contexts(spark):
    """A passage of 60 bytes that all texts have, among bytes of their own and some that a few of them share."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    common, after = some(60), [some(170) for _ in range(5)]
    rows = [(i, some(rng.randint(0, 200)) + common + (rng.choice(after)[: rng.randint(100, 170)] if i % 4 == 0 else some(190))) for i in range(400)]
    assert repeats_of(spark, rows) == brute_repeats(rows)
    assert np.array([r[2] for r in repeats_of(spark, rows)]).sum() > 0
