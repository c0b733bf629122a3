"""Rows, not ids, decide: null and repeated doc_ids with equal and different texts, against brute force."""

import hashlib
import random
from collections import Counter

from test_llm_ops import frame, low, odd

from corpusloom.llm import line_dedup


def brute_lines(rows, least=20, docs=3):
    """A document is all rows of an id, or all rows of a null id and one text; the keeper is the greatest id, of nulls any one."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    name = lambda d, t: (d, None) if d is not None else (None, t)
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(name(d, t))
    return key, name, {k: v for k, v in holders.items() if len(v) >= docs}


def digests(spark, rows):
    docs = line_dedup.with_bitmaps(odd(frame(spark, rows)))
    return Counter(tuple(r) for r in docs.mapInArrow(line_dedup._digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").collect())


def expected(rows):
    key, name, hot = brute_lines(rows)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in hot or name(d, t) == max(hot[key(x)], key=lambda n: -1 if n[0] is None else n[0])]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def test_rows_of_one_id_lose_their_own_lines(spark):
    common = "a line that very many documents have in common"
    rows = [(1, f"{common}\nshort"), (1, f"a line that occurs nowhere else at all\n{common}"), (2, common), (3, f"x\n{common}"), (3, "another row of the keeper\n" + common), (3, common)]
    assert digests(spark, rows) == expected(rows)


def test_many_ids_with_several_texts(spark):
    rng = random.Random(4)
    pool = [f"line number {i} that may be common" for i in range(12)]
    rows = [(rng.randrange(25), "\n".join(rng.choice([*pool, f"only here {rng.random()}"]) for _ in range(rng.randint(1, 6)))) for _ in range(120)]
    rows += rows[:10]
    assert digests(spark, rows) == expected(rows)


def test_null_ids_are_documents_of_their_own(spark):
    common = "a line that very many documents have in common"
    rows = [(None, f"{common}\nnull {i}\na line that only this text has, number {i}") for i in range(40)] + [(7, common)]
    got = digests(spark, rows)
    assert got == expected(rows)
    # without any id one of them keeps the line, and nobody loses another
    got = line_dedup.dedup_lines(frame(spark, rows[:40])).collect()
    assert sum(common in r["text"] for r in got) == 1 and all("only this text" in r["text"] for r in got)
    # equal rows are one document
    assert digests(spark, [(None, common)] * 5) == Counter({(None, 1, 0, hashlib.sha256(common.encode()).hexdigest()): 5})
