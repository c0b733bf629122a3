"""Decontamination: against an edit search of every text for every item, in text with and without spaces, over several blocks of items."""

import random

import numpy as np
import pytest
from test_llm_ops import EDGES, frame, leaks

from corpusloom.llm import decontaminate

ITEM = "item_id long, text string"


def changed(b, rate, rng):
    """Substituted, inserted and deleted bytes."""
    b = bytearray(b)
    for _ in range(int(len(b) * rate)):
        at, c = rng.randrange(len(b)), rng.choice(b"etaoinshrdlu qxz")
        match rng.randrange(3):
            case 0:
                b[at] = c
            case 1:
                b.insert(at, c)
            case 2:
                del b[at]
    return bytes(b)


def say(rng, n, spaced=True):
    return "".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) + " " * spaced for _ in range(n))[:n].strip().ljust(n, "x")


def brute(docs, items):
    """(doc, item) to the fewest edits, where there are few enough."""
    held = decontaminate.Items(items)
    out = {}
    for d, t in docs:
        plain = decontaminate.PLAIN[np.frombuffer((t or "").encode(), np.uint8)].tobytes()
        for k, b in enumerate(held.bytes):
            if b and (e := decontaminate.edit_distance(b, plain, held.most[k])) is not None:
                out[d, held.ids[k]] = min(e, out.get((d, held.ids[k]), e))
    return out


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    items = [(i, say(rng, rng.choice((12, 24, 39, 60, 110, 240)), i % 4 > 0)) for i in range(24)] + [(90, None), (91, " "), (92, "qzqz"), (3, "a second item of the same number, long enough")]
    docs = []
    for i in range(150):
        k, item = items[i % 24]
        rate = rng.choice((0, 0.04, 0.08, 0.1, 0.15, 0.18, 0.2, 0.24))
        docs.append((i, (say(rng, 90, i % 3 > 0) + changed(item.encode(), rate, rng).decode() + say(rng, 70, i % 3 > 0)).upper()))
    docs += [(500, "xx qzqz xx"), (501, items[-1][1]), (501, items[5][1]), *[(d, t) for d, t in EDGES if d is not None and d > 5]]
    want = brute(docs, items)
    got = leaks(spark, docs, items)
    assert set(got) <= set(want) and len(want) > 90
    assert len(got) >= 0.95 * len(want)
    assert {p for p, e in want.items() if e == 0} <= set(got)
    assert all(want[p] <= e for p, e in got.items()) and sum(want[p] == got[p] for p in got) >= 0.95 * len(got)


def test_exact_copies_in_text_without_spaces(spark):
    rng = random.Random(8)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60))
    around = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300))
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(80))
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(5000))
    spaced = say(rng, 200)
    items = [(1, han), (2, run), (3, spaced)]
    docs = [(1, around + han + around), (2, letters + run + letters), (3, letters + spaced + letters), (4, around + letters)]
    got = leaks(spark, docs, items)
    assert got == {(1, 1): 0, (2, 2): 0, (3, 3): 0}


@pytest.mark.parametrize("size", [56, 75, 120, 250])
@pytest.mark.parametrize("spaced", [True, False])
def test_recall_at_the_most_edits(size, spaced):
    rng = random.Random(size)
    items = [(i, say(rng, size, spaced)) for i in range(100)]
    for some in (items, items[:1], items[1:2], items[2:3]):
        search = decontaminate.Search(decontaminate.Items(some))
        rows = [b"some words " + changed(some[i % len(some)][1].encode(), 0.2, rng) + b" and more" for i in range(200)]
        off = np.r_[0, np.cumsum([len(r) for r in rows])]
        hits = {(r, k) for r, k, _, _ in search.hits(np.frombuffer(b"".join(rows), np.uint8), off)}
        assert sum((i, i % len(some)) in hits for i in range(200)) >= 180


@pytest.mark.parametrize("size", [10, 11, 17, 24, 33, 39, 40, 48, 55])
def test_short_items_are_never_missed(size):
    rng = random.Random(size)
    items = [(i, say(rng, size)) for i in range(30)]
    search = decontaminate.Search(decontaminate.Items(items))
    rows = [b"pre " + changed(items[i % 30][1].encode(), 0.1, rng) + b" post" for i in range(300)]
    off = np.r_[0, np.cumsum([len(r) for r in rows])]
    hits = {(r, k) for r, k, _, _ in search.hits(np.frombuffer(b"".join(rows), np.uint8), off)}
    assert all((i, i % 30) in hits for i in range(300))


def test_several_blocks_of_items(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(decontaminate, "blocks", lambda benchmark, f=decontaminate.blocks: f(benchmark, 300))
    items = [(i, say(rng, 100)) for i in range(7)] + [(None, say(rng, 90))]
    docs = [(i, f"text {items[i % 8][1]} number {i}") for i in range(16)] + [(None, items[0][1]), (None, "clean"), (50, None), (51, "clean too")]
    want = {(i, items[i % 8][0]) for i in range(16)} | {(None, 0)}
    assert set(leaks(spark, docs, items)) == want
    clean = decontaminate.without_leaks(frame(spark, docs), frame(spark, items, ITEM)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in clean if r["text"]) == [(0, "clean"), (51, "clean too")] and len(clean) == 3
    assert decontaminate.without_leaks(frame(spark, docs), frame(spark, [], ITEM)).count() == len(docs)
