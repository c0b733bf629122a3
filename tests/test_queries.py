import pytest

from corpusloom.plans import catalog

catalog.load()
from oracle import connect, same  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, con, name):
    same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_known_answers(spark):
    sf = "/root/testdata/sf0.01"
    assert catalog.QUERIES["keep_article_filter"](spark, sf).count() == 130
    split = {r["split"]: (r["docs"], r["bytes"]) for r in catalog.QUERIES["split_totals"](spark, sf).collect()}
    assert split == {"held": (63, 217888), "train": (430, 1002587), "dropped": (507, 1251983)}
