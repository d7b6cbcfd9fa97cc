"""Every query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import difference, oracle

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    sql = entry.oracle_sql().get(name)
    if sql:
        assert difference(got, oracle(sql, SF)) is None


def test_fuzzy_fallback_equals_brute_force(spark):
    import difflib

    from deckflow.plans import inputs
    from deckflow.operators import themes

    got = entry.queries()["theme_fuzzy_fallback"](spark, SF).toPandas()
    aliases = themes.alias_map(themes.alias_entries(inputs.resolutions(spark, SF))).toPandas()
    pools = {s: sorted(set(g.canonical)) for s, g in aliases.groupby("subject")}
    closest = got[got.how == "closest"]
    assert len(closest) > 0
    for r in closest.itertuples():
        assert r.canonical == difflib.get_close_matches(r.name, pools[r.subject], n=1, cutoff=0.0)[0]


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "lang"]
