"""Every registered query runs; those with SQL give what DuckDB gives."""

import pytest

from compare import TABLES, assert_same, database
from framelens.plans import registry


@pytest.fixture(scope="module")
def con():
    return database(TABLES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, TABLES), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, TABLES)
    assert len(df.collect()) >= 0
    assert df.columns


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


@pytest.mark.parametrize("name", ["rank_then_verify", "reflection_tracks"])
def test_takes_all_frames(spark, name):
    """Identifications of frames of every remainder are used, not those of a subset."""
    from pyspark.sql import functions as F
    from framelens.plans.views import view

    got = registry.QUERIES[name](spark, TABLES)
    if name == "rank_then_verify":
        assert {r[0] for r in got.select(F.col("frame") % 4).distinct().collect()} == {0, 1, 2, 3}
    else:
        seen = view(spark, TABLES, "v_identify").filter("frame % 3 <> 0").select("frame", "phase", F.round("pressure", 0).alias("own"))
        known = view(spark, TABLES, "v_frames").select("frame")
        both = got.join(seen.join(known, "frame"), ["frame", "phase"])
        assert both.count() > 0 and both.filter("NOT pressure <=> own").count() == 0
        assert {r[0] for r in got.filter("pressure IS NOT NULL").select(F.col("frame") % 3).distinct().collect()} == {0, 1, 2}
