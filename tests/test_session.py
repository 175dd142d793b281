import pytest

from eventrates import session


def test_levels_of_each_keeps_types(spark):
    df = spark.createDataFrame([("b", 2), ("a", None), (None, 2), ("a", 1)], "s string, i int")
    assert session.levels_of_each(df, ["s", "i"]) == {"s": ["a", "b"], "i": [1, 2]}
    assert session.levels_of(df, "s") == ["a", "b"]


def test_too_many_levels_are_refused(spark):
    df = spark.range(30).selectExpr("cast(id as string) as s", "id % 2 as t")
    with pytest.raises(ValueError, match="explicitly"):
        session.levels_of_each(df, ["s", "t"], max_levels=20)


def test_broadcast_is_gated_by_size(spark):
    df = spark.range(1000)
    assert session.broadcast_if_small(df, 8, limit=8000)[1]
    assert not session.broadcast_if_small(df, 8, limit=7999)[1]
    assert session.broadcast_if_small(df.where("id < 0"), 8)[1]


def test_materialize_cuts_lineage(spark):
    stored = session.materialize(spark.range(10).selectExpr("id * 2 AS x"))
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()
    assert stored.agg({"x": "sum"}).first()[0] == 90


def test_settings_are_applied(spark):
    assert session.build_session().conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
