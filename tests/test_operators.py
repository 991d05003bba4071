import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.errors import EngineError
from marlstone.functions import aggregates as A
from marlstone.functions import predicates as P
from marlstone.operators import dml, join
from marlstone.operators.aggregate import aggregate, group
from marlstone.operators.select import limit, order, top
from marlstone.operators.ttl import live_rows, with_lifetime
from marlstone.plans import queries as plans

ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.sampled_from(["", "a", "b%", "b_", "ü"]))), max_size=12)
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


@quick
@given(rows=ROWS)
def test_filters_are_three_valued(spark, rows):
    df = frame(spark, rows)
    count = lambda c: df.where(c).count()
    known = [k for k, _ in rows if k is not None]
    assert count(P.compare("k", "!=", 1)) == sum(k != 1 for k in known)
    assert count(P.not_between("k", -1, 1)) == sum(not -1 <= k <= 1 for k in known)
    assert count(P.none_of("k", [0, 2])) == sum(k not in (0, 2) for k in known)
    assert count(P.is_null("k")) == len(rows) - len(known)
    assert count(P.like("v", "b%")) == sum(v is not None and v.startswith("b") for _, v in rows)
    assert count(P.like("v", "_")) == sum(v is not None and len(v) == 1 for _, v in rows)


@quick
@given(rows=ROWS)
def test_aggregates_ignore_null(spark, rows):
    got = aggregate(frame(spark, rows), n=A.count_rows(), c=A.count("k"), s=A.total("k"), a=A.mean("k"), lo=A.least("k"), hi=A.most("k")).first()
    known = [k for k, _ in rows if k is not None]
    assert tuple(got) == (len(rows), len(known), sum(known) if known else None, pytest.approx(sum(known) / len(known)) if known else None, min(known, default=None), max(known, default=None))


@quick
@given(rows=ROWS)
def test_order_puts_null_first_and_last(spark, rows):
    keys = [r.k for r in order(frame(spark, rows), "k").collect()]
    assert keys == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    keys = [r.k for r in order(frame(spark, rows), ("k", "DESC")).collect()]
    assert keys == sorted((k for k, _ in rows), key=lambda k: (k is None, -(k or 0)))


def test_like_with_special_characters(spark):
    df = spark.createDataFrame([("a\\b",), ("a~b",), ("ab",)], "v string")
    assert [r.v for r in df.where(P.like("v", "a\\%")).collect()] == ["a\\b"]
    assert [r.v for r in df.where(P.like("v", "a~_")).collect()] == ["a~b"]
    with pytest.raises(ValueError):
        P.one_of("v", [])


def test_limit(spark):
    df = spark.range(10)
    assert limit(df, 3).count() == 3 and limit(df, -1).count() == 10 and limit(df, 0).count() == 0
    assert [r.id for r in top(df, [("id", "DESC")], 2, 3).collect()] == [6, 5]


def test_group_and_having(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (None, "c"), (2, None)])
    assert sorted(map(tuple, group(df, ["k"], n=A.count("v")).collect()), key=str) == sorted([(1, 2), (None, 1), (2, 0)], key=str)
    assert [tuple(r) for r in group(df, ["k"], P.compare("n", ">", 1), n=A.count_rows()).collect()] == [(1, 2)]
    assert group(df, ["k"]).count() == 3


def test_joins(spark):
    a, b = frame(spark, [(1, "x"), (2, "y"), (None, "z")]), spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k long, w long")
    assert sorted(r.w for r in join.inner(a, b, "k", "k").collect()) == [10, 11]
    got = [(r.v, r.w) for r in join.left_outer(a, b, "k", "k", b["w"] > 10).collect()]
    assert sorted(got) == [("x", 11), ("y", None), ("z", None)] or sorted(got, key=str) == sorted([("x", 11), ("y", None), ("z", None)], key=str)
    assert join.qualified(a, "A").columns == ["A.k", "A.v"]
    assert join.equi_join(a, b, "k", "k", "left_anti").count() == 2
    with pytest.raises(ValueError):
        join.equi_join(a, b, "k", "k", "cross")


def test_dml(spark):
    df = frame(spark, [(1, "a"), (2, None), (None, "c")])
    assert [(r.k, r.v) for r in dml.update(df, {"v": "x"}, F.col("v") == "a").collect()] == [(1, "x"), (2, None), (None, "c")]
    assert [r.k for r in dml.delete(df, F.col("v") == "a").collect()] == [2, None]
    assert dml.delete(df).count() == 0 and dml.truncate(df).count() == 0
    with pytest.raises(EngineError, match="unknown column: z"):
        dml.update(df, {"z": 1})
    new = frame(spark, [(2, "n"), (3, "n"), (3, "m")])
    assert sorted(r.k for r in dml.duplicate_keys(df, new, "k").collect()) == [2, 3]
    assert [r.k for r in dml.new_keys_only(df, new, "k").collect()] == [3]
    assert [tuple(r) for r in dml.arrange(spark.createDataFrame([("7",)], "q string"), ["k"], df).collect()] == [(7, None)]


def test_expiry_is_at_its_second(spark):
    df = spark.createDataFrame([(1, 100), (2, 101), (3, 0), (4, None), (5, -1)], "id long, _expires_at long")
    assert [r.id for r in live_rows(df, now=100).collect()] == [2, 3, 4]


def test_lifetimes_are_exact(spark):
    """Against SQL's ts + INTERVAL 7 DAYS > now, on parts of a second, on the epoch and before it; a NULL has no end."""
    moments = ["2024-01-13 00:00:00", "2024-01-13 00:00:00.000001", "2024-01-12 23:59:59.999999", "1969-12-25 00:00:00", "1969-12-24 23:59:59.5", "1969-12-20 00:00:00.25", None]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp_ntz").alias("ts"))
    for now, text in ((1_705_708_800, "2024-01-20 00:00:00"), (1, "1970-01-01 00:00:01")):
        got = live_rows(with_lifetime(df, "ts", 7 * 86400), now=now).where("ts is not null").select("ts")
        expected = df.where(F.expr(f"ts + INTERVAL 7 DAYS > timestamp_ntz'{text}'"))
        assert sorted(got.collect()) == sorted(expected.collect())
    assert live_rows(with_lifetime(df, "ts", 7 * 86400), now=1_705_708_800).where("ts is null").count() == 1


def test_ttl_query_on_odd_moments(spark, tmp_path):
    import duckdb

    moments = ["2024-01-13 00:00:00", "2024-01-13 00:00:00.000001", "2024-01-13 00:00:00.9", "2024-01-12 23:59:59.999999", "1969-12-25 00:00:00", None]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame([(i, i, m) for i, m in enumerate(moments)], "event_id long, user_id long, m string").selectExpr("event_id", "user_id", "cast(m as timestamp_ntz) ts").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = plans.queries()["ttl_live_rows"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(plans.SQL["ttl_live_rows"]).fetchall()) == [(1, 1), (2, 2)]


def test_closed_form_counts(spark):
    df = spark.range(1, 1_000_001).select(F.concat(F.lit("user"), "id").alias("name"), F.element_at(F.array(*map(F.lit, "ENG HR SALES OPS LEGAL FIN MKT QA".split())), (F.col("id") % 8 + 1).cast("int")).alias("dept"), (30000 + F.col("id") % 70000).alias("salary"))
    got = df.agg(*[F.count_if(c) for c in (P.compare("salary", ">", 90000), P.between("salary", 50000, 60000), P.one_of("dept", ["ENG", "HR", "FIN"]), P.like("name", "user1%"))]).first()
    assert tuple(got) == (139_986, 140_015, 375_000, 111_112)
    assert group(df, ["dept"], n=A.count_rows()).count() == 8
