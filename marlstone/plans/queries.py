"""Queries over the driver's tables: each with the operators of this package, and as SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import predicates as P
from ..operators import dml as D
from ..operators import join as J
from ..operators.aggregate import aggregate, group
from ..operators.select import distinct, limit, order, project, scan, top, where
from ..operators.ttl import live_rows, with_lifetime

Tables = Callable[[str], DataFrame]
NOW = 1_705_708_800  # 2024-01-20 00:00:00 UTC


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def labelled(t: Tables, on: Column | None = None) -> DataFrame:
    """Documents with their quality label, or NULL."""
    found = J.left_outer(t("documents").select("doc_id"), t("labels").select(F.col("doc_id").alias("of"), "quality"), "doc_id", "of", on)
    return found.select("doc_id", "quality")


def rows(t: Tables, values: list[tuple], schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame(values, schema)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_all": lambda t: project(t("region")),
    "project_cols": lambda t: project(t("nation"), "n_name", "n_regionkey"),
    "project_alias": lambda t: project(t("customer"), ("c_name", "customer"), ("c_acctbal", "balance")),
    "filter_eq_num": lambda t: project(where(t("orders"), P.compare("o_orderkey", "=", 500)), "o_orderkey", "o_custkey"),
    "filter_eq_str": lambda t: project(where(t("customer"), P.compare("c_mktsegment", "=", "BUILDING")), "c_custkey", "c_name"),
    "filter_ne": lambda t: project(where(t("region"), P.compare("r_name", "!=", "ASIA")), "r_regionkey", "r_name"),
    "filter_gt": lambda t: project(where(t("customer"), P.compare("c_acctbal", ">", 9000)), "c_custkey", "c_acctbal"),
    "filter_ge": lambda t: project(where(t("part"), P.compare("p_size", ">=", 48)), "p_partkey", "p_size"),
    "filter_lt": lambda t: project(where(t("supplier"), P.compare("s_acctbal", "<", 0)), "s_suppkey", "s_acctbal"),
    "filter_le": lambda t: project(where(t("part"), P.compare("p_size", "<=", 2)), "p_partkey", "p_size"),
    "filter_ts_ge": lambda t: project(where(t("orders"), P.compare("o_orderdate", ">=", moment("2001-01-01 00:00:00"))), "o_orderkey", "o_orderdate"),
    "filter_between": lambda t: project(where(t("lineitem"), P.between("l_quantity", 10, 12)), "l_orderkey", "l_linenumber", "l_quantity"),
    "filter_not_between": lambda t: project(where(t("lineitem"), P.not_between("l_quantity", 3, 49)), "l_orderkey", "l_linenumber", "l_quantity"),
    "filter_in_num": lambda t: project(where(t("part"), P.one_of("p_size", [1, 15, 49])), "p_partkey", "p_name", "p_size"),
    "filter_in_str": lambda t: project(where(t("events"), P.one_of("event_type", ["click", "purchase"])), "event_id", "event_type"),
    "filter_not_in": lambda t: project(where(t("events"), P.none_of("event_type", ["click", "view", "error"])), "event_id", "event_type"),
    "filter_like_prefix": lambda t: project(where(t("customer"), P.like("c_name", "Customer#00000012%")), "c_custkey", "c_name"),
    "filter_like_suffix": lambda t: project(where(t("part"), P.like("p_name", "%ring")), "p_partkey", "p_name"),
    "filter_like_underscore": lambda t: project(where(t("nation"), P.like("n_name", "NATION__")), "n_nationkey", "n_name"),
    "filter_is_null": lambda t: project(where(labelled(t), P.is_null("quality")), "doc_id"),
    "filter_is_not_null": lambda t: project(where(labelled(t), P.is_not_null("quality")), "doc_id", "quality"),
    "pk_lookup_eq": lambda t: where(t("customer"), P.compare("c_custkey", "=", 42)),
    "pk_lookup_in": lambda t: where(t("customer"), P.one_of("c_custkey", [1, 10, 100, 1000])),
    "order_by_limit": lambda t: top(project(t("orders"), "o_orderkey", "o_totalprice"), [("o_totalprice", "DESC"), "o_orderkey"], 10),
    "order_by_multi": lambda t: order(project(t("customer"), "c_mktsegment", "c_nationkey", "c_custkey"), "c_mktsegment", ("c_nationkey", "DESC"), "c_custkey"),
    "limit_offset": lambda t: top(project(t("orders"), "o_orderkey"), [("o_orderkey", "DESC")], 100, 1000),
    "limit_no_order": lambda t: aggregate(limit(t("orders"), 17), n=A.count_rows()),
    "distinct_single": lambda t: distinct(t("customer"), "c_mktsegment"),
    "distinct_multi": lambda t: distinct(t("orders"), "o_orderstatus", "o_orderpriority"),
    "distinct_order_limit": lambda t: top(distinct(t("part"), "p_size"), [("p_size", "DESC")], 5, 2),
    "agg_count_star": lambda t: aggregate(t("lineitem"), n=A.count_rows()),
    "agg_count_where": lambda t: aggregate(where(t("lineitem"), P.compare("l_quantity", ">", 25)), n=A.count_rows()),
    "agg_count_col": lambda t: aggregate(t("lineitem"), n=A.count("l_shipdate")),
    "agg_sum": lambda t: aggregate(t("lineitem"), s=A.exact_total("l_extendedprice")),
    "agg_avg": lambda t: aggregate(t("lineitem"), a=A.exact_mean("l_quantity")),
    "agg_min": lambda t: aggregate(t("lineitem"), lo=A.least("l_extendedprice")),
    "agg_max": lambda t: aggregate(t("lineitem"), hi=A.most("l_shipdate")),
    "agg_minmax_str": lambda t: aggregate(t("customer"), lo=A.least("c_name"), hi=A.most("c_name")),
    "group_by_single": lambda t: group(t("lineitem"), ["l_returnflag"], n=A.count_rows(), s=A.exact_total("l_extendedprice")),
    "group_by_multi": lambda t: group(t("orders"), ["o_orderstatus", "o_orderpriority"], n=A.count_rows(), lo=A.least("o_totalprice"), hi=A.most("o_totalprice")),
    "group_by_where": lambda t: group(where(t("lineitem"), P.compare("l_discount", ">", 0.05)), ["l_linestatus"], n=A.count_rows()),
    "having_agg": lambda t: group(t("customer"), ["c_nationkey"], P.compare("n", ">", 60), n=A.count_rows()),
    "having_and_or": lambda t: group(t("part"), ["p_size"], P.any_of(P.all_of(P.compare("n", ">", 45), P.compare("hi", ">", 1000)), P.compare("n", "<", 30)), n=A.count_rows(), hi=A.most("p_retailprice")),
    "having_group_key": lambda t: group(t("events"), ["event_type"], P.compare("event_type", "=", "click"), n=A.count_rows()),
    "group_by_limit": lambda t: top(group(t("customer"), ["c_nationkey"], n=A.count_rows()), [("n", "DESC"), "c_nationkey"], 5),
    "join_inner": lambda t: project(J.inner(t("nation"), t("region"), "n_regionkey", "r_regionkey"), "n_name", "r_name"),
    "join_inner_where": lambda t: project(where(J.inner(t("orders"), t("customer"), "o_custkey", "c_custkey"), P.compare("o_totalprice", ">", 400000)), "o_orderkey", "c_name"),
    "join_inner_order": lambda t: top(project(J.inner(t("orders"), t("customer"), "o_custkey", "c_custkey"), "o_orderkey", "c_name", "o_totalprice"), [("o_totalprice", "DESC"), "o_orderkey"], 20),
    "join_left": lambda t: labelled(t),
    "join_left_where": lambda t: where(labelled(t), P.compare("quality", "=", 1)),
    "join_left_on_filter": lambda t: labelled(t, P.compare("quality", "=", 1)),
    "dml_insert_append": lambda t: D.insert(t("region"), rows(t, [(99, "ATLANTIS")], "r_regionkey int, r_name string")),
    "dml_insert_collist": lambda t: D.insert(t("region"), D.arrange(rows(t, [(98,)], "k int"), ["r_regionkey"], t("region"))),
    "dml_insert_pk_skip": lambda t: D.insert(project(t("region"), "r_regionkey"), D.new_keys_only(t("region"), rows(t, [(3,), (7,)], "r_regionkey int"), "r_regionkey")),
    "dml_update": lambda t: project(D.update(t("customer"), {"c_acctbal": 0.0}, P.compare("c_mktsegment", "=", "BUILDING")), "c_custkey", "c_acctbal"),
    "dml_update_multi": lambda t: project(D.update(t("supplier"), {"s_name": "X", "s_nationkey": 1}, P.compare("s_suppkey", "<=", 10)), "s_suppkey", "s_name", "s_nationkey"),
    "dml_delete": lambda t: project(D.delete(t("orders"), P.compare("o_orderstatus", "=", "F")), "o_orderkey"),
    "dml_truncate": lambda t: D.truncate(t("region")),
    "ttl_live_rows": lambda t: project(live_rows(with_lifetime(where(t("events"), P.is_not_null("ts")), "ts", 7 * 86400), now=NOW), "event_id", "user_id"),
}

#: The expected results as SQL; DuckDB runs it over the same tables.
SQL: dict[str, str] = {
    "scan_all": "SELECT * FROM region",
    "project_cols": "SELECT n_name, n_regionkey FROM nation",
    "project_alias": "SELECT c_name AS customer, c_acctbal AS balance FROM customer",
    "filter_eq_num": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 500",
    "filter_eq_str": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_ne": "SELECT r_regionkey, r_name FROM region WHERE r_name != 'ASIA'",
    "filter_gt": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000",
    "filter_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 48",
    "filter_lt": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0",
    "filter_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 2",
    "filter_ts_ge": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_not_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 49",
    "filter_in_num": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 15, 49)",
    "filter_in_str": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
    "filter_not_in": "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'error')",
    "filter_like_prefix": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000012%'",
    "filter_like_suffix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring'",
    "filter_like_underscore": "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION__'",
    "filter_is_null": "SELECT doc_id FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t WHERE quality IS NULL",
    "filter_is_not_null": "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t WHERE quality IS NOT NULL",
    "pk_lookup_eq": "SELECT * FROM customer WHERE c_custkey = 42",
    "pk_lookup_in": "SELECT * FROM customer WHERE c_custkey IN (1, 10, 100, 1000)",
    "order_by_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "order_by_multi": "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment ASC, c_nationkey DESC, c_custkey",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 100 OFFSET 1000",
    "limit_no_order": "SELECT COUNT(*) AS n FROM (SELECT * FROM orders LIMIT 17) t",
    "distinct_single": "SELECT DISTINCT c_mktsegment FROM customer",
    "distinct_multi": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_order_limit": "SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5 OFFSET 2",
    "agg_count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "agg_count_where": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 25",
    "agg_count_col": "SELECT COUNT(l_shipdate) AS n FROM lineitem",
    "agg_sum": "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem",
    "agg_avg": "SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity) AS a FROM lineitem",
    "agg_min": "SELECT MIN(l_extendedprice) AS lo FROM lineitem",
    "agg_max": "SELECT MAX(l_shipdate) AS hi FROM lineitem",
    "agg_minmax_str": "SELECT MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer",
    "group_by_single": "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag",
    "group_by_multi": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_by_where": "SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_linestatus",
    "having_agg": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 60",
    "having_and_or": "SELECT p_size, COUNT(*) AS n, MAX(p_retailprice) AS hi FROM part GROUP BY p_size HAVING COUNT(*) > 45 AND MAX(p_retailprice) > 1000 OR COUNT(*) < 30",
    "having_group_key": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type HAVING event_type = 'click'",
    "group_by_limit": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 5",
    "join_inner": "SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_inner_where": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 400000",
    "join_inner_order": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20",
    "join_left": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_left_where": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1",
    "join_left_on_filter": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1",
    "dml_insert_append": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'",
    "dml_insert_collist": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 98, CAST(NULL AS VARCHAR(10))",
    "dml_insert_pk_skip": "SELECT r_regionkey FROM region UNION ALL SELECT v FROM (SELECT 3 AS v UNION ALL SELECT 7) t WHERE v NOT IN (SELECT r_regionkey FROM region)",
    "dml_update": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "dml_update_multi": "SELECT s_suppkey, CASE WHEN s_suppkey <= 10 THEN 'X' ELSE s_name END AS s_name, CASE WHEN s_suppkey <= 10 THEN 1 ELSE s_nationkey END AS s_nationkey FROM supplier",
    "dml_delete": "SELECT o_orderkey FROM orders WHERE NOT COALESCE(o_orderstatus = 'F', FALSE)",
    "dml_truncate": "SELECT * FROM region WHERE FALSE",
    "ttl_live_rows": "SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20 00:00:00'",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(lambda name: scan(spark, f"{sf_dir}/{name}.parquet"))

        return run

    return {name: over(q) for name, q in QUERIES.items()}
