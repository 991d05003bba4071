"""Queries that go through a session: statements over tables of its own, which are loaded from the driver's; and the expected results as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..repl import run as shell
from ..server import Client, Server
from ..session import Session, connect
from ..streaming.ingest import append_stream

FUTURE = 9_999_999_999  # epoch seconds
CUSTOMER = "CREATE TABLE customer (c_custkey INT PRIMARY KEY, c_name VARCHAR(64) NOT NULL, c_nationkey INT, c_acctbal DECIMAL, c_mktsegment TEXT)"
ORDERS = "CREATE TABLE orders (o_orderkey INT PRIMARY KEY, o_custkey INT, o_orderstatus TEXT, o_totalprice DECIMAL, o_orderdate DATETIME, o_orderpriority TEXT)"
NATION = "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(32), n_regionkey INT)"
REGION = "CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(32))"
EVENTS = "CREATE TABLE events (event_id INT, user_id INT)"
MONEY = "CAST(c_acctbal AS DOUBLE) AS c_acctbal"


class Bench:
    """A session over an empty root folder, and the driver's tables to fill it from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        local = spark.sparkContext.master.startswith("local[")
        self.db: Session = connect(None if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/statements/{uuid.uuid4().hex}", spark)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def run(self, *statements: str) -> Bench:
        for s in statements:
            self.db.execute(s)
        return self

    def load(self, create: str, *columns: str) -> Bench:
        """A table as declared, with all rows of the driver's table of that name."""
        name = create.split()[2]
        self.run(create)
        rows = self.source(name)
        self.db.catalog.append(name, rows.selectExpr(*columns) if columns else rows)
        return self

    def insert(self, name: str, rows: list, at_once: int) -> Bench:
        """INSERT statements of so many rows."""
        literal = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
        for a in range(0, len(rows), at_once):
            self.run(f"INSERT INTO {name} VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows[a : a + at_once]))
        return self

    def select(self, sql: str) -> DataFrame:
        return self.db.execute(sql).df

    def error(self, sql: str) -> str:
        try:
            self.db.execute(sql)
        except EngineError as e:
            return str(e)
        return "ok"

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def small(self, name: str) -> list[tuple]:
        """The rows of region or nation, whose size doesn't grow."""
        return [tuple(r) for r in self.source(name).collect()]


def errors(b: Bench, statements: list[str]) -> DataFrame:
    return b.frame([(i, b.error(s)) for i, s in enumerate(statements)], "i long, said string")


def values(names: str, rows: list[tuple]) -> str:
    """SQL of constant rows."""
    literal = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


def pk_reject(b: Bench) -> DataFrame:
    """A key that is there, one twice in a statement, one behind fine rows: each statement fails as a whole; the last one is fine."""
    b.load(CUSTOMER)
    row = "({}, 'new', 1, 2.5, 'X')"
    said = [b.error("INSERT INTO customer VALUES " + ", ".join(row.format(k) for k in keys)) for keys in ((1,), (-5, -5), (-6, 7), (-7, -8))]
    return b.select("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 3").union(b.frame([(k - 100, s) for k, s in enumerate(said)], "k long, s string"))


def sweep(b: Bench) -> DataFrame:
    """What is on disk before and after the sweep of expired rows, and what a reader sees."""
    b.run(EVENTS)
    events = b.source("events").selectExpr("event_id", "user_id", f"IF(event_id % 2 = 0, {FUTURE}, 1) AS _expires_at")
    b.db.catalog.append("events", events)
    b.db.catalog.append("events", b.source("events").select("event_id", "user_id"))
    stored = lambda: b.db.catalog.store.read(b.db.catalog.version("EVENTS")).count()
    before = (stored(), b.db.table("events").count())
    b.db.catalog.sweep("EVENTS", 64)
    return b.frame([("stored before", before[0]), ("seen before", before[1]), ("stored after", stored()), ("seen after", b.db.table("events").count())], "what string, n long")


def compact(b: Bench) -> DataFrame:
    """Loads in three parts and deletes; then the live rows are one segment."""
    b.run(CUSTOMER)
    for k in range(3):
        b.db.catalog.append("customer", b.source("customer").where(f"c_custkey % 3 = {k}"))
    b.run("DELETE FROM customer WHERE c_nationkey = 3")
    b.db.catalog.compact("customer", age=0)
    n = len(b.db.catalog.version("CUSTOMER").segments)
    return b.select(f"SELECT c_custkey, c_name, {n} AS segments FROM customer")


def reopened(b: Bench) -> DataFrame:
    """Another session over the same folder sees all that was committed."""
    b.load(NATION).run("DELETE FROM nation WHERE n_regionkey = 0", "UPDATE nation SET n_name = 'X' WHERE n_nationkey = 24")
    return connect(b.db.catalog.store.root, b.spark).execute("SELECT n_nationkey, n_name, n_regionkey FROM nation").df


def cached(b: Bench) -> DataFrame:
    """A result is kept until the table changes."""
    b.load(REGION)
    ask = lambda: b.db.execute("SELECT COUNT(*) AS n FROM region").rows[0][0]
    out = [("first", ask(), b.db.cache.hits), ("again", ask(), b.db.cache.hits)]
    b.run("INSERT INTO region VALUES (77, 'NEW')")
    return b.frame([*out, ("changed", ask(), b.db.cache.hits), ("kept", ask(), b.db.cache.hits)], "asked string, n long, hits long")


def star_of_a_join(b: Bench) -> DataFrame:
    """The names that SELECT * of a join gives."""
    b.load(NATION).load(REGION)
    columns = b.db.execute("SELECT * FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey").columns
    return b.frame(list(enumerate(columns)), "i long, name string")


def callback(b: Bench) -> DataFrame:
    """Rows are delivered as text until the callback stops them."""
    b.load(NATION)
    seen: list[tuple] = []
    b.db.execute("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey", lambda row, names: seen.append((names[0], *row)) or len(seen) == 7)
    seen.append((",".join(b.db.last_columns), str(b.db.last_was_query).lower(), str(b.db.last.elapsed > 0).lower()))
    b.run("UPDATE nation SET n_name = 'X' WHERE n_nationkey < 3")
    seen.append((",".join(b.db.last_columns), str(b.db.last_was_query).lower(), str(b.db.last.rows[0][0])))
    return b.frame(seen, "name string, key string, value string")


def over_tcp(b: Bench) -> DataFrame:
    """Statements, rows and errors over a connection."""
    server = Server(b.db).start()
    client = Client(*server.server_address)
    try:
        client.execute(REGION)
        client.execute("INSERT INTO region VALUES (0, 'two\nlines'), (1, NULL), (2, 'ü')")
        rows = [tuple(r) for r in client.execute("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")]
        try:
            client.execute("SELECT * FROM nothing")
        except EngineError as e:
            rows.append(("error", str(e)))
        return b.frame([*rows, *[tuple(r) for r in client.execute("SELECT 'n' AS k, COUNT(*) AS n FROM region")]], "k string, v string")
    finally:
        client.close()
        server.shutdown()


def typed(b: Bench) -> DataFrame:
    """What the shell shows, but for the times."""
    out: list[str] = []
    lines = [REGION + ";", "INSERT INTO region VALUES", " (1, 'A'), (2, NULL);", "SELECT r_regionkey, r_name FROM region", "ORDER BY r_regionkey;", "SELECT 1 AS x FROM region WHERE r_regionkey > 9;", "NOPE;", ".tables", "TRUNCATE region;", ".exit", "SELECT 1;"]
    shell(b.db, lines, out.append)
    return b.frame([(i, text.split(" (")[0]) for i, text in enumerate("\n".join(out).split("\n"))], "i long, line string")


def streamed(b: Bench) -> DataFrame:
    """A stream of files into a table, twice: batches that were taken aren't taken again."""
    b.run(CUSTOMER)
    root = b.db.catalog.store.root
    b.source("customer").write.parquet(f"{root}-source")
    for _ in range(2):
        stream = b.db.spark.readStream.schema(b.source("customer").schema).parquet(f"{root}-source")
        append_stream(b.db, stream, "customer", f"{root}-progress", once=True).awaitTermination()
    return b.select(f"SELECT c_custkey, c_name, {MONEY} FROM customer")


def predicates(b: Bench) -> DataFrame:
    """How many rows meet each kind of condition."""
    b.load(CUSTOMER)
    parts = [f"SELECT {i} AS i, COUNT(*) AS n FROM customer WHERE {c}" for i, c in enumerate(CONDITIONS)]
    return b.select(" UNION ALL ".join(parts))


CONDITIONS = [
    "c_custkey = 7", "c_custkey != 7", "c_custkey <> 7", "c_acctbal < 100", "c_acctbal <= 100", "c_acctbal > 9000", "c_acctbal >= 9000", "c_acctbal BETWEEN 10 AND 500", "c_acctbal NOT BETWEEN 10 AND 500", "c_nationkey IN (1, 2, 3)", "c_nationkey NOT IN (1, 2, 3)",
    "c_mktsegment LIKE 'B%'", "c_mktsegment NOT LIKE '%E'", "c_name LIKE 'Customer#00000000_'", "c_name IS NULL", "c_name IS NOT NULL", "c_nationkey = 1 AND c_acctbal > 0", "c_nationkey = 1 OR c_nationkey = 2", "NOT c_nationkey = 1", "NOT (c_nationkey = 1 OR c_acctbal > 0)",
]
BAD = [
    "SELECT * FROM nothing", "SELECT nope FROM region", "SELECT r_name FROM region WHERE nope = 1", "INSERT INTO region VALUES (1, 'dup')", "INSERT INTO region VALUES (50)", "INSERT INTO region VALUES ('x', 'y')", "CREATE TABLE region (a INT)", "DROP TABLE nothing",
    "SELECT n_name FROM nation INNER JOIN region ON n_regionkey = nope", "SELECT COUNT(*) AS n FROM nation GROUP BY nope", "SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "ALTER TABLE region ADD COLUMN x INT", "ALTER TABLE region DROP COLUMN r_name", "ALTER TABLE region MODIFY COLUMN r_name TEXT", "ALTER TABLE nothing ADD COLUMN x INT",
    "UPDATE region SET nope = 1", "DELETE FROM nothing", "TRUNCATE nothing", "DESCRIBE nothing", "UPDATE region SET r_regionkey = 1 WHERE r_regionkey = 2", "INSERT INTO region (nope) VALUES (1)", "INSERT INTO region VALUES (NULL, 'x')",
]
SAID = [
    "no such table: NOTHING", "unknown column: NOPE", "unknown column: NOPE", "duplicate primary key: 1", "column count mismatch: expected 2 got 1", "invalid INT value for column R_REGIONKEY: x", "table already exists: REGION", "no such table: NOTHING",
    "join column not found", "GROUP BY: unknown column: NOPE", "SELECT column not in GROUP BY: N_NAME", "ALTER TABLE ADD COLUMN not yet supported", "ALTER TABLE DROP COLUMN not supported (schema is immutable after creation)", "ALTER TABLE MODIFY COLUMN not yet supported", "no such table: NOTHING",
    "unknown column: NOPE", "no such table: NOTHING", "no such table: NOTHING", "no such table: NOTHING", "duplicate primary key: 1", "unknown column: NOPE", "column R_REGIONKEY must not be null",
]
SCREEN = [
    "Query OK", "Query OK", "+-------------+--------+", "| r_regionkey | r_name |", "+-------------+--------+", "| 1           | A      |", "| 2           | NULL   |", "+-------------+--------+", "2 rows in set", "Empty set", "ERROR: parse error: unknown statement starting with 'NOPE'",
    "+--------+", "| Tables |", "+--------+", "| REGION |", "+--------+", "1 row in set", "Query OK",
]
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CAST(o_orderdate AS TIMESTAMP) AS o_orderdate", "o_orderpriority")

#: Each query, and its SQL.
QUERIES: dict[str, tuple[Callable[[Bench], DataFrame], str]] = {
    "sql_create_insert": (lambda b: b.run(NATION).insert("nation", b.small("nation"), 1000).select("SELECT n_nationkey, n_name, n_regionkey FROM nation"), "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "sql_insert_rows": (lambda b: b.run(REGION).insert("region", b.small("region"), 1).select("SELECT r_regionkey, r_name FROM region"), "SELECT r_regionkey, r_name FROM region"),
    "sql_insert_columns": (lambda b: b.load(REGION).run("INSERT INTO region (r_name, r_regionkey) VALUES ('ATLANTIS', 90), (NULL, 91)", "INSERT INTO region (r_regionkey) VALUES (92)").select("SELECT r_regionkey, r_name FROM region"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'ATLANTIS'), (91, NULL), (92, NULL)) t"),
    "sql_bulk_load": (lambda b: b.load(CUSTOMER).select(f"SELECT c_custkey, c_name, c_nationkey, {MONEY}, c_mktsegment FROM customer"), "SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(28,10)) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"),
    "sql_pk_reject": (pk_reject, "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 3 UNION ALL SELECT * FROM (VALUES (-7, 'new'), (-8, 'new'), (-100, 'duplicate primary key: 1'), (-99, 'duplicate primary key: -5'), (-98, 'duplicate primary key: 7'), (-97, 'ok')) t"),
    "sql_update": (lambda b: b.load(CUSTOMER).run("UPDATE customer SET c_acctbal = 0, c_name = 'B' WHERE c_mktsegment = 'BUILDING'").select(f"SELECT c_custkey, c_name, {MONEY} FROM customer"), "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_name END AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "sql_update_count": (lambda b: b.load(CUSTOMER).frame([(b.db.execute("UPDATE customer SET c_nationkey = c_nationkey + 1 WHERE c_nationkey = 5").rows[0][0], b.db.execute("UPDATE customer SET c_nationkey = 0 WHERE c_nationkey = 6").rows[0][0])], "first long, second long"), "SELECT COUNT(*) FILTER (WHERE c_nationkey = 5) AS first, COUNT(*) FILTER (WHERE c_nationkey IN (5, 6)) AS second FROM customer"),
    "sql_delete": (lambda b: b.load(ORDERS, *ORDER_COLUMNS).run("DELETE FROM orders WHERE o_orderstatus = 'F'").select("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP_NTZ) AS o_orderdate FROM orders"), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus != 'F'"),
    "sql_delete_all": (lambda b: b.load(NATION).run("DELETE FROM nation", "INSERT INTO nation VALUES (3, 'BACK', 1)").select("SELECT n_nationkey, n_name FROM nation"), "SELECT 3 AS n_nationkey, 'BACK' AS n_name"),
    "sql_truncate": (lambda b: b.load(ORDERS, *ORDER_COLUMNS).run("TRUNCATE TABLE orders", "INSERT INTO orders VALUES (1, 2, 'O', 10.5, '2024-01-02 03:04:05', 'x')").select("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders"), "SELECT 1 AS o_orderkey, 10.5::DOUBLE AS p"),
    "sql_drop": (lambda b: b.load(REGION).run("DROP TABLE region", "DROP TABLE IF EXISTS region", "CREATE TABLE IF NOT EXISTS region (a INT)", "INSERT INTO region VALUES (5)").select("SELECT a FROM region"), "SELECT 5 AS a"),
    "sql_errors": (lambda b: errors(b.load(REGION).load(NATION), BAD), values("i, said", list(enumerate(SAID)))),
    "sql_show_tables": (lambda b: b.run(REGION, NATION, EVENTS, "DROP TABLE nation").frame(b.db.execute("SHOW TABLES").rows, "`Tables` string"), values('"Tables"', [("EVENTS",), ("REGION",)])),
    "sql_show_databases": (lambda b: b.frame(b.db.execute("SHOW DATABASES").rows, "`Database` string"), values('"Database"', [("default",)])),
    "sql_describe": (lambda b: b.run(CUSTOMER).frame(b.db.execute("DESCRIBE customer").rows, "Field string, Type string, `Key` string, `Null` string"), values('"Field", "Type", "Key", "Null"', [("C_CUSTKEY", "INT", "PRI", "NO"), ("C_NAME", "VARCHAR", "-", "NO"), ("C_NATIONKEY", "INT", "-", "YES"), ("C_ACCTBAL", "DECIMAL", "-", "YES"), ("C_MKTSEGMENT", "TEXT", "-", "YES")])),
    "sql_databases": (lambda b: b.load(REGION).run("CREATE DATABASE x", "USE x", "DROP DATABASE x").select("SELECT COUNT(*) AS n FROM region"), "SELECT COUNT(*) AS n FROM region"),
    "sql_ttl": (lambda b: b.run(REGION, f"INSERT INTO region VALUES (1, 'gone', 1), (2, 'stays', {FUTURE}), (3, 'never', 0), (4, 'gone', -1), (5, 'plain')", "INSERT INTO region VALUES (1, 'again')").select("SELECT r_regionkey, r_name FROM region"), values("r_regionkey, r_name", [(2, "stays"), (3, "never"), (5, "plain"), (1, "again")])),
    "sql_sweep": (sweep, "SELECT * FROM (SELECT 'stored before' AS what, 2 * COUNT(*) AS n FROM events UNION ALL SELECT 'seen before', COUNT(*) + COUNT(*) FILTER (WHERE event_id % 2 = 0) FROM events UNION ALL SELECT 'stored after', COUNT(*) + COUNT(*) FILTER (WHERE event_id % 2 = 0) FROM events UNION ALL SELECT 'seen after', COUNT(*) + COUNT(*) FILTER (WHERE event_id % 2 = 0) FROM events) t"),
    "sql_compact": (compact, "SELECT c_custkey, c_name, 1 AS segments FROM customer WHERE c_nationkey != 3"),
    "sql_reopen": (reopened, "SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey != 0"),
    "sql_key_eq": (lambda b: b.load(CUSTOMER).select("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42"),
    "sql_key_in": (lambda b: b.load(CUSTOMER).select("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 10, 100, 100000000)"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 10, 100, 100000000)"),
    "sql_cache": (cached, "SELECT * FROM (SELECT 'first' AS asked, COUNT(*) AS n, 0 AS hits FROM region UNION ALL SELECT 'again', COUNT(*), 1 FROM region UNION ALL SELECT 'changed', COUNT(*) + 1, 1 FROM region UNION ALL SELECT 'kept', COUNT(*) + 1, 2 FROM region) t"),
    "sql_predicates": (predicates, " UNION ALL ".join(f"SELECT {i} AS i, COUNT(*) AS n FROM customer WHERE {c}" for i, c in enumerate(CONDITIONS))),
    "sql_join": (lambda b: b.load(NATION).load(REGION).select("SELECT nation.n_name, region.r_name FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey WHERE n_nationkey > 3"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3"),
    "sql_left_join": (lambda b: b.load(NATION).load(REGION).run("DELETE FROM region WHERE r_regionkey = 1").select("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"), "SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey != 1) r ON n_regionkey = r_regionkey"),
    "sql_join_star": (star_of_a_join, values("i, name", list(enumerate(["NATION.N_NATIONKEY", "NATION.N_NAME", "NATION.N_REGIONKEY", "REGION.R_REGIONKEY", "REGION.R_NAME"])))),
    "sql_group": (lambda b: b.load(CUSTOMER).select("SELECT c_nationkey, COUNT(*) AS n, COUNT(c_acctbal) AS k, CAST(SUM(c_acctbal) AS DOUBLE) AS s, CAST(MIN(c_acctbal) AS DOUBLE) AS lo, CAST(MAX(c_acctbal) AS DOUBLE) AS hi FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 50 AND MAX(c_acctbal) > 0 ORDER BY n DESC, c_nationkey LIMIT 10"), "SELECT c_nationkey, COUNT(*) AS n, COUNT(c_acctbal) AS k, CAST(SUM(CAST(c_acctbal AS DECIMAL(28,10))) AS DOUBLE) AS s, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 50 AND MAX(c_acctbal) > 0 ORDER BY n DESC, c_nationkey LIMIT 10"),
    "sql_order": (lambda b: b.load(CUSTOMER).select("SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey DESC LIMIT 5 OFFSET 2"), "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey DESC LIMIT 5 OFFSET 2"),
    "sql_callback": (callback, "SELECT 'n_nationkey' AS name, CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_nationkey < 7 UNION ALL SELECT * FROM (VALUES ('n_nationkey,n_name', 'true', 'true'), ('rows_updated', 'false', '3')) t"),
    "sql_server": (over_tcp, "SELECT * FROM (VALUES ('0', 'two\nlines'), ('1', NULL), ('2', 'ü'), ('error', 'no such table: NOTHING'), ('n', '3')) AS t(k, v)"),
    "sql_shell": (typed, values("i, line", list(enumerate(SCREEN)))),
    "sql_stream": (streamed, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, query=query: query(Bench(spark, sf_dir)) for name, (query, _) in QUERIES.items()}


SQL = {name: sql for name, (_, sql) in QUERIES.items()}
