import threading
import time

import pytest

from marlstone import server as server_module
from marlstone import statements
from marlstone.errors import EngineError, ParseError
from marlstone.repl import run
from marlstone.server import Client, Server
from marlstone.session import connect
from marlstone.streaming.ingest import append_stream
from marlstone.sweeper import Sweeper


@pytest.fixture
def db(spark, tmp_path):
    with connect(f"file://{tmp_path}/db", spark) as session:
        yield session


def rows(db, sql):
    return [tuple(r) for r in db.execute(sql).rows]


def fails(db, sql, text):
    with pytest.raises(EngineError) as e:
        db.execute(sql)
    assert text in str(e.value)


def test_employees(db):
    db.execute("CREATE TABLE emp (id INT PRIMARY KEY, name VARCHAR(64), salary DECIMAL)")
    db.execute("INSERT INTO emp VALUES (1,'Alice',50000),(2,'Bob',60000),(3,'Carol',70000)")
    assert rows(db, "SELECT name FROM emp WHERE salary > 55000 ORDER BY name") == [("Bob",), ("Carol",)]
    assert rows(db, "SHOW TABLES") == [("EMP",)]
    assert rows(db, "DESCRIBE emp") == [("ID", "INT", "PRI", "NO"), ("NAME", "VARCHAR", "-", "YES"), ("SALARY", "DECIMAL", "-", "YES")]
    assert rows(db, "SHOW DATABASES") == [("default",)]
    result = db.execute("SELECT COUNT(*), AVG(salary) FROM emp")
    assert result.columns == ["COUNT(*)", "AVG(SALARY)"] and float(result.rows[0][1]) == 60000
    assert db.last_was_query and db.last_columns == ["COUNT(*)", "AVG(SALARY)"]
    fails(db, "CREATE TABLE emp (a INT)", "table already exists: EMP")
    db.execute("CREATE TABLE IF NOT EXISTS emp (a INT)")
    db.execute("DROP TABLE emp")
    fails(db, "SELECT * FROM emp", "no such table: EMP")
    fails(db, "DROP TABLE emp", "no such table: EMP")
    db.execute("DROP TABLE IF EXISTS emp")


def test_key_and_null_checks_leave_no_trace(db):
    db.execute("CREATE TABLE pkt (id INT PRIMARY KEY, v TEXT NOT NULL)")
    db.execute("INSERT INTO pkt VALUES (1,'a')")
    fails(db, "INSERT INTO pkt VALUES (2,'x'),(1,'b')", "duplicate primary key: 1")
    fails(db, "INSERT INTO pkt VALUES (7,'x'),(07,'b')", "duplicate primary key: 7")
    fails(db, "INSERT INTO pkt VALUES (8,NULL)", "must not be null")
    fails(db, "INSERT INTO pkt (v) VALUES ('q')", "must not be null")
    fails(db, "INSERT INTO pkt VALUES (9,'x'),('z','b')", "invalid INT value for column ID: z")
    fails(db, "INSERT INTO pkt VALUES (9,'x'),(10)", "column count mismatch: expected 2 got 1")
    fails(db, "INSERT INTO pkt (id, nope) VALUES (9,'x')", "unknown column: NOPE")
    assert rows(db, "SELECT * FROM pkt") == [(1, "a")]
    db.execute("DELETE FROM pkt WHERE id = 1")
    db.execute("INSERT INTO pkt VALUES (1,'again')")
    assert rows(db, "SELECT v FROM pkt") == [("again",)]


def test_types_and_null(db):
    db.execute("CREATE TABLE ty (i INT, d DECIMAL, t TEXT, w DATETIME)")
    db.execute("INSERT INTO ty VALUES (1, 10.5, '', '2024-01-02 03:04:05'), (2, -0.5, NULL, 1704164645), (NULL, NULL, 'ü', NULL)")
    assert rows(db, "SELECT i FROM ty WHERE d > 10") == [(1,)]
    assert rows(db, "SELECT COUNT(*) AS n FROM ty WHERE t IS NULL") == [(1,)]
    assert rows(db, "SELECT COUNT(DISTINCT w) AS n, COUNT(i) AS k, SUM(i) AS s FROM ty") == [(1, 2, 3)]
    assert rows(db, "SELECT COUNT(*) AS n FROM ty WHERE t != 'x'") == [(2,)]
    assert rows(db, "SELECT SUM(i) AS s, COUNT(i) AS n FROM ty WHERE i > 99") == [(None, 0)]
    for bad in ("('x',1,'',NULL)", "(1,'1.2.3','',NULL)", "(1,1,'','yesterday')"):
        fails(db, f"INSERT INTO ty VALUES {bad}", "invalid ")


def test_update_delete_truncate(db):
    db.execute("CREATE TABLE du (id INT PRIMARY KEY, v TEXT, n DECIMAL)")
    db.execute("INSERT INTO du VALUES (1,'a',1),(2,'b',2)")
    db.execute("INSERT INTO du VALUES (3,'c',3)")
    assert rows(db, "UPDATE du SET v = 'new', n = n + 1 WHERE id = 1") == [(1,)]
    assert rows(db, "SELECT v, CAST(n AS INT) AS n FROM du ORDER BY id") == [("new", 2), ("b", 2), ("c", 3)]
    fails(db, "UPDATE du SET id = 3 WHERE id = 1", "duplicate primary key: 3")
    fails(db, "UPDATE du SET id = 5", "duplicate primary key: 5")
    fails(db, "UPDATE du SET q = 5", "unknown column: Q")
    assert rows(db, "UPDATE du SET v = 'x' WHERE id = 99") == [(0,)]
    assert rows(db, "UPDATE du SET id = 30 WHERE id = 3") == [(1,)]
    db.execute("DELETE FROM du WHERE id = 2")
    assert rows(db, "SELECT id FROM du ORDER BY id") == [(1,), (30,)]
    fails(db, "DELETE FROM nope", "no such table: NOPE")
    fails(db, "DELETE FROM du WHERE nope = 1", "unknown column")
    db.execute("TRUNCATE du")
    assert rows(db, "SELECT COUNT(*) AS n FROM du") == [(0,)]
    db.execute("INSERT INTO du VALUES (1,'back',0)")
    db.execute("DELETE FROM du")
    assert rows(db, "SELECT * FROM du") == []


def test_joins(db):
    db.execute("CREATE TABLE lj_a (id INT PRIMARY KEY, name VARCHAR(64))")
    db.execute("INSERT INTO lj_a VALUES (1,'Alice'),(2,'Bob'),(3,'Carol')")
    db.execute("CREATE TABLE lj_b (id INT PRIMARY KEY, aid INT, val VARCHAR(64))")
    db.execute("INSERT INTO lj_b VALUES (10,1,'x'),(11,3,'y')")
    result = db.execute("SELECT * FROM lj_a LEFT JOIN lj_b ON lj_a.id = lj_b.aid ORDER BY lj_a.id")
    assert result.columns == ["LJ_A.ID", "LJ_A.NAME", "LJ_B.ID", "LJ_B.AID", "LJ_B.VAL"]
    assert result.rows == [(1, "Alice", 10, 1, "x"), (2, "Bob", None, None, None), (3, "Carol", 11, 3, "y")]
    assert rows(db, "SELECT name, val FROM lj_a INNER JOIN lj_b ON lj_a.id = lj_b.aid WHERE val = 'y'") == [("Carol", "y")]


def test_ttl_and_compact(db):
    soon = int(time.time()) + 10_000
    db.execute("CREATE TABLE ttl (id INT PRIMARY KEY)")
    db.execute(f"INSERT INTO ttl VALUES (1, 1), (2, {soon}), (3, 0), (4, -1), (5)")
    assert rows(db, "SELECT id FROM ttl ORDER BY id") == [(2,), (3,), (5,)]
    assert db.catalog.table("TTL", now=soon).count() == 2  # gone at that second
    db.execute("INSERT INTO ttl VALUES (1)")  # an expired key is free
    assert rows(db, "UPDATE ttl SET id = id + 10 WHERE id < 4") == [(3,)]
    db.catalog.compact("ttl", age=0)
    assert rows(db, "SELECT id FROM ttl ORDER BY id") == [(5,), (11,), (12,), (13,)]
    assert len(db.catalog.version("TTL").segments) == 1
    assert len(db.catalog.store.files.list(db.catalog.store.folder("TTL") + "/data")) == 1


def test_cache_follows_versions(db):
    db.execute("CREATE TABLE c (id INT)")
    db.execute("INSERT INTO c VALUES (1),(2),(3)")
    assert rows(db, "SELECT COUNT(*) AS n FROM c WHERE id IN (1)") == [(1,)]
    assert rows(db, "SELECT COUNT(*) AS n FROM c WHERE id IN (1, 2)") == [(2,)]
    rows(db, "SELECT COUNT(*) AS n FROM c WHERE id IN (1)")
    assert db.cache.hits == 1
    db.execute("INSERT INTO c VALUES (1)")
    assert rows(db, "SELECT COUNT(*) AS n FROM c WHERE id IN (1)") == [(2,)]
    db.execute("INSERT INTO c VALUES (1, 9999999999)")
    assert rows(db, "SELECT COUNT(*) AS n FROM c WHERE id IN (1)") == [(3,)]
    rows(db, "SELECT COUNT(*) AS n FROM c WHERE id IN (1)")
    assert db.cache.hits == 1  # rows that expire are never served from it


def test_literals_are_plain(db):
    db.execute("CREATE TABLE lit (t TEXT, `key` TEXT)")
    db.execute(r"INSERT INTO lit VALUES ('a\b', '%'), ('a''b', '_'), ('''; DROP TABLE lit; --', 'x')")
    assert rows(db, r"SELECT `key` FROM lit WHERE t = 'a\b'") == [("%",)]
    assert rows(db, r"SELECT `key` FROM lit WHERE t LIKE 'a\%'") == [("%",)]
    assert rows(db, "SELECT COUNT(*) AS n FROM lit WHERE t NOT LIKE 'a%'") == [(1,)]
    fails(db, "SELECT t FROM lit WHERE nope = 1", "unknown column: NOPE")
    with pytest.raises(ParseError):
        db.execute("SELECT t FROM lit WHERE t = 'x' garbage here")
    db.execute("INSERT INTO lit VALUES ('" + "A" * 1_000_000 + "', 'big')")
    assert rows(db, "SELECT length(t) AS n FROM lit WHERE `key` = 'big'") == [(1_000_000,)]


def test_empty_table_and_alter(db):
    db.execute("CREATE TABLE e (id INT, v TEXT)")
    assert rows(db, "SELECT * FROM e") == [] and rows(db, "SELECT COUNT(*) AS n FROM e") == [(0,)]
    db.execute("DELETE FROM e")
    assert rows(db, "UPDATE e SET v = 'x'") == [(0,)]
    fails(db, "ALTER TABLE e DROP COLUMN v", "schema is immutable")
    fails(db, "ALTER TABLE nope ADD COLUMN v INT", "no such table: NOPE")


def test_callback_can_stop(db):
    db.execute("CREATE TABLE cb (id INT, v TEXT)")
    db.execute("INSERT INTO cb VALUES (1,'a'),(2,NULL),(3,'c')")
    seen = []
    db.execute("SELECT id, v FROM cb ORDER BY id", lambda values, names: seen.append((values, names)) or len(seen) == 2)
    assert seen == [(["1", "a"], ["id", "v"]), (["2", None], ["id", "v"])]


def test_concurrent_writers_and_readers(db):
    db.execute("CREATE TABLE conc (id INT PRIMARY KEY, val TEXT)")
    errors = []

    def write(w):
        try:
            for k in range(3):
                db.execute("INSERT INTO conc VALUES " + ", ".join(f"({w * 1000 + k * 100 + i}, 'v')" for i in range(50)))
        except Exception as e:
            errors.append(e)

    def read():
        try:
            for _ in range(4):
                assert rows(db, "SELECT COUNT(*) AS n FROM conc")[0][0] % 50 == 0
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)] + [threading.Thread(target=read)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert rows(db, "SELECT COUNT(*) AS n FROM conc") == [(450,)]


def test_a_new_session_sees_the_tables(db, spark, tmp_path):
    db.execute("CREATE TABLE kept (id INT)")
    db.execute("INSERT INTO kept VALUES (1)")
    with connect(f"file://{tmp_path}/db", spark) as other:
        assert rows(other, "SELECT id FROM kept") == [(1,)]
        other.execute("INSERT INTO kept VALUES (2)")
    assert rows(db, "SELECT id FROM kept ORDER BY id") == [(1,), (2,)]


def test_bulk_append_and_stream(db, spark, tmp_path):
    db.execute("CREATE TABLE big (id INT PRIMARY KEY, name TEXT, bal DECIMAL)")
    db.catalog.append("big", spark.range(25_000).selectExpr("id", "concat('user', id) AS name", "1000 + id % 100 AS bal"))
    assert rows(db, "SELECT COUNT(*) AS n, CAST(SUM(bal) AS BIGINT) AS s FROM big") == [(25_000, 25_000 * 1000 + 250 * 4950)]
    with pytest.raises(EngineError, match="unknown column: Q"):
        db.catalog.append("big", spark.range(1).selectExpr("id AS q"))
    db.execute("CREATE TABLE st (id INT)")
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = db.spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    append_stream(db, stream, "st", f"{tmp_path}/check", name="s", once=True).awaitTermination(60)
    assert rows(db, "SELECT COUNT(*) AS n FROM st") == [(10,)]
    db.catalog.append("st", spark.range(5), ("s", 0))  # the batch was taken already
    assert rows(db, "SELECT COUNT(*) AS n FROM st") == [(10,)]


def test_server_and_shell(db):
    server = Server(db).start()
    client = Client(*server.server_address)
    client.execute("CREATE TABLE net (id INT, v TEXT)")
    client.execute("INSERT INTO net VALUES (1, 'two\nlines'), (2, NULL)")
    assert client.execute("SELECT id, v FROM net ORDER BY id") == [["1", "two\nlines"], ["2", None]]
    assert client.execute("SELECT id FROM net WHERE id > 5") == [] and client.last_columns == ["id"] and client.last_was_query
    with pytest.raises(EngineError, match="no such table: MISSING"):
        client.execute("SELECT * FROM missing")
    client.close()
    server.shutdown()
    out = []
    run(db, ["SELECT id, v", "FROM net ORDER BY id DESC LIMIT 1;", "SELECT 1 FROM net WHERE id > 9;", "NOPE;", ".tables", "TRUNCATE net;", ".exit", "SELECT 1;"], out.append)
    assert "| 2  | NULL |" in out[0] and "1 row in set" in out[1] and out[2].startswith("Empty set")
    assert out[3].startswith("ERROR: parse error") and "NET" in out[4] and out[5].startswith("Query OK") and len(out) == 6


def test_strict(spark, tmp_path):
    with connect(f"file://{tmp_path}/s", spark, strict=True) as db:
        db.execute("CREATE TABLE t (a INT, b INT)")
        fails(db, "SELECT * FROM t WHERE a = 1 AND b = 2", "compound WHERE with AND")


def test_sweeper(db):
    db.execute("CREATE TABLE sw (id INT)")
    db.execute("INSERT INTO sw VALUES (1, 1), (2, 1)")
    db.execute("INSERT INTO sw VALUES (3)")
    sweeper = Sweeper(db.catalog, every=0.05)
    sweeper.start()
    while not sweeper.sweeps:
        time.sleep(0.05)
    sweeper.stop()
    version = db.catalog.version("SW")
    assert len(version.segments) == 1 and not db.catalog.has_ttl("SW")
    assert db.catalog.store.read(version).count() == 1


def test_requests_that_are_too_large_keep_answers_in_step(db, monkeypatch):
    monkeypatch.setattr(server_module, "LARGEST", 1000)
    server = Server(db).start()
    client = Client(*server.server_address)
    client.execute("CREATE TABLE big (id INT, v TEXT)")
    for n in (960, 1000, 1001, 5000):
        with pytest.raises(EngineError, match="larger than"):
            client.execute(f"INSERT INTO big VALUES (1, '{'x' * n}')")
        assert client.execute("SELECT COUNT(*) AS n FROM big") == [["0"]]
    client.close()
    server.shutdown()


def test_error_texts(db):
    db.execute("CREATE TABLE a (id INT, v TEXT)")
    db.execute("CREATE TABLE b (aid INT, w TEXT)")
    for sql, text in [
        ("SELECT v FROM a INNER JOIN b ON a.id = b.nope", "join column not found"), ("SELECT v FROM a LEFT JOIN b ON a.zip = b.aid", "join column not found"),
        ("SELECT COUNT(*) AS n FROM a GROUP BY nope", "GROUP BY: unknown column: NOPE"), ("SELECT v, COUNT(*) AS n FROM a GROUP BY id", "SELECT column not in GROUP BY: V"),
        ("SELECT nope FROM a", "unknown column: NOPE"), ("SELECT a.id FROM a INNER JOIN b ON a.id = b.aid WHERE nope = 1", "unknown column: NOPE"),
    ]:
        with pytest.raises(EngineError) as e:
            db.execute(sql)
        assert str(e.value) == text


MALFORMED = [
    "", ";", "SELECT", "SELECT * FROM", "INSERT INTO", "INSERT INTO t VALUES", "INSERT INTO t VALUES (", "CREATE TABLE", "CREATE TABLE x (", "DELETE", "UPDATE t", "UPDATE t SET", "DROP", "SHOW", "SELECT * FROM t WHERE", "'",
    "INSERT INTO t VALUES (1, 'open)", "((((", "SELECT * FROM t WHERE v = 'a' OR", "CREATE TABLE y (id BLOB)",
]


def test_malformed_statements_fail_and_change_nothing(db):
    db.execute("CREATE TABLE t (id INT, v TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'safe')")
    for sql in MALFORMED:
        with pytest.raises(EngineError):
            db.execute(sql)
    hostile = ["'; DROP TABLE t; --", "x' OR '1'='1", "\\", "%", "Robert'); DELETE FROM t; --", "‮", "a" * 100_000]
    for i, text in enumerate(hostile):
        db.execute("INSERT INTO t VALUES ({}, '{}')".format(i + 2, text.replace("'", "''")))
    assert rows(db, "SELECT id, v FROM t WHERE id > 1 ORDER BY id") == [(i + 2, x) for i, x in enumerate(hostile)]
    for text in hostile[:5]:
        literal = text.replace("'", "''")
        assert rows(db, f"SELECT COUNT(*) AS n FROM t WHERE v = '{literal}'") == [(1,)]
    assert rows(db, "SELECT COUNT(*) AS n FROM t WHERE v LIKE '%''1''=%' AND v IN ('a', 'x'' OR ''1''=''1')") == [(1,)]
    assert rows(db, "UPDATE t SET v = 'it''s' WHERE v = 'x'' OR ''1''=''1'") == [(1,)] and rows(db, "SELECT v FROM t WHERE id = 3") == [("it's",)]
    assert rows(db, "SHOW TABLES") == [("T",)]


def test_expiry_at_the_ends_of_64_bits(db):
    db.execute("CREATE TABLE ends (id INT, v TEXT)")
    db.execute("INSERT INTO ends VALUES (1, 'a'), (2, 'b', 9223372036854775807), (3, 'c', -1), (4, 'd', -9223372036854775808), (5, 'e', 9223372036854775808), (6, 'f', 'soon')")
    assert rows(db, "SELECT id FROM ends ORDER BY id") == [(1,), (2,), (5,), (6,)]


def test_a_plain_insert_is_read_as_any_other():
    for sql in ("INSERT INTO t VALUES (1, 'a''b', NULL), (-2.5, '(x, y)', 3);", "INSERT INTO t (a, b) VALUES ('', '''')", "insert into t values(1)", "INSERT INTO t VALUES (1,2),(3,4) ;"):
        fast, reader = statements.plain_insert(sql), statements.Reader(sql)
        reader.at = 1
        slow = statements._insert(reader)
        assert (fast.table, fast.columns, [list(r) for r in zip(*fast.by_column)]) == (slow.table, slow.columns, slow.rows)
    for sql in ("INSERT INTO t VALUES (1, 2), (3)", "INSERT INTO t VALUES (1 2)", "INSERT INTO t VALUES (now())", "INSERT INTO t VALUES (1) garbage", "INSERT INTO t VALUES (1, )", "INSERT INTO t VALUES ('open)", "INSERT INTO t VALUES -- (1)\n(2)"):
        assert statements.plain_insert(sql) is None


def test_changes_rewrite_only_the_files_they_touch(db, spark):
    db.execute("CREATE TABLE f (id INT PRIMARY KEY, v TEXT)")
    db.catalog.append("f", spark.range(0, 4000, 1, 8).selectExpr("id", "'x' AS v"))
    files = lambda: set(db.catalog.store.read(db.catalog.version("F")).inputFiles())
    before = files()
    assert len(before) == 8
    db.execute("UPDATE f SET v = 'y' WHERE id = 10")
    db.execute("DELETE FROM f WHERE id IN (3999, 3998)")
    assert len(before & files()) == 6 and rows(db, "SELECT COUNT(*) AS n, COUNT_IF(v = 'y') AS y FROM f") == [(3998, 1)]
    fails(db, "INSERT INTO f VALUES (5000, 'z'), (10, 'z')", "duplicate primary key: 10")
    fails(db, "INSERT INTO f VALUES " + ", ".join(f"({i}, 'z')" for i in range(3990, 3990 + 2 * 2000)), "duplicate primary key: 399")
    db.execute("INSERT INTO f VALUES (3998, 'back'), (3999, 'back')")
    fails(db, "UPDATE f SET id = 3999 WHERE id = 5", "duplicate primary key: 3999")
    assert rows(db, "SELECT COUNT(*) AS n FROM f") == [(4000,)]


def test_new_keys_beyond_those_of_all_segments_read_nothing(db, monkeypatch):
    db.execute("CREATE TABLE k (id INT PRIMARY KEY, v TEXT)")
    db.execute("INSERT INTO k VALUES (1, 'a'), (5, 'b')")
    monkeypatch.setattr(type(db.catalog), "live", lambda *a, **b: 1 / 0)
    db.execute("INSERT INTO k VALUES (6, 'c'), (900, 'd')")
    with pytest.raises(ZeroDivisionError):
        db.execute("INSERT INTO k VALUES (3, 'e')")


def test_readers_keep_their_version_across_compaction(db):
    db.execute("CREATE TABLE r (id INT)")
    for i in range(3):
        db.execute(f"INSERT INTO r VALUES ({i}), ({i + 10}, 1)")
    old = db.execute("SELECT id FROM r ORDER BY id")
    folders = lambda: db.catalog.store.files.list(db.catalog.store.folder("R") + "/data")
    db.catalog.compact("r")
    assert [r[0] for r in old] == [0, 1, 2] and len(folders()) == 4  # younger than an hour
    db.catalog.compact("r", age=0)
    assert len(folders()) == 1 and rows(db, "SELECT id FROM r ORDER BY id") == [(0,), (1,), (2,)]


def test_two_writers_cannot_make_the_same_version(db, tmp_path):
    db.execute("CREATE TABLE w (id INT)")
    store = db.catalog.store
    version = store.current("W")
    store.commit(version)
    with pytest.raises(EngineError, match="another writer was first"):
        store.commit(version)
    errors, done = [], []

    def race(k):
        try:
            store.files.write_new(f"file://{tmp_path}/one", str(k))
            done.append(k)
        except EngineError as e:
            errors.append(e)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1 and len(errors) == 7 and store.files.read(f"file://{tmp_path}/one") == str(done[0])


def test_a_table_made_again_elsewhere_is_another_one(db, spark, tmp_path):
    db.execute("CREATE TABLE again (id INT)")
    db.execute("INSERT INTO again VALUES (1)")
    assert rows(db, "SELECT id FROM again") == [(1,)]
    with connect(f"file://{tmp_path}/db", spark) as other:
        other.execute("DROP TABLE again")
        other.execute("CREATE TABLE again (id INT, v TEXT)")
        other.execute("INSERT INTO again VALUES (2, 'x')")
    assert rows(db, "SELECT * FROM again") == [(2, "x")]
