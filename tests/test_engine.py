"""The transactional script and what it must report; then the analytical mode."""

import io

import pytest
from pyspark.sql import functions as F

from millrace import EngineError
from millrace.operators import relational
from millrace.plans.parser import parse
from millrace.plans.select import plan_select
from millrace.sources.console import format_result, run_console, statements

SCRIPT = [
    ("CREATE TABLE Harbour(code INT PK, town CHAR(12))", 'create table "Harbour"'),
    ("CREATE TABLE Ship(hull INT PK, title VARCHAR(16), home INT REFERENCES Harbour, tons INT DEFAULT 40 * 25)", 'create table "Ship"'),
    ("CREATE TABLE Cargo(lot INT PK, weight INT)", 'create table "Cargo"'),
    *[(f"INSERT Harbour(code, town) VALUES({c}, {t})", "INSERT OK") for c, t in (("10", "'Bergen'"), ("2 * 10", "'Porto'"), ("30", "'Oran' + 'ge'"), ("40", '"Kiel"'))],
    ("INSERT Harbour(town, code) VALUES('twice', 60 / 2)", 'PK exists: "30"'),
    *[(f"INSERT Ship(hull, title, home) VALUES({h}, '{t}', {p})", "INSERT OK") for h, t, p in ((1, "Alba", 10), (2, "Brisa", 20), (3, "Corvo", 20))],
    ("INSERT Ship(hull, title, home, tons) VALUES(4, 'Delta', 40, 7)", "INSERT OK"),
    ("INSERT Ship(hull, title, home) VALUES(5, 'Echo', 50)", 'FK constraint violate: "50"'),
    *[(f"INSERT Cargo(lot, weight) VALUES({k}, {k * k % 7})", "INSERT OK") for k in (2, 20, 40)],
    ("DELETE FROM Harbour WHERE code == 40", "delete 0 rows"),
    ("UPDATE Ship SET home = home + 20", 'update 3 rows in table "Ship"'),  # 10 to 30, 20 to 40 twice, but 40 to 60 isn't there
]
REST = [
    ("UPDATE Ship SET home = 30, title = title + '!'", 'update 4 rows in table "Ship"'),
    ("UPDATE Ship SET tons = tons WHERE hull > 1", 'update 0 rows in table "Ship"'),
    ("UPDATE Ship SET tons = tons - 1 WHERE title == 'Nobody'", 'update 0 rows in table "Ship"'),
    ("DELETE FROM Harbour WHERE code > 10", "delete 2 rows"),  # 30 is referred to
    ("DELETE FROM Ship WHERE title == 'Al' + 'ba!'", "delete 1 rows"),
    ("DROP TABLE Harbour", 'table "Harbour" cannot be dropped due to FK constraint'),
    ("DROP TABLE Cargo", 'table "Cargo" has been dropped'),
    ("CREATE TABLE Ship(hull INT PK)", 'The table "Ship" has already existed'),
    ("DROP TABLE Nothing", 'the table "Nothing" does not exist'),
]


def rows(r):
    assert not r.error, r.message
    return sorted(tuple(x) for x in r.df.collect())


def test_script(engine):
    for text, message in SCRIPT:
        assert engine.execute(text).message == message, text
    assert rows(engine.execute("SELECT $ FROM Ship")) == [(1, "Alba", 30, 1000), (2, "Brisa", 40, 1000), (3, "Corvo", 40, 1000), (4, "Delta", 40, 7)]
    assert rows(engine.execute("SELECT town FROM Harbour WHERE code >= 20 AND town != 'Kiel'")) == [("Orange",), ("Porto",)]
    r = engine.execute("SELECT Harbour.code, Cargo.lot, Cargo.weight FROM Harbour, Cargo WHERE Harbour.code > 35 OR Cargo.lot == 20")
    assert r.df.columns == ["Harbour.code", "Cargo.lot", "Cargo.weight"] and len(rows(r)) == 3 + 3
    r = engine.execute("SELECT $ FROM Harbour JOIN Cargo WHERE Harbour.code < 40")
    assert r.df.columns == ["Harbour.code", "Harbour.town", "Cargo.weight"] and rows(r) == [(20, "Porto", 1)]
    assert rows(engine.execute("SELECT Ship.hull, Harbour.town FROM Harbour, Ship WHERE Harbour.code == Ship.home")) == [(1, "Orange"), (2, "Kiel"), (3, "Kiel"), (4, "Kiel")]
    r = engine.execute("SELECT code, code * 2 - 1, town FROM Harbour ORDERBY code DESC")
    assert r.df.columns == ["code", "Column1", "town"] and [x[1] for x in r.df.collect()] == [79, 59, 39, 19]
    for text, message in REST:
        assert engine.execute(text).message == message, text


def test_rows_are_shown_in_the_order_of_keys(engine):
    """As a tree of keys gives them, although an UPDATE has put a row into a later segment."""
    engine.run("CREATE TABLE T(id INT PK, v INT); INSERT T(id, v) VALUES(3, 0); INSERT T(id, v) VALUES(1, 0); INSERT T(id, v) VALUES(2, 0); UPDATE T SET v = 9 WHERE id == 1")
    shown = lambda q: format_result(engine.execute(q)).splitlines()[1:-1]
    assert shown("SELECT $ FROM T") == ["1\t9", "2\t0", "3\t0"]
    assert shown("SELECT id, v FROM T ORDERBY v DESC, id DESC") == ["1\t9", "3\t0", "2\t0"]
    engine.run("CREATE TABLE U(name CHAR(3) PK); INSERT U(name) VALUES('b'); INSERT U(name) VALUES('a')")
    assert shown("SELECT T.id, U.name FROM T, U WHERE T.id < 3") == ["1\ta", "1\tb", "2\ta", "2\tb"]


def test_show_has_sizes_columns_and_empty_tables(engine):
    assert engine.execute("SHOW").df.count() == 0
    engine.run("CREATE TABLE B(id INT PK, s CHAR(2)); CREATE TABLE A(name CHAR(3) PK); INSERT B(id, s) VALUES(10, 'x'); INSERT B(id, s) VALUES(9, 'y')")
    got = [tuple(r) for r in engine.execute("SHOW").df.collect()]
    assert got == [("A", 0, ["name"], None), ("B", 2, ["id", "s"], '{"id":9,"s":"y"}'), ("B", 2, ["id", "s"], '{"id":10,"s":"x"}')]


def test_defaults_are_cut_to_the_column(engine):
    engine.run("CREATE TABLE T(id INT PK, s VARCHAR(3) DEFAULT 'abcdef'); INSERT T(id) VALUES(1)")
    assert rows(engine.execute("SELECT s FROM T")) == [("abc",)]


def test_failures_are_results_and_change_nothing(engine):
    engine.run("CREATE TABLE E(a INT PK, b INT DEFAULT 1); INSERT E(a) VALUES(1)")
    for text in ("INSERT E(a) VALUES(3000000000)", "INSERT E(a, a) VALUES(2, 3)", "UPDATE E SET b = 1, b = 2", "UPDATE E SET b = b + 2147483647", "CREATE TABLE F(a INT DEFAULT 65536 * 65536)", "SELECT d / 2 FROM Real"):
        r = engine.execute(text)
        assert r.error and r.message.startswith("SQL syntax error, please check query log: "), text
    assert rows(engine.execute("SELECT $ FROM E")) == [(1, 1)]


def test_doubles_are_passed_on_only(engine, tmp_path):
    engine.spark.createDataFrame([(1, 2.5)], "k int, d double").write.parquet(f"{tmp_path}/real")
    engine.register("Real", f"file://{tmp_path}/real", "k")
    assert rows(engine.execute("SELECT $ FROM Real")) == [(1, 2.5)]
    assert "types don't match" in engine.execute("SELECT $ FROM Real WHERE d > 2").message


def test_vacuum_keeps_what_is_in_use(engine):
    engine.run("CREATE TABLE T(id INT PK, v INT)")
    for i in range(4):
        engine.run(f"INSERT T(id, v) VALUES({i}, 0); UPDATE T SET v = {i + 1}")
    assert engine.catalog.vacuum(keep=1) > 0 and engine.catalog.vacuum(keep=1) == 0
    assert rows(engine.execute("SELECT $ FROM T")) == [(i, 4) for i in range(4)]
    assert engine.execute("INSERT T(id, v) VALUES(9, 9)").message == "INSERT OK"


def test_cached_snapshot(engine):
    from millrace import Engine

    engine.run("CREATE TABLE T(id INT PK, v INT); INSERT T(id, v) VALUES(1, 1); INSERT T(id, v) VALUES(2, 1)")
    db = Engine(engine.spark, engine.catalog.root, cache=True)
    db.execute("SWITCH")
    first = rows(db.execute("SELECT $ FROM T WHERE T.v == 1"))
    assert "InMemoryTableScan" in db.explain("SELECT $ FROM T")
    engine.execute("DELETE FROM T WHERE id == 1")
    assert rows(db.execute("SELECT $ FROM T WHERE T.v == 1")) == first == [(1, 1), (2, 1)]
    db.run("SWITCH; SWITCH")
    assert rows(db.execute("SELECT $ FROM T")) == [(2, 1)]


def test_auto_pk_defaults_and_truncation(engine):
    assert engine.execute("CREATE TABLE Note(body VARCHAR(4) DEFAULT 'none', n INT DEFAULT 2 + 3 * 4)").message == 'create table "Note"'
    engine.execute("INSERT Note(body) VALUES('longer')")
    engine.execute("INSERT Note(n) VALUES(-7)")
    assert rows(engine.execute("SELECT $ FROM Note")) == [(0, "long", 14), (1, "none", -7)]
    assert engine.execute("DELETE FROM Note WHERE n < 0").message == "delete 1 rows"
    engine.execute("INSERT Note(n) VALUES(1)")
    assert rows(engine.execute("SELECT autoPK, n / 2, n % 2 FROM Note")) == [(0, 7, 0), (2, 0, 1)]
    assert engine.execute("CREATE TABLE Bare(a INT PK, b INT)").message
    assert "neither" in engine.execute("INSERT Bare(a) VALUES(1)").message


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("SELECT $ FROM Missing", 'no such table "Missing"'),
        ("SELECT x FROM T", 'no such column "x" in "T"'),
        ("SELECT $ FROM T WHERE a == 'x'", "expression types don't match"),
        ("SELECT $ FROM T WHERE b - 'x' == b", "STR can only be connected with '+'"),
        ("SELECT $ FROM T WHERE a", "condition type invalid, must be a comparison"),
        ("INSERT T(a, b) VALUES(1)", "the number of columns and elements don't match"),
        ("UPDATE T SET a = 3", "a primary key can't be updated"),
        ("select $ from T", "expected SELECT"),
        ("SELECT $ FROM T WHERE a == 1 b", "unexpected b"),
    ],
)
def test_errors(engine, text, message):
    engine.execute("CREATE TABLE T(a INT PK, b VARCHAR(9))")
    r = engine.execute(text)
    assert r.error and r.message.startswith("SQL syntax error, please check query log: ") and message in r.message


def test_analytical_mode_sees_the_snapshot(engine):
    for name, n in (("A", 6), ("B", 9)):
        engine.execute(f"CREATE TABLE {name}(id INT PK, value INT)")
        for i in range(n):
            engine.execute(f"INSERT {name}(id, value) VALUES({i}, {i % 4})")
    assert engine.execute("SWITCH").message == "SWITCH to OLAP"
    q = "SELECT $ FROM A, B WHERE A.value == B.value AND B.id > 3 AND A.id * 2 - B.id < 3"
    want = sorted((i, i % 4, j, j % 4) for i in range(6) for j in range(9) if i % 4 == j % 4 and j > 3 and i * 2 - j < 3)
    assert rows(engine.execute(q)) == want
    assert engine.execute(q).df.columns == ["A.id", "A.value", "B.id", "B.value"]
    from millrace import Engine

    other = Engine(engine.spark, engine.catalog.root)
    assert other.execute("DELETE FROM B WHERE id > 3").message == "delete 5 rows"
    assert rows(engine.execute(q)) == want
    assert "unjoined" in engine.execute("SELECT $ FROM A, B WHERE A.id < B.id").message
    assert engine.execute("SELECT id FROM A").error and engine.execute("DELETE FROM A").error
    assert "PushedFilters" in engine.explain(q)
    assert engine.execute("SWITCH").message == "SWITCH to OLTP"
    assert rows(engine.execute("SELECT $ FROM B"))[-1] == (3, 3)
    assert {tuple(r) for r in engine.execute("SCHEMA").df.collect()} == {("A", 6, "id", 0), ("A", 6, "value", 1), ("B", 4, "id", 0), ("B", 4, "value", 1)}
    assert engine.execute("SHOW").df.count() == 10
    assert engine.execute("EXIT").message == "DB exit"
    with pytest.raises(EngineError):
        engine.execute("SHOW")


def test_console(engine):
    text = "CREATE TABLE T(a INT PK,\n b VARCHAR(9)); INSERT T(a, b) VALUES(1, 'x;y');\n// a note\nSELECT $ FROM T;\nEXIT;SHOW;"
    assert len(list(statements(io.StringIO(text)))) == 5
    out = io.StringIO()
    run_console(engine, io.StringIO(text), out)
    assert out.getvalue().splitlines() == ['create table "T"', "INSERT OK", "a\tb", "1\tx;y", "output size = 1", "DB exit"]


def test_concurrent_commits_do_not_overwrite(engine):
    state = engine.catalog.state()
    engine.catalog.commit(state)
    with pytest.raises(EngineError):
        engine.catalog.commit(state)


def test_many_segments_become_one(engine, monkeypatch):
    from millrace.sources import catalog

    monkeypatch.setattr(catalog, "MOST_SEGMENTS", 3)
    engine.execute("CREATE TABLE T(a INT PK)")
    for i in range(5):
        engine.execute(f"INSERT T(a) VALUES({i})")
    assert len(engine.catalog.state().get("T").segments) <= 3
    assert rows(engine.execute("SELECT $ FROM T WHERE a > 2")) == [(3,), (4,)]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_join_on_non_keys_is_dealt_to_all_tasks(spark, tmp_path, monkeypatch, threshold):
    monkeypatch.setattr(relational, "PIECE_ROWS", 20_000)
    monkeypatch.setattr(relational, "LEAST_PIECE", 1)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = "CASE WHEN id < 900 THEN 7 WHEN id < 990 THEN id % 30 END"  # one very common key, and nulls
        spark.range(1000).coalesce(1).selectExpr("id AS a", f"{key} AS k", "'x' AS s").write.parquet(f"{tmp_path}/A")
        spark.range(3000).coalesce(1).selectExpr("id DIV 2 AS b", f"CAST({key} AS INT) AS k").write.parquet(f"{tmp_path}/B")  # without a primary key, rows come twice
        tables = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in "AB"}
        for text in ("SELECT $ FROM A, B WHERE A.k == B.k AND A.a + B.b != 5", "SELECT $ FROM B, A WHERE A.k == B.k AND A.a + B.b != 5"):
            got = plan_select(parse(text, True), tables.get, {"A": "a"}.get, True)
            a, b = tables["A"].alias("a"), tables["B"].alias("b")
            want = a.join(b, F.expr("a.k = b.k AND a.a + b.b != 5")).selectExpr("a.a AS `A.a`", "a.k AS `A.k`", "a.s AS `A.s`", "b.b AS `B.b`", "b.k AS `B.k`")
            count = lambda df, by: {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}
            names = [f"`{c}`" for c in want.columns]
            assert count(got, names) == count(want, names)
            per_task = [r[-1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            assert max(per_task) < 0.6 * sum(per_task)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_joins_on_a_key_are_not_dealt(spark):
    at = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}.get
    dealt = []
    for where in ("nation.n_nationkey == customer.c_nationkey AND customer.c_custkey == orders.o_custkey", "nation.n_regionkey == customer.c_nationkey AND customer.c_custkey == orders.o_custkey"):
        for tables in ("nation, customer, orders", "orders, customer, nation"):
            q = plan_select(parse(f"SELECT $ FROM {tables} WHERE {where}", True), at, keys, True)
            dealt.append(q._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"))
    assert dealt == [0, 0, 2, 1]  # customers that come twice multiply orders too
