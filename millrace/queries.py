"""One query for each operator of the dialect, over the star-schema tables, with the SQL that must agree.

SELECTs are statements of the dialect, run by the engine's own parser and binder; UPDATE, DELETE and DROP are the
after-images and checks that the engine uses; CREATE, INSERT, SHOW and SCHEMA are statements on an engine of their
own, which refers to the tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .operators import dml
from .plans.parser import parse
from .plans.select import plan_select
from .session import Engine

#: Columns of the tables that wildcards expand to, and primary keys.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement(text: str, analytical: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan_select(parse(text, analytical), lambda n: table(spark, sf_dir, n), KEYS.get, analytical)

    return run


def qualified(*tables: str, without: str | None = None) -> str:
    """The list of a wildcard over joined tables, in SQL."""
    return ", ".join(f'{t}.{c} AS "{t}.{c}"' for t in tables for c in COLUMNS[t] if c != without)


#: name: (statement, analytical, SQL)
STATEMENTS: dict[str, tuple[str, bool, str]] = {
    "scan_all": ("SELECT $ FROM nation", False, "SELECT * FROM nation"),
    "ap_scan": ("SELECT $ FROM supplier", True, f"SELECT {qualified('supplier')} FROM supplier"),
    "point_lookup": ("SELECT $ FROM orders WHERE o_orderkey == 777", False, "SELECT * FROM orders WHERE o_orderkey = 777"),
    "key_range_scan": ("SELECT $ FROM orders WHERE o_orderkey >= 1_000 AND o_orderkey < 1_250", False, "SELECT * FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 1250"),
    "project_cols": ("SELECT c_name, c_custkey FROM customer", False, "SELECT c_name, c_custkey FROM customer"),
    "project_expr": ("SELECT l_orderkey, l_linenumber, l_partkey * 10 + l_linenumber FROM lineitem", False, 'SELECT l_orderkey, l_linenumber, l_partkey * 10 + l_linenumber AS "Column2" FROM lineitem'),
    **{f"cmp_int_{n}": (f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {s} 500", False, f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {q} 500") for n, s, q in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("gt", ">", ">"), ("le", "<=", "<="), ("ge", ">=", ">="))},
    **{f"cmp_str_{n}": (f"SELECT $ FROM part WHERE part.p_brand {s} 'Brand#3'", True, f"SELECT {qualified('part')} FROM part WHERE p_brand {q} 'Brand#3'") for n, s, q in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("gt", ">", ">"), ("le", "<=", "<="), ("ge", ">=", ">="))},
    "cmp_str_lit_left": ("SELECT $ FROM part WHERE part.p_brand >= 'Brand#3' AND 'Brand#5' > part.p_brand", True, f"SELECT {qualified('part')} FROM part WHERE p_brand >= 'Brand#3' AND p_brand < 'Brand#5'"),
    "ap_filter": ("SELECT $ FROM lineitem WHERE lineitem.l_partkey > 1000 AND lineitem.l_linenumber == 3", True, f"SELECT {qualified('lineitem')} FROM lineitem WHERE l_partkey > 1000 AND l_linenumber = 3"),
    "and_chain": ("SELECT c_custkey FROM customer WHERE c_custkey > 100 AND c_nationkey < 9 AND c_mktsegment != 'BUILDING'", False, "SELECT c_custkey FROM customer WHERE c_custkey > 100 AND c_nationkey < 9 AND c_mktsegment <> 'BUILDING'"),
    "or_chain": ("SELECT c_custkey FROM customer WHERE c_custkey < 50 OR c_nationkey == 3 OR c_mktsegment == 'BUILDING'", False, "SELECT c_custkey FROM customer WHERE c_custkey < 50 OR c_nationkey = 3 OR c_mktsegment = 'BUILDING'"),
    "and_or_left_assoc": ("SELECT c_custkey FROM customer WHERE c_custkey < 100 OR c_nationkey == 3 AND c_mktsegment != 'BUILDING'", False, "SELECT c_custkey FROM customer WHERE (c_custkey < 100 OR c_nationkey = 3) AND c_mktsegment <> 'BUILDING'"),
    "col_vs_col_same_table": ("SELECT $ FROM lineitem WHERE lineitem.l_partkey < lineitem.l_suppkey", True, f"SELECT {qualified('lineitem')} FROM lineitem WHERE l_partkey < l_suppkey"),
    "arith_add": ("SELECT o_orderkey + o_custkey FROM orders WHERE o_orderkey + o_custkey > 900", False, 'SELECT o_orderkey + o_custkey AS "Column0" FROM orders WHERE o_orderkey + o_custkey > 900'),
    "arith_sub": ("SELECT o_orderkey - o_custkey FROM orders WHERE o_orderkey - o_custkey < -5", False, 'SELECT o_orderkey - o_custkey AS "Column0" FROM orders WHERE o_orderkey - o_custkey < -5'),
    "arith_mul": ("SELECT $ FROM lineitem WHERE l_partkey * 1000 + l_linenumber > 100000 AND l_suppkey % 7 == 3", False, "SELECT * FROM lineitem WHERE l_partkey * 1000 + l_linenumber > 100000 AND l_suppkey % 7 = 3"),
    "arith_quadratic": ("SELECT $ FROM orders WHERE orders.o_custkey * orders.o_custkey * 6 + orders.o_orderkey > 60000 AND orders.o_custkey * orders.o_orderkey + orders.o_custkey * 1888 < 2500000", True, f"SELECT {qualified('orders')} FROM orders WHERE o_custkey * o_custkey * 6 + o_orderkey > 60000 AND o_custkey * o_orderkey + o_custkey * 1888 < 2500000"),
    "arith_div": ("SELECT o_orderkey, o_custkey / 7, -9 / 2 FROM orders", False, 'SELECT o_orderkey, o_custkey // 7 AS "Column1", CAST(-4 AS BIGINT) AS "Column2" FROM orders'),
    "arith_mod": ("SELECT o_orderkey, o_custkey % 7, -9 % 4 FROM orders", False, 'SELECT o_orderkey, o_custkey % 7 AS "Column1", -9 % 4 AS "Column2" FROM orders'),
    "str_concat": ("SELECT n_nationkey, n_name + '-' + n_name FROM nation WHERE n_name != 'A' + 'B'", False, "SELECT n_nationkey, n_name || '-' || n_name AS \"Column1\" FROM nation WHERE n_name <> 'AB'"),
    "const_fold": ("SELECT $ FROM customer WHERE customer.c_custkey < 1 + 2 * 1", True, f"SELECT {qualified('customer')} FROM customer WHERE c_custkey < 3"),
    "pk_merge_join": ("SELECT $ FROM supplier JOIN part", False, f"SELECT {qualified('supplier', 'part', without='p_partkey')} FROM supplier JOIN part ON s_suppkey = p_partkey"),
    "cross_join": ("SELECT $ FROM region, nation", False, f"SELECT {qualified('region', 'nation')} FROM region, nation"),
    "theta_join": ("SELECT $ FROM nation, region WHERE nation.n_regionkey < region.r_regionkey OR n_nationkey == r_regionkey", False, f"SELECT {qualified('nation', 'region')} FROM nation, region WHERE n_regionkey < r_regionkey OR n_nationkey = r_regionkey"),
    "tp_equi_join": ("SELECT customer.c_name, orders.o_orderkey FROM customer, orders WHERE customer.c_custkey == orders.o_custkey AND o_orderstatus == 'F'", False, 'SELECT c_name AS "customer.c_name", o_orderkey AS "orders.o_orderkey" FROM customer, orders WHERE c_custkey = o_custkey AND o_orderstatus = \'F\''),
    "tp_three_tables": ("SELECT region.r_name, nation.n_name, supplier.s_suppkey FROM region, nation, supplier WHERE r_regionkey == n_regionkey AND n_nationkey == s_nationkey", False, 'SELECT r_name AS "region.r_name", n_name AS "nation.n_name", s_suppkey AS "supplier.s_suppkey" FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey'),
    "hash_join_2way": ("SELECT $ FROM customer, orders WHERE customer.c_custkey == orders.o_custkey", True, f"SELECT {qualified('customer', 'orders')} FROM customer JOIN orders ON c_custkey = o_custkey"),
    "hash_join_3way": ("SELECT $ FROM nation, customer, orders WHERE nation.n_nationkey == customer.c_nationkey AND customer.c_custkey == orders.o_custkey AND nation.n_regionkey == 1 AND orders.o_orderstatus != 'F'", True, f"SELECT {qualified('nation', 'customer', 'orders')} FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE n_regionkey = 1 AND o_orderstatus <> 'F'"),
    "hash_join_4way": ("SELECT $ FROM region, nation, customer, orders WHERE region.r_regionkey == nation.n_regionkey AND nation.n_nationkey == customer.c_nationkey AND customer.c_custkey == orders.o_custkey", True, f"SELECT {qualified('region', 'nation', 'customer', 'orders')} FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey"),
    "hash_join_bushy": ("SELECT $ FROM supplier, orders, nation, customer WHERE supplier.s_nationkey == nation.n_nationkey AND customer.c_custkey == orders.o_custkey AND nation.n_nationkey == customer.c_nationkey AND supplier.s_suppkey < 20", True, f"SELECT {qualified('supplier', 'orders', 'nation', 'customer')} FROM supplier, orders, nation, customer WHERE s_nationkey = n_nationkey AND c_custkey = o_custkey AND n_nationkey = c_nationkey AND s_suppkey < 20"),
    "hash_join_nonkey": ("SELECT $ FROM supplier, customer WHERE supplier.s_nationkey == customer.c_nationkey", True, f"SELECT {qualified('supplier', 'customer')} FROM supplier JOIN customer ON s_nationkey = c_nationkey"),
    "hash_join_string_key": ("SELECT $ FROM orders, lineitem WHERE orders.o_orderstatus == lineitem.l_linestatus AND orders.o_orderkey == lineitem.l_orderkey", True, f"SELECT {qualified('orders', 'lineitem')} FROM orders JOIN lineitem ON o_orderstatus = l_linestatus AND o_orderkey = l_orderkey"),
    "hash_join_two_keys": ("SELECT $ FROM customer, supplier WHERE customer.c_nationkey == supplier.s_nationkey AND customer.c_custkey == supplier.s_suppkey", True, f"SELECT {qualified('customer', 'supplier')} FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey"),
    "join_residual": ("SELECT $ FROM customer, nation WHERE customer.c_nationkey == nation.n_nationkey AND customer.c_custkey * 7 + nation.n_regionkey * 15 - customer.c_nationkey > 2100", True, f"SELECT {qualified('customer', 'nation')} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey * 7 + n_regionkey * 15 - c_nationkey > 2100"),
    "join_range_filters": ("SELECT $ FROM customer, orders WHERE customer.c_custkey == orders.o_custkey AND customer.c_custkey > 1 AND orders.o_orderkey <= 8500", True, f"SELECT {qualified('customer', 'orders')} FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey > 1 AND o_orderkey <= 8500"),
    "order_by": ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey == 7 ORDERBY c_mktsegment DESC, c_custkey", False, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 ORDER BY c_mktsegment DESC, c_custkey"),
}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{named.rstrip('/')}/millrace-{uuid.uuid4().hex}" if named else f"file://{tempfile.mkdtemp(prefix='millrace-')}"


def after(script: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of the last statement of a script, on an engine that reads the named tables.  Statements that
    constraints refuse change nothing and don't end the script."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Engine(spark, scratch(spark))
        for t in tables:
            db.register(t, f"{sf_dir}/{t}.parquet", KEYS.get(t))
        for result in (results := db.run(script)):
            if result.error:
                raise EngineError(result.message)
        return results[-1].df

    return run


_MEMBERS = [(1, 3, "one"), (2, 99, "two"), (1, 4, "again"), (3, 24, "a longer name"), (4, -1, "four")]
_MEMBER_SQL = "(VALUES " + ", ".join(f"({k}, {i}, {n}, '{name[:6]}')" for k, (i, n, name) in enumerate(_MEMBERS)) + ") v(k, i, n, name)"
_insert_members = "; ".join(f"INSERT Member(id, nation, name) VALUES({i}, {n}, '{name}')" for i, n, name in _MEMBERS)

#: name: (script, tables, SQL)
SCRIPTS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "insert_pk_check": (
        f"CREATE TABLE Member(id INT PK, nation INT, name VARCHAR(6)); {_insert_members}; SELECT $ FROM Member",
        (),
        f"SELECT i AS id, n AS nation, name FROM {_MEMBER_SQL} WHERE k IN (SELECT min(k) FROM {_MEMBER_SQL} GROUP BY i)",
    ),
    "insert_fk_check": (
        f"CREATE TABLE Member(id INT, nation INT REFERENCES nation, name CHAR(6)); {_insert_members}; SELECT id, nation, name FROM Member",
        ("nation",),
        f"SELECT i AS id, n AS nation, name FROM {_MEMBER_SQL} WHERE n IN (SELECT n_nationkey FROM nation)",
    ),
    "insert_default": (
        "CREATE TABLE Note(id INT PK, body VARCHAR(4) DEFAULT 'no' + 'thing', n INT DEFAULT 2 + 3 * 4); INSERT Note(id) VALUES(1); INSERT Note(id, body) VALUES(2, 'longer'); INSERT Note(n, id) VALUES(-7, 3); SELECT $ FROM Note",
        (),
        "SELECT * FROM (VALUES (1, 'noth', 14), (2, 'long', 14), (3, 'noth', -7)) v(id, body, n)",
    ),
    "insert_autopk": (
        "CREATE TABLE Note(body VARCHAR(9)); INSERT Note(body) VALUES('a'); INSERT Note(body) VALUES('b'); DELETE FROM Note WHERE body == 'b'; INSERT Note(body) VALUES('c'); SELECT $ FROM Note",
        (),
        'SELECT * FROM (VALUES (0, \'a\'), (2, \'c\')) v("autoPK", body)',
    ),
    "show_schema": (
        "CREATE TABLE Empty(id INT PK, name VARCHAR(9)); SCHEMA",
        tuple(COLUMNS),
        'SELECT t AS "table", size, c AS "column", CAST(p AS INTEGER) AS position FROM (VALUES ' + ", ".join(f"('{t}', {i}, '{c}')" for t, cs in {**COLUMNS, "Empty": ["id", "name"]}.items() for i, c in enumerate(cs)) + ") v(t, p, c) JOIN (SELECT 'Empty' AS n, CAST(0 AS BIGINT) AS size UNION ALL " + " UNION ALL ".join(f"SELECT '{t}', count(*) FROM {t}" for t in COLUMNS) + ") s ON s.n = v.t",
    ),
    "show_tables": (
        "CREATE TABLE Empty(id INT PK); SHOW",
        ("region", "nation"),
        "SELECT 'region' AS \"table\", (SELECT count(*) FROM region) AS size, ['r_regionkey', 'r_name'] AS columns, CAST(to_json(region) AS VARCHAR) AS row FROM region UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), ['n_nationkey', 'n_name', 'n_regionkey'], CAST(to_json(nation) AS VARCHAR) FROM nation UNION ALL SELECT 'Empty', 0, ['id'], NULL",
    ),
}


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"c_custkey2": F.col("c_custkey2") + F.col("c_nationkey"), "c_nationkey": F.col("c_nationkey") + 1}
    target = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("c_custkey2"), "c_nationkey")
    return dml.update_rows(target, F.col("c_custkey") % 3 == 0, sets, {})


def update_fk_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return dml.update_rows(target, None, {"c_nationkey": F.col("c_nationkey") + 5}, {"c_nationkey": table(spark, sf_dir, "nation").select("n_nationkey")})


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete_rows(table(spark, sf_dir, "customer"), F.col("c_nationkey") == 3, "c_custkey", [])


def delete_fk_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").filter("o_orderkey > 9000").select("o_custkey")
    return dml.delete_rows(table(spark, sf_dir, "customer"), F.col("c_nationkey") < 12, "c_custkey", [late])


def drop_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.droppable("n_nationkey", table(spark, sf_dir, "nation").select("n_nationkey"), [table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: statement(text, ap) for n, (text, ap, _) in STATEMENTS.items()},
    **{n: after(script, *tables) for n, (script, tables, _) in SCRIPTS.items()},
    **{f.__name__: f for f in (update_where, update_fk_skip, delete_where, delete_fk_restrict, drop_check)},
}

ORACLES: dict[str, str] = {n: sql for n, (_, _, sql) in (*STATEMENTS.items(), *SCRIPTS.items())} | {
    "update_where": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + c_nationkey ELSE c_custkey END AS c_custkey2, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS INTEGER) AS c_nationkey, c_custkey % 3 = 0 AS __changed FROM customer",
    "update_fk_skip": "SELECT c_custkey, CAST(CASE WHEN ok THEN c_nationkey + 5 ELSE c_nationkey END AS INTEGER) AS c_nationkey, ok AS __changed FROM (SELECT *, c_nationkey + 5 IN (SELECT n_nationkey FROM nation) AS ok FROM customer)",
    "delete_where": "SELECT * FROM customer WHERE NOT c_nationkey = 3",
    "delete_fk_restrict": "SELECT * FROM customer WHERE NOT (c_nationkey < 12 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey > 9000))",
    "drop_check": "SELECT NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS droppable",
}
