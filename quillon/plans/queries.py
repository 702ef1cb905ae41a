"""The registered queries of the engine's own operators, each with DuckDB SQL.

Every SELECT runs through the dialect's parser, checks and folding. Results are compared without
regard to order, so order is covered by tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.engine import Engine, Session
from quillon.operators import bitmap, join, scan, sort
from quillon.sources.parquet import select_parquet

Query = Callable[[SparkSession, str], DataFrame]

#: name: (the dialect's SQL, DuckDB's SQL where it differs)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "scan_full": ("SELECT * FROM nation", None),
    "project_cols": ("SELECT c_name, c_custkey FROM customer", None),
    "project_case": ("SELECT C_NAME, c_MktSegment FROM customer", "SELECT c_name, c_mktsegment FROM customer"),
    "filter_eq_str": ("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#12'", None),
    "filter_ne": ("SELECT p_partkey, p_brand FROM part WHERE p_brand <> 'Brand#12'", None),
    "filter_ne_bang": ("SELECT p_partkey, p_size FROM part WHERE p_size != 7", None),
    "filter_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size < 11", None),
    "filter_le": ("SELECT p_partkey, p_size FROM part WHERE p_size <= 11", None),
    "filter_gt": ("SELECT p_partkey, p_size FROM part WHERE p_size > 39", None),
    "filter_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 39", None),
    "filter_str_order": ("SELECT p_partkey, p_brand FROM part WHERE p_brand < 'Brand#3'", None),
    "filter_and": ("SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand = 'Brand#12'", None),
    "filter_or": ("SELECT p_partkey FROM part WHERE p_size > 48 OR p_brand = 'Brand#12'", None),
    "filter_and_or_prec": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_returnflag = 'A' AND l_linenumber > 3", None),
    "filter_parens": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND l_linenumber > 3", None),
    "filter_arith": ("SELECT p_partkey, p_size FROM part WHERE p_size * 2 + 1 > 2 + 40", None),
    "filter_sub": ("SELECT p_partkey, p_size FROM part WHERE 60 - p_size - 5 > 20", None),
    "filter_int_div": ("SELECT p_partkey, p_size FROM part WHERE p_size / 7 = 3", "SELECT p_partkey, p_size FROM part WHERE p_size // 7 = 3"),
    "filter_int_div_negative": ("SELECT p_partkey, p_size FROM part WHERE (p_size - 30) / 7 = -2", "SELECT p_partkey, p_size FROM part WHERE (p_size - 30) // 7 = -2"),
    "filter_neg_literal": ("SELECT p_partkey, p_size FROM part WHERE p_size - -5 > 50", None),
    "filter_bool_eq": ("SELECT p_partkey, p_size FROM part WHERE (p_size > 10) = (p_size < 40)", None),
    "filter_bool_literal": ("SELECT p_partkey FROM part WHERE (p_size > 25) = TRUE", None),
    "filter_eager_and": ("SELECT p_partkey FROM part WHERE p_size > 0 AND 100 / p_size = 4", "SELECT p_partkey FROM part WHERE p_size > 0 AND 100 // p_size = 4"),
    "filter_eager_or": ("SELECT p_partkey FROM part WHERE p_size + 1 < 5 OR p_size * 2 > 90", None),
    "fold_tautology": ("SELECT * FROM region WHERE 1 = 1", None),
    "fold_contradiction": ("SELECT * FROM region WHERE 1 = 2", None),
    "fold_constants": ("SELECT p_partkey FROM part WHERE p_size = (2 + 3) * 4 - 6 / 2", "SELECT p_partkey FROM part WHERE p_size = (2 + 3) * 4 - 6 // 2"),
    "order_by_asc": ("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name", None),
    "order_by_desc": ("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC", None),
    "order_by_hidden": ("SELECT s_name FROM supplier WHERE s_suppkey > 3 ORDER BY s_nationkey", None),
    "flagship": ("SELECT p_partkey, p_size FROM part WHERE p_size + 1 <= 5 AND p_brand <> 'Brand#11' ORDER BY p_size DESC", None),
}

PRIORITY = "1-URGENT"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _statement(sql: str) -> Query:
    return lambda spark, d: select_parquet(spark, d, sql)


def _orders_rows(spark: SparkSession, d: str, column: str, value: str) -> DataFrame:
    return bitmap.lookup(bitmap.build_index(_table(spark, d, "orders"), column, "o_orderkey"), value)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return bitmap.build_index(_table(spark, d, "lineitem"), "l_returnflag", "l_orderkey")


def _found(rows: DataFrame) -> DataFrame:
    return bitmap.positions(rows)


def _scan(scan_by: Callable[..., DataFrame], keys: object) -> Query:
    """Orders through an index of their line items' flags."""
    return lambda spark, d: scan_by(_table(spark, d, "orders"), "o_orderkey", _index(spark, d), keys).select("o_orderkey", "o_custkey")


def _columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def join_1_1(spark: SparkSession, d: str) -> DataFrame:
    out = join.hash_join(_table(spark, d, "orders"), _table(spark, d, "customer"), "o_custkey", "c_custkey")
    return out.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


def join_m_n(spark: SparkSession, d: str) -> DataFrame:
    out = join.hash_join(_table(spark, d, "lineitem"), _table(spark, d, "orders"), "l_orderkey", "o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "o_custkey", "o_orderstatus")


def join_empty(spark: SparkSession, d: str) -> DataFrame:
    """Keys that cannot meet: those of orders are negated and less one."""
    a, b = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    return join.hash_join(a, b, -a["o_orderkey"] - 1, b["l_orderkey"]).select("o_orderkey", "l_orderkey")


def join_expr_key(spark: SparkSession, d: str) -> DataFrame:
    n, s = _table(spark, d, "nation"), _table(spark, d, "supplier")
    return join.hash_join(n, s, n["n_nationkey"] * 2, s["s_nationkey"] + 1).select("n_name", "s_suppkey", "s_name")


def scan_sort_join(spark: SparkSession, d: str) -> DataFrame:
    n, s = sort.sort_by(_table(spark, d, "nation"), "n_nationkey"), _table(spark, d, "supplier")
    return join.hash_join(n, s, "n_nationkey", "s_nationkey").select("n_nationkey", "n_name", "s_suppkey")


def txn_visible_after_commit(spark: SparkSession, d: str) -> DataFrame:
    engine, s = Engine(spark), Session()
    for sql in (
        "CREATE TABLE t (id INT, name VARCHAR)", "INSERT INTO t VALUES (1, 'alice')", "BEGIN", "INSERT INTO t VALUES (42, 'gone')", "ROLLBACK",
        "BEGIN TRANSACTION", "INSERT INTO t VALUES (2, 'it''s')", "INSERT INTO t VALUES (-3, '')", "COMMIT",
    ):
        engine.execute(sql, s)
    return engine.execute("SELECT id, name FROM t ORDER BY id DESC", s).df


OPERATORS: dict[str, tuple[Query, str]] = {
    "scan_range": (lambda s, d: _columns(scan.range_scan(_table(s, d, "orders"), "o_orderkey", 100, 200), "o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200"),
    "scan_range_ordered": (lambda s, d: _columns(scan.ordered_range(_table(s, d, "orders"), "o_orderkey", 14990, 99999), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 14990 AND 99999"),
    "point_lookup": (lambda s, d: _columns(scan.at_key(_table(s, d, "orders"), "o_orderkey", 42), "o_orderkey", "o_custkey", "o_orderstatus"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42"),
    "scan_empty": (lambda s, d: scan.empty_scan(_table(s, d, "region")), "SELECT * FROM region WHERE 1 = 2"),
    "sort_operator": (lambda s, d: _columns(sort.sort_by(_table(s, d, "orders"), F.col("o_custkey") * 10 + 1, "o_orderkey"), "o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders"),
    "sort_external": (lambda s, d: _columns(sort.external_sort(_table(s, d, "orders"), "o_orderkey"), "o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders"),
    "hash_join_1_1": (join_1_1, "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"),
    "hash_join_m_n": (join_m_n, "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "hash_join_empty": (join_empty, "SELECT o_orderkey, l_orderkey FROM orders JOIN lineitem ON -o_orderkey - 1 = l_orderkey"),
    "hash_join_expr_key": (join_expr_key, "SELECT n_name, s_suppkey, s_name FROM nation JOIN supplier ON n_nationkey * 2 = s_nationkey + 1"),
    "scan_sort_join": (scan_sort_join, "SELECT n_nationkey, n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey"),
    "bitmap_eq": (lambda s, d: _columns(bitmap.scan_equal(_table(s, d, "lineitem"), "l_returnflag", "R"), "l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'"),
    "bitmap_or": (lambda s, d: _columns(bitmap.scan_or(_table(s, d, "lineitem"), "l_returnflag", ["A", "N"]), "l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N')"),
    "bitmap_and_cols": (lambda s, d: _columns(bitmap.scan_and(_table(s, d, "lineitem"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'"),
    "bitmap_and_multikey": (lambda s, d: bitmap.scan_and_keys(_table(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "R"]), "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2"),
    "bitmap_index_lookup": (lambda s, d: _found(bitmap.lookup(_index(s, d), "R")), "SELECT DISTINCT l_orderkey AS row FROM lineitem WHERE l_returnflag = 'R'"),
    "bitmap_index_or": (lambda s, d: _found(bitmap.any_of(_index(s, d), ["A", "N"])), "SELECT DISTINCT l_orderkey AS row FROM lineitem WHERE l_returnflag IN ('A', 'N')"),
    "bitmap_index_and": (lambda s, d: _found(bitmap.all_of(_index(s, d), ["A", "R"])), "SELECT l_orderkey AS row FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2"),
    "bitmap_index_count": (lambda s, d: bitmap.count_rows(_index(s, d), "N"), "SELECT count(DISTINCT l_orderkey) AS count FROM lineitem WHERE l_returnflag = 'N'"),
    "bitmap_num_values": (lambda s, d: bitmap.num_values(_index(s, d)), "SELECT count(DISTINCT l_returnflag) AS num_values FROM lineitem"),
    "bitmap_total_rows": (lambda s, d: bitmap.total_rows(_table(s, d, "orders"), "o_orderkey"), "SELECT max(o_orderkey) + 1 AS total_rows FROM orders"),
    "bitmap_scan_eq": (_scan(bitmap.scan_by_index, "R"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "bitmap_scan_or": (_scan(bitmap.scan_by_index_or, ["A", "R"]), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))"),
    "bitmap_scan_and": (_scan(bitmap.scan_by_index_and, ["A", "R"]), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "bitset_and": (lambda s, d: _found(bitmap.set_and(_orders_rows(s, d, "o_orderpriority", PRIORITY), _orders_rows(s, d, "o_orderstatus", "F"))), f"SELECT o_orderkey AS row FROM orders WHERE o_orderpriority = '{PRIORITY}' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "bitset_or": (lambda s, d: _found(bitmap.set_or(_orders_rows(s, d, "o_orderpriority", PRIORITY), _orders_rows(s, d, "o_orderstatus", "F"))), f"SELECT o_orderkey AS row FROM orders WHERE o_orderpriority = '{PRIORITY}' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "bitset_not": (lambda s, d: _found(bitmap.set_not(_orders_rows(s, d, "o_orderstatus", "F"), bitmap.total_rows(_table(s, d, "orders"), "o_orderkey"))), "SELECT range AS row FROM range((SELECT max(o_orderkey) + 1 FROM orders)) EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "bitset_count": (lambda s, d: bitmap.set_count(_orders_rows(s, d, "o_orderstatus", "F")), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'"),
    "bitset_iterate": (lambda s, d: bitmap.set_iterate(_orders_rows(s, d, "o_orderstatus", "P")), "SELECT o_orderkey AS row FROM orders WHERE o_orderstatus = 'P'"),
    "txn_visible_after_commit": (txn_visible_after_commit, "SELECT * FROM (VALUES (1, 'alice'), (2, 'it''s'), (-3, '')) AS t(id, name)"),
}

QUERIES: dict[str, Query] = {k: _statement(sql) for k, (sql, _) in STATEMENTS.items()} | {k: f for k, (f, _) in OPERATORS.items()}
ORACLES: dict[str, str] = {k: other or sql for k, (sql, other) in STATEMENTS.items()} | {k: sql for k, (_, sql) in OPERATORS.items()}
