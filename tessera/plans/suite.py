"""The registered queries over the star schema: dialect text, and SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..sources.catalog import Catalog


@dataclass(frozen=True)
class Case:
    text: str
    oracle: str
    method: str | None = None
    #: Result columns that are rounded on both sides, as sums of doubles hang on the order of addition.
    rounded: tuple[str, ...] = ()


def _cases() -> dict[str, Case]:
    out: dict[str, Case] = {}

    def add(name: str, text: str, oracle: str, method: str | None = None, rounded: tuple[str, ...] = ()) -> None:
        out[name] = Case(text, oracle, method, rounded)

    ops = {"lt": "<", "gt": ">", "le": "<=", "ge": ">=", "eq": "=", "ne": "!="}
    add("scan_star", "SELECT * FROM nation", "SELECT * FROM nation")
    add("scan_events", "SELECT * FROM events", "SELECT * FROM events")
    add("project_columns", "SELECT customer.c_custkey,customer.c_name FROM customer", "SELECT c_custkey, c_name FROM customer")
    for name, op in ops.items():
        add(f"filter_int_{name}", f'SELECT part.p_partkey,part.p_size FROM part WHERE part.p_size{op}"25"', f"SELECT p_partkey, p_size FROM part WHERE p_size {op} 25")
        add(f"filter_str_{name}", f'SELECT customer.c_custkey,customer.c_mktsegment FROM customer WHERE customer.c_mktsegment{op}"BUILDING"', f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment {op} 'BUILDING'")
        add(f"filter_real_{name}", f'SELECT lineitem.l_orderkey,lineitem.l_quantity FROM lineitem WHERE lineitem.l_quantity{op}"25.0"', f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {op} 25.0")
    add("filter_same_table", "SELECT lineitem.l_orderkey,lineitem.l_discount,lineitem.l_tax FROM lineitem WHERE lineitem.l_discount<lineitem.l_tax", "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount < l_tax")
    add("filter_conjunction", 'SELECT lineitem.l_orderkey,lineitem.l_linenumber FROM lineitem WHERE lineitem.l_quantity>="10",lineitem.l_discount<="0.05",lineitem.l_returnflag="R"', "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_discount <= 0.05 AND l_returnflag = 'R'")
    add("filter_timestamp", 'SELECT orders.o_orderkey,orders.o_totalprice FROM orders WHERE orders.o_orderdate>="1998-01-01"', "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
    add("filter_documents", 'SELECT documents.doc_id,documents.n_chars FROM documents WHERE documents.lang="en",documents.n_chars>"1000"', "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
    two = "FROM customer JOIN orders ON c_custkey = o_custkey"
    three, four = two + " JOIN lineitem ON o_orderkey = l_orderkey", two + " JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"
    add("join_two", "SELECT customer.c_name,orders.o_orderkey,orders.o_totalprice FROM customer,orders WHERE customer.c_custkey=orders.o_custkey", f"SELECT c_name, o_orderkey, o_totalprice {two}")
    w3 = "customer.c_custkey=orders.o_custkey,orders.o_orderkey=lineitem.l_orderkey"
    w4 = w3 + ",lineitem.l_partkey=part.p_partkey"
    add("join_three", f"SELECT customer.c_custkey,orders.o_orderkey,lineitem.l_linenumber FROM customer,orders,lineitem WHERE {w3}", f"SELECT c_custkey, o_orderkey, l_linenumber {three}")
    add("join_four", f"SELECT customer.c_custkey,orders.o_orderkey,lineitem.l_linenumber,part.p_name FROM customer,orders,lineitem,part WHERE {w4}", f"SELECT c_custkey, o_orderkey, l_linenumber, p_name {four}")
    add("join_star", "SELECT lineitem.l_orderkey,lineitem.l_linenumber,orders.o_orderpriority,part.p_brand,supplier.s_name FROM lineitem,orders,part,supplier WHERE lineitem.l_orderkey=orders.o_orderkey,lineitem.l_partkey=part.p_partkey,lineitem.l_suppkey=supplier.s_suppkey",
        "SELECT l_orderkey, l_linenumber, o_orderpriority, p_brand, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
    add("join_filter_pushdown", f'SELECT customer.c_nationkey,lineitem.l_extendedprice FROM customer,orders,lineitem,part WHERE {w4},part.p_size<"10",orders.o_totalprice>"100000",customer.c_nationkey<"12"', f"SELECT c_nationkey, l_extendedprice {four} WHERE p_size < 10 AND o_totalprice > 100000 AND c_nationkey < 12")
    for method in ("nested", "block_nested", "hash", "sort_merge"):
        add(f"join_{method}", "SELECT supplier.s_name,nation.n_name FROM supplier,nation WHERE supplier.s_nationkey=nation.n_nationkey", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", method)
    add("join_theta", "SELECT nation.n_name,region.r_name FROM nation,region WHERE nation.n_regionkey>region.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
    add("join_multi_cond", "SELECT customer.c_custkey,supplier.s_suppkey FROM customer,supplier WHERE customer.c_nationkey=supplier.s_nationkey,customer.c_acctbal<supplier.s_acctbal", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
    add("join_cycle", "SELECT customer.c_custkey,supplier.s_suppkey,nation.n_name FROM customer,supplier,nation WHERE customer.c_nationkey=supplier.s_nationkey,supplier.s_nationkey=nation.n_nationkey,customer.c_nationkey=nation.n_nationkey", "SELECT c_custkey, s_suppkey, n_name FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey")
    add("join_label_documents", 'SELECT documents.doc_id,documents.source,labels.quality FROM documents,labels WHERE documents.doc_id=labels.doc_id,labels.toxic="1"', "SELECT documents.doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
    add("cross_product", "SELECT region.r_name,nation.n_name FROM region,nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
    add("cross_disconnected", "SELECT customer.c_custkey,orders.o_orderkey,region.r_name FROM customer,orders,region WHERE customer.c_custkey=orders.o_custkey", f"SELECT c_custkey, o_orderkey, r_name {two} CROSS JOIN region")
    add("distinct_single", "SELECT DISTINCT customer.c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer")
    add("distinct_multi", "SELECT DISTINCT part.p_brand,part.p_size FROM part", "SELECT DISTINCT p_brand, p_size FROM part")
    add("distinct_star", "SELECT DISTINCT * FROM region", "SELECT DISTINCT * FROM region")
    add("distinct_join", "SELECT DISTINCT customer.c_nationkey FROM customer,orders WHERE customer.c_custkey=orders.o_custkey", f"SELECT DISTINCT c_nationkey {two}")
    add("groupby_keys", "SELECT lineitem.l_returnflag FROM lineitem GROUPBY lineitem.l_returnflag", "SELECT DISTINCT l_returnflag FROM lineitem")
    add("groupby_multi_keys", "SELECT lineitem.l_returnflag,lineitem.l_linestatus,lineitem.l_quantity FROM lineitem GROUPBY lineitem.l_returnflag,lineitem.l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
    add("groupby_join", "SELECT customer.c_mktsegment,orders.o_orderpriority FROM customer,orders WHERE customer.c_custkey=orders.o_custkey GROUPBY customer.c_mktsegment,orders.o_orderpriority", f"SELECT DISTINCT c_mktsegment, o_orderpriority {two}")
    for function, column in (("max", "l_extendedprice"), ("min", "l_shipdate"), ("sum", "l_quantity"), ("count", "l_partkey"), ("avg", "l_discount")):
        name, made = f"{function}_{column}", f"{function}({column})"
        rounded = (name,) if function in ("sum", "avg") else ()
        add(f"agg_{function}", f"SELECT lineitem.l_returnflag,{function.upper()}(lineitem.{column}) FROM lineitem GROUPBY lineitem.l_returnflag", f"SELECT l_returnflag, {f'round({made}, 2)' if rounded else made} AS {name} FROM lineitem GROUP BY l_returnflag", rounded=rounded)
    add("agg_global", "SELECT COUNT(orders.o_orderkey),MAX(orders.o_totalprice),MIN(orders.o_orderdate),AVG(orders.o_totalprice) FROM orders", "SELECT count(o_orderkey) AS count_o_orderkey, max(o_totalprice) AS max_o_totalprice, min(o_orderdate) AS min_o_orderdate, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders", rounded=("avg_o_totalprice",))
    add("agg_sum_int", "SELECT part.p_brand,SUM(part.p_size) FROM part GROUPBY part.p_brand", "SELECT p_brand, sum(p_size)::BIGINT AS sum_p_size FROM part GROUP BY p_brand")
    add("agg_join_group", f'SELECT customer.c_mktsegment,MAX(lineitem.l_extendedprice) FROM customer,orders,lineitem,part WHERE {w4},part.p_size<"25" GROUPBY customer.c_mktsegment ORDERBY customer.c_mktsegment', f"SELECT c_mktsegment, max(l_extendedprice) AS max_l_extendedprice {four} WHERE p_size < 25 GROUP BY c_mktsegment")
    add("agg_events", "SELECT events.event_type,COUNT(events.event_id),AVG(events.value) FROM events GROUPBY events.event_type", "SELECT event_type, count(event_id) AS count_event_id, round(avg(value), 2) AS avg_value FROM events GROUP BY event_type", rounded=("avg_value",))
    add("orderby", 'SELECT orders.o_orderkey FROM orders WHERE orders.o_totalprice>"400000" ORDERBY orders.o_totalprice,orders.o_orderkey', "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice, o_orderkey")
    add("groupby_orderby", "SELECT part.p_brand,COUNT(part.p_partkey) FROM part GROUPBY part.p_brand ORDERBY COUNT(part.p_partkey),part.p_brand", "SELECT p_brand, count(p_partkey) AS count_p_partkey FROM part GROUP BY p_brand ORDER BY 2, 1")
    add("distinct_orderby", "SELECT DISTINCT part.p_size FROM part ORDERBY part.p_size", "SELECT DISTINCT p_size FROM part ORDER BY p_size")
    return out


SUITE = _cases()
FLAGSHIP = "agg_join_group"


def run_query(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A registered query over folder/<table>.parquet."""
    case = SUITE[name]
    engine = Engine(spark, Catalog(spark))
    query = engine.parse(case.text)
    engine.catalog.parquet(folder, *query.tables)
    df = engine.dataframe(query, case.method)
    return df.withColumns({c: F.round(c, 2) for c in case.rounded})
