import re
from pathlib import Path

import duckdb
import pytest

from tessera.api import Engine
from tessera.errors import QueryError
from tessera.plans.suite import SUITE, run_query
from tessera.sources.catalog import Catalog
from tessera.sources.generator import generate, is_key, statistics
from tessera.sources.schema import parse_spec
from tessera.sources.text import read_text, write_table

DATA = Path("/root/testdata/sf0.001")
FIXTURES = Path(__file__).parent / "fixtures"
WHERE = "PERSON.pid=BASKET.pid,BASKET.bid=ITEM.bid,ITEM.iid=BILL.iid"
ALL = "PERSON,BASKET,ITEM,BILL"
SQL = "FROM PERSON JOIN BASKET USING (pid) JOIN ITEM USING (bid) JOIN BILL USING (iid)"

needs_data = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


def bag(rows, columns):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns))) for r in rows)


@needs_data
@pytest.mark.parametrize("name", list(SUITE))
def test_suite_matches_sql(spark, name):
    case, con = SUITE[name], duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(case.oracle)
    got = run_query(spark, str(DATA), name)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    wanted = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert bag([r.asDict() for r in got.collect()], columns) == bag(wanted, columns)


TABLES = {"PERSON": "pid INT, club INT, name VARCHAR", "BASKET": "bid INT, pid INT, status VARCHAR", "ITEM": "iid INT, bid INT, qty INT", "BILL": "kid INT, iid INT, amount INT, rate FLOAT"}


@pytest.fixture(scope="module")
def shop(spark):
    return Engine(spark, Catalog(spark).text(str(FIXTURES), *TABLES))


@pytest.fixture(scope="module")
def shop_sql():
    con = duckdb.connect()
    for name, columns in TABLES.items():
        con.sql(f"CREATE TABLE {name} ({columns})")
        rows = [line.split() for line in (FIXTURES / f"{name}.txt").read_text().split("\n")]
        con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)
    return con


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("SELECT * FROM PERSON", "SELECT * FROM PERSON"),
        ('SELECT PERSON.name,PERSON.pid FROM PERSON WHERE PERSON.club="1"', "SELECT name, pid FROM PERSON WHERE club = 1"),
        ('SELECT BASKET.bid FROM BASKET WHERE BASKET.status>="new",BASKET.bid<"70"', "SELECT bid FROM BASKET WHERE status >= 'new' AND bid < 70"),
        ('SELECT BILL.kid,BILL.rate FROM BILL WHERE BILL.rate<="1.75"', "SELECT kid, rate FROM BILL WHERE rate <= 1.75"),
        ("SELECT BASKET.bid,PERSON.name FROM PERSON,BASKET WHERE PERSON.pid=BASKET.pid", "SELECT bid, name FROM PERSON JOIN BASKET USING (pid)"),
        (f"SELECT PERSON.name,BASKET.status,ITEM.qty,BILL.amount FROM {ALL} WHERE {WHERE}", f"SELECT name, status, qty, amount {SQL}"),
        (f'SELECT PERSON.club,BILL.amount FROM {ALL} WHERE {WHERE},BILL.amount<"900"', f"SELECT club, amount {SQL} WHERE amount < 900"),
        (f'SELECT PERSON.club,MAX(BILL.amount),AVG(BILL.rate) FROM {ALL} WHERE {WHERE} GROUPBY PERSON.club ORDERBY PERSON.club', f"SELECT club, max(amount) AS max_amount, avg(rate) AS avg_rate {SQL} GROUP BY club"),
        ("SELECT DISTINCT PERSON.club FROM PERSON", "SELECT DISTINCT club FROM PERSON"),
        ("SELECT ITEM.bid,ITEM.qty FROM ITEM GROUPBY ITEM.qty", "SELECT DISTINCT qty FROM ITEM"),
        ("SELECT PERSON.pid,ITEM.iid,BILL.kid FROM PERSON,ITEM,BILL WHERE ITEM.iid=BILL.iid,PERSON.club<BILL.rate", "SELECT pid, ITEM.iid, kid FROM ITEM JOIN BILL USING (iid) JOIN PERSON ON club < rate"),
    ],
)
def test_text_tables(shop, shop_sql, text, sql):
    want = shop_sql.sql(sql)
    wanted = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = shop.sql(text)
    assert sorted(got.columns) == sorted(want.columns) and wanted
    assert bag([r.asDict() for r in got.collect()], want.columns) == bag(wanted, want.columns)


def test_rows_come_in_the_order_of_orderby(shop, shop_sql):
    text = f"SELECT BILL.amount,BILL.kid,PERSON.name FROM {ALL} WHERE {WHERE} ORDERBY BILL.amount,BILL.kid"
    assert [tuple(r) for r in shop.sql(text).collect()] == shop_sql.sql(f"SELECT amount, kid, name {SQL} ORDER BY amount, kid").fetchall()


def test_joins_begin_where_few_rows_are(shop):
    stats = shop.catalog.stats
    assert stats["ITEM"].rows == 90 and stats["ITEM"].distinct["iid"] == 90
    assert shop.explain(f'SELECT * FROM {ALL} WHERE {WHERE},BILL.kid="3"').split("\n")[1] == "join order: BILL ITEM BASKET PERSON"
    assert shop.explain(f'SELECT * FROM {ALL} WHERE {WHERE},PERSON.pid="3"').split("\n")[1] == "join order: PERSON BASKET ITEM BILL"
    plan = shop.explain('SELECT * FROM PERSON,ITEM,BILL WHERE ITEM.iid=BILL.iid,BILL.kid="1"')
    assert plan.split("\n")[1] == "join order: BILL ITEM x PERSON"


@needs_data
def test_filtered_small_table_joins_first(spark):
    engine = Engine(spark, Catalog(spark).parquet(str(DATA), "customer", "orders", "lineitem", "part"))
    text = SUITE["agg_join_group"].text
    assert "join order: part lineitem orders customer\n" in engine.explain(text)
    before = engine.sql(text).collect()
    engine.catalog.analyze("customer", "orders", "lineitem", "part")
    assert engine.catalog.stats["part"].rows == 200 and engine.sql(text).collect() == before
    assert "join order: part lineitem orders customer\n" in engine.explain(text)


def test_order_of_many_tables():
    from tessera.plans.ast import Column, Condition
    from tessera.plans.ordering import estimate, order
    from tessera.sources.statistics import TableStats

    names = [f"t{i}" for i in range(14)]
    joins = [Condition(Column(a, "k"), "=", Column(b, "k")) for a, b in zip(names, names[1:])]
    found = order(names, estimate({t: TableStats(1000 - i, {"k": 100}) for i, t in enumerate(names)}, {}, joins))
    assert sorted(found) == sorted(names) and found[0] == "t13"


def test_hints_of_large_sides_are_left_out(shop, monkeypatch):
    import tessera.operators.relational as relational

    text = "SELECT PERSON.pid,ITEM.iid FROM PERSON,ITEM WHERE PERSON.pid<=ITEM.iid"
    plan = lambda method: shop.dataframe(text, method)._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" in plan("block_nested") and "strategy=shuffle_replicate_nl" in plan("nested")
    monkeypatch.setattr(relational, "NESTED_BYTES", 0)
    monkeypatch.setattr(relational, "BROADCAST_BYTES", 0)
    assert "strategy=" not in plan("nested") + plan("block_nested")
    assert bag(shop.sql(text, "nested").collect(), ["pid", "iid"]) == bag(shop.sql(text).collect(), ["pid", "iid"])


def test_float_columns(spark):
    rows = [(1, 0.5), (2, float("nan")), (3, -0.0), (4, 0.0), (5, None), (6, 0.1)]
    engine = Engine(spark, {"F": spark.createDataFrame(rows, "i int, f float")})
    ids = lambda where: [r.i for r in engine.sql(f"SELECT F.i FROM F WHERE {where} ORDERBY F.i").collect()]
    # NaN is the largest value and equals itself; both zeros are equal; a literal takes the column's precision
    assert ids('F.f>"0.4"') == [1, 2] and ids('F.f="0"') == [3, 4] and ids('F.f="0.1"') == [6] and ids('F.f!="0.5"') == [2, 3, 4, 6] and ids('F.f="nan"') == [2]
    assert engine.sql("SELECT DISTINCT F.f FROM F").count() == 5
    assert [r.i for r in engine.sql("SELECT F.i FROM F ORDERBY F.f,F.i").collect()] == [5, 3, 4, 6, 1, 2]


@pytest.fixture
def small(spark):
    t = spark.createDataFrame([(1, "x", 1.5), (2, "y", None), (2, None, float("nan")), (None, "x", 2.0)], "a int, b string, r double")
    u = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, v bigint")
    return Engine(spark, {"T": t, "U": u})


def test_nulls_and_names(small):
    assert small.sql("SELECT T.a,U.a,U.v FROM T,U WHERE T.a=U.a").columns == ["T_a", "U_a", "v"]
    assert small.sql("SELECT T.a,U.a FROM T,U WHERE T.a=U.a").count() == 3
    assert small.sql('SELECT T.b FROM T WHERE T.b!="x"').collect() == [("y",)]
    assert small.sql("SELECT COUNT(T.b),SUM(U.v) FROM T,U").collect() == [(9, 240)]
    assert small.sql("SELECT T.b FROM T GROUPBY T.b").count() == 3
    assert [r.v for r in small.sql("SELECT U.v FROM U ORDERBY U.a").collect()] == [10, 20, 30]


@pytest.mark.parametrize("method", ["nested", "block_nested", "hash", "sort_merge"])
def test_methods_give_equal_bags(small, method):
    text = "SELECT T.a,U.v FROM T,U WHERE T.a<=U.a"
    assert bag(small.sql(text, method).collect(), ["a", "v"]) == bag(small.sql(text).collect(), ["a", "v"])
    with pytest.raises(QueryError):
        small.sql(text, "index")


def test_group_of_keys_is_distinct(small):
    assert bag(small.sql("SELECT T.a,T.b FROM T GROUPBY T.a,T.b").collect(), ["a", "b"]) == bag(small.sql("SELECT DISTINCT T.a,T.b FROM T").collect(), ["a", "b"])


def test_filter_order_does_not_matter(small):
    a = small.sql('SELECT * FROM T WHERE T.a>"1",T.b="y"').collect()
    assert a == small.sql('SELECT * FROM T WHERE T.b="y",T.a>"1"').collect() != []


def test_fluent_is_the_same_query(small):
    built = small.from_("T", "U").select("T.b", "MAX(U.v)").on("T.a", "=", "U.a").where("U.v", ">", 5).group_by("T.b").order_by("T.b")
    assert str(built.query) == 'SELECT T.b,MAX(U.v) FROM T,U WHERE T.a=U.a,U.v>"5" GROUPBY T.b ORDERBY T.b'
    assert built.dataframe().collect() == small.sql(str(built.query)).collect()


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    engine = Engine(spark, Catalog(spark).parquet(str(DATA), "customer", "orders"))
    plan = engine.explain('SELECT customer.c_name FROM customer,orders WHERE customer.c_custkey=orders.o_custkey,orders.o_totalprice<"5000"')
    assert re.search(r"PushedFilters: \[.*LessThan\(o_totalprice,5000.0\)", plan)
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double>", plan)


def test_result_file(small, tmp_path):
    assert small.run("SELECT T.a,T.b FROM T ORDERBY T.a", tmp_path / "out") == 4
    lines = (tmp_path / "out").read_text().split("\n")
    assert lines[0] == "T.a  T.b  " and lines[1] == "-NULL-\tx\t" and len(lines) == 6


def test_generator_and_loader(spark, tmp_path):
    spec = parse_spec("4\n30\nid INTEGER 50 PK 4\nn INTEGER 7 NK 4\ns STRING 6 NK 12\np REAL 3 NK 4")
    made = generate(spark, spec, 40, seed=3)
    rows = made.collect()
    assert rows == generate(spark, spec, 40, seed=3).collect() != generate(spark, spec, 40, seed=4).collect()
    assert is_key(made, "id") and all(0 <= r.id < 50 and 0 <= r.n < 7 and 0 <= r.p < 3 and re.fullmatch("[a-z]{6}", r.s) for r in rows)
    assert statistics(made)[0] == 40
    write_table(made, str(tmp_path / "t"))
    back = read_text(spark, str(tmp_path / "t"), spec.struct, "\t")
    assert bag(back.collect(), ["id", "n", "s"]) == bag(rows, ["id", "n", "s"])
    with pytest.raises(QueryError):
        generate(spark, spec, 51)


def test_command(spark, tmp_path, capsys):
    from tessera.__main__ import main

    (tmp_path / "T.det").write_text("3\n20\nid INTEGER 60 PK 4\nn INTEGER 5 NK 4\ns STRING 4 NK 8")
    assert main(["generate", "T", "40", "--tables", str(tmp_path), "--seed", "3"]) == 0
    assert (tmp_path / "T.stat").read_text().split()[:2] == ["40", "40"]
    (tmp_path / "q").write_text("SELECT T.n,COUNT(T.id) FROM T GROUPBY T.n ORDERBY T.n")
    assert main([str(tmp_path / "q"), str(tmp_path / "out"), "--tables", f"file://{tmp_path}", "--explain"]) == 0
    rows = [x.split() for x in (tmp_path / "out").read_text().split("\n")[1:-1]]
    assert sum(int(n) for _, n in rows) == 40 and [k for k, _ in rows] == sorted(k for k, _ in rows)
    assert main([str(tmp_path / "q"), str(tmp_path / "folder"), "--tables", str(tmp_path), "--distributed"]) == 0
    assert sorted(x.split() for p in (tmp_path / "folder").glob("part-*") for x in p.read_text().split("\n") if x) == sorted(rows)
    (tmp_path / "q").write_text("SELECT T.x FROM T")
    assert main([str(tmp_path / "q"), str(tmp_path / "out"), "--tables", str(tmp_path)]) == 1
    assert "UnknownColumn" in capsys.readouterr().out


@pytest.mark.parametrize("text", ["1_0", "٣", "0x1", "1e", ""])
def test_numbers_that_spark_does_not_cast(small, text):
    with pytest.raises(QueryError):
        small.sql(f'SELECT T.r FROM T WHERE T.r>"{text}"')


def test_stream_sinks(spark, tmp_path):
    from tessera.streaming.continuous import start

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 3 AS k FROM range(30)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long").parquet(str(tmp_path / "in"))
    engine = Engine(spark, {"S": stream})

    def run(text, **options):
        query = start(engine, text, "made", str(tmp_path / f"check{len(list(tmp_path.iterdir()))}"), **options)
        query.processAllAvailable()
        query.stop()

    run("SELECT S.k FROM S", sink="parquet", path=str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    run("SELECT S.ts,COUNT(S.k) FROM S GROUPBY S.ts", watermark=("ts", "5 minutes"))
    assert sorted(r.count_k for r in spark.table("made").collect()) == [1] * 30
    run("SELECT S.ts,COUNT(S.k) FROM S GROUPBY S.ts", watermark=("ts", "5 minutes"), sink="parquet", path=str(tmp_path / "groups"))
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 25  # those that the watermark has passed
    run("SELECT DISTINCT S.ts FROM S", watermark=("ts", "5 minutes"))
    assert spark.table("made").count() == 30
    for text, options in (("SELECT DISTINCT S.k FROM S", {}), ("SELECT S.k FROM S GROUPBY S.k", {}), ("SELECT S.k FROM S ORDERBY S.k", {}), ("SELECT S.k,COUNT(S.ts) FROM S GROUPBY S.k", {"sink": "parquet", "path": str(tmp_path / "no")})):
        with pytest.raises(QueryError):
            start(engine, text, "made", **options)


def test_stream(spark, tmp_path):
    from tessera.streaming.continuous import start

    spark.range(6).selectExpr("id % 2 AS k", "id AS v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
    query = start(Engine(spark, {"S": stream}), "SELECT S.k,SUM(S.v) FROM S GROUPBY S.k", "sums")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == [(0, 6), (1, 9)]


def test_joins_that_multiply_are_dealt_out(spark, tmp_path):
    """A join of few keys makes its result in many tasks, though its tables are one file each."""
    a, b = spark.range(600_000).selectExpr("id", "id % 25 as k"), spark.range(20_000).selectExpr("id", "id % 25 as k")
    for name, df in (("a", a), ("b", b), ("n", spark.range(25).selectExpr("id as k"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    engine = Engine(spark, Catalog(spark).parquet(str(tmp_path), "a", "b", "n"))
    df = engine.sql("SELECT a.id,b.id FROM a,b,n WHERE a.k=b.k,b.k=n.k,a.k=n.k")
    assert df.count() == 600_000 * 20_000 // 25
    assert df.rdd.getNumPartitions() > 4
