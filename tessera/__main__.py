"""python -m tessera QUERY_FILE RESULT_FILE --tables FOLDER [--method METHOD] [--explain] [--distributed]

or python -m tessera generate NAME ROWS --tables FOLDER [--seed N]: FOLDER/NAME.txt and NAME.stat after NAME.det"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .api import Engine
from .errors import QueryError
from .sources.catalog import Catalog
from .sources.files import read_small
from .sources.generator import generate_table


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["generate"]:
        return generate_main(argv[1:])
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("query")
    p.add_argument("result")
    p.add_argument("--tables", default=".", help="folder of <table>.parquet, or <table>.det with <table>.txt")
    p.add_argument("--method", help="nested, block_nested, hash or sort_merge")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--distributed", action="store_true", help="the executors write RESULT_FILE as a folder")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    catalog = Catalog(spark)
    try:
        engine = Engine(spark, catalog)
        query = engine.parse(read_small(spark, args.query))
        catalog.open(args.tables, *query.tables)
        if args.explain:
            print(engine.explain(query, args.method))
        began = time.monotonic()
        if args.distributed:
            engine.write(query, args.result, args.method)
            print(f"written in {time.monotonic() - began:.3f} s")
            return 0
        rows = engine.run(query, args.result, args.method)
    except QueryError as e:
        print(f"{type(e).__name__}: {e}")
        return 1
    print(f"{rows} rows in {time.monotonic() - began:.3f} s")
    return 0


def generate_main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tessera generate")
    p.add_argument("name")
    p.add_argument("rows", type=int)
    p.add_argument("--tables", default=".")
    p.add_argument("--seed", type=int, default=0)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        stats = generate_table(spark, args.tables, args.name, args.rows, args.seed)
    except QueryError as e:
        print(f"{type(e).__name__}: {e}")
        return 1
    print(f"{stats.rows} rows; distinct values: {', '.join(f'{c} {n}' for c, n in stats.distinct.items())}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
