"""python -m kindred list | sql NAME | explain NAME FOLDER | run NAME FOLDER [OUT]"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from kindred.plans.registry import ORACLES, QUERIES

    parser = argparse.ArgumentParser(prog="kindred", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    sub.add_parser("sql", help="a query as DuckDB SQL").add_argument("name", choices=sorted(ORACLES))
    for command in ("explain", "run"):
        p = sub.add_parser(command)
        p.add_argument("name", choices=sorted(QUERIES))
        p.add_argument("folder", help="where the tables are")
        if command == "run":
            p.add_argument("out", nargs="?", help="Parquet to write, which must not exist; else rows are shown")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
    elif args.command == "sql":
        print(ORACLES[args.name])
    else:
        from pyspark.sql import SparkSession

        from kindred.ship import ship
        from kindred.sources.readers import write_once

        spark = SparkSession.builder.appName("kindred").getOrCreate()
        ship(spark)
        df = QUERIES[args.name](spark, args.folder)
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            write_once(df, args.out)
        else:
            df.show(truncate=False)


if __name__ == "__main__":
    main()
