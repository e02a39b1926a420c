"""Run registered queries against their SQL on the same parquet files.

    python -m checks.compare [--sf DIR] [--only NAME,NAME] [--group GROUP]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import glob
import os
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb

from checks import registry


def _cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, float):
        return "f:nan" if value != value else f"f:{value:.9g}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, dt.datetime):
        return f"t:{value.replace(tzinfo=None).isoformat()}"
    if isinstance(value, dt.date):
        return f"d:{value.isoformat()}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return f"s:{value}"


def canonical_rows(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(_cell(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir: str, name: str, query, oracle: str | None) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, sf_dir)
    mine = canonical_rows(frame.columns, frame.collect())
    took = time.time() - started
    if oracle is None:
        return True, f"rows={len(mine)} no-oracle {took:.2f}s"
    cursor = con.execute(oracle)
    columns = [d[0] for d in cursor.description]
    theirs = canonical_rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3]
        missing = [r for r in theirs if r not in set(mine)][:3]
        return False, f"rows {len(mine)} vs {len(theirs)}\n   mine   {extra}\n   theirs {missing}"
    note = "" if mine else "  EMPTY"
    return True, f"rows={len(mine)} {took:.2f}s{note}"


def main() -> int:
    from fleetlens.session import get_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--group", default="")
    parser.add_argument("--threads", type=int, default=4)
    args = parser.parse_args()
    if args.group:
        registry.GROUPS[:] = args.group.split(",")
    queries, oracle = registry.merged("QUERIES"), registry.merged("ORACLE")
    names = args.only.split(",") if args.only else list(queries)
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(args.sf), []

    def check(name: str) -> None:
        try:
            ok, note = compare(spark, con.cursor(), args.sf, name, queries[name], oracle.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
        if not ok:
            failed.append(name)

    with ThreadPoolExecutor(args.threads) as pool:
        list(pool.map(check, names))
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
