"""Outcome metrics of recorded tool calls from the command line: python -m tessera.metrics query TABLE [--tool T] [--since 30d] [--json]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from tessera.functions.scalars import since_days
from tessera.operators.sync import outcome_metrics
from tessera.session import build


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera.metrics")
    q = p.add_subparsers(dest="command", required=True).add_parser("query")
    q.add_argument("table", help="the Parquet table that record_calls() appends to")
    q.add_argument("--tool")
    q.add_argument("--since", type=since_days, help="days, as 30d")
    q.add_argument("--json", action="store_true")
    a = p.parse_args(args)
    calls = build("metrics").read.parquet(a.table)
    since = None if a.since is None else F.current_timestamp() - F.make_dt_interval(F.lit(a.since))
    rows = [r.asDict() for r in outcome_metrics(calls, since, a.tool).orderBy("tool_name").collect()]
    if a.json:
        print(json.dumps(rows))
    else:
        for r in rows:
            print("  ".join(f"{k}={v}" for k, v in r.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
