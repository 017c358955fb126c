"""python -m prismcube.cli prepare | run | baseline | profile | validate"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from prismcube.engine import Engine
from prismcube.errors import CubeError
from prismcube.model import AD_EVENTS
from prismcube.operators import profile
from prismcube.plans.spec import parse
from prismcube.sources import events as sources
from prismcube.sources import queries as documents


def session() -> SparkSession:
    return SparkSession.builder.appName("prismcube").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="prismcube")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare", help="build rollups and detail rows from CSV parts")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--warehouse", "--rollup-dir", required=True)
    p.add_argument("--method", choices=("lattice", "grouping_sets", "direct"), default="lattice")
    p.add_argument("--partition-minutes", action="store_true")
    p.add_argument("--strict", action="store_true")
    p = sub.add_parser("run", help="answer queries from a warehouse")
    p.add_argument("--warehouse", "--rollup-dir", required=True)
    p.add_argument("--query-file")
    p.add_argument("--query-dir")
    p.add_argument("--output-dir", default="results")
    p.add_argument("--route", default="auto")
    p = sub.add_parser("baseline", help="answer queries from CSV parts, without a warehouse")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--query-file")
    p.add_argument("--queries-dir", "--query-dir", dest="query_dir")
    p.add_argument("--output-dir", "--out-dir", default="results")
    p = sub.add_parser("profile", help="describe data and workload")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--query-dir")
    p.add_argument("--sample", type=float)
    p = sub.add_parser("validate", help="check a warehouse")
    p.add_argument("--warehouse", "--rollup-dir", required=True)
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = session()
    try:
        return {"prepare": prepare, "run": run, "baseline": baseline, "profile": describe, "validate": validate}[a.command](spark, a)
    except CubeError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


def prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    events = sources.read_csv(spark, a.data_dir, AD_EVENTS, strict=a.strict)
    for name, rows in Engine(spark, path=a.warehouse).prepare(events, method=a.method, partition_minutes=a.partition_minutes).items():
        print(f"{name}\t{rows}")
    return 0


def _report(outcomes: list) -> int:
    for o in outcomes:
        print(f"{o.name}\t{o.table or '-'}\t{'-' if o.rows is None else o.rows}\t{o.seconds:.3f} s\t{o.error or 'ok'}")
    failed = sum(o.error is not None for o in outcomes)
    print(f"{len(outcomes) - failed} of {len(outcomes)} answered in {sum(o.seconds for o in outcomes):.3f} s")
    return 1 if failed else 0


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    engine = Engine(spark, path=a.warehouse)
    engine.preload()
    return _report(engine.run_batch(documents.load(a.query_file, a.query_dir), a.output_dir, route=a.route))


def baseline(spark: SparkSession, a: argparse.Namespace) -> int:
    engine = Engine.frames(spark, sources.read_csv(spark, a.data_dir, AD_EVENTS, "events_part_*.csv"))
    return _report(engine.run_batch(documents.load(a.query_file, a.query_dir), a.output_dir, "_result.csv", route="detail"))


def describe(spark: SparkSession, a: argparse.Namespace) -> int:
    rows, factor = sources.read_csv(spark, a.data_dir, AD_EVENTS), 1.0
    if a.sample:
        rows, factor = sources.row_sample(rows, a.sample)
    found = profile.summary(rows, AD_EVENTS)
    print({**found, "rows": round(found["rows"] * factor)})
    each = profile.columns(rows).collect()
    for r in each:
        print(f"{r.name}\t{r.distinct} values\t{r.null_pct or 0:.1f} % null")
    if a.query_dir:
        w = profile.workload([parse(q, AD_EVENTS) for _, q in documents.load(folder=a.query_dir)], AD_EVENTS)
        for line in profile.advice(w, {r.name: (r.distinct, r.null_pct or 0) for r in each}, AD_EVENTS):
            print(line)
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    checks = Engine(spark, path=a.warehouse).validate()
    for what, passed, note in checks:
        print(f"{'ok' if passed else 'FAILED'}\t{what}\t{note}")
    return 0 if all(passed for _, passed, _ in checks) else 1


if __name__ == "__main__":
    sys.exit(main())
