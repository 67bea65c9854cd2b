"""python -m terradelta run BEFORE AFTER OUT | synthetic OUT | evaluate BEFORE AFTER REFERENCE OUT | robustness OUT | demos OUT"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .config import config_of
from .plans import evaluate
from .plans.run import AlignmentError, ValidationError, run_pipeline


def settings(path: str | None):
    if not path:
        return config_of(None)
    with open(path) as f:
        if path.endswith(".json"):
            return config_of(json.load(f))
        import yaml  # only for settings in YAML

        return config_of(yaml.safe_load(f))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="terradelta")
    sub = p.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run")
    for x in ("before", "after", "out"):
        run.add_argument(x)
    run.add_argument("--name")
    run.add_argument("--mode", choices=("emergency", "enforcement"))
    run.add_argument("--allow-misaligned", action="store_true")
    run.add_argument("--auto-correct", action=argparse.BooleanOptionalAction)
    run.add_argument("--bands", type=json.loads, help='band numbers by name, as {"red": 1, "nir": 4}')
    run.add_argument("--context", action="append", default=[], metavar="NAME=PATH")
    made = sub.add_parser("synthetic")
    made.add_argument("out")
    made.add_argument("--size", type=int, default=512)
    made.add_argument("--shift", type=int, default=0)
    for x in ("season", "no-data", "converted", "road"):
        made.add_argument(f"--{x}", action="store_true")
    test = sub.add_parser("evaluate")
    for x in ("before", "after", "reference", "out"):
        test.add_argument(x)
    for x in ("robustness", "demos"):
        sub.add_parser(x).add_argument("out")
    for x in (run, test):
        x.add_argument("--config")
    o = p.parse_args(argv)

    spark = SparkSession.builder.appName("terradelta").getOrCreate()
    try:
        if o.what == "run":
            got = run_pipeline(spark, o.before, o.after, o.out, settings(o.config), o.name, o.mode, o.allow_misaligned, o.auto_correct, o.bands, dict(x.split("=", 1) for x in o.context))
            print(json.dumps({"folder": got.folder, "counts": got.counts, "warnings": got.warnings}, default=str))
        elif o.what == "synthetic":
            print(json.dumps(evaluate.write_synthetic_pair(spark, o.out, o.size, o.shift, season=o.season, no_data=o.no_data, converted=o.converted, road=o.road)))
        elif o.what == "evaluate":
            evaluate.evaluate(spark, o.before, o.after, o.reference, o.out, settings(o.config)).show(truncate=False)
        elif o.what == "demos":
            evaluate.failure_demos(spark, o.out).show(truncate=False)
        else:
            evaluate.shift_robustness(spark, o.out).show(truncate=False)
    except (ValidationError, AlignmentError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
