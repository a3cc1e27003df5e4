"""``python -m facetmill.cli [folder] [--candidate-details ID]``: analyse a folder below ``assets``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from facetmill.plans import reports
from facetmill.plans.pipeline import Analysis
from facetmill.sources import scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="facetmill", description="Analyse variant-annotated sources.")
    p.add_argument("folder", nargs="?", help="folder below the assets folder; asked for if left out")
    p.add_argument("--candidate-details", metavar="ID", help="show one candidate, FEC-... or AFEC-...")
    p.add_argument("--root", default=".", help="where the assets folder is")
    p.add_argument("--output", default="output", help="where reports go")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    sub = args.folder if args.folder is not None else input(f"{scan.base_directory_display(args.root)}/")
    try:
        project = scan.resolve_project(args.root, sub)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("facetmill").getOrCreate()
    a = Analysis.of(spark, str(project.path))
    a.export(args.output)
    reports.show(spark, a)
    if args.candidate_details:
        try:
            found = reports.detail_text(a, args.candidate_details)
        except ValueError:
            print(f"Candidate not found: {args.candidate_details}")
            return 0
        for r in found.orderBy("n").toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
