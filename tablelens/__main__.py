"""Command line: the reference's upload -> dashboard flow for one file.

    python -m tablelens data.csv [--template Sales] [--no-insights]
    python -m tablelens data.parquet

Reads the table (CSV with the NA-word and type inference of
``sources.files.read_csv``, or Parquet), profiles it, computes KPI cards, chart
datasets and the insight report, and prints one JSON document.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tablelens")
    ap.add_argument("path")
    ap.add_argument("--template", default=None, choices=["Sales", "Finance", "HR", "Marketing", "Auto"])
    ap.add_argument("--no-insights", action="store_true")
    ap.add_argument("--quality", action="store_true", help="add the data-quality page")
    ap.add_argument("--approx", action="store_true", help="sketch distinct counts and quartiles (huge tables)")
    ap.add_argument("--master", default=None, help="Spark master when no session exists (default local[*])")
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from tablelens.plans.report import EmptyTableError, collect_all, dashboard, quality_page
    from tablelens.session import get_spark
    from tablelens.sources.files import read_csv, read_parquet

    spark = SparkSession.getActiveSession() or get_spark(master=a.master or "local[*]")
    df = read_csv(spark, a.path) if a.path.lower().endswith(".csv") else read_parquet(spark, a.path)
    try:
        d = dashboard(df, template=a.template, with_insights=not a.no_insights, approx=a.approx)
    except EmptyTableError as e:
        print(json.dumps({"error": str(e)}))
        return 1
    frames = d.frames()
    if a.quality:
        frames.update({f"quality_{k}": v for k, v in quality_page(d).items()})
    res = collect_all(frames)
    p = d.profile
    out = {"profile": {"rows": p.rows, "columns": p.columns, "roles": p.roles, "dataset_type": p.dataset_type,
                       "primary_measure": p.primary_measure, "semantic_roles": p.semantic_roles,
                       "missing_pct": p.missing_pct},
           **{k: [r.asDict() for r in v] for k, v in res.items()}}
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
