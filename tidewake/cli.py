"""Command line: predictions from a Parquet or CSV file to another."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewake", description="Vessel-track analytics on Spark")
    sub = p.add_subparsers(dest="cmd")
    for name, about in (("effort", "tell which points are fishing"), ("gear", "tell each trip's gear by a saved model"), ("vessel", "tell each trip's kind of vessel by a saved model")):
        one = sub.add_parser(name, help=about).add_subparsers(dest="action").add_parser("predict")
        one.add_argument("--input", required=True, help="Parquet or CSV with track points or trips")
        one.add_argument("--output", required=True, help="Parquet or CSV to write")
        one.add_argument("--model", help="a saved model; effort predicts by rules without one")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.cmd or getattr(args, "action", None) != "predict":
        p.print_help()
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.columns import as_points
    from .operators.ml import EffortForest, GearModel, VesselModel
    from .plans.effort import predict_fishing_effort
    from .sources.files import read_table, write_table

    spark = SparkSession.builder.appName("tidewake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = read_table(spark, args.input)
    if args.cmd == "effort":
        out = EffortForest.load(args.model).predict(as_points(df)) if args.model else predict_fishing_effort(df)
    elif not args.model:
        p.error(f"{args.cmd} predict needs --model")
    else:
        out = (GearModel if args.cmd == "gear" else VesselModel).load(args.model).predict(df)
    if args.output.lower().endswith(".csv") and "vessel_type_prob" in out.columns:
        out = out.withColumn("vessel_type_prob", F.to_json("vessel_type_prob"))
    write_table(out, args.output)
    print(f"wrote {args.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
