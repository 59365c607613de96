"""spark-submit entry: python -m quakeledger.cli audit|prepare ... (see --help)."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quakeledger")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="audit canonical CSV or Parquet catalogs")
    a.add_argument("input", nargs="+")
    a.add_argument("--out", help="folder for the verdicts as JSON")
    a.add_argument("--reference", help="Parquet or CSV with source_id and the canonical columns")
    a.add_argument("--faults", help="GeoJSON with fault traces")
    a.add_argument("--admit", type=float, default=0.75)
    a.add_argument("--reject", type=float, default=0.20)
    a.add_argument("--dimension", type=float, help="reference correlation dimension")
    a.add_argument("--replicates", type=int, default=0, help="also audit so many resampled replicates of each catalog")
    r = sub.add_parser("prepare", help="bring a raw CSV into canonical columns")
    r.add_argument("input")
    r.add_argument("out")
    r.add_argument("--catalog", required=True)
    r.add_argument("--column", action="append", default=[], metavar="CANONICAL=HEADER")
    r.add_argument("--date")
    r.add_argument("--time")
    return p


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quakeledger.audit import Audit
    from quakeledger.catalog import canonical, seconds
    from quakeledger.operators.decision import Thresholds
    from quakeledger.operators.generators import resampled
    from quakeledger.operators.interval import densify
    from quakeledger.operators.studies import uncertainty
    from quakeledger.runtime import checkpoint, fetch_bounded
    from quakeledger.sources import files

    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    read = lambda paths: canonical(spark.read.parquet(*paths)) if paths[0].rstrip("/").endswith(".parquet") else files.read_csv(spark, paths)
    if args.command == "prepare":
        rows, bad = files.read_raw_csv(spark, args.input)
        pair = (args.date, args.time) if args.date and args.time else None
        files.write_csv(files.prepare(rows, args.catalog, dict(c.split("=", 1) for c in args.column), pair), args.out)
        print(f"{bad.count()} lines didn't fit the header and were left out")
        return 0
    references = None
    if args.reference:
        raw = spark.read.parquet(args.reference) if args.reference.rstrip("/").endswith(".parquet") else spark.read.csv(args.reference, header=True, inferSchema=True)
        references = raw.select("source_id", seconds().alias("t"), *(F.col(c).cast("double").alias(c) for c in ("latitude", "longitude", "magnitude")))
    faults = densify(files.read_geojson_faults(spark, args.faults), "line", "i") if args.faults else None
    audit = Audit(references, faults, args.dimension, Thresholds(admit=args.admit, reject=args.reject))
    cat = read(args.input).withColumn("t", seconds())
    documents = checkpoint(audit.documents(cat))
    for row in fetch_bounded(files.report_text(documents).orderBy("catalog_id"), 10_000, "the report"):
        print(row["value"])
    if args.out:
        files.as_json(documents.select("document.*")).write.mode("overwrite").text(f"{args.out}/verdicts")
        if args.replicates:
            files.as_json(uncertainty(audit.verdicts(resampled(cat, args.replicates)))).write.mode("overwrite").text(f"{args.out}/uncertainty")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
