"""Command line: train, calibrate, detect, check."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from pixeltide.plans import verbs as V
from pixeltide.sources import models as M


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pixeltide")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, extra in (("train", ["--cube", "--config", "--out"]), ("calibrate", ["--cube", "--config", "--model"]), ("detect", ["--cube", "--config", "--model", "--out"]), ("check", ["--folder", "--manifest"])):
        one = verbs.add_parser(name)
        for flag in extra:
            one.add_argument(flag, required=True)
        if name == "detect":
            one.add_argument("--created", default="1970-01-01T00:00:00Z")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"pixeltide-{args.verb}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "check":
        problems = V.check(spark, args.folder, args.manifest)
        rows = V.E.first_errors(problems).collect()
        print(json.dumps({r["status"]: {"n": r["n"], "first": r["first"]} for r in rows}))
        return int(bool(rows))
    config, cube = V.Config.from_yaml(args.config), spark.read.parquet(args.cube)
    if args.verb == "train":
        meta, coef = V.train(cube, config)
        M.write_model(args.out, meta, coef)
        return 0
    meta, coef = M.read_model(spark, args.model)
    M.check_contract(meta, len(config.bands))
    if args.verb == "calibrate":
        profile, audit = V.calibrate(cube, V.predictor(meta, coef), config)
        M.embed_profile(args.model, profile)
        audit.write.mode("overwrite").json(f"{args.model}/audit")
        return 0
    profile = spark.read.schema(M.PROFILE_SCHEMA).json(f"{args.model}/profile")
    decided = V.detect(cube, V.predictor(meta, coef), profile, config)
    decided.write.mode("overwrite").parquet(f"{args.out}/decided")
    summary = V.summarised(spark.read.parquet(f"{args.out}/decided"), config)
    M.alerts(summary, args.created).select("alert").write.mode("overwrite").text(f"{args.out}/alerts")
    M.batch_summary(summary).coalesce(1).write.mode("overwrite").json(f"{args.out}/summary")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
