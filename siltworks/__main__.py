"""Command line: prepare a corpus, diagnose a prepared folder, show the step budget of a run."""

from __future__ import annotations

import argparse
import json

from siltworks import config as cfg


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltworks", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("prepare", help="documents (Parquet) to datasets")
    one.add_argument("documents")
    one.add_argument("folder")
    one.add_argument("--config", help="a preparation configuration, JSON or YAML")
    one.add_argument("--dataset", default="corpus")
    one.add_argument("--version", default="1")
    one.add_argument("--restart", action="store_true")
    two = commands.add_parser("diagnose", help="verify the datasets of a folder and sum them up")
    two.add_argument("folder")
    three = commands.add_parser("budget", help="optimizer steps of a run")
    three.add_argument("config")
    three.add_argument("--accumulate", type=int, default=1)
    three.add_argument("--world", type=int, default=1)
    three.add_argument("--target-tokens", type=cfg.token_count)
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from siltworks.plans import loader, prepare
    from siltworks.sources import sinks
    from siltworks.sources.files import Files

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("siltworks").getOrCreate()
    if args.command == "prepare":
        settings = cfg.build(cfg.Preparation, cfg.read(args.config)) if args.config else cfg.Preparation()
        out = prepare.prepare(spark, spark.read.parquet(args.documents), args.folder, args.dataset, args.version, settings, args.restart)
    elif args.command == "diagnose":
        out = {}
        for split in prepare.SPLITS:
            if Files(spark).exists(f"{args.folder}/{split}"):
                m = sinks.verify(spark, f"{args.folder}/{split}")
                out[split] = {"samples": m["sample_count"], "shards": len(m["shards"]), **m["metadata"]}
    else:
        out = loader.budget(spark, cfg.Data.from_mapping(cfg.read(args.config)), args.accumulate, args.world, args.target_tokens)
    print(json.dumps(out, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
