"""Command line: spark-submit a thin entry that calls main()."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftwood.config import Flags
from siftwood.plans import engine, render
from siftwood.plans.analyzers import capabilities
from siftwood.runtime import setup_logging
from siftwood.sources.sinks import extract


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftwood", description="Triage of mails and files")
    parser.add_argument("files", nargs="*")
    parser.add_argument("--check", action="store_true", help="tell what can be analysed here")
    parser.add_argument("-x", "--extract", action="store_true")
    parser.add_argument("-f", "--filenames", action="store_true", help="extract under the files' own names")
    parser.add_argument("-o", "--output", default="extracted", help="folder to extract to")
    parser.add_argument("--format", default="text")
    parser.add_argument("-v", "--verbosity", type=int, default=0)
    parser.add_argument("-d", "--debug", action="store_true")
    parser.add_argument("--defang", action="store_true")
    parser.add_argument("--yara", dest="yara_rules_dir", help="a folder of rule files")
    parser.add_argument("--network-policy", default="passive", choices=("passive", "online"))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.check:
        capabilities(spark).show(100, truncate=False)
        return 0
    flags = Flags.from_session(spark).update({"debug": args.debug, "defang": args.defang, "network_policy": args.network_policy} | ({"yara_rules_dir": args.yara_rules_dir} if args.yara_rules_dir else {}))
    log = setup_logging(spark, flags.debug)
    render.get_renderer(args.format)
    for path in args.files:
        log.debug("analysing %s", path)
        result = engine.analyze(spark, path, flags)
        for row in render.render(result, args.format, args.verbosity, flags.defang).toLocalIterator():
            print(row["rendered"])
        if args.extract:
            extract(result.nodes, args.output, args.filenames).count()
    return 0
