"""Command line: ``python -m tessera.cli [-v] [-d ROOT] ambiguity|evaluate|plot-tensorboard ...``"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import AmbiguityConfig, ConfigError, EvaluationConfig, load
from .operators.matching import ORDERS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Entity-resolution analytics on Spark.")
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("-d", "--root-dir", default=".")
    commands = top.add_subparsers(dest="command", required=True)

    ambiguity = commands.add_parser("ambiguity").add_subparsers(dest="action", required=True)
    for name in ("generate", "analyse"):
        p = ambiguity.add_parser(name)
        p.add_argument("-c", "--config", required=True)
        p.add_argument("-O", "--output-dir", "--plot-dir", dest="out", required=True)

    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("-f", "--config", required=True)
    actions = evaluate.add_subparsers(dest="action", required=True)
    for name in ("matching", "clustering", "confusion-matrix", "asymmetry"):
        p = actions.add_parser(name)
        p.add_argument("-R", "-o", "-O", "--results-dir", "--output-dir", dest="out", required=True)
        if name != "asymmetry":
            p.add_argument("-i", "--input-order", action="append", choices=ORDERS, dest="orders")
        if name == "matching":
            p.add_argument("--degrade-directional-labels", action="store_true", dest="degrade")
            p.add_argument("--skip-existing", action="store_true")
            p.add_argument("--graph-plots", metavar="FOLDER", help="tables of the graphs' charts")
        if name == "clustering":
            p.add_argument("--cluster-plots", metavar="FOLDER", help="tables of the clusterings' charts")
        if name in ("matching", "clustering"):
            p.add_argument("--plot-dpi", type=int, help="kept for scripts; charts come as tables")
        p.add_argument("-s", "--stats-file")
        p.add_argument("-w", "--workers", type=int, help="kept for scripts; Spark's partitions take its place")

    plot = commands.add_parser("plot-tensorboard")
    plot.add_argument("-O", "--output-dir", dest="out", required=True)
    plot.add_argument("-c", "--config", required=True, help="JSON: logs, models (name to feature folder), window")
    return top


def resolve(path: str, root: str) -> str:
    """A path against the root directory; absolute ones and those of other stores as they are."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.WARNING - 10 * min(args.verbose, 2))
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    root, out = args.root_dir, resolve(args.out, args.root_dir)
    path = resolve(args.config, root)
    try:
        if args.command == "ambiguity":
            from .plans import ambiguity

            config = load(spark, path, AmbiguityConfig)
            getattr(ambiguity, args.action)(spark, config, out, root)
        elif args.command == "evaluate":
            from .plans import evaluation

            config = load(spark, path, EvaluationConfig)
            options = {"root": root} | ({"orders": args.orders or (ORDERS[0],)} if args.action != "asymmetry" else {})
            if args.action == "matching":
                options |= {"degrade": args.degrade, "skip_existing": args.skip_existing, "graph_plots": args.graph_plots and resolve(args.graph_plots, root)}
            if args.action == "clustering":
                options["cluster_plots"] = args.cluster_plots and resolve(args.cluster_plots, root)
            stats = getattr(evaluation, args.action.replace("-", "_"))(spark, config, out, **options)
            if args.stats_file:
                stats.coalesce(1).write.mode("overwrite").csv(resolve(args.stats_file, root), header=True)
        else:
            import json

            from .plans.evaluation import scalar_table

            settings = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
            table = scalar_table(spark, resolve(settings["logs"], root), settings["models"], settings.get("window", 5))
            table.coalesce(1).write.mode("overwrite").csv(f"{out}/scalars.csv", header=True)
    except ConfigError as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
