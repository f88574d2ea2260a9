"""Command line: clean, augment, index, export-order, queries, report.

    python -m wayquad clean IN OUT --format wkt --box 115.29 39.0 117.83 41.5 --least 10
    python -m wayquad export-order IN order.json --box ... --levels 8 --least 4
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayquad.functions.geometry import Grid
from wayquad.operators import augment, index, order, partition, report
from wayquad.sources import store
from wayquad.sources import trajectories as src


def _points(rows: DataFrame) -> DataFrame:
    return rows.select("tid", F.posexplode("points").alias("seq", "p")).select("tid", "seq", "p.x", "p.y")


def _placed(spark: SparkSession, args: argparse.Namespace, grid: Grid) -> DataFrame:
    own = index.assign(src.read_lines(spark, args.source).select("tid", "points"), grid)
    return index.signed(index.prune(own, grid, args.least), grid)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayquad", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("clean", "augment", "index", "export-order", "queries", "report"))
    parser.add_argument("source", help="text file or folder; the suffix tells the format")
    parser.add_argument("target")
    parser.add_argument("--box", nargs=4, type=float, default=(0.0, 0.0, 720.0, 600.0), metavar=("MIN_X", "MIN_Y", "MAX_X", "MAX_Y"))
    parser.add_argument("--format", choices=("txt", "geojson", "wkt", "raw"), default="txt")
    parser.add_argument("--levels", type=int, default=8)
    parser.add_argument("--alpha", type=int, default=3)
    parser.add_argument("--beta", type=int, default=3)
    parser.add_argument("--least", type=int, default=4, help="trajectories of a cell, or points of a trajectory")
    parser.add_argument("--adaptive", action="store_true", help="choose the grid of each cell")
    parser.add_argument("--share", type=float, default=1.0)
    parser.add_argument("--count", type=int, default=100)
    parser.add_argument("--ranges", nargs="+", type=float, default=(5.0, 10.0, 20.0))
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("wayquad").getOrCreate()
    box = tuple(args.box)
    if args.command in ("index", "export-order"):
        grid = Grid(*box, args.levels, args.alpha, args.beta)
        own = _placed(spark, args, grid)
        if args.command == "index":
            store.save_index(own, args.target)
            return
        chosen = partition.choose(partition.scores(own, grid, partition.options(grid))) if args.adaptive else None
        order.write_order(order.entries(index.z_order(index.active_cells(own, grid)), grid, chosen), args.target, grid)
        return
    rows = src.read_lines(spark, args.source)
    if args.command == "clean":
        valid = report.clean(rows, box, args.least).where("verdict = 'valid'")
        src.to_lines(rows.join(valid, "tid", "left_semi"), args.format).write.text(args.target)
    elif args.command == "augment":
        src.to_lines(augment.augment(rows, args.share).select("tid", "points"), args.format).write.text(args.target)
    elif args.command == "queries":
        made = augment.generate_queries(_points(rows), box, args.count, tuple(args.ranges))
        augment.split_sets(made, "query_id", 0.7, 0.15).write.partitionBy("part").json(args.target)
    else:
        report.dataset_report(index.mbr(rows), _points(rows)).write.json(args.target)


if __name__ == "__main__":
    main()
