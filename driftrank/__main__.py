"""Command line: ``python -m driftrank run|encode|choose ...``.

``run`` keeps the vector of a binary edge stream and prints its metrics, ``encode`` makes the binary stream of an edge list,
``choose`` draws target vertices of the first window. Sessions come from the environment (spark-submit, spark-defaults).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.config import ALPHA, EPSILON, WINDOW_RATIO, Slide, Variant
from driftrank.operators import degree, edges as E
from driftrank.plans.engine import PushEngine, static_ppr, topk
from driftrank.plans.metrics import profile, summary
from driftrank.sources import binary, text
from driftrank.sources.derived import stored

#: Numbers that stand for the variants on the command line.
VARIANTS = (Variant.OPTIMIZED, Variant.FAST_FRONTIER, Variant.EAGER, Variant.VANILLA)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftrank", description=__doc__.split("\n")[0])
    kinds = top.add_subparsers(dest="command", required=True)
    run = kinds.add_parser("run", help="keep the vector of a stream")
    run.add_argument("-d", "--data", required=True, help="binary edge stream")
    run.add_argument("-i", "--directed", type=int, choices=(0, 1), required=True)
    run.add_argument("-y", "--dynamic", type=int, choices=(0, 1), required=True)
    run.add_argument("-w", "--window-ratio", type=float, default=WINDOW_RATIO)
    run.add_argument("-n", "--mode", type=int, choices=(0, 1), default=0, help="0: -r and -b, 1: -c and -l")
    run.add_argument("-r", "--slide-ratio", type=float, default=-1.0)
    run.add_argument("-b", "--batches", type=int, default=0)
    run.add_argument("-c", "--slide-size", type=int, default=0)
    run.add_argument("-l", "--total", type=int, default=0)
    run.add_argument("-s", "--target", type=int, action="append", help="may be given several times")
    run.add_argument("-o", "--variant", type=int, choices=range(len(VARIANTS)), default=0)
    run.add_argument("-e", "--epsilon", type=float, default=EPSILON)
    run.add_argument("--strategy", default="bsp", choices=("bsp", "arrow"))
    run.add_argument("--top", type=int, default=0, help="print so many of the largest values")
    run.add_argument("--out", help="write the last state there, as Parquet")
    encode = kinds.add_parser("encode", help="binary stream of a text edge list")
    encode.add_argument("input")
    encode.add_argument("output")
    encode.add_argument("--reverse", action="store_true")
    encode.add_argument("--shuffle", type=int, help="seed of a pseudorandom order")
    choose = kinds.add_parser("choose", help="draw target vertices of the first window")
    choose.add_argument("data")
    choose.add_argument("output")
    choose.add_argument("-i", "--directed", type=int, choices=(0, 1), required=True)
    choose.add_argument("-w", "--window-ratio", type=float, default=WINDOW_RATIO)
    choose.add_argument("--num", type=int, default=10)
    choose.add_argument("--ranks", type=int, nargs=2, metavar=("FROM", "TO"), help="of these ranks by degree; all without")
    choose.add_argument("--by", choices=("out", "in"), default="out")
    choose.add_argument("--seed", type=int, default=0)
    return top


def slide_of(args: argparse.Namespace, n_edges: int) -> Slide:
    """Slides of a share of the window, or of a number of edges; raises ValueError where the numbers make none."""
    if args.mode == 0:
        return Slide.by_ratio(n_edges, args.slide_ratio, args.batches, args.window_ratio)
    return Slide.by_size(n_edges, args.slide_size, args.total, args.window_ratio)


def _stream(spark: SparkSession, path: str, directed: int):
    vertices = spark.range(binary.read_header(spark, path)).select("id")
    return stored(binary.read_binary(spark, path), vertices, bool(directed))


def _show(rows: DataFrame) -> None:
    for r in rows.collect():  # a few lines: metrics, or the values asked for
        print(*r)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    stream, targets = _stream(spark, args.data, args.directed), args.target or [1]
    print("edge_count", stream.n_edges)
    if not args.dynamic:
        window = Slide(max(1, int(stream.n_edges * args.window_ratio)), 1, 0)
        state = static_ppr(stream, window, targets, epsilon=args.epsilon, alpha=ALPHA, variant=VARIANTS[args.variant], strategy=args.strategy)
    else:
        slide = slide_of(args, stream.n_edges)
        engine = PushEngine(stream, slide, targets, args.epsilon, ALPHA, VARIANTS[args.variant], strategy=args.strategy)
        state = engine.run()
        if engine.batch:
            m = summary(engine.metrics()).first()
            print("ppr_time", m.ppr_latency * m.batches)
            print("ppr_latency", m.ppr_latency)
            print("ppr_throughput", m.ppr_throughput)
            _show(profile(engine.metrics()).orderBy("name").select("name", "total", "mean", "most"))
    if args.top:
        _show(topk(state, args.top).orderBy("target", "rank"))
    if args.out:
        state.write.mode("overwrite").parquet(args.out)


def _encode(spark: SparkSession, args: argparse.Namespace) -> None:
    encoded = E.encode(text.read_edge_list(spark, args.input), args.reverse, args.shuffle)
    n = encoded.agg(F.max("n")).first()[0] or 0
    binary.write_binary(encoded.select("pos", "src", "dst"), args.output, n)


def _choose(spark: SparkSession, args: argparse.Namespace) -> None:
    stream = _stream(spark, args.data, args.directed)
    pairs = stream.window_pairs(Slide(max(1, int(stream.n_edges * args.window_ratio)), 1, 0))
    if args.ranks:
        chosen = degree.choose_by_degree(pairs, stream.vertices, args.num, *args.ranks, by=args.by, seed=args.seed)
    else:
        chosen = degree.choose_uniform(pairs, stream.vertices, args.num, seed=args.seed)
    text.write_vertices(chosen.select("id"), args.output)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser()
    args = options.parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftrank").getOrCreate()
    try:
        {"run": _run, "encode": _encode, "choose": _choose}[args.command](spark, args)
    except ValueError as e:
        options.error(str(e))
    return 0


if __name__ == "__main__":
    sys.exit(main())
