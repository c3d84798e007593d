"""The registered queries over the driver's tables: derived graphs, fixed windows and rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.config import Phases, Slide, Variant
from driftrank.operators import degree as D
from driftrank.operators import edges as E
from driftrank.operators.scan import prefix_scan, with_position
from driftrank.plans import engine, power, push, repair, validate
from driftrank.plans.metrics import mean_by, profile, summary
from driftrank.plans.stream import EdgeStream
from driftrank.sources import binary, text
from driftrank.sources.derived import event_graph, supply_graph
from driftrank.storage import cut, shared_dir

TARGET, EPS, ALPHA = 5, 1e-5, 0.15
TARGETS = (1, 5, 7)
WARM = 8  # rounds of the state that the one-step queries start from


def default_slide(n_edges: int) -> Slide:
    """Window a tenth of the stream, batch a hundredth of the window, 5 edges at least."""
    window = n_edges // 10
    return Slide(window, max(window // 100, 5), 100)


@lru_cache(8)
def _event_graph(spark: SparkSession, sf_dir: str) -> tuple[EdgeStream, Slide]:
    stream = event_graph(spark, sf_dir)
    return stream, default_slide(stream.n_edges)


@lru_cache(8)
def _supply_graph(spark: SparkSession, sf_dir: str) -> tuple[EdgeStream, Slide]:
    stream = supply_graph(spark, sf_dir)
    return stream, default_slide(stream.n_edges)


def _targets(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids or (TARGET,)], "target bigint")


def _rounds(spark: SparkSession, sf_dir: str, rounds: int, *ids: int) -> DataFrame:
    """The state after so many rounds on the first window."""
    g, s = _event_graph(spark, sf_dir)
    return push.push_rounds(push.init_state(g.vertices, _targets(spark, *ids)), g.weights(s, 0, ALPHA), rounds, EPS, ALPHA)


def _r8(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 8) for n in names})


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


@_query
def edge_stream(spark, d):
    return _event_graph(spark, d)[0].edges.select("pos", "src", "dst")


@_query
def encode_rebase(spark, d):
    raw = _event_graph(spark, d)[0].edges.select("pos", (F.col("src") + 7).alias("src"), (F.col("dst") + 7).alias("dst"))
    return E.encode(raw)


@_query
def encode_shuffled(spark, d):
    return E.encode(_event_graph(spark, d)[0].edges, reverse=True, shuffle_seed=11)


@_query
def reverse_edges(spark, d):
    return E.reverse(_event_graph(spark, d)[0].edges)


@_query
def mirror_undirected(spark, d):
    g, s = _supply_graph(spark, d)
    return E.mirror(g.window(s)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))


@_query
def ts_edge_list(spark, d):
    g, s = _supply_graph(spark, d)
    return E.timestamped(g.window(s), g.directed)


@_query
def out_degree(spark, d):
    g, _ = _event_graph(spark, d)
    return D.out_degrees(g.edges, g.vertices)


@_query
def in_degree(spark, d):
    g, _ = _event_graph(spark, d)
    return D.degrees(g.edges, g.vertices).select("id", "in_d")


@_query
def window_degree(spark, d):
    g, s = _event_graph(spark, d)
    return D.degrees(g.window_pairs(s), g.vertices)


@_query
def hopping_window_degree(spark, d):
    from driftrank.streaming.sliding import windowed_degrees

    g, s = _event_graph(spark, d)
    return windowed_degrees(g.edges, Slide(s.window, s.window // 2, 1))


@_query
def window_edges(spark, d):
    g, s = _event_graph(spark, d)
    return g.window(s, 3)


@_query
def row_ptr(spark, d):
    g, s = _event_graph(spark, d)
    return D.row_pointers(g.window_pairs(s), g.vertices)


@_query
def adjacency_lists(spark, d):
    g, s = _event_graph(spark, d)
    return E.adjacency(g.window_pairs(s)).select("id", F.array_join("neighbours", " ").alias("neighbours"))


@_query
def edge_pairs_sorted(spark, d):
    g, s = _event_graph(spark, d)
    return with_position(g.window(s).select("src", "dst"), ["src", "dst"])


@_query
def id_range_stats(spark, d):
    ends = _event_graph(spark, d)[0].edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("id").alias("n_ends"))


@_query
def id_range_violations(spark, d):
    return E.outside(_event_graph(spark, d)[0].edges, 10).agg(F.count(F.lit(1)).alias("n_violations"))


@_query
def transition_weights(spark, d):
    g, s = _event_graph(spark, d)
    return _r8(g.weights(s, 0, ALPHA), "w")


@_query
def slide_config(spark, d):
    n = _event_graph(spark, d)[0].n_edges
    modes = {"ratio": Slide.by_ratio(n, 0.1, 7, 0.1), "size": Slide.by_size(n, 9, 100, 0.1)}
    return spark.createDataFrame([(m, s.window, s.size, s.batches, s.total) for m, s in modes.items()], "mode string, w bigint, k bigint, b bigint, total bigint")


@_query
def slide_updates(spark, d):
    g, s = _event_graph(spark, d)
    return g.updates(s, 0)


@_query
def slide_updates_undirected(spark, d):
    g, s = _supply_graph(spark, d)
    return g.updates(s, 1)


@_query
def window_after_slide(spark, d):
    g, s = _event_graph(spark, d)
    return g.window(s, 2)


@_query
def window_incremental(spark, d):
    g, s = _supply_graph(spark, d)
    m = E.multiplicities(g.window_pairs(s))
    for batch in range(3):
        m = cut(E.merge_updates(m, cut(g.updates(s, batch)), s.size <= engine.FEW_UPDATES))
    return m


@_query
def update_endpoints(spark, d):
    g, s = _event_graph(spark, d)
    return E.endpoints(g.updates(s, 0))


@_query
def batch_delta(spark, d):
    g, s = _event_graph(spark, d)
    return _r8(repair.batch_delta(_rounds(spark, d, WARM), g.updates(s, 0), ALPHA), "mass")


@_query
def degree_rollback(spark, d):
    g, s = _event_graph(spark, d)
    return repair.degree_before(g.degrees(s, 1), g.updates(s, 0))


@_query
def init_state(spark, d):
    return push.init_state(_event_graph(spark, d)[0].vertices, _targets(spark, *TARGETS))


@_query
def frontier_seed(spark, d):
    return push.frontier(_rounds(spark, d, WARM), EPS).select("target", "id")


def _repaired(spark, d) -> DataFrame:
    g, s = _event_graph(spark, d)
    return repair.repair(_rounds(spark, d, WARM), g.updates(s, 0), g.degrees(s, 0), ALPHA)


@_query
def frontier_seed_endpoints(spark, d):
    g, s = _event_graph(spark, d)
    return push.frontier(_repaired(spark, d), EPS, -1, E.endpoints(g.updates(s, 0))).select("target", "id")


@_query
def push_one_round(spark, d):
    return _r8(_rounds(spark, d, 1), "p", "r")


@_query
def push_fixed_rounds(spark, d):
    return _r8(_rounds(spark, d, 24), "p", "r")


@_query
def crossing_frontier(spark, d):
    return push.crossing(_rounds(spark, d, 3), _rounds(spark, d, 4), EPS).select("target", "id")


@_query
def repair_frontier(spark, d):
    return push.still_legal(_rounds(spark, d, 3), _rounds(spark, d, 4), EPS).select("target", "id")


@_query
def residual_repair(spark, d):
    return _r8(_repaired(spark, d), "p", "r")


@_query
def static_ppr_topk(spark, d):
    return _r8(engine.topk(_rounds(spark, d, 24), 10), "p")


@_query
def static_ppr_solved(spark, d):
    """The ten largest values of the first window, solved to epsilon."""
    g, s = _event_graph(spark, d)
    return _r8(engine.topk(engine.static_ppr(g, s, [TARGET], epsilon=EPS, alpha=ALPHA), 10), "p")


def _one_batch(spark, d, *ids: int) -> DataFrame:
    g, s = _event_graph(spark, d)
    w = push.prepared(g.weights(s, 1, ALPHA))
    state = repair.repair(_rounds(spark, d, WARM, *ids), g.updates(s, 0), g.degrees(s, 0), ALPHA)
    for sign in (1, -1):
        state = push.push_rounds(state, w, WARM, EPS, ALPHA, sign)
    return state


@_query
def dynamic_ppr_one_batch(spark, d):
    return _r8(_one_batch(spark, d), "p", "r")


@_query
def dynamic_ppr_multi_target(spark, d):
    return _r8(_one_batch(spark, d, *TARGETS), "p", "r")


@_query
def power_reverse_fixed(spark, d):
    g, s = _event_graph(spark, d)
    return _r8(power.power(g.weights(s, 0, ALPHA), g.vertices, _targets(spark), ALPHA, rounds=20), "v")


@_query
def power_forward_fixed(spark, d):
    g, s = _event_graph(spark, d)
    return _r8(power.power(g.weights(s, 0, ALPHA), g.vertices, _targets(spark), ALPHA, rounds=20, forward=True), "v")


@_query
def linf_delta(spark, d):
    g, s = _event_graph(spark, d)
    return _r8(power.deltas(g.weights(s, 0, ALPHA), g.vertices, _targets(spark), 8, ALPHA), "delta")


@_query
def validate_contract(spark, d):
    g, s = _event_graph(spark, d)
    state = engine.static_ppr(g, s, [TARGET], epsilon=EPS, alpha=ALPHA)
    return validate.validate(state, g.weights(s, 0, ALPHA), g.vertices, EPS, ALPHA)


@_query
def validate_dynamic(spark, d):
    """Two warm batches, then the contract."""
    g, s = _event_graph(spark, d)
    run = engine.PushEngine(g, s, [TARGET], EPS, ALPHA)
    state = run.run(2)
    return validate.validate(state, run.weights(), g.vertices, EPS, ALPHA)


@_query
def sparse_dynamic(spark, d):
    """Two warm batches on a state of reached rows only, then the contract on all vertices."""
    g, s = _event_graph(spark, d)
    run = engine.PushEngine(g, s, [TARGET], EPS, ALPHA, sparse=True)
    run.run(2)
    return validate.validate(run.vector(), run.weights(), g.vertices, EPS, ALPHA)


@_query
def validate_window(spark, d):
    g, s = _supply_graph(spark, d)
    m = E.multiplicities(g.window_pairs(s))
    for batch in range(2):
        m = E.merge_updates(m, g.updates(s, batch))
    return validate.window_differences(E.multiplicities(g.window_pairs(s, 2)), m)


@_query
def top_degree_10(spark, d):
    g, s = _event_graph(spark, d)
    return D.top_by_degree(g.window_pairs(s), g.vertices, 10).select("id", "d")


@_query
def degree_rank_range_sample(spark, d):
    g, s = _event_graph(spark, d)
    return D.choose_by_degree(g.window_pairs(s), g.vertices, 10, 5, 100, seed=17).select("rank", "id", "d")


@_query
def uniform_sample(spark, d):
    g, s = _event_graph(spark, d)
    return D.choose_uniform(g.window_pairs(s), g.vertices, 10, seed=17).select("id")


@_query
def prefix_scans(spark, d):
    g, s = _event_graph(spark, d)
    return prefix_scan(D.out_degrees(g.window_pairs(s), g.vertices), "id", "d")


def _scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/driftrank-{uuid.uuid4().hex}/{name}"


@_query
def encode_roundtrip(spark, d):
    """Write the stream in the binary format, read it back, compare both ways."""
    g, _ = _event_graph(spark, d)
    path = _scratch(spark, binary.binary_name("event_graph.txt"))
    binary.write_binary(g.edges, path, g.vertices.agg(F.max("id") + 1).first()[0])
    back = binary.read_binary(spark, path)
    wrong = E.differing(g.edges.select("pos", "src", "dst"), back.select("pos", "src", "dst"))
    both = wrong.agg(F.count(F.lit(1)).alias("n_wrong"), F.lit(0).cast("long").alias("n_edges")).unionByName(back.agg(F.lit(0).cast("long").alias("n_wrong"), F.count(F.lit(1)).alias("n_edges")))
    return both.agg(F.sum("n_wrong").alias("n_wrong"), F.sum("n_edges").alias("n_edges")).withColumn("n", F.lit(binary.read_header(spark, path)).cast("long"))


@_query
def edge_list_roundtrip(spark, d):
    """Write the window as a time-stamped edge list, read it back."""
    g, s = _supply_graph(spark, d)
    path = _scratch(spark, "edges")
    text.write_edge_list(E.timestamped(g.window(s), g.directed), path)
    return text.read_timestamped(spark, path)


@_query
def vertex_list_slice(spark, d):
    """Write the vertices by degree, read lines 3 to 9."""
    g, s = _event_graph(spark, d)
    path = _scratch(spark, "ids")
    text.write_vertices(D.ranked(g.window_pairs(s), g.vertices).orderBy("rank"), path)
    return text.read_vertices(spark, path, 3, 10)


@_query
def log_keywords(spark, d):
    """A log line for each of the first events; the last value of each keyword."""
    path = _scratch(spark, "log")
    events = spark.read.parquet(f"{d}/events.parquet").orderBy("event_id")
    lines = events.select(F.concat_ws(" ", F.concat(F.lit("of_"), (F.col("event_id") % 3).cast("string")), "event_id", F.lit("ms")).alias("value"))
    lines.coalesce(1).sortWithinPartitions(F.regexp_extract("value", r" (\d+) ", 1).cast("long")).write.text(path)
    return text.log_values(spark, path, ["of_0", "of_1", "of_2", "of"]).select("keyword", "value")


@_query
def mean_per_configuration(spark, d):
    """Mean degree by id modulo 3, as runs are averaged over their target vertices."""
    g, s = _event_graph(spark, d)
    runs = D.out_degrees(g.window_pairs(s), g.vertices).select((F.col("id") % 3).alias("config"), F.col("d").alias("value"))
    return _r8(mean_by(runs, "config"), "mean")


@_query
def next_frontier(spark, d):
    return push.next_frontier(_rounds(spark, d, 3), _rounds(spark, d, 4), EPS).select("target", "id")


@_query
def slide_reports(spark, d):
    """Totals that reports name, and how often they come."""
    n = _event_graph(spark, d)[0].n_edges
    slides = {"small": Slide(n // 10, 5, 20), "large": Slide(n // 2, 100, 1_000_000)}
    return spark.createDataFrame([(m, s.total, s.reported_total(n), s.report_every) for m, s in slides.items()], "mode string, total bigint, reported bigint, every bigint")


@_query
def streaming_contract(spark, d):
    """Two slides of a stream of files that come in the wrong order, then the contract."""
    from driftrank.streaming.sliding import SlidingPPR

    g, s = _event_graph(spark, d)
    source, upto = _scratch(spark, "in"), s.window + 2 * s.size
    for low, high in ((upto // 2, upto), (0, upto // 2)):
        g.edges.where((F.col("pos") >= low) & (F.col("pos") < high)).coalesce(1).write.mode("append").parquet(source)
    job = SlidingPPR(g.vertices, [TARGET], s, _scratch(spark, "root"), epsilon=EPS, alpha=ALPHA)
    job.start(source, _scratch(spark, "checkpoint"), once=True).awaitTermination()
    checked = validate.validate(job.state(2), g.weights(s, 2, ALPHA), g.vertices, EPS, ALPHA)
    return checked.withColumn("slides", F.lit(job.done()).cast("long"))


@_query
def frontier_counts_per_round(spark, d):
    g, s = _event_graph(spark, d)
    state = push.init_state(g.vertices, _targets(spark))
    w = push.prepared(g.weights(s, 0, ALPHA))
    in_d = D.degrees(g.window_pairs(s), g.vertices).select("id", "in_d")
    found = None
    for n in range(6):
        row = push.frontier(state, EPS).join(in_d, "id").agg(F.lit(n).alias("round"), F.count(F.lit(1)).alias("expanded"), F.coalesce(F.sum("in_d"), F.lit(0)).alias("traversed"))
        found = row if found is None else found.unionByName(row)
        state = push.push_rounds(state, w, 1, EPS, ALPHA)
    return found


@_query
def metrics_mean(spark, d):
    g, s = _event_graph(spark, d)
    run = engine.PushEngine(g, s, [TARGET], EPS, ALPHA, strategy="arrow")
    run.run(2)
    return summary(run.metrics())


@_query
def metrics_counts(spark, d):
    """The counters of a run that do not depend on the clock."""
    g, s = _event_graph(spark, d)
    run = engine.PushEngine(g, s, [TARGET], EPS, ALPHA, strategy="arrow")
    run.run(3)
    counters = profile(run.metrics()).where(F.col("name").isin("target_count", "k"))
    return counters.select("name", "batches", "total", "mean", "most")


@_query
def variants_agree(spark, d):
    """States of every variant, phase mode and strategy that differ from the exact vector by more than epsilon: none."""
    g, s = _event_graph(spark, d)
    w, start = push.prepared(g.weights(s, 0, ALPHA)), push.init_state(g.vertices, _targets(spark))
    exact = power.power(w, g.vertices, _targets(spark), ALPHA)
    found = None
    for name, kw in ({v.value: {"variant": v} for v in Variant} | {"merged": {"phases": Phases.MERGED}, "arrow": {"strategy": "arrow"}}).items():
        state, _ = push.push(start, w, EPS, ALPHA, warm=False, **kw)
        row = state.join(exact, ["target", "id"]).agg(F.lit(name).alias("variant"), F.count_if(F.abs(F.col("p") - F.col("v")) > EPS).alias("n_wrong"))
        found = row if found is None else found.unionByName(row)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)
