"""Static and dynamic personalized PageRank."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftrank.config import ALPHA, EPSILON, Phases, Slide, Variant
from driftrank.operators.edges import merge_updates, multiplicities
from driftrank.functions import transition_weight
from driftrank.plans.metrics import metrics_frame
from driftrank.plans.push import dense, init_state, push, seed_state
from driftrank.plans.repair import degree_before, repair, sparse_repair
from driftrank.plans.stream import EdgeStream
from driftrank.storage import cut

LOG = logging.getLogger("driftrank")
#: Edges in a batch up to which its updates (twice or four times as many rows of 24 bytes) are broadcast to the window.
FEW_UPDATES = 100_000


def target_frame(vertices: DataFrame, targets: Iterable[int] | DataFrame) -> DataFrame:
    if isinstance(targets, DataFrame):
        return targets.select("target")
    return vertices.sparkSession.createDataFrame([(int(t),) for t in targets], "target bigint")


def static_ppr(stream: EdgeStream, slide: Slide, targets, batch: int = 0, epsilon: float = EPSILON, alpha: float = ALPHA, variant: Variant = Variant.OPTIMIZED, strategy: str = "bsp") -> DataFrame:
    """``(target, id, p, r)``: the value of every vertex with respect to each target, to within epsilon."""
    start = init_state(stream.vertices, target_frame(stream.vertices, targets))
    return push(start, stream.weights(slide, batch, alpha), epsilon, alpha, variant, strategy=strategy, warm=False)[0]


class PushEngine:
    """The same vector kept up to date, batch after batch.

    The window lives as multiplicities that updates are merged into; ``rebuild=True`` takes it from the
    stream's positions instead. Both give the same window. With ``sparse=True`` the state has the rows that were reached
    only; others are 0, and ``vector`` gives all of them. Progress goes to the log ``driftrank``.
    """

    def __init__(
        self, stream: EdgeStream, slide: Slide, targets, epsilon: float = EPSILON, alpha: float = ALPHA,
        variant: Variant = Variant.OPTIMIZED, phases: Phases = Phases.SIGNED, strategy: str = "bsp", rebuild: bool = False, sparse: bool = False,
    ):
        if sparse and strategy == "arrow":
            raise ValueError("the arrow strategy needs every vertex")
        self.sparse = sparse
        self.stream, self.slide, self.epsilon, self.alpha = stream, slide, epsilon, alpha
        self.variant, self.phases, self.strategy, self.rebuild = variant, phases, strategy, rebuild
        self.targets = target_frame(stream.vertices, targets)
        self.n_targets = self.targets.count()
        self.batch = 0
        self.window = cut(multiplicities(stream.window_pairs(slide, 0)))
        start = seed_state(self.targets) if sparse else init_state(stream.vertices, self.targets)
        self.state = push(start, self.weights(), epsilon, alpha, variant, strategy=strategy, warm=False)[0]
        self._metrics: list[tuple] = []

    def degrees(self) -> DataFrame:
        tails = self.window.select(F.col("src").alias("id"), F.col("m").alias("d"))
        return self.stream.vertices.select("id", F.lit(0).cast("long").alias("d")).unionByName(tails).groupBy("id").agg(F.sum("d").alias("d"))

    def weights(self) -> DataFrame:
        degree = self.window.groupBy("src").agg(F.sum("m").alias("d"))
        return self.window.join(degree, "src").select("src", "dst", "m", transition_weight(F.col("m"), F.col("d"), self.alpha).alias("w"))

    def step(self, updates: DataFrame | None = None) -> DataFrame | None:
        """One slide: maintain the window, repair, push. None when the stream is over."""
        if updates is None:
            if self.stream.is_over(self.slide, self.batch):
                return None
            updates = self.stream.updates(self.slide, self.batch)
        begun = time.perf_counter()
        updates = cut(updates)
        self.window = cut(multiplicities(self.stream.window_pairs(self.slide, self.batch + 1)) if self.rebuild else merge_updates(self.window, updates, self.slide.size <= FEW_UPDATES))
        maintained = time.perf_counter()
        before = degree_before(self.degrees(), updates)
        fixed = cut(sparse_repair(self.state, updates, before, self.targets, self.alpha) if self.sparse else repair(self.state, updates, before, self.alpha))
        repaired = time.perf_counter()
        self.state, rounds = push(fixed, self.weights(), self.epsilon, self.alpha, self.variant, self.phases, self.strategy)
        done = time.perf_counter()
        positive, negative = [*rounds, 0, 0][:2]
        times = ((b - a) * 1e3 for a, b in ((begun, maintained), (maintained, repaired), (repaired, done), (maintained, done)))
        self._metrics.append((self.batch, self.n_targets, self.slide.size, positive, negative, *times))
        self.batch += 1
        if self.batch % self.slide.report_every == 0:
            LOG.info("batch %d of %d, %d of %d edges, %.1f ms", self.batch, self.slide.batches, self.batch * self.slide.size, self.slide.reported_total(self.stream.n_edges), (done - begun) * 1e3)
        return self.state

    def run(self, batches: int | None = None) -> DataFrame:
        for _ in range(self.slide.batches if batches is None else batches):
            if self.step() is None:
                break
        return self.state

    def vector(self) -> DataFrame:
        """The state with every vertex."""
        return dense(self.state, self.stream.vertices, self.targets) if self.sparse else self.state

    def metrics(self) -> DataFrame:
        return metrics_frame(self.stream.vertices.sparkSession, self._metrics)

    def topk(self, k: int) -> DataFrame:
        """The ``k`` largest values of each target, ties by id."""
        return topk(self.state, k)


def topk(state: DataFrame, k: int) -> DataFrame:
    """Per target; every task keeps its own k best before the shuffle (a window group limit), so no vector comes together in one task."""
    best = Window.partitionBy("target").orderBy(F.desc("p"), F.asc("id"))
    return state.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("target", "rank", "id", "p")
