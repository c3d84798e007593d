"""Local push towards an error bound, as rounds over ``state(target, id, p, r)``.

A round reads the state once. Every row carries itself over, and a hot one besides asks for the edges into its vertex: only
the frontier meets edges, so a round costs the state's rows and the frontier's edges. One partial-then-final aggregate on
(target, id) gives the new state. Rounds chain into one plan; every ROUNDS_PER_CUT the state is checkpointed and the frontier
tested. Edges are counted and up to BROADCAST_PAIRS broadcast; states are counted, and where no target has more than
LOCAL_ROWS they are dealt by target, so that the rounds between two cuts shuffle nothing. Else edges and frontier are dealt
by vertex, where adaptive skew joins split hubs. No setting of the session is touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.config import ALPHA, Phases, Variant, check_push
from driftrank.functions import is_hot
from driftrank.storage import cut

ROUNDS_PER_CUT = 8
#: Weighted pairs (24 bytes each) up to which the edges are broadcast, and up to which a task may hold them all.
BROADCAST_PAIRS = 500_000
ARROW_PAIRS = 5_000_000
#: Vertices of a target up to which a task takes all of them.
LOCAL_ROWS, ARROW_ROWS = 1_000_000, 5_000_000
MAX_ROUNDS = 10_000
STRATEGIES = ("bsp", "arrow")


def init_state(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """p = 0 everywhere, r = 1 at the target. ``targets`` is a list that a user gives; it is broadcast."""
    return vertices.crossJoin(F.broadcast(targets)).select("target", "id", F.lit(0.0).alias("p"), F.when(F.col("id") == F.col("target"), 1.0).otherwise(0.0).alias("r"))


def seed_state(targets: DataFrame) -> DataFrame:
    """The same without the rows that are 0: rounds add the vertices that they reach, so the state costs the pushed neighbourhood, not the graph."""
    return targets.select("target", F.col("target").alias("id"), F.lit(0.0).alias("p"), F.lit(1.0).alias("r"))


def dense(state: DataFrame, vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """Every vertex for every target, 0 where ``state`` has no row."""
    every = vertices.crossJoin(F.broadcast(targets)).select("target", "id")
    return every.join(state, ["target", "id"], "left").select("target", "id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p", "r")))


def frontier(state: DataFrame, epsilon: float, sign: int = 1, restrict_to: DataFrame | None = None) -> DataFrame:
    """The states that may be pushed; with ``restrict_to(id)`` only those vertices are looked at."""
    hot = state.where(is_hot(F.col("r"), epsilon, sign))
    return hot if restrict_to is None else hot.join(restrict_to.select("id").distinct(), "id", "left_semi")


def crossing(before: DataFrame, after: DataFrame, epsilon: float, sign: int = 1) -> DataFrame:
    """The states that may be pushed now and could not before the round."""
    new = frontier(after, epsilon, sign)
    return new.join(frontier(before, epsilon, sign).select("target", "id"), ["target", "id"], "left_anti")


def still_legal(before: DataFrame, after: DataFrame, epsilon: float, sign: int = 1) -> DataFrame:
    """The states that were pushed and may be pushed again."""
    return frontier(after, epsilon, sign).join(frontier(before, epsilon, sign).select("target", "id"), ["target", "id"], "left_semi")


def next_frontier(before: DataFrame, after: DataFrame, epsilon: float, sign: int = 1) -> DataFrame:
    """The union of both, which are disjoint: the frontier of the next round."""
    return crossing(before, after, epsilon, sign).unionByName(still_legal(before, after, epsilon, sign))


@dataclass(frozen=True)
class Edges:
    """Weighted pairs ``(src, dst, w)``, computed once, and whether they are few."""

    pairs: DataFrame
    n: int

    @property
    def small(self) -> bool:
        return self.n <= BROADCAST_PAIRS

    def by_head(self) -> DataFrame:
        pairs = self.pairs.select("src", "dst", "w")
        return F.broadcast(pairs) if self.small else pairs


def prepared(weights: DataFrame | Edges) -> Edges:
    """Edges for many rounds; prepared ones are taken as they are."""
    if isinstance(weights, Edges):
        return weights
    pairs = cut(weights.select("src", "dst", "w"))
    return Edges(pairs, pairs.count())


def dealt(state: DataFrame, edges: Edges) -> DataFrame:
    """``state`` dealt by target, where that is small enough for tasks."""
    if not edges.small:
        return state
    facts = state.groupBy("target").count().agg(F.max("count").alias("rows"), F.count(F.lit(1)).alias("targets")).first()
    if (facts.rows or 0) > LOCAL_ROWS:
        return state
    return state.repartition(max(1, min(facts.targets, state.sparkSession.sparkContext.defaultParallelism)), "target")


def push_round(state: DataFrame, edges: DataFrame, epsilon: float, alpha: float = ALPHA, sign: int = 1, only: Column | None = None, variant: Variant = Variant.VANILLA) -> DataFrame:
    """One round over all states that are hot, or over those of them that ``only`` names.

    With a column ``b``, which the optimized and the fast-frontier variant need, the frontier is derived from the
    residual that the last push left (fast) or found (optimized) there.
    """
    derived = variant in (Variant.OPTIMIZED, Variant.FAST_FRONTIER) and "b" in state.columns
    hot = is_hot(F.col("r"), epsilon, sign)
    if derived:
        legal_before = is_hot(F.col("b"), epsilon, sign)
        crossed = hot & ~legal_before
        hot = crossed if variant is Variant.FAST_FRONTIER else crossed | hot & legal_before
    hot = hot if only is None else hot & only
    zero, r = F.lit(0.0), F.col("r")
    left = F.when(hot, zero).otherwise(r)
    # keys below 0 meet no edge
    own = F.struct((-F.col("id") - 1).alias("key"), F.lit(True).alias("own"), (F.col("p") + F.when(hot, alpha * r).otherwise(zero)).alias("p"), left.alias("r"), (left if variant is Variant.FAST_FRONTIER else r).alias("b"))
    asks = F.struct(F.col("id").alias("key"), F.lit(False).alias("own"), zero.alias("p"), r.alias("r"), zero.alias("b"))
    rows = state.select("target", "id", F.inline(F.when(hot, F.array(own, asks)).otherwise(F.array(own))))
    met = rows.join(edges.select("src", "dst", "w"), F.col("key") == F.col("dst"), "left").where("own or src is not null")
    to = F.when(F.col("own"), F.col("id")).otherwise(F.col("src"))
    given = F.when(F.col("own"), F.col("r")).otherwise(F.col("w") * F.col("r"))
    sums = [F.sum("p").alias("p"), F.sum("_r").alias("r"), *([F.sum("b").alias("b")] if "b" in state.columns else [])]
    return met.select("target", to.alias("id"), "p", given.alias("_r"), "b").groupBy("target", "id").agg(*sums)


def _class(groups: int, n: int) -> Column | None:
    return F.col("id") % groups == n % groups if groups > 1 else None


def push_rounds(state: DataFrame, weights: DataFrame | Edges, rounds: int, epsilon: float, alpha: float = ALPHA, sign: int = 1, groups: int = 1) -> DataFrame:
    """So many rounds, whatever the frontier."""
    edges = prepared(weights)
    state, by_head = dealt(state, edges), edges.by_head()
    for n in range(rounds):
        state = push_round(state, by_head, epsilon, alpha, sign, _class(groups, n))
        if n % ROUNDS_PER_CUT == ROUNDS_PER_CUT - 1 and n < rounds - 1:
            state = dealt(cut(state), edges)
    return cut(state) if rounds else state


def _push_bsp(state: DataFrame, edges: Edges, epsilon: float, alpha: float, signs: list[int], variant: Variant) -> tuple[DataFrame, list[int]]:
    took, by_head, groups = [], edges.by_head(), 2 if variant is Variant.EAGER else 1
    keeps = variant in (Variant.OPTIMIZED, Variant.FAST_FRONTIER)
    for sign in signs:
        # a phase starts from all states that may be pushed: none counts as legal before
        state, n = (state.withColumn("b", F.lit(0.0)) if keeps else state), 0
        while not state.where(is_hot(F.col("r"), epsilon, sign)).isEmpty():
            if n >= MAX_ROUNDS:
                raise RuntimeError(f"residuals stayed above {epsilon} after {n} rounds")
            state = dealt(state, edges)
            for k in range(n, n + ROUNDS_PER_CUT):
                state = push_round(state, by_head, epsilon, alpha, sign, _class(groups, k), variant)
            state, n = cut(state), n + ROUNDS_PER_CUT
        took.append(n)
    return state.select("target", "id", "p", "r"), took


def push_arrays(p: np.ndarray, r: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, epsilon: float, alpha: float, signs: list[int]) -> None:
    """The same rounds on arrays, in place; ``src`` and ``dst`` are indices."""
    for sign in signs:
        for _ in range(MAX_ROUNDS):
            hot = np.abs(r) > epsilon if sign == 0 else sign * r > epsilon
            if not hot.any():
                break
            pushed = np.where(hot, r, 0.0)
            p += alpha * pushed
            r -= pushed
            use = hot[dst]
            r += np.bincount(src[use], w[use] * pushed[dst[use]], len(r))
        else:
            raise RuntimeError(f"residuals stayed above {epsilon} after {MAX_ROUNDS} rounds")


def _push_arrow(state: DataFrame, edges: Edges, epsilon: float, alpha: float, signs: list[int]) -> DataFrame:
    """All rounds of a target in one task, targets in parallel; edges and vertices are counted before."""
    rows = edges.pairs.toPandas()
    held = state.sparkSession.sparkContext.broadcast((rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["w"].to_numpy()))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids = group["id"].to_numpy()
        src, dst, w = held.value
        p, r = group["p"].to_numpy().copy(), group["r"].to_numpy().copy()
        push_arrays(p, r, np.searchsorted(ids, src), np.searchsorted(ids, dst), w, epsilon, alpha, signs)
        return pd.DataFrame({"target": group["target"], "id": ids, "p": p, "r": r})

    return state.groupBy("target").applyInPandas(run, "target bigint, id bigint, p double, r double")


def push(
    state: DataFrame, weights: DataFrame | Edges, epsilon: float, alpha: float = ALPHA,
    variant: Variant = Variant.OPTIMIZED, phases: Phases = Phases.SIGNED, strategy: str = "bsp", warm: bool = True,
) -> tuple[DataFrame, list[int]]:
    """Push to the fixpoint: no residual above epsilon is left. Returns the state and the rounds of each phase.

    Rounds are bulk-synchronous, so the frontier of every variant is the set of hot states, derived in the variant's way;
    ``EAGER`` takes vertices in residue classes, whose later ones see what the earlier ones gave. ``warm=False``:
    residuals cannot be negative, so only the first phase runs. Strategy ``arrow``: ``state`` has every vertex.
    """
    check_push(alpha, epsilon)
    if strategy not in STRATEGIES:
        raise ValueError(f"a strategy is one of {STRATEGIES}, not {strategy!r}")
    signs = [0] if phases is Phases.MERGED else [1, -1] if warm else [1]
    edges = prepared(weights)
    if strategy == "arrow":
        rows = state.groupBy("target").count().agg(F.max("count")).first()[0] or 0
        if edges.n > ARROW_PAIRS or rows > ARROW_ROWS:
            raise ValueError(f"more than {ARROW_PAIRS} weighted pairs or {ARROW_ROWS} vertices: use the bsp strategy")
        return cut(_push_arrow(state, edges, epsilon, alpha, signs)), []
    return _push_bsp(state, edges, epsilon, alpha, signs, variant)
