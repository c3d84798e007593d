import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftrank.config import Phases, Slide, Variant
from driftrank.functions import repaired_residual
from driftrank.plans import engine, metrics, power, push, repair, validate
from driftrank.plans.stream import EdgeStream
from driftrank.streaming.sliding import windowed_degrees

A = 0.15


def stream(spark, edges, n, directed=True):
    rows = [(i, a, b) for i, (a, b) in enumerate(edges)]
    return EdgeStream(spark.createDataFrame(rows, "pos bigint, src bigint, dst bigint"), spark.range(n).select("id"), directed)


def exact(edges, n, t, directed=True):
    m = np.zeros((n, n))
    for a, b in edges:
        m[a, b] += 1
        if not directed:
            m[b, a] += 1
    w = (1 - A) * m / (m.sum(axis=1) + 1)[:, None]
    e = np.zeros(n)
    e[t] = A
    return np.linalg.solve(np.eye(n) - w, e)


def values(state):
    return {r.id: r.p for r in state.collect()}


@pytest.mark.parametrize(
    "edges, n, want",
    [
        ([(1, 0)], 2, [0.15, 0.06375]),
        ([(1, 0), (1, 0)], 2, [0.15, 0.085]),
        ([(0, 0)], 1, [0.15 / (1 - 0.425)]),
        ([(0, 1), (1, 0)], 2, [0.15 / (1 - 0.425**2), 0.425 * 0.15 / (1 - 0.425**2)]),
        ([(1, 0)], 3, [0.15, 0.06375, 0.0]),
    ],
)
def test_hand_graphs(spark, edges, n, want):
    g = stream(spark, edges, n)
    state = engine.static_ppr(g, Slide(len(edges), 1, 1), [0], epsilon=1e-7)
    got = values(state)
    assert all(abs(got[i] - x) <= 1e-7 for i, x in enumerate(want))


def test_isolated_vertices_only(spark):
    g = stream(spark, [], 2)
    state, _ = push.push(push.init_state(g.vertices, engine.target_frame(g.vertices, [0])), g.weights(Slide(1, 1, 1), 0, A), 1e-9, warm=False)
    assert values(state) == {0: pytest.approx(0.15), 1: 0.0}


def test_repair_is_the_sequential_rule_in_any_order(spark):
    rng = random.Random(4)
    for _ in range(20):
        d, p, r, t = rng.randint(3, 9), rng.random(), rng.random() - 0.5, rng.random() < 0.5
        heads = [(rng.choice([-1, 1]), rng.random()) for _ in range(3)]
        x, deg = r, d
        for sign, ph in heads:
            deg += sign
            x += sign * ((1 - A) * ph - p - A * x + A * t) / (deg + 1) / A
        row = spark.range(1).select(repaired_residual(*(F.lit(float(v)) for v in (p, r, d, sum(s for s, _ in heads), (1 - A) * sum(s * q for s, q in heads))), F.lit(t), A).alias("x")).first()
        assert row.x == pytest.approx(x, abs=1e-12)


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize(
    "kw",
    [{}, {"strategy": "arrow", "phases": Phases.MERGED}, {"variant": Variant.EAGER, "rebuild": True}, {"variant": Variant.FAST_FRONTIER}, {"variant": Variant.VANILLA, "phases": Phases.MERGED}, {"sparse": True}],
    ids=["bsp", "arrow", "eager", "fast", "vanilla", "sparse"],
)
def test_dynamic_keeps_the_contract(spark, directed, kw):
    """Window 7, batch 3: they do not line up; edges repeat and loop."""
    rng = random.Random(1)
    edges = [(rng.randrange(5), rng.randrange(5)) for _ in range(14)]
    g = stream(spark, edges, 6, directed)
    run = engine.PushEngine(g, Slide(7, 3, 9), [0, 2], epsilon=1e-5, **kw)
    for batch in range(3):
        got = {(r.target, r.id): r.p for r in run.vector().collect()}
        for t in (0, 2):
            want = exact(edges[3 * batch : 3 * batch + 7], 6, t, directed)
            assert max(abs(got[t, i] - want[i]) for i in range(6)) <= 1e-5
        assert validate.invariant(run.state, run.weights()).agg(F.max("gap")).first()[0] < 1e-12
        stepped = run.step()
        assert (stepped is None) == (batch == 2)
    assert run.metrics().count() == 2


def test_sparse_states_stay_in_reach(spark):
    """A component that no edge leads to from the target's is never touched, also when an update comes there."""
    g = stream(spark, [(1, 0), (5, 6), (2, 1), (6, 5), (5, 5)], 8)
    run = engine.PushEngine(g, Slide(3, 1, 2), [0], epsilon=1e-6, sparse=True)
    assert {r.id for r in run.state.collect()} == {0, 1, 2}
    run.run(2)
    assert {r.id for r in run.state.collect()} <= {0, 1, 2} and run.vector().count() == 8
    with pytest.raises(ValueError, match="every vertex"):
        engine.PushEngine(g, Slide(3, 1, 2), [0], sparse=True, strategy="arrow")


def test_rounds_beyond_the_small_plans(spark, monkeypatch):
    """Edges that are not broadcast and states that are not dealt by target give the same; so do targets in one table."""
    rng = random.Random(3)
    g = stream(spark, [(rng.randrange(30), rng.randrange(30)) for _ in range(90)], 30)
    w, start = g.weights(Slide(90, 1, 1), 0, A), push.init_state(g.vertices, engine.target_frame(g.vertices, [0, 7]))
    small = {(r.target, r.id): r.p for r in push.push_rounds(start, w, 10, 1e-6).collect()}
    monkeypatch.setattr(push, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(push, "LOCAL_ROWS", 0)
    large = {(r.target, r.id): r.p for r in push.push_rounds(start, w, 10, 1e-6).collect()}
    assert len(small) == 60 and all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_only_the_frontier_meets_edges(spark):
    """The test for hot rows stands below the join, and between cuts nothing is shuffled."""
    g = stream(spark, [(0, 1), (1, 2)], 3)
    edges = push.prepared(g.weights(Slide(2, 1, 1), 0, A))
    state = push.dealt(push.init_state(g.vertices, engine.target_frame(g.vertices, [0])), edges)
    for _ in range(3):
        state = push.push_round(state, edges.by_head(), 1e-6)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1 and plan.count("BroadcastHashJoin") == 3
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_bounds_are_errors(spark, monkeypatch):
    g = stream(spark, [(0, 1), (1, 0)], 2)
    w, start = g.weights(Slide(2, 1, 1), 0, A), push.init_state(g.vertices, engine.target_frame(g.vertices, [0]))
    with pytest.raises(ValueError, match="strategy"):
        push.push(start, w, 1e-6, strategy="other")
    monkeypatch.setattr(push, "MAX_ROUNDS", 8)
    with pytest.raises(RuntimeError):
        push.push(start, w, 1e-12)
    monkeypatch.setattr(power, "MAX_ROUNDS", 8)
    with pytest.raises(RuntimeError):
        power.power(w, g.vertices, engine.target_frame(g.vertices, [0]))


def test_reports_and_profile(spark, caplog):
    assert Slide(100, 5, 30).report_every == 1000 and Slide(100, 100, 3).report_every == 1 and Slide(10, 5, 30).reported_total(50) == 40
    g = stream(spark, [(i % 2, (i + 1) % 2) for i in range(400)], 2)
    run = engine.PushEngine(g, Slide(200, 100, 9), [0], epsilon=1e-6, strategy="arrow")
    with caplog.at_level("INFO", "driftrank"):
        run.run()
    assert len(caplog.records) == 2 and "of 200 edges" in caplog.text
    found = {r["name"]: r for r in metrics.profile(run.metrics()).collect()}
    assert set(found) == {*metrics.PHASES, *metrics.COUNTERS} and found["k"].total == 200 and found["push"].total > 0


def test_deletes_leave_negative_residuals(spark):
    g = stream(spark, [(0, 1), (1, 0), (2, 3), (3, 2)], 4)
    run = engine.PushEngine(g, Slide(2, 2, 1), [0], epsilon=1e-7)
    before = repair.repair(run.state, g.updates(run.slide, 0), run.degrees(), A)
    assert before.agg(F.min("r")).first()[0] < 0
    assert values(run.step())[0] == pytest.approx(0.15, abs=1e-7)


def test_trailing_partial_batch_is_left(spark):
    g = stream(spark, [(0, 1)] * 10, 2)
    s = Slide(4, 4, 9)
    assert not g.is_over(s, 0) and g.is_over(s, 1)
    with pytest.raises(StopIteration):
        g.updates(s, 1)


@pytest.mark.parametrize("n, last", [(10, 3), (11, 3), (12, 4), (3, None)])
def test_hopping_windows_are_full(spark, n, last):
    """Every full window and no other."""
    g = stream(spark, [(i % 3, 0) for i in range(n)], 3)
    got = {(r.batch, r.id): r.d for r in windowed_degrees(g.edges, Slide(4, 2, 1)).collect()}
    want = {} if last is None else {(b, i): sum(p % 3 == i for p in range(2 * b, 2 * b + 4)) for b in range(last + 1) for i in range(3)}
    assert got == want


def test_validation_of_parameters():
    assert Slide.by_ratio(9999, 0.01, 100) == Slide(999, 9, 100)
    assert Slide.by_size(9999, 9, 100).batches == 12
    for bad in (lambda: Slide(3, 4, 1), lambda: Slide.by_ratio(999, 0.001, 1), lambda: Slide.by_size(10, 0, 5), lambda: Slide.by_ratio(10, 0.5, 0)):
        with pytest.raises(ValueError):
            bad()


def test_power_forward_is_the_transposed_problem(spark):
    edges = [(0, 1), (1, 2), (2, 0), (0, 2)]
    g = stream(spark, edges, 3)
    w = g.weights(Slide(4, 1, 1), 0, A)
    got = {r.id: r.v for r in power.power(w, g.vertices, engine.target_frame(g.vertices, [0]), forward=True, tol=1e-12).collect()}
    m = np.zeros((3, 3))
    for a, b in edges:
        m[a, b] += 1
    want = np.linalg.solve(np.eye(3) - ((1 - A) * m / (m.sum(axis=1) + 1)[:, None]).T, [A, 0, 0])
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(3))


def test_topk(spark):
    state = spark.createDataFrame([(0, i, float(i % 3), 0.0) for i in range(6)], "target bigint, id bigint, p double, r double")
    assert [(r.rank, r.id) for r in engine.topk(state, 3).orderBy("rank").collect()] == [(1, 2), (2, 5), (3, 1)]
