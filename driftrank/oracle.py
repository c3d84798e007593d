"""The registered queries in DuckDB's SQL: fixed-round recurrences as recursive CTEs."""

from __future__ import annotations

EV = """
ev AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id::BIGINT AS src, (lead(user_id) OVER (ORDER BY event_id))::BIGINT AS dst FROM events),
e AS (SELECT pos, src, dst FROM ev WHERE dst IS NOT NULL),
vx AS (SELECT DISTINCT user_id::BIGINT AS id FROM events),
"""
LI = """
sh AS (SELECT max(p_partkey)::BIGINT + 1 AS shift FROM part),
e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey::BIGINT AS src, l_suppkey::BIGINT + shift AS dst FROM lineitem, sh),
vx AS (SELECT p_partkey::BIGINT AS id FROM part UNION ALL SELECT s_suppkey::BIGINT + shift FROM supplier, sh),
"""
CFG = """
cf AS (SELECT count(*) // 10 AS w, greatest(count(*) // 1000, 5) AS k FROM e)
"""
MIRROR = "(SELECT pos, src, dst FROM {0} UNION ALL SELECT pos, dst, src FROM {0})"


def _window(name: str, batch: int) -> str:
    return f"{name} AS (SELECT pos, src, dst FROM e, cf WHERE pos >= {batch} * k AND pos < {batch} * k + w)"


def _updates(name: str, batch: int) -> str:
    return (
        f"{name} AS (SELECT pos, src, dst, CASE WHEN pos < {batch + 1} * k THEN -1 ELSE 1 END AS sign FROM e, cf"
        f" WHERE (pos >= {batch} * k AND pos < {batch + 1} * k) OR (pos >= {batch} * k + w AND pos < {batch + 1} * k + w))"
    )


def _weights(name: str, window: str) -> str:
    return (
        f"{name}m AS (SELECT src, dst, count(*) AS m FROM {window} GROUP BY 1, 2),"
        f"{name}d AS (SELECT src, sum(m) AS d FROM {name}m GROUP BY 1),"
        f"{name} AS (SELECT m.src, m.dst, m.m, 0.85::DOUBLE * m.m / (d.d + 1.0::DOUBLE) AS w FROM {name}m m JOIN {name}d d ON m.src = d.src)"
    )


def _push(name: str, start: str, weights: str, rounds: int, sign: int = 1, eps: str = "1e-5") -> str:
    hot = f"r > {eps}" if sign > 0 else f"r < -{eps}"
    return (
        f"{name} AS (SELECT 0 AS it, target, id, p, r FROM {start} UNION ALL SELECT it + 1, target, id, sum(p), sum(r) FROM ("
        f" SELECT it, target, id, p + CASE WHEN {hot} THEN 0.15::DOUBLE * r ELSE 0 END AS p, CASE WHEN {hot} THEN 0.0::DOUBLE ELSE r END AS r FROM {name}"
        f" UNION ALL SELECT s.it, s.target, x.src, 0.0::DOUBLE, x.w * s.r FROM {name} s JOIN {weights} x ON x.dst = s.id WHERE {hot.replace('r ', 's.r ', 1)})"
        f" WHERE it < {rounds} GROUP BY it, target, id)"
    )


def _init(*ids: int) -> str:
    values = ", ".join(f"({i}::BIGINT)" for i in ids)
    return f"tg(target) AS (VALUES {values}), s0 AS (SELECT target, id, 0.0::DOUBLE AS p, CASE WHEN id = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM vx, tg)"


def _with(*parts: str, graph: str = EV) -> str:
    return "WITH RECURSIVE " + graph.strip() + ", ".join([CFG.strip(), *parts]) + " "


def _state(rounds: int, *ids: int) -> list[str]:
    return [_window("w0", 0), _weights("x0", "w0"), _init(*(ids or (5,))), _push("st", "s0", "x0", rounds)]


def _at(rounds: int, name: str = "st") -> str:
    return f"(SELECT target, id, p, r FROM {name} WHERE it = {rounds})"


def _repaired(*ids: int) -> list[str]:
    return [
        *_state(8, *ids),
        _updates("up", 0),
        f"s8 AS {_at(8)}",
        "dg AS (SELECT id, count(src) AS d FROM vx LEFT JOIN w0 ON src = id GROUP BY 1)",
        "dl AS (SELECT target, up.src AS id, sum(sign) AS change, sum(CASE WHEN sign < 0 THEN 1 ELSE 0 END) AS deleted, 0.85::DOUBLE * sum(sign * p) AS mass FROM up JOIN s8 ON s8.id = up.dst GROUP BY 1, 2)",
        "rp AS (SELECT s8.target, s8.id, p, CASE WHEN change IS NULL THEN r ELSE"
        " (((d + 1.0) * (p + 0.15::DOUBLE * r - CASE WHEN s8.id = s8.target THEN 0.15::DOUBLE ELSE 0 END) + mass) / (d + change + 1.0)"
        " + CASE WHEN s8.id = s8.target THEN 0.15::DOUBLE ELSE 0 END - p) / 0.15::DOUBLE END AS r"
        " FROM s8 LEFT JOIN dl ON s8.target = dl.target AND s8.id = dl.id LEFT JOIN dg ON dg.id = s8.id)",
    ]


def _one_batch(*ids: int) -> str:
    parts = [*_repaired(*ids), _window("w1", 1), _weights("x1", "w1"), _push("sa", "rp", "x1", 8), f"a8 AS {_at(8, 'sa')}", _push("sb", "a8", "x1", 8, -1)]
    return _with(*parts) + "SELECT target, id, round(p, 8) AS p, round(r, 8) AS r FROM sb WHERE it = 8"


def _power(rounds: int, forward: bool = False) -> list[str]:
    frm, to = ("src", "dst") if forward else ("dst", "src")
    return [
        _window("w0", 0), _weights("x0", "w0"), "tg(target) AS (VALUES (5::BIGINT))",
        "pw AS (SELECT 0 AS it, target, id, 0.0::DOUBLE AS v FROM vx, tg UNION ALL SELECT it + 1, target, id, sum(v) FROM ("
        " SELECT it, target, id, CASE WHEN id = target THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS v FROM pw"
        f" UNION ALL SELECT s.it, s.target, x.{to}, x.w * s.v FROM pw s JOIN x0 x ON x.{frm} = s.id) WHERE it < {rounds} GROUP BY it, target, id)",
    ]


_DEG0 = "dg AS (SELECT vx.id, (SELECT count(*) FROM w0 WHERE src = vx.id) AS d, (SELECT count(*) FROM w0 WHERE dst = vx.id) AS in_d FROM vx)"
_HASH = "(id % 2147483648 * 2654435761 + 17) % 4294967296"
_HOT3 = "SELECT target, id FROM st WHERE it = {} AND r > 1e-5"

ORACLE: dict[str, str] = {
    "edge_stream": _with() + "SELECT pos, src, dst FROM e",
    "encode_rebase": _with("r AS (SELECT pos, src + 7 AS src, dst + 7 AS dst FROM e)", "b AS (SELECT least(min(src), min(dst)) AS low, greatest(max(src), max(dst)) AS high FROM r)") + "SELECT pos, src - low AS src, dst - low AS dst, high - low + 1 AS n FROM r, b",
    "encode_shuffled": _with("b AS (SELECT least(min(src), min(dst)) AS low, greatest(max(src), max(dst)) AS high FROM e)")
    + "SELECT row_number() OVER (ORDER BY (pos % 2147483648 * 2654435761 + 11) % 4294967296, pos) - 1 AS pos, dst - low AS src, src - low AS dst, high - low + 1 AS n FROM e, b",
    "reverse_edges": _with() + "SELECT pos, dst AS src, src AS dst FROM e",
    "mirror_undirected": _with(_window("w0", 0), graph=LI) + f"SELECT src, dst, count(*) AS m FROM {MIRROR.format('w0')} GROUP BY 1, 2",
    "ts_edge_list": _with(_window("w0", 0), graph=LI) + "SELECT src, dst, 2 * pos AS ts FROM w0 UNION ALL SELECT dst, src, 2 * pos + 1 FROM w0",
    "out_degree": _with() + "SELECT id, count(src) AS d FROM vx LEFT JOIN e ON src = id GROUP BY 1",
    "in_degree": _with() + "SELECT id, count(src) AS in_d FROM vx LEFT JOIN e ON dst = id GROUP BY 1",
    "window_degree": _with(_window("w0", 0), _DEG0) + "SELECT id, d, in_d FROM dg",
    "hopping_window_degree": _with("c AS (SELECT w, w // 2 AS h FROM cf)", "b AS (SELECT unnest(range(0, ((SELECT count(*) FROM e) - w) // h + 1)) AS batch FROM c)") + "SELECT batch, src AS id, count(*) AS d FROM e, c, b WHERE pos >= batch * h AND pos < batch * h + w GROUP BY 1, 2",
    "window_edges": _with(_window("w3", 3)) + "SELECT pos, src, dst FROM w3",
    "row_ptr": _with(_window("w0", 0), _DEG0) + "SELECT id, (coalesce(sum(d) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS row_ptr FROM dg",
    "adjacency_lists": _with(_window("w0", 0)) + "SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS neighbours FROM w0 GROUP BY 1",
    "edge_pairs_sorted": _with(_window("w0", 0)) + "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM w0",
    "id_range_stats": _with() + "SELECT least(min(src), min(dst)) AS min_id, greatest(max(src), max(dst)) AS max_id, 2 * count(*) AS n_ends FROM e",
    "id_range_violations": _with() + "SELECT count(*) AS n_violations FROM e WHERE NOT (src BETWEEN 0 AND 9 AND dst BETWEEN 0 AND 9)",
    "transition_weights": _with(_window("w0", 0), _weights("x0", "w0")) + "SELECT src, dst, m, round(w, 8) AS w FROM x0",
    "slide_config": _with("n AS (SELECT count(*) AS n FROM e)") + "SELECT 'ratio' AS mode, n // 10 AS w, CAST(floor((n // 10) * 0.1) AS BIGINT) AS k, 7::BIGINT AS b, CAST(floor((n // 10) * 0.1) AS BIGINT) * 7 AS total FROM n UNION ALL SELECT 'size', n // 10, 9, 12, 108 FROM n",
    "slide_updates": _with(_updates("up", 0)) + "SELECT pos, src, dst, sign FROM up",
    "slide_updates_undirected": _with(_updates("up", 1), graph=LI) + "SELECT pos, src, dst, sign FROM up UNION ALL SELECT pos, dst, src, sign FROM up",
    "window_after_slide": _with(_window("w2", 2)) + "SELECT pos, src, dst FROM w2",
    "window_incremental": _with(_window("w3", 3), graph=LI) + f"SELECT src, dst, count(*) AS m FROM {MIRROR.format('w3')} GROUP BY 1, 2",
    "update_endpoints": _with(_updates("up", 0)) + "SELECT src AS id FROM up UNION SELECT dst FROM up",
    "batch_delta": _with(*_repaired()) + "SELECT target, id, change::BIGINT AS change, deleted::BIGINT AS deleted, round(mass, 8) AS mass FROM dl",
    "degree_rollback": _with(_window("w0", 0)) + "SELECT id, count(src) AS d FROM vx LEFT JOIN w0 ON src = id GROUP BY 1",
    "init_state": _with(_init(1, 5, 7)) + "SELECT target, id, p, r FROM s0",
    "frontier_seed": _with(*_state(8)) + _HOT3.format(8),
    "frontier_seed_endpoints": _with(*_repaired()) + "SELECT target, id FROM rp WHERE r < -1e-5 AND id IN (SELECT src FROM up UNION SELECT dst FROM up)",
    "push_one_round": _with(*_state(1)) + f"SELECT target, id, round(p, 8) AS p, round(r, 8) AS r FROM {_at(1)}",
    "push_fixed_rounds": _with(*_state(24)) + f"SELECT target, id, round(p, 8) AS p, round(r, 8) AS r FROM {_at(24)}",
    "crossing_frontier": _with(*_state(4)) + _HOT3.format(4) + " EXCEPT " + _HOT3.format(3),
    "repair_frontier": _with(*_state(4)) + _HOT3.format(4) + " INTERSECT " + _HOT3.format(3),
    "residual_repair": _with(*_repaired()) + "SELECT target, id, round(p, 8) AS p, round(r, 8) AS r FROM rp",
    "static_ppr_topk": _with(*_state(24), f"s24 AS {_at(24)}") + "SELECT target, row_number() OVER (ORDER BY p DESC, id)::INTEGER AS rank, id, round(p, 8) AS p FROM s24 ORDER BY rank LIMIT 10",
    "static_ppr_solved": _with(*_state(80), f"s80 AS {_at(80)}") + "SELECT target, row_number() OVER (ORDER BY p DESC, id)::INTEGER AS rank, id, round(p, 8) AS p FROM s80 ORDER BY rank LIMIT 10",
    "dynamic_ppr_one_batch": _one_batch(5),
    "dynamic_ppr_multi_target": _one_batch(1, 5, 7),
    "power_reverse_fixed": _with(*_power(20)) + "SELECT target, id, round(v, 8) AS v FROM pw WHERE it = 20",
    "power_forward_fixed": _with(*_power(20, True)) + "SELECT target, id, round(v, 8) AS v FROM pw WHERE it = 20",
    "linf_delta": _with(*_power(8)) + "SELECT a.it AS round, round(max(abs(a.v - b.v)), 8) AS delta FROM pw a JOIN pw b ON a.it = b.it + 1 AND a.id = b.id GROUP BY 1",
    "validate_contract": "SELECT count(DISTINCT user_id) AS n_vertices, 0::BIGINT AS n_residual_viol, 0::BIGINT AS n_value_viol FROM events",
    "validate_dynamic": "SELECT count(DISTINCT user_id) AS n_vertices, 0::BIGINT AS n_residual_viol, 0::BIGINT AS n_value_viol FROM events",
    "sparse_dynamic": "SELECT count(DISTINCT user_id) AS n_vertices, 0::BIGINT AS n_residual_viol, 0::BIGINT AS n_value_viol FROM events",
    "validate_window": "SELECT 0::BIGINT AS n_differences",
    "top_degree_10": _with(_window("w0", 0), _DEG0) + "SELECT id, d FROM dg ORDER BY d DESC, id LIMIT 10",
    "degree_rank_range_sample": _with(_window("w0", 0), _DEG0, "rk AS (SELECT row_number() OVER (ORDER BY d DESC, id) - 1 AS rank, id, d, in_d FROM dg)") + f"SELECT rank, id, d FROM rk WHERE rank >= 5 AND rank < 100 AND d > 0 AND in_d > 0 ORDER BY {_HASH}, id LIMIT 10",
    "uniform_sample": _with(_window("w0", 0), _DEG0) + f"SELECT id FROM dg WHERE d > 0 AND in_d > 0 ORDER BY {_HASH}, id LIMIT 10",
    "prefix_scans": _with(_window("w0", 0), _DEG0)
    + "SELECT id, d, (sum(d) OVER a - d)::BIGINT AS exclusive, (sum(d) OVER a)::BIGINT AS inclusive, (sum(d) OVER b - d)::BIGINT AS back_exclusive, (sum(d) OVER b)::BIGINT AS back_inclusive FROM dg WINDOW a AS (ORDER BY id ROWS UNBOUNDED PRECEDING), b AS (ORDER BY id DESC ROWS UNBOUNDED PRECEDING)",
    "encode_roundtrip": _with("n AS (SELECT max(id) + 1 AS n FROM vx)") + "SELECT 0::BIGINT AS n_wrong, count(*) AS n_edges, any_value(n) AS n FROM e, n",
    "frontier_counts_per_round": _with(*_state(5), _DEG0, "rs AS (SELECT unnest(range(0, 6)) AS round)")
    + "SELECT round::INTEGER AS round, count(h.id) AS expanded, coalesce(sum(in_d), 0)::BIGINT AS traversed FROM rs LEFT JOIN (SELECT it, id FROM st WHERE r > 1e-5) h ON h.it = round LEFT JOIN dg ON dg.id = h.id GROUP BY 1",
    "edge_list_roundtrip": _with(_window("w0", 0), graph=LI) + "SELECT src, dst, 2 * pos AS ts FROM w0 UNION ALL SELECT dst, src, 2 * pos + 1 FROM w0",
    "vertex_list_slice": _with(_window("w0", 0), _DEG0) + "SELECT id AS target FROM (SELECT id, row_number() OVER (ORDER BY d DESC, id) - 1 AS rank FROM dg) WHERE rank >= 3 AND rank < 10",
    "log_keywords": "SELECT 'of_' || (event_id % 3) AS keyword, max(event_id)::DOUBLE AS value FROM events GROUP BY 1",
    "mean_per_configuration": _with(_window("w0", 0), _DEG0) + "SELECT id % 3 AS config, round(avg(d), 8) AS mean, count(*) AS n FROM dg GROUP BY 1",
    "next_frontier": _with(*_state(4)) + _HOT3.format(4),
    "slide_reports": _with("n AS (SELECT count(*) AS n FROM e)") + "SELECT 'small' AS mode, 100::BIGINT AS total, least(100, n - n // 10) AS reported, 1000::BIGINT AS every FROM n UNION ALL SELECT 'large', 100000000, n - n // 2, 1 FROM n",
    "streaming_contract": "SELECT count(DISTINCT user_id) AS n_vertices, 0::BIGINT AS n_residual_viol, 0::BIGINT AS n_value_viol, 2::BIGINT AS slides FROM events",
    "metrics_counts": _with() + "SELECT 'k' AS name, 3::BIGINT AS batches, 3.0::DOUBLE * k AS total, k::DOUBLE AS mean, k::DOUBLE AS most FROM cf UNION ALL SELECT 'target_count', 3, 3.0, 1.0, 1.0",
    "variants_agree": "SELECT unnest(['optimized', 'fast_frontier', 'eager', 'vanilla', 'merged', 'arrow']) AS variant, 0::BIGINT AS n_wrong",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
