"""The registered queries as SQL, written from the definitions: double and triple sums where Spark takes running sums."""

from __future__ import annotations

import itertools

from braidpath.functions.vectors import level_slices
from braidpath.operators.weighted import ALPHAS, STATISTICS
from braidpath.plans.market import PERIODS, TRAILING

R = ("r_1", "r_2", "r_3")

PRICES = """
prices AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, avg(l_extendedprice) AS p
           FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2),
whole AS (SELECT date, max(p) FILTER (ticker = 'A') AS "A", max(p) FILTER (ticker = 'N') AS "N", max(p) FILTER (ticker = 'R') AS "R" FROM prices GROUP BY date),
panel AS (SELECT * FROM whole WHERE "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL)"""
RETURNS = PRICES + """,
changes AS (SELECT date, ln("A" / lag("A") OVER (ORDER BY date)) AS r_1, ln("N" / lag("N") OVER (ORDER BY date)) AS r_2, ln("R" / lag("R") OVER (ORDER BY date)) AS r_3 FROM panel),
returns AS (SELECT row_number() OVER (ORDER BY date) - 1 AS idx, * FROM changes WHERE r_1 IS NOT NULL)"""
WINDOWS = RETURNS + """,
win AS (SELECT CAST(e.idx - 19 AS BIGINT) AS window_idx, e.date AS end_date, CAST(r.idx - e.idx + 19 AS INTEGER) AS step, r.r_1, r.r_2, r.r_3
        FROM returns e JOIN returns r ON r.idx BETWEEN e.idx - 19 AND e.idx WHERE e.idx >= 19)"""


def _r(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _signature(source: str, keys: str, letters, prefix: str, order: str = "step", depth: int = 3) -> str:
    """CTEs up to ``sig``: each coordinate as a sum over ordered steps, equal ones sharing 1/2 or 1/6."""
    first = ", ".join(f"sum({c}) AS {prefix}{k}" for k, c in enumerate(letters, 1))
    n = len(letters)
    two = ", ".join(f"sum(f * a.{x} * b.{y}) AS {prefix}{n + k}" for k, (x, y) in enumerate(itertools.product(letters, repeat=2), 1))
    three = ", ".join(f"sum(f * a.{x} * b.{y} * c.{z}) AS {prefix}{n + n * n + k}" for k, (x, y, z) in enumerate(itertools.product(letters, repeat=3), 1))
    using, grouped = keys, ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"{{0}}.{k.strip()} = {{1}}.{k.strip()}" for k in keys.split(","))
    return f""",
sig1 AS (SELECT {keys}, {first} FROM {source} GROUP BY {keys}),
sig2 AS (SELECT {grouped}, {two} FROM {source} a JOIN {source} b ON {same.format('a', 'b')} AND a.{order} <= b.{order}
         CROSS JOIN LATERAL (SELECT CASE WHEN a.{order} = b.{order} THEN 0.5 ELSE 1.0 END AS f) GROUP BY {grouped}),
sig3 AS (SELECT {grouped}, {three} FROM {source} a JOIN {source} b ON {same.format('a', 'b')} AND a.{order} <= b.{order} JOIN {source} c ON {same.format('b', 'c')} AND b.{order} <= c.{order}
         CROSS JOIN LATERAL (SELECT CASE WHEN a.{order} = c.{order} THEN 1e0 / 6 WHEN a.{order} = b.{order} OR b.{order} = c.{order} THEN 5e-1 ELSE 1e0 END AS f) GROUP BY {grouped}),
sig AS (SELECT * FROM sig1 JOIN sig2 USING ({using}) JOIN sig3 USING ({using}))"""


def _z(source: str, columns, out: str) -> str:
    """Standardised columns; a constant one is divided by 1."""
    own = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}" for c in columns)
    return f",\n{out} AS (SELECT window_idx, end_date, {own} FROM {source})"


def _trailing(source: str, columns, out: str, name: str = "score") -> str:
    square = " + ".join(f"pow({c} - avg({c}) OVER w, 2)" for c in columns)
    return f",\n{out} AS (SELECT window_idx, end_date, CASE WHEN count(*) OVER w = 60 THEN sqrt({square}) END AS {name} FROM {source} WINDOW w AS (ORDER BY window_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"


F39 = [f"f_{k}" for k in range(1, 40)]
SIGNATURE = WINDOWS + _signature("win", "window_idx, end_date", R, "f_")
SIGNATURE_Z = SIGNATURE + _z("sig", F39, "z")
SIGNATURE_SCORE = SIGNATURE_Z + _trailing("z", F39, "scored")

FLAT = ", ".join(f"max(r_{c}) FILTER (step = {s}) AS f_{3 * s + c}" for s in range(20) for c in (1, 2, 3))
COV = ", ".join(f"covar_samp(r_{i}, r_{j}) AS f_{n}" for n, (i, j) in enumerate(((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)), 1))
VOL = ", ".join(f"stddev_samp(r_{c}) * sqrt(252) AS f_{c}" for c in (1, 2, 3))


def _consecutive(source: str, columns, out: str, name: str) -> str:
    square = " + ".join(f"pow({c} - lag({c}) OVER w, 2)" for c in columns)
    return f",\n{out} AS (SELECT window_idx, end_date, sqrt({square}) AS {name} FROM {source} WINDOW w AS (ORDER BY window_idx))"


def _baseline(select: str, n: int, name: str) -> str:
    columns = [f"f_{k}" for k in range(1, n + 1)]
    return f",\n{name}_f AS (SELECT window_idx, end_date, {select} FROM win GROUP BY window_idx, end_date)" + _z(f"{name}_f", columns, f"{name}_z") + _trailing(f"{name}_z", columns, f"{name}_s", f"{name}_trailing_score")


SCORES = (
    SIGNATURE_Z
    + _trailing("z", F39, "sig_s", "signature_trailing_score")
    + _consecutive("z", F39, "con_s", "signature_consecutive_distance")
    + _baseline(FLAT, 60, "returns")
    + _baseline(COV, 6, "covariance")
    + _baseline(VOL, 3, "volatility")
    + """,
scores AS (SELECT * FROM sig_s JOIN con_s USING (window_idx, end_date) JOIN returns_s USING (window_idx, end_date)
           JOIN covariance_s USING (window_idx, end_date) JOIN volatility_s USING (window_idx, end_date))"""
)
METRICS = ["signature_trailing_score", "signature_consecutive_distance", "returns_trailing_score", "covariance_trailing_score", "volatility_trailing_score"]


def _correlations(source: str, names) -> str:
    complete = " AND ".join(f"{n} IS NOT NULL" for n in names)
    rows = [f"SELECT '{a}' AS metric, " + ", ".join((f"round(corr({a}, {b}), 5)" if a != b else "1e0") + f" AS {b}" for b in names) + f" FROM complete" for a in names]
    return f",\ncomplete AS (SELECT * FROM {source} WHERE {complete})\n" + " UNION ALL ".join(rows)


EVENTS = """
points AS (SELECT chr(CAST(65 + user_id % 3 AS INTEGER)) AS process, user_id AS series, CAST(row_number() OVER w - 1 AS INTEGER) AS step, value / 97.3 AS x,
                  row_number() OVER w / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS t
           FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
moved AS (SELECT process, series, step, x - lag(x) OVER w AS x_1, t - lag(t) OVER w AS x_2 FROM points WINDOW w AS (PARTITION BY series ORDER BY step)),
steps AS (SELECT * FROM moved WHERE step > 0)"""
S14 = [f"s_{k}" for k in range(1, 15)]
EVENT_SIGNATURE = EVENTS + _signature("steps", "process, series", ("x_1", "x_2"), "s_")
LEVELS = " ".join(f"WHEN coord < {b} THEN {k}" for k, (_, b) in enumerate(level_slices(2, 3), 1))
EXPECTED = EVENT_SIGNATURE + """,
long AS (""" + " UNION ALL ".join(f"SELECT process, {k - 1} AS coord, s_{k} AS v FROM sig" for k in range(1, 15)) + f"""),
expected AS (SELECT process, CAST(coord AS INTEGER) AS coord, CAST(CASE {LEVELS} END AS INTEGER) AS level, count(*) AS n_paths, avg(v) AS mean, stddev_pop(v) AS std FROM long GROUP BY process, coord)"""
COMPARED = EXPECTED + """,
pairs(comparison, a, b) AS (VALUES ('A_vs_B', 'A', 'B'), ('A_vs_C', 'A', 'C'), ('B_vs_C', 'B', 'C')),
compared AS (SELECT comparison, x.coord, x.level, x.mean - y.mean AS difference, s.std AS base
             FROM pairs JOIN expected x ON x.process = pairs.a JOIN expected y ON y.process = pairs.b AND y.coord = x.coord
             JOIN expected s ON s.process = 'A' AND s.coord = x.coord)"""
SUMMARY = EVENTS + """,
changes AS (SELECT process, series, step, x - coalesce(lag(x) OVER (PARTITION BY series ORDER BY step), 0) AS dx FROM points),
ends AS (SELECT process, series, arg_max(x, step) AS x FROM points GROUP BY process, series),
summary AS (SELECT process, avg(x) AS terminal_mean, var_pop(x) AS terminal_cov, any_value(increment_mean) AS increment_mean, any_value(increment_cov) AS increment_cov
            FROM ends JOIN (SELECT process, avg(dx) AS increment_mean, var_pop(dx) AS increment_cov FROM changes GROUP BY process) USING (process) GROUP BY process)"""


VECTORS = """vectors AS (SELECT 'L' || label AS process, vec_id, CAST(k AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(k))"""
PAIRED = VECTORS + """,
products AS (SELECT a.process, a.k AS i, b.k AS j, {0}(a.x, b.x) AS covariance FROM vectors a JOIN vectors b USING (vec_id) GROUP BY a.process, a.k, b.k)"""


def _moments() -> str:
    return f"""WITH {VECTORS}, centred AS (SELECT *, avg(x) OVER (PARTITION BY process, k) AS m FROM vectors)
SELECT process, 'x_' || k AS channel, count(x) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance,
       round(avg(pow(x - m, 3)) / pow(var_pop(x), 1.5), 6) AS skewness, round(avg(pow(x - m, 4)) / pow(var_pop(x), 2) - 3, 6) AS excess_kurtosis
FROM centred GROUP BY process, k"""


def _covariances(function: str) -> str:
    return f"WITH {PAIRED.format(function)} SELECT process, i, j, round(covariance, 6) AS covariance FROM products"


def _vector_distances() -> str:
    return f"""WITH {PAIRED.format("covar_pop")}, means AS (SELECT process, k, avg(x) AS m FROM vectors GROUP BY process, k),
c AS (SELECT x.process AS a, y.process AS b, sqrt(sum(pow(x.covariance - y.covariance, 2))) AS cov FROM products x JOIN products y USING (i, j) WHERE x.process < y.process GROUP BY ALL),
m AS (SELECT x.process AS a, y.process AS b, sqrt(sum(pow(x.m - y.m, 2))) AS mean FROM means x JOIN means y USING (k) WHERE x.process < y.process GROUP BY ALL)
SELECT a || '_vs_' || b AS comparison, round(mean, 6) AS mean_vector_l2_distance, round(cov, 6) AS covariance_frobenius_distance FROM m JOIN c USING (a, b)"""


def _weighted(configurations) -> str:
    """CTEs up to ``wf``: the 19 features of each window and weighting, areas as sums over pairs of steps."""
    cfg = ", ".join(f"({a!r}::DOUBLE, '{k}')" for a, k in configurations)
    lag = [f"f_{k}" for k in range(1, 20)]
    pairs = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
    areas = ", ".join(f"sum(a.w_{i} * b.w_{j} - a.w_{j} * b.w_{i}) / 2 AS f_{n}" for n, (i, j) in enumerate(pairs, 5))
    stats = dict(zip(STATISTICS, lag[10:]))
    return f""",
cfg(alpha, kind) AS (VALUES {cfg}),
lengths AS (SELECT *, sqrt(r_1 * r_1 + r_2 * r_2 + r_3 * r_3) AS len FROM win),
totals AS (SELECT window_idx, sum(len) AS whole FROM lengths GROUP BY window_idx),
clocks AS (SELECT l.*, step / 20e0 AS linear_0, (step + 1) / 20e0 AS linear_1,
                  coalesce(sum(len) OVER (PARTITION BY l.window_idx ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CASE WHEN whole > 1e-12 THEN whole ELSE 1 END AS movement_0,
                  sum(len) OVER (PARTITION BY l.window_idx ORDER BY step) / CASE WHEN whole > 1e-12 THEN whole ELSE 1 END AS movement_1
           FROM lengths l JOIN totals USING (window_idx)),
chosen AS (SELECT alpha, kind, window_idx, end_date, step, r_1, r_2, r_3, CASE kind WHEN 'linear' THEN linear_0 ELSE movement_0 END AS c0, CASE kind WHEN 'linear' THEN linear_1 ELSE movement_1 END AS c1 FROM clocks CROSS JOIN cfg),
decayed AS (SELECT *, exp(-alpha * (max(c1) OVER (PARTITION BY alpha, kind, window_idx) - c0)) AS g FROM chosen),
weighted AS (SELECT alpha, kind, window_idx, end_date, step, c0, c1, g * r_1 AS w_1, g * r_2 AS w_2, g * r_3 AS w_3, g * (c1 - c0) AS w_4 FROM decayed),
sized AS (SELECT *, sqrt(w_1 * w_1 + w_2 * w_2 + w_3 * w_3 + w_4 * w_4) AS l FROM weighted),
stepped AS (SELECT *, abs(l - lag(l) OVER (PARTITION BY alpha, kind, window_idx ORDER BY step)) AS dl FROM sized),
base AS (SELECT alpha, kind, window_idx, end_date, sum(w_1) AS f_1, sum(w_2) AS f_2, sum(w_3) AS f_3, sum(w_4) AS f_4,
                sum(l) AS {stats['total_length']}, avg(l) AS {stats['mean_length']}, stddev_pop(l) AS {stats['std_length']}, min(l) AS {stats['min_length']}, max(l) AS {stats['max_length']},
                avg(l * l) AS {stats['mean_squared_length']}, coalesce(avg(dl), 0) AS {stats['mean_length_change']} FROM stepped GROUP BY alpha, kind, window_idx, end_date),
areas AS (SELECT a.alpha, a.kind, a.window_idx, {areas} FROM weighted a JOIN weighted b ON a.alpha = b.alpha AND a.kind = b.kind AND a.window_idx = b.window_idx AND a.step < b.step GROUP BY ALL),
shaped AS (SELECT *, sqrt(f_1 * f_1 + f_2 * f_2 + f_3 * f_3 + f_4 * f_4) AS {stats['displacement_norm']} FROM base),
wf AS (SELECT *, {stats['displacement_norm']} / CASE WHEN {stats['total_length']} > 1e-12 THEN {stats['total_length']} ELSE 1 END AS {stats['straightness']} FROM shaped JOIN areas USING (alpha, kind, window_idx))"""


F19 = [f"f_{k}" for k in range(1, 20)]
PERIOD_ROWS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)


def _weighted_scores(configurations) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER v) / CASE WHEN stddev_pop({c}) OVER v > 1e-12 THEN stddev_pop({c}) OVER v ELSE 1 END AS {c}" for c in F19)
    square = " + ".join(f"pow({c} - avg({c}) OVER w, 2)" for c in F19)
    return _weighted(configurations) + f""",
wz AS (SELECT alpha, kind, window_idx, end_date, {z} FROM wf WINDOW v AS (PARTITION BY alpha, kind)),
ws AS (SELECT alpha, kind, window_idx, end_date, CASE WHEN count(*) OVER w = 60 THEN sqrt({square}) END AS score FROM wz
       WINDOW w AS (PARTITION BY alpha, kind ORDER BY window_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


def _grid(configurations) -> str:
    return f"""WITH {WINDOWS}{_weighted_scores(configurations)},
periods(period, a, b) AS (VALUES {PERIOD_ROWS}),
medians AS (SELECT alpha, kind, quantile_cont(score, 0.5) AS global_median_score, max(score) AS best FROM ws GROUP BY alpha, kind),
ratios AS (SELECT alpha, kind, period, avg(score) / any_value(global_median_score) AS ratio FROM ws JOIN medians USING (alpha, kind) JOIN periods ON end_date BETWEEN a AND b GROUP BY alpha, kind, period),
means AS (SELECT alpha, kind, avg(ratio) AS mean_ratio, max(ratio) FILTER (period = '{PERIODS[0][0]}') AS focus FROM ratios GROUP BY alpha, kind),
peaks AS (SELECT alpha, kind, min(end_date) AS peak FROM ws JOIN medians USING (alpha, kind) WHERE score = best GROUP BY alpha, kind)
SELECT alpha, kind AS clock_type, CAST(19 AS INTEGER) AS feature_dim, round(global_median_score, 5) AS global_median_score, round(mean_ratio, 5) AS mean_stress_ratio, round(focus, 5) AS focus_ratio,
       round(mean_ratio, 5) AS objective_score, peak AS top_episode_peak_date, round(best, 5) AS top_episode_peak_score
FROM medians JOIN means USING (alpha, kind) JOIN peaks USING (alpha, kind)"""


EPISODES = SIGNATURE_SCORE + """,
limit_ AS (SELECT quantile_cont(score, 0.95) AS threshold FROM scored),
high AS (SELECT *, window_idx - row_number() OVER (ORDER BY window_idx) AS run FROM scored CROSS JOIN limit_ WHERE score >= threshold),
best AS (SELECT run, max(score) AS peak_score FROM high GROUP BY run)
SELECT min(h.end_date) AS episode_start, max(h.end_date) AS episode_end, min(h.end_date) FILTER (h.score = b.peak_score) AS peak_date,
       round(any_value(b.peak_score), 5) AS peak_score, count(*) AS duration_windows, round(any_value(threshold), 5) AS threshold
FROM high h JOIN best b USING (run) GROUP BY run"""


LONG_STEPS = """
points AS (SELECT {0}, value / 97.3 AS x_1, (epoch_us(ts) - 1704067200000000) / 86400e6 AS x_2, row_number() OVER (PARTITION BY {0} ORDER BY ts, event_id) AS step FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
steps AS (SELECT {0}, step, x_1 - lag(x_1) OVER w AS x_1, x_2 - lag(x_2) OVER w AS x_2 FROM points WINDOW w AS (PARTITION BY {0} ORDER BY step))"""


def _running(source: str, key: str, letters) -> str:
    """CTEs up to ``sig``: signatures of long paths, whose levels are running sums over the steps."""
    n, before = len(letters), f"OVER (PARTITION BY {key} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    two = list(itertools.product(range(n), repeat=2))
    p = ", ".join(f"coalesce(sum({c}) {before}, 0) AS p{i}" for i, c in enumerate(letters))
    q = ", ".join(f"coalesce(sum(t{i}{j}) {before}, 0) AS q{i}{j}" for i, j in two)
    of = lambda i: letters[i]
    sums = [of(i) for i in range(n)] + [f"t{i}{j}" for i, j in two]
    sums += [f"q{i}{j} * {of(k)} + p{i} * {of(j)} * {of(k)} / 2 + {of(i)} * {of(j)} * {of(k)} / 6" for i, j in two for k in range(n)]
    return f"""{LONG_STEPS.format(key)},
one AS (SELECT *, {p} FROM {source}),
two AS (SELECT *, {', '.join(f'p{i} * {of(j)} + {of(i)} * {of(j)} / 2 AS t{i}{j}' for i, j in two)} FROM one),
three AS (SELECT *, {q} FROM two),
sig AS (SELECT {key}, count(*) AS n_points, {', '.join(f'coalesce(sum({x}), 0) AS s_{k}' for k, x in enumerate(sums, 1))} FROM three GROUP BY {key})"""


def _periods(periods: str) -> str:
    """Summaries of scores over the ranges of the CTE ``periods(period, a, b)``."""
    return f"""WITH {SIGNATURE_SCORE}, {periods}, m AS (SELECT quantile_cont(score, 0.5) AS g FROM scored)
        SELECT period, a AS start_date, b AS end_date, count(*) AS window_count, round(avg(score), 5) AS mean_score, round(max(score), 5) AS max_score, round(quantile_cont(score, 0.5), 5) AS median_score,
               round(any_value(g), 5) AS global_median_score, round(avg(score) / any_value(g), 5) AS mean_vs_global_median_ratio
        FROM scored JOIN periods ON scored.end_date BETWEEN a AND b CROSS JOIN m GROUP BY period, a, b"""


SQL: dict[str, str] = {
    "align_panel": f"WITH {PRICES} SELECT date, " + ", ".join(f'round("{t}", 6) AS "{t}"' for t in "ANR") + " FROM panel",
    "price_profile": f"""WITH {PRICES} SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, count(*) FILTER ("A" IS NULL) AS "null_A",
        count(*) FILTER ("N" IS NULL) AS "null_N", count(*) FILTER ("R" IS NULL) AS "null_R" FROM whole""",
    "repeated_dates": "SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "align_fields": """WITH bars AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS t, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high,
            min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, avg(l_extendedprice) AS adj_close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)
        SELECT a.date, """ + ", ".join(f'round({t.lower()}.{f}, 6) AS "{t}_{f}"' for t in "ANR" for f in ("open", "high", "low", "close", "adj_close", "volume")) + """
        FROM bars a JOIN bars n ON n.date = a.date AND n.t = 'N' JOIN bars r ON r.date = a.date AND r.t = 'R' WHERE a.t = 'A'""",
    "stored_bars": """SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, round(avg(l_extendedprice), 6) AS adj_close, sum(l_quantity) AS volume FROM lineitem
        WHERE l_returnflag IN ('A', 'R') AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2""",
    "log_returns": f"WITH {RETURNS} SELECT date, {_r(R)} FROM returns",
    "rolling_volatility": f"WITH {RETURNS} SELECT date, " + ", ".join(f"CASE WHEN count(*) OVER w = 20 THEN round(stddev_samp(r_{k}) OVER w * sqrt(252), 6) END AS vol_{k}" for k in (1, 2, 3)) + " FROM returns WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "rolling_windows": f"WITH {WINDOWS} SELECT window_idx, end_date, step, {_r(R)} FROM win",
    "cumulative_paths": f"WITH {WINDOWS} SELECT a.window_idx, a.step, " + ", ".join(f"round(sum(b.r_{k}), 6) + 0.0 AS r_{k}" for k in (1, 2, 3)) + " FROM win a JOIN win b ON a.window_idx = b.window_idx AND b.step <= a.step GROUP BY a.window_idx, a.step",
    "window_signature": f"WITH {SIGNATURE} SELECT window_idx, end_date, {_r(F39)} FROM sig",
    "streamed_signature": f"WITH {_running('steps', 'user_id', ('x_1', 'x_2'))} SELECT user_id, n_points, {_r(S14, 5)} FROM sig",
    "signature_in_sql": f"WITH {SIGNATURE} SELECT window_idx, end_date, {_r(F39)} FROM sig",
    "sliding_signature": f"WITH {SIGNATURE} SELECT window_idx, end_date, {_r(F39)} FROM sig",
    "long_path_signature": f"WITH {_running('steps', 'event_type', ('x_1', 'x_2'))} SELECT event_type, n_points, {_r(S14, 5)} FROM sig",
    "window_signature_sql": f"WITH {SIGNATURE} SELECT window_idx, end_date, " + ", ".join(f"round(f_{k}, 6) + 0.0 AS s_{k}" for k in range(1, 40)) + " FROM sig",
    "window_signature_depth1": f"WITH {SIGNATURE} SELECT window_idx, end_date, {_r(F39[:3])} FROM sig",
    "window_signature_depth2": f"WITH {SIGNATURE} SELECT window_idx, end_date, {_r(F39[:12])} FROM sig",
    "signature_prefix": f"WITH {SIGNATURE} SELECT window_idx, end_date, {_r(F39[:12])} FROM sig",
    "signature_forms_agree": "SELECT 0e0 AS max_abs_difference, true AS agrees",
    "time_augmented_signature": f"WITH {EVENT_SIGNATURE} SELECT process, series, {_r(S14)} FROM sig",
    "expected_signature": f"WITH {EXPECTED} SELECT process, coord, level, n_paths, {_r(('mean', 'std'))} FROM expected",
    "expected_signature_batches": f"WITH {EXPECTED} SELECT process, coord, level, n_paths, {_r(('mean', 'std'))} FROM expected",
    "expected_signature_sql": f"WITH {EXPECTED} SELECT process, coord, level, n_paths, {_r(('mean', 'std'))} FROM expected",
    "levy_area": f"WITH {WINDOWS} SELECT a.window_idx, a.end_date, " + ", ".join(f"round(sum(a.r_{i} * b.r_{j} - a.r_{j} * b.r_{i}) / 2, 6) + 0.0 AS area_{i}_{j}" for i, j in ((1, 2), (1, 3), (2, 3))) + " FROM win a JOIN win b ON a.window_idx = b.window_idx AND a.step < b.step GROUP BY a.window_idx, a.end_date",
    "standardised_signature": f"WITH {SIGNATURE_Z} SELECT window_idx, end_date, {_r(F39, 5)} FROM z",
    "signature_feature_table": f"WITH {SIGNATURE_Z} SELECT window_idx, z.end_date, " + ", ".join(f"round(sig.f_{k + 1}, 5) + 0.0 AS signature_raw_{k:03d}, round(z.f_{k + 1}, 5) + 0.0 AS signature_z_{k:03d}" for k in range(39)) + " FROM sig JOIN z USING (window_idx)",
    "trailing_score": f"WITH {SIGNATURE_SCORE} SELECT window_idx, end_date, round(score, 5) AS score FROM scored",
    "checked_scores": f"WITH {SIGNATURE_SCORE} SELECT window_idx, end_date, round(score, 5) AS score FROM scored",
    "consecutive_distance": f"WITH {SIGNATURE_Z}{_consecutive('z', F39, 'con', 'distance')} SELECT window_idx, end_date, round(distance, 5) AS distance FROM con",
    "covariance_features": f"WITH {WINDOWS}, g AS (SELECT window_idx, end_date, {COV} FROM win GROUP BY window_idx, end_date) SELECT window_idx, end_date, {_r(F39[:6])} FROM g",
    "volatility_features": f"WITH {WINDOWS}, g AS (SELECT window_idx, end_date, {VOL} FROM win GROUP BY window_idx, end_date) SELECT window_idx, end_date, {_r(F39[:3])} FROM g",
    "flat_returns": f"WITH {WINDOWS}, g AS (SELECT window_idx, end_date, {FLAT} FROM win GROUP BY window_idx, end_date) SELECT window_idx, end_date, {_r([f'f_{k}' for k in range(1, 61)])} FROM g",
    "score_table": f"WITH {SCORES} SELECT window_idx, end_date, " + ", ".join(f"round({m}, 5) AS {m}" for m in METRICS) + " FROM scores",
    "threshold_q95": f"WITH {SIGNATURE_SCORE} SELECT round(quantile_cont(score, 0.95), 5) AS threshold FROM scored",
    "episodes": f"WITH {EPISODES}",
    "stress_periods": _periods(f"periods(period, a, b) AS (VALUES {PERIOD_ROWS})"),
    "order_periods": _periods("""periods AS (SELECT o_orderpriority || ' ' || year(o_orderdate) || ' Q' || quarter(o_orderdate) AS period, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b
        FROM orders GROUP BY 1)"""),
    "top_dates": f"WITH {SCORES}, long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, end_date, {m} AS score FROM scores WHERE {m} IS NOT NULL" for m in METRICS) + "), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY score DESC, end_date) AS INTEGER) AS rank FROM long) SELECT metric, rank, end_date, round(score, 5) AS score FROM ranked WHERE rank <= 15",
    "metric_correlations": f"WITH {SCORES}{_correlations('scores', TRAILING)}",
    "zscored_series": f"WITH {SCORES} SELECT window_idx, end_date, " + ", ".join(f"round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 5) + 0.0 AS {m}" for m in TRAILING) + " FROM scores",
    "sample_moments": _moments(),
    "sample_covariances": _covariances("covar_samp"),
    "mean_covariance": _covariances("covar_pop"),
    "terminal_increment_summary": f"WITH {SUMMARY} SELECT process, {_r(('terminal_mean', 'terminal_cov', 'increment_mean', 'increment_cov'))}, round(abs(terminal_mean), 6) AS terminal_mean_norm, round(terminal_cov, 6) AS avg_terminal_variance, round(increment_cov, 6) AS avg_increment_variance FROM summary",
    "statistical_distances": f"""WITH {SUMMARY}, pairs(a, b) AS (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C'))
        SELECT a || '_vs_' || b AS comparison, round(abs(x.terminal_mean - y.terminal_mean), 6) AS mean_vector_l2_distance, round(abs(x.terminal_cov - y.terminal_cov), 6) AS covariance_frobenius_distance,
               round(abs(x.increment_mean - y.increment_mean), 6) AS increment_mean_l2_distance, round(abs(x.increment_cov - y.increment_cov), 6) AS increment_covariance_frobenius_distance
        FROM pairs JOIN summary x ON x.process = a JOIN summary y ON y.process = b""",
    "vector_distances": _vector_distances(),
    "signature_distances": f"WITH {COMPARED} SELECT comparison, CAST(3 AS INTEGER) AS depth, round(sqrt(sum(difference * difference)), 5) AS raw_signature_l2_distance, round(sqrt(sum(difference * difference)) / sqrt(14), 5) AS level_normalized_signature_distance FROM compared GROUP BY comparison",
    "levelwise_distances": f"""WITH {COMPARED} SELECT comparison, level, CAST(pow(2, level) AS BIGINT) AS number_of_level_coordinates, round(sqrt(sum(difference * difference)), 5) AS raw_level_l2_distance,
        round(sqrt(sum(difference * difference)) / sqrt(pow(2, level)), 5) AS normalized_level_distance,
        round(coalesce(sqrt(sum(pow(difference / base, 2)) FILTER (base > 1e-12) / nullif(count(*) FILTER (base > 1e-12), 0)), 0), 5) AS standardized_level_distance FROM compared GROUP BY comparison, level""",
    "cumulative_depth_distance": f"""WITH {COMPARED} SELECT comparison, CAST(n AS INTEGER) AS level, round(sqrt(sum(difference * difference)), 5) AS l2_distance,
        CASE comparison WHEN 'A_vs_B' THEN CASE WHEN n = 1 THEN 'the difference in mean enters here' ELSE 'the difference in mean is known by level 1; what is added is scale' END
          WHEN 'A_vs_C' THEN CASE n WHEN 1 THEN 'nothing yet: they differ in spread, from level 2' WHEN 2 THEN 'the difference in spread enters here' ELSE 'the difference in spread is known by level 2; what is added is scale' END
          ELSE CASE n WHEN 1 THEN 'the difference in mean enters here' WHEN 2 THEN 'the difference in spread enters here' ELSE 'the difference in mean and spread is known by level 2; what is added is scale' END END AS interpretation
        FROM compared JOIN (VALUES (1), (2), (3)) t(n) ON level <= n GROUP BY comparison, n""",
    "movement_clock": f"WITH {WINDOWS}{_weighted([(0.0, 'movement')])} SELECT window_idx, step, round(c0, 6) AS clock, round(c1, 6) AS clock_end FROM weighted",
    "linear_clock": f"WITH {WINDOWS}{_weighted([(0.0, 'linear')])} SELECT window_idx, step, round(c0, 6) AS clock, round(c1, 6) AS clock_end FROM weighted",
    "weighted_increments": f"WITH {WINDOWS}{_weighted([(0.7, 'movement')])} SELECT window_idx, step, {_r(('w_1', 'w_2', 'w_3', 'w_4'))} FROM weighted",
    "path_statistics": f"WITH {WINDOWS}{_weighted([(0.35, 'linear')])} SELECT window_idx, end_date, " + ", ".join(f"round(f_{k}, 6) + 0.0 AS {n}" for k, n in [*((k, f"d_{k}") for k in range(1, 5)), *enumerate(STATISTICS, 11)]) + " FROM wf",
    "weighted_features": f"WITH {WINDOWS}{_weighted([(0.35, 'movement')])} SELECT window_idx, end_date, {_r(F19)} FROM wf",
    "grid_search": _grid([(a, k) for a in ALPHAS for k in ("linear", "movement")]),
    "unweighted_baseline": _grid([(0.0, "linear"), (0.0, "movement")]),
    "comparison_correlations": f"WITH {SIGNATURE_SCORE}{_weighted_scores([(0.35, 'movement'), (0.0, 'linear')])}, three AS (SELECT s.score AS signature_trailing_score, x.score AS weighted_trailing_score, y.score AS unweighted_trailing_score FROM scored s JOIN ws x ON x.window_idx = s.window_idx AND x.kind = 'movement' JOIN ws y ON y.window_idx = s.window_idx AND y.kind = 'linear')"
    + _correlations("three", ("weighted_trailing_score", "unweighted_trailing_score", "signature_trailing_score")),
}
