"""DuckDB SQL of the registered queries, written on its own terms."""

from __future__ import annotations

import math
from itertools import combinations

_P0 = "(6.0 / 49.0)"
_N = [f"number_{i}" for i in range(1, 7)]

#: Named parts; each query takes those that it names, and what they build on.
_PARTS = {
    "o": "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS draw_index FROM orders",
    "hh": "SELECT draw_index, n::INTEGER AS n, row_number() OVER (PARTITION BY draw_index ORDER BY ((k * 7919 + n * 104729) * (n * 31 + k % 1009 + 17)) % 1000003, n) AS rk FROM o, (SELECT unnest(range(1, 50)) AS n)",
    "d": "SELECT draw_index, lpad(draw_index::VARCHAR, 9, '0') AS draw_id, (DATE '2007-01-02' + (draw_index % 7000 * 3)::INTEGER)::DATE AS draw_date, list(n ORDER BY n) FILTER (rk <= 6) AS numbers, max(n) FILTER (rk = 7) AS special_number FROM hh WHERE rk <= 7 GROUP BY draw_index",
    "w": "SELECT draw_index, draw_id, draw_date, " + ", ".join(f"numbers[{i}] AS number_{i}" for i in range(1, 7)) + ", special_number FROM d",
    "t": "SELECT count(*) AS t FROM d",
    "p": "SELECT draw_index, n AS number, (rk <= 6)::BIGINT AS y FROM hh",
    "h": "SELECT draw_index, number FROM p WHERE y = 1",
    "gl": "SELECT number, draw_index, draw_index - lag(draw_index) OVER (PARTITION BY number ORDER BY draw_index) AS gap FROM h",
    "g": "SELECT u.number, t AS periods, coalesce(c, 0) AS count, coalesce(t - 1 - l, t) AS current_gap, coalesce(greatest(coalesce(m, 0), f, t - 1 - l), t) AS max_gap, mg AS mean_gap, coalesce(l, -1) AS last_index FROM t, (SELECT unnest(range(1, 50)) AS number) u LEFT JOIN (SELECT number, count(*) AS c, max(draw_index) AS l, min(draw_index) AS f, max(gap) AS m, avg(gap) AS mg FROM gl GROUP BY number) x USING (number)",
    "hi": "SELECT draw_index, number, y, coalesce(sum(y) OVER b, 0) AS count_before, max(CASE WHEN y = 1 THEN draw_index END) OVER b AS last_seen, lag(y) OVER a AS state, lag(y, 2) OVER a AS state_before, coalesce(sum(y) OVER (PARTITION BY number ORDER BY draw_index ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0) AS hot FROM p WINDOW a AS (PARTITION BY number ORDER BY draw_index), b AS (PARTITION BY number ORDER BY draw_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "hx": "SELECT *, coalesce(draw_index - 1 - last_seen, draw_index) AS gap_asof, coalesce(sum((state = 1)::INT) OVER b, 0) AS n1, coalesce(sum((state = 1)::INT * y) OVER b, 0) AS k1, coalesce(sum((state = 0)::INT) OVER b, 0) AS n0, coalesce(sum((state = 0)::INT * y) OVER b, 0) AS k0 FROM hi WINDOW b AS (PARTITION BY number ORDER BY draw_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "hs": "SELECT *, CASE WHEN coalesce(state, 0) = 1 THEN n1 ELSE n0 END AS n_from, CASE WHEN coalesce(state, 0) = 1 THEN k1 ELSE k0 END AS n_to FROM hx",
    "pat": f"""SELECT d.draw_index, len(list_filter(numbers, lambda x: x % 2 = 1)) AS odd_count, len(list_filter(numbers, lambda x: x >= 25)) AS high_count, list_sum(numbers)::BIGINT AS total, numbers[1] AS lowest, numbers[6] AS highest,
  numbers[6] - numbers[1] AS span, list_sum(numbers) / 6.0 AS mean, list_aggregate(numbers, 'stddev_pop') AS std, {" + ".join(f"(numbers[{i + 1}] - numbers[{i}] = 1)::INT" for i in range(1, 6))} AS adjacent_pairs,
  6 - len(list_distinct(list_transform(numbers, lambda x: x % 10))) AS duplicate_tails, coalesce(len(list_intersect(numbers, b.before)), 0) AS overlap_previous, len(list_filter(numbers, lambda x: x IN (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47))) AS prime_count,
  {", ".join(f"len(list_filter(numbers, lambda x: least(x // 10, 4) = {i})) AS decade_{i}" for i in range(5))}, {", ".join(f"numbers[{i + 1}] - numbers[{i}] AS gap_{i}" for i in range(1, 6))}
  FROM d LEFT JOIN (SELECT draw_index + 1 AS draw_index, numbers AS before FROM d) b ON b.draw_index = d.draw_index""",
    # ingest with defects
    "r0": "SELECT draw_index AS seq, draw_id, CASE WHEN draw_index % 61 = 4 THEN (draw_date - 30)::DATE ELSE draw_date END AS draw_date, CASE WHEN draw_index % 97 = 5 THEN 50 ELSE number_1 END AS number_1, CASE WHEN draw_index % 83 = 7 THEN number_3 ELSE number_2 END AS number_2, number_3, number_4, number_5, CASE WHEN draw_index % 89 = 9 THEN NULL ELSE number_6 END AS number_6, CASE WHEN draw_index % 79 = 3 THEN number_4 WHEN draw_index % 73 = 2 THEN NULL ELSE special_number END AS special_number FROM w WHERE draw_index % 101 <> 100",
    "r": "SELECT * FROM r0 UNION ALL SELECT * REPLACE (seq + 10000000 AS seq) FROM r0 WHERE seq % 71 = 1",
    "mi": "SELECT prefix, x.id AS missing FROM (SELECT prefix, unnest(range(min(id), max(id) + 1)) AS id FROM (SELECT substr(draw_id, 1, 3) AS prefix, draw_id::BIGINT AS id FROM r) GROUP BY prefix) x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.draw_id::BIGINT = x.id AND substr(r.draw_id, 1, 3) = x.prefix)",
    "iss": f"""SELECT code, seq FROM (
  SELECT 'missing_number' AS code, seq FROM r WHERE {" OR ".join(f"{c} IS NULL" for c in _N)}
  UNION ALL SELECT 'main_out_of_range', seq FROM r WHERE {" OR ".join(f"coalesce({c} NOT BETWEEN 1 AND 49, false)" for c in _N)}
  UNION ALL SELECT 'main_repeated', seq FROM r WHERE len(list_distinct([{", ".join(_N)}])) <> 6
  UNION ALL SELECT 'special_out_of_range', seq FROM r WHERE special_number NOT BETWEEN 1 AND 49
  UNION ALL SELECT 'special_repeated', seq FROM r WHERE {" OR ".join(f"coalesce(special_number = {c}, false)" for c in _N)}
  UNION ALL SELECT 'special_missing', seq FROM r WHERE special_number IS NULL
  UNION ALL SELECT 'invalid_date', seq FROM r WHERE draw_date IS NULL
  UNION ALL SELECT 'duplicate_draw_id', seq FROM (SELECT seq, count(*) OVER (PARTITION BY draw_id) AS n FROM r) WHERE n > 1
  UNION ALL SELECT 'duplicate_date', seq FROM (SELECT seq, count(*) OVER (PARTITION BY draw_date) AS n FROM r WHERE draw_date IS NOT NULL) WHERE n > 1
  UNION ALL SELECT 'duplicate_row', seq FROM (SELECT seq, count(*) OVER (PARTITION BY draw_id, draw_date, {", ".join(_N)}) AS n FROM r) WHERE n > 1
  UNION ALL SELECT 'not_ascending', seq FROM r WHERE {" OR ".join(f"coalesce(number_{i + 1} < number_{i}, false)" for i in range(1, 6))}
  UNION ALL SELECT 'not_sorted', seq FROM (SELECT seq, draw_date, lag(draw_date) OVER (ORDER BY seq) AS before FROM r) WHERE draw_date < before
  UNION ALL SELECT 'missing_draw_ids', missing FROM mi)""",
    # exponential averages: the seed and each earlier hit's weight, by buckets of periods
    "hb": "SELECT number, draw_index AS i, draw_index // 450 AS b FROM h",
    "pb": "SELECT draw_index, number, unnest([draw_index // 450, draw_index // 450 - 1]) AS b FROM p",
}


def _ewma(alpha: float) -> str:
    return f"SELECT p.draw_index, p.number, {_P0} * (1 - {alpha!r}) ** p.draw_index + coalesce(x.s, 0) AS ewma FROM p LEFT JOIN (SELECT draw_index, number, sum({alpha!r} * (1 - {alpha!r}) ** (draw_index - 1 - i)) AS s FROM pb JOIN hb USING (number, b) WHERE i < draw_index GROUP BY ALL) x USING (draw_index, number)"


_PARTS["e6"], _PARTS["e2"] = _ewma(0.06), _ewma(2 / 21)
_rate = lambda w: f"coalesce(avg(y) OVER (PARTITION BY number ORDER BY draw_index ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0)"
_z = lambda c: f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY draw_index) <= 1e-15 THEN 0 ELSE ({c} - avg({c}) OVER (PARTITION BY draw_index)) / stddev_pop({c}) OVER (PARTITION BY draw_index) END AS z_{c}"
_RAW = ["gap_asof", "ewma", "transition_rate", "long_rate", "rate_20", "rate_50", "rate_100"]
_PARTS["au"] = f"SELECT draw_index, number, y, gap_asof, ewma, (n_to + 30 * {_P0}) / (n_from + 30) AS transition_rate, (count_before + 12 * {_P0}) / (draw_index + 12) AS long_rate, {_rate(20)} AS rate_20, {_rate(50)} AS rate_50, {_rate(100)} AS rate_100 FROM hs JOIN e6 USING (draw_index, number)"
_pct = lambda c: f"(rank() OVER (PARTITION BY draw_index ORDER BY {c}) + (count(*) OVER (PARTITION BY draw_index, {c}) - 1) / 2.0) / 49.0"
_PARTS["sc"] = f"""SELECT strategy, draw_index, number, y, round(score, 12) AS score FROM (SELECT draw_index, number, y, 1.0::DOUBLE AS uniform_random, (count_before + 1)::DOUBLE AS frequency_random, (hot + 1)::DOUBLE AS recent_hot, (gap_asof + 1)::DOUBLE AS cold_number,
  (0.4::DOUBLE * {_pct("hot")} + 0.3::DOUBLE * {_pct("gap_asof")} + 0.3::DOUBLE * (1 - abs({_pct("count_before")} - 0.5) * 2) + 0.01)::DOUBLE AS mixed_hot_cold, (ewma + 1e-3)::DOUBLE AS ewma_frequency, ((count_before + 6) / (draw_index + 49))::DOUBLE AS bayesian_shrinkage, ((n_to + 1) / (n_from + 2))::DOUBLE AS markov
  FROM hs JOIN e2 USING (draw_index, number) WHERE draw_index >= 300) UNPIVOT (score FOR strategy IN (uniform_random, frequency_random, recent_hot, cold_number, mixed_hot_cold, ewma_frequency, bayesian_shrinkage, markov))"""
_PARTS["sp"] = "SELECT strategy, draw_index, y, row_number() OVER (PARTITION BY strategy, draw_index ORDER BY score DESC, number) AS rank, 6 * (score - min(score) OVER x + 1e-9) / (sum(score) OVER x - 49 * min(score) OVER x + 49e-9) AS p FROM sc WINDOW x AS (PARTITION BY strategy, draw_index)"
_PARTS["pp"] = """SELECT strategy, draw_index, sum(CASE WHEN rank <= 6 THEN y ELSE 0 END)::BIGINT AS hits_6, sum(CASE WHEN rank <= 10 THEN y ELSE 0 END)::BIGINT AS hits_10, avg((q - y) ** 2) AS brier, avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS log_loss
  FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM sp) GROUP BY ALL"""
_PARTS["bs"] = f"""SELECT strategy, draw_index, number, y, round(score, 12) AS score FROM (SELECT draw_index, number, y, {_P0}::DOUBLE AS exact_uniform, (number <= 6)::INT::DOUBLE AS fixed_first_six, ((count_before + 12 * {_P0}) / (draw_index + 12))::DOUBLE AS historical_top, r20::DOUBLE AS recent_20, r50::DOUBLE AS recent_50, r100::DOUBLE AS recent_100,
  gap_asof::DOUBLE AS gap, coalesce(state, 0)::DOUBLE AS previous_draw, ((n_to + 30 * {_P0}) / (n_from + 30))::DOUBLE AS transition, (1 - coalesce(state, 0))::DOUBLE AS exclude_last FROM (SELECT *, {_rate(20)} AS r20, {_rate(50)} AS r50, {_rate(100)} AS r100 FROM hs) WHERE draw_index >= 300)
  UNPIVOT (score FOR strategy IN (exact_uniform, fixed_first_six, historical_top, recent_20, recent_50, recent_100, gap, previous_draw, transition, exclude_last))"""
_PARTS["bt"] = "SELECT *, row_number() OVER (PARTITION BY strategy, draw_index ORDER BY score DESC, number) AS rank FROM bs"
_PARTS["yr"] = "SELECT pp.*, year(draw_date) AS year FROM pp JOIN d USING (draw_index)"


_PARTS["lc"] = "SELECT k, t::DOUBLE AS n, lgamma(t + 1) - lgamma(greatest(k, 0) + 1) - lgamma(t - k + 1) AS c FROM (SELECT t, unnest(range(0, t + 1)) AS k FROM t)"
_PARTS["gc"] = f"SELECT number, count(*) AS n, CASE WHEN count(*) >= 20 THEN greatest(0, floor(ln(5 / (count(*) * {_P0})) / ln(1 - {_P0})) + 1)::BIGINT END AS cells FROM gl WHERE gap IS NOT NULL GROUP BY number"
_PARTS["nx"] = f"""SELECT t AS draw_index, number, current_gap AS gap_asof, ewma, (n_to + 30 * {_P0}) / (n_from + 30) AS transition_rate, (count + 12 * {_P0}) / (t + 12) AS long_rate, {", ".join(f"r{w} / least(t, {w})::DOUBLE AS rate_{w}" for w in (20, 50, 100))} FROM t, g
  JOIN (SELECT number, {_P0} * 0.94::DOUBLE ** any_value(t) + sum(0.06 * 0.94::DOUBLE ** (t - 1 - draw_index)) AS ewma, {", ".join(f"count(*) FILTER (draw_index >= t - {w}) AS r{w}" for w in (20, 50, 100))} FROM h, t GROUP BY number) USING (number)
  JOIN (SELECT number, count(*) FILTER (b = state) AS n_from, coalesce(sum(y) FILTER (b = state), 0) AS n_to FROM (SELECT number, y, lag(y) OVER (PARTITION BY number ORDER BY draw_index) AS b, last_value(y) OVER (PARTITION BY number ORDER BY draw_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS state FROM p) GROUP BY number) USING (number)"""
_PARTS["pr"] = f"SELECT strategy, draw_index, number, y, CASE WHEN strategy = 'exact_uniform' THEN score ELSE score * 0.9 + 0.1 * {_P0} END AS p FROM bs WHERE strategy IN ('exact_uniform', 'recent_50', 'recent_100', 'previous_draw')"
_PARTS["ht"] = "SELECT strategy, count(*) AS n, avg(h6) AS top6, avg(h10) AS top10, avg(h12) AS top12 FROM (SELECT strategy, draw_index, " + ", ".join(f"sum(y) FILTER (rk <= {k}) AS h{k}" for k in (6, 10, 12)) + " FROM (SELECT *, row_number() OVER (PARTITION BY strategy, draw_index ORDER BY p - (number - 1) * 1e-14 DESC, number) AS rk FROM pr) GROUP BY ALL) GROUP BY strategy"
_PARTS["ct"] = "SELECT strategy, q, ln(q / (1 - q)) AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM (SELECT strategy, y, round(least(greatest(p, 1e-6), 1 - 1e-6), 12) AS q FROM pr) GROUP BY ALL"
_PARTS["ce"] = "SELECT strategy, sum(abs(k - p)) / sum(n) AS ece FROM (SELECT strategy, least(floor(q * 10), 9) AS bin, sum(n) AS n, sum(k) AS k, sum(n * q) AS p FROM ct GROUP BY ALL) GROUP BY strategy"
_PARTS["nw0"] = "SELECT strategy, ln(sum(k) / (sum(n) - sum(k))) AS a, 0.0::DOUBLE AS b, max(x) - min(x) < 1e-12 AS flat FROM ct GROUP BY strategy"
_STEPS = 10
for _i in range(_STEPS):
    _PARTS[f"nw{_i + 1}"] = f"""SELECT strategy, CASE WHEN flat THEN a ELSE a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) END AS a, CASE WHEN flat THEN b ELSE b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) END AS b, flat FROM (
  SELECT strategy, any_value(a) AS a, any_value(b) AS b, any_value(flat) AS flat, sum(k - n * m) AS g0, sum((k - n * m) * x) - any_value(b) / 1e6 AS g1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) + 1e-6 AS h11 FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS m FROM ct JOIN nw{_i} USING (strategy)) GROUP BY strategy)"""
#: Rows that models are fitted to: an intercept and the seven standardised features.
_PARTS["fz"] = f"SELECT draw_index, number, y, 1.0::DOUBLE AS x0, {', '.join(f'z_{c}::DOUBLE AS x{i + 1}' for i, c in enumerate(_RAW))} FROM (SELECT *, {', '.join(map(_z, _RAW))} FROM au) WHERE draw_index >= 100"
_PARTS["fy"] = "SELECT fz.*, year(draw_date) AS year FROM fz JOIN d USING (draw_index)"
_PARTS["bt0"] = "SELECT count(*) AS t FROM d"
_D = 8


def _fit_row(fit: str, end: str, c: str = "0.2", drop: int = 0, number: int = 1) -> str:
    """SQL of one fit: rows before ``end`` train it, and ``drop`` names the feature, from 1, that it lacks."""
    return f"SELECT {fit} AS fit, {end} AS stop, {c}::DOUBLE AS c, {number} AS num, " + ", ".join(f"{int(i != drop)} AS m{i}" for i in range(1, _D))


def _eliminated(name: str, start: str, keep: str) -> None:
    """Part ``name`` (keep, d0 ..): the solutions of ``start``'s systems (a<i>_<j> for i <= j, r<i>), a stage of Gauss's elimination for each part."""
    d, last = range(_D), start
    for j in d[:-1]:
        now = f"{name}x{j}"
        cells = [f"a{i}_{m} - a{j}_{i} * a{j}_{m} / a{j}_{j} AS a{i}_{m}" for i in d for m in d if j < i <= m]
        right = [f"r{i} - a{j}_{i} * r{j} / a{j}_{j} AS r{i}" for i in d if i > j]
        done = [f"a{i}_{m}" for i in d for m in d if i <= j and i <= m] + [f"r{i}" for i in d if i <= j]
        _PARTS[now] = f"SELECT {keep}, {', '.join([*done, *cells, *right])} FROM {last}"
        last = now
    back: dict[int, str] = {}
    for i in reversed(d):
        back[i] = f"((r{i}" + "".join(f" - a{i}_{m} * {back[m]}" for m in range(i + 1, _D)) + f") / a{i}_{i})"
    _PARTS[name] = f"SELECT {keep}, {', '.join(f'{back[i]} AS d{i}' for i in d)} FROM {last}"


def _newton(name: str, fits: str, rows: str = "fz", at: str = "draw_index", steps: int = 5) -> None:
    """Parts ``<name>b`` (fit, b0 ..) and ``<name>e`` (fit, number, e) after so many Newton steps: effects of numbers are eliminated before the rest."""
    d, f = range(_D), f"{name}f"
    _PARTS[f] = fits
    _PARTS[f"{name}b0"] = f"SELECT fit, ln({_P0} / (1 - {_P0})) AS b0, {', '.join(f'0.0::DOUBLE AS b{i}' for i in d[1:])} FROM {f}"
    _PARTS[f"{name}e0"] = f"SELECT fit, number, 0.0::DOUBLE AS e FROM {f}, (SELECT unnest(range(1, 50)) AS number)"
    x = ["x0", *(f"x{i} * m{i}" for i in d[1:])]
    pairs = [(i, j) for i in d for j in d if i <= j]
    for k in range(steps):
        b, e, last = f"{name}b{k}", f"{name}e{k}", k == steps - 1
        z = " + ".join(f"b{i} * {x[i]}" for i in d)
        _PARTS[f"{name}s{k}"] = f"""SELECT fit, number, {', '.join(f'sum((y - p) * v{i}) AS g{i}' for i in d)}, {', '.join(f'sum(p * (1 - p) * v{i} * v{j}) AS h{i}_{j}' for i, j in pairs)}
  FROM (SELECT r.fit, r.number, y, {', '.join(f'{x[i]} AS v{i}' for i in d)}, 1 / (1 + exp(-({z} + e))) AS p FROM (SELECT q.*, w.fit, {', '.join(f'm{i}' for i in d[1:])} FROM {rows} q JOIN {f} w ON q.{at} < w.stop) r JOIN {b} USING (fit) JOIN {e} USING (fit, number)) GROUP BY fit, number"""
        h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
        ridge = lambda i: "0" if i == 0 else "any_value(1 / c)"
        a = [f"sum({h(i, j)}) - sum(num * {h(0, i)} * {h(0, j)} / (h0_0 + 1 / c))" + (f" + {ridge(i)} + any_value(1 - m{i})" if i == j and i else "") + f" AS a{i}_{j}" for i, j in pairs]
        g = [f"sum(g{i}) - {ridge(i)} * any_value(b{i}) - sum(num * {h(0, i)} * (g0 - e / c) / (h0_0 + 1 / c)) AS r{i}" for i in d]
        _PARTS[f"{name}a{k}"] = f"SELECT fit, {', '.join(a)}, {', '.join(g)} FROM {name}s{k} JOIN {f} USING (fit) JOIN {b} USING (fit) JOIN {e} USING (fit, number) GROUP BY fit"
        _eliminated(f"{name}d{k}", f"{name}a{k}", "fit")
        _PARTS[f"{name}b" if last else f"{name}b{k + 1}"] = f"SELECT fit, {', '.join(f'b{i} + d{i} AS b{i}' for i in d)} FROM {b} JOIN {name}d{k} USING (fit)"
        _PARTS[f"{name}e" if last else f"{name}e{k + 1}"] = f"SELECT fit, number, e + num * (g0 - e / c - ({' + '.join(f'{h(0, i)} * d{i}' for i in d)})) / (h0_0 + 1 / c) AS e FROM {e} JOIN {name}s{k} USING (fit, number) JOIN {name}d{k} USING (fit) JOIN {f} USING (fit)"


def _losses(name: str, blocks: str) -> str:
    """(block, draw_index, hits_6, brier, log_loss) of blocks (block, fit, low, high); chances lie so near 6/49 that their projection is a shift."""
    z = " + ".join(["b0", *(f"b{i} * m{i} * x{i}" for i in range(1, _D))])
    return f"""SELECT block, draw_index, sum(y) FILTER (rank <= 6)::BIGINT AS hits_6, avg((q - y) ** 2) AS brier, avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS log_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY block, draw_index ORDER BY round(q, 10) DESC, number) AS rank FROM (
  SELECT block, draw_index, number, y, (p + (6 - sum(p) OVER (PARTITION BY block, draw_index)) / 49) * 0.9 + 0.1 * {_P0} AS q FROM (
  SELECT k.block, r.draw_index, r.number, y, 1 / (1 + exp(-({z} + e))) AS p FROM fz r JOIN ({blocks}) k ON r.draw_index >= k.low AND r.draw_index < k.high JOIN {name}f USING (fit) JOIN {name}b USING (fit) JOIN {name}e ON {name}e.fit = k.fit AND {name}e.number = r.number))) GROUP BY ALL"""


_newton("lh", _fit_row("0", "t * 8 // 10") + " FROM bt0")
_newton("wf", _fit_row("s", "s", drop=0) + " FROM (SELECT unnest(range(t * 6 // 10, t, t // 10)) AS s FROM bt0)")
_GRID = (0.01, 0.03, 0.1, 0.2, 0.5, 1.0, 3.0, 10.0)
_PARTS["po"] = "SELECT t // 10 AS tenth, unnest([t - 2 * (t // 10), t - t // 10]) AS s FROM bt0"
_newton("np", _fit_row("s::VARCHAR || ' ' || k", "s - tenth", "g") + f" FROM po, (SELECT unnest({list(_GRID)}) AS g, unnest(range(0, 8)) AS k)")
_PARTS["nt"] = f"SELECT split_part(block, ' ', 1)::BIGINT AS s, {list(_GRID)}[split_part(block, ' ', 2)::INT + 1]::DOUBLE AS c, avg(brier) AS inner_brier, avg(log_loss) AS inner_log_loss FROM ({_losses('np', 'SELECT fit AS block, fit, stop AS low, stop + tenth AS high FROM npf, (SELECT DISTINCT tenth FROM po)')}) GROUP BY block"
_PARTS["nc"] = "SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(inner_brier, 12), round(inner_log_loss, 12), c) = 1 AS chosen FROM nt"
_newton("nq", _fit_row("s", "s", "g") + " FROM (SELECT s, c AS g FROM nc WHERE chosen)")
_newton("ab", " UNION ALL ".join(_fit_row(str(k), "t * 8 // 10", drop=k if k < 8 else 0, number=int(k < 8)) + " FROM bt0" for k in range(9)))
_newton("yc", _fit_row("year", "year") + " FROM (SELECT year, sum(n) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (SELECT year, count(DISTINCT draw_index) AS n FROM fy GROUP BY year)) WHERE n >= 100", "fy", "year")
_newton("wh", _fit_row("0", "t", number=0) + " FROM bt0")
_newton("fp", _fit_row("0", "t", "0.01") + " FROM bt0")
_PARTS["fq"] = f"SELECT number, (p + (6 - sum(p) OVER ()) / 49) * 0.9 + 0.1 * {_P0} AS p FROM (SELECT number, 1 / (1 + exp(-(b0 + {' + '.join(f'b{i} * z_{c}' for i, c in enumerate(_RAW, 1))} + e))) AS p FROM (SELECT *, {', '.join(map(_z, _RAW))} FROM nx) JOIN fpe USING (number) JOIN fpb ON true)"
_PARTS["rf"] = f"SELECT *, draw_id::BIGINT AS id, special_number IS NOT NULL AND draw_date IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _N)} AS whole FROM r"
_PARTS["rl"] = "SELECT *, seq > min(seq) OVER (PARTITION BY draw_id) AS again, last_value(CASE WHEN whole THEN draw_date END IGNORE NULLS) OVER w AS last_date, last_value(CASE WHEN whole THEN id END IGNORE NULLS) OVER w AS last_id FROM rf WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_half = lambda start: f"sum(('0x' || substr(md5(x), {start}, 15))::BIGINT::HUGEINT)"
_text = " || '|' || ".join(f"coalesce(length({c})::VARCHAR || ':' || {c}, '-')" for c in ("o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "round(o_totalprice * 100)::BIGINT::VARCHAR", "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority"))
_SUMS = [f"g{i}" for i in range(_D)] + [f"h{i}_{j}" for i in range(_D) for j in range(i, _D)]
_PARTS["ps"] = f"""SELECT draw_index, {', '.join(f'sum((y - p) * x{i}) AS g{i}' for i in range(_D))}, {', '.join(f'sum(p * (1 - p) * x{i} * x{j}) AS h{i}_{j}' for i in range(_D) for j in range(i, _D))}
  FROM (SELECT fz.*, 1 / (1 + exp(-({' + '.join(f'b{i} * x{i}' for i in range(_D))}))) AS p FROM fz, whb) GROUP BY draw_index"""


def _stepped(name: str, sums: str) -> None:
    """Part ``name`` (variant, c0 ..): one Newton step from the whole fit on each variant's sums."""
    d = range(_D)
    _PARTS[f"{name}s"] = sums
    cells = [f"h{i}_{j}" + (" + 5" if i == j and i else "") + f" AS a{i}_{j}" for i in d for j in d if i <= j]
    _PARTS[f"{name}a"] = f"SELECT variant, {', '.join(cells)}, {', '.join(f'g{i} - {5 if i else 0} * b{i} AS r{i}' for i in d)} FROM {name}s, whb"
    _eliminated(f"{name}d", f"{name}a", "variant")
    _PARTS[name] = f"SELECT variant, {', '.join(f'b{i} + d{i} AS c{i}' for i in d)} FROM {name}d, whb"


_POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_stepped("mb", f"""SELECT variant, {', '.join(f'sum(k * {c}) AS {c}' for c in _SUMS)} FROM (SELECT variant, ps.*, list_sum([(u >= x)::INT FOR x IN {_POISSON!r}]) AS k FROM (
  SELECT variant, draw_index, ((m * m + (draw_index % 1009 + 17) * (variant * 31 + 7)) % 1000003) / 1000003.0::DOUBLE AS u FROM (SELECT variant, draw_index, (draw_index * 7919 + variant * 104729) % 1000003 AS m FROM ps, (SELECT unnest(range(0, 2000)) AS variant))) JOIN ps USING (draw_index)) GROUP BY variant""")
_PARTS["pe"] = "SELECT ps.*, max(draw_index) OVER () - draw_index + 1 AS back, (draw_index - min(draw_index) OVER ()) * 20 // (max(draw_index) OVER () - min(draw_index) OVER () + 1) AS part FROM ps"
_stepped("rs", f"SELECT k AS variant, {', '.join(f'sum({c}) FILTER (back > k) AS {c}' for c in _SUMS)} FROM pe, (SELECT unnest(range(1, 21)) AS k) GROUP BY k UNION ALL SELECT -1 - k, {', '.join(f'sum({c}) FILTER (part <> k) AS {c}' for c in _SUMS)} FROM pe, (SELECT unnest(range(0, 20)) AS k) GROUP BY k")
_PARTS["rp"] = f"""SELECT variant, list(number ORDER BY number) AS picked FROM (SELECT variant, number, row_number() OVER (PARTITION BY variant ORDER BY round({' + '.join(f'c{i} * x{i}' for i in range(1, _D))}, 10) DESC, number) AS rank
  FROM (SELECT * FROM rs UNION ALL SELECT 0, {', '.join(f'b{i}' for i in range(_D))} FROM whb), (SELECT number, {', '.join(f'z_{c} AS x{i + 1}' for i, c in enumerate(_RAW))} FROM (SELECT *, {', '.join(map(_z, _RAW))} FROM nx))) WHERE rank <= 6 GROUP BY variant"""
#: Multipliers of the permutations: primes above a block's 2,048 periods, by a sieve.
_sieve = bytearray([1]) * 8192
for _q in range(2, 91):
    _sieve[_q * _q :: _q] = bytes(len(_sieve[_q * _q :: _q]))
_PRIMES = [k for k in range(2049, 8192) if _sieve[k]]
_PARTS["gb"] = "SELECT draw_index, number, y, gap_asof, len(list_filter(edges, lambda e: e < gap_asof)) AS bin FROM hx, (SELECT list_distinct(quantile_cont(gap_asof, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS edges FROM hx WHERE draw_index >= 300) WHERE draw_index >= 300"
_PARTS["oc"] = "SELECT place // 2048 AS block, place % 2048 AS i, outcome, count(*) OVER (PARTITION BY place // 2048) AS n FROM (SELECT draw_index - 300 AS place, bit_or(1::BIGINT << number) AS outcome FROM h WHERE draw_index >= 300 GROUP BY draw_index)"
_PARTS["pm"] = f"SELECT r, block, i, CASE WHEN r = 0 THEN i ELSE ({_PRIMES}[(r * 31 + block) % {len(_PRIMES)} + 1] * i + r * 7919 + block * 104729) % n END AS j FROM (SELECT DISTINCT block, i, n FROM oc), (SELECT unnest(range(0, 1001)) AS r)"
_permuted = lambda masks: f"SELECT r, k, sum(bit_count(v & outcome))::BIGINT AS hits FROM ({masks}) x JOIN pm USING (block, i) JOIN oc ON oc.block = pm.block AND oc.i = pm.j GROUP BY r, k"
_PARTS["gm"] = _permuted("SELECT (draw_index - 300) // 2048 AS block, (draw_index - 300) % 2048 AS i, bin AS k, bit_or(1::BIGINT << number) AS v FROM gb GROUP BY ALL")
_PARTS["gs"] = "SELECT bin AS k, count(*) AS n, sum(y)::BIGINT AS hits FROM gb GROUP BY bin"
_PARTS["gq"] = "SELECT r, corr(k::DOUBLE, x) AS rho FROM (SELECT r, k, rank() OVER (PARTITION BY r ORDER BY rate) + (count(*) OVER (PARTITION BY r, rate) - 1) / 2 AS x FROM (SELECT r, k, round(gm.hits / n, 12) AS rate FROM gm JOIN gs USING (k))) GROUP BY r"
_PARTS["gp"] = f"SELECT k, least(1, 2 * least(sum(m) FILTER (j <= hits), sum(m) FILTER (j >= hits))) AS p FROM (SELECT k, hits, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P0}) + (n - j) * ln(1 - {_P0})) AS m FROM (SELECT k, n::DOUBLE AS n, hits, unnest(range(0, n + 1)) AS j FROM gs)) GROUP BY k"
_PARTS["sk"] = "SELECT (draw_index - 300) // 2048 AS block, (draw_index - 300) % 2048 AS i, strategy AS k, bit_or(1::BIGINT << number) AS v FROM (SELECT *, row_number() OVER (PARTITION BY strategy, draw_index ORDER BY score DESC, number) AS rank FROM sc) WHERE rank <= 6 GROUP BY ALL"
_PARTS["fh"] = _permuted("SELECT * FROM sk")
_PARTS["fo"] = f"SELECT k, hits AS seen, row_number() OVER (ORDER BY hits DESC, list_position({list(('uniform_random', 'frequency_random', 'recent_hot', 'cold_number', 'mixed_hot_cold', 'ewma_frequency', 'bayesian_shrinkage', 'markov'))}, k)) AS place FROM fh WHERE r = 0"
_walk = "PARTITION BY strategy, draw_index ORDER BY place DESC, turn DESC, number"


def _power(weights: list[int], total: int, times: int) -> list[float]:
    """Probabilities of sums of so many values whose weights are integers, in exact arithmetic."""
    out = [1]
    for _ in range(times):
        new = [0] * (len(out) + len(weights) - 1)
        for i, a in enumerate(out):
            for j, b in enumerate(weights):
                new[i + j] += a * b
        out = new
    return [x / total**times for x in out]


def _query(sql: str, doubles: str = "", digits: int = 9) -> str:
    """``sql`` after the parts that it needs, in order, with the named columns rounded."""
    import re

    need: set[str] = set()

    def add(text: str) -> None:
        for name in set(re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", text)) & set(_PARTS):
            if name not in need:
                need.add(name)
                add(_PARTS[name])

    add(sql)
    parts = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in _PARTS.items() if k in need)
    cols = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
    body = f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql
    return f"WITH {parts} {body}"


def _cooccurrence(k: int) -> str:
    names = ["n1", "n2", "n3"][:k]
    p = math.comb(49 - k, 6 - k) / math.comb(49, 6)
    universe = ", ".join(f"(SELECT unnest(range(1, 50)) AS {x})" for x in names)
    order = " AND ".join(f"{a} < {b}" for a, b in zip(names, names[1:], strict=False))
    picks = " UNION ALL ".join("SELECT " + ", ".join(f"numbers[{i + 1}] AS {x}" for i, x in zip(c, names, strict=True)) + " FROM d" for c in combinations(range(6), k))
    return f"SELECT concat_ws('-', {', '.join(names)}) AS combination, coalesce(c, 0) AS count, t * {p!r}::DOUBLE AS expected, (coalesce(c, 0) - t * {p!r}::DOUBLE) / sqrt(t * {p!r}::DOUBLE * (1 - {p!r}::DOUBLE)) AS z_score FROM t, (SELECT * FROM {universe} WHERE {order}) u LEFT JOIN (SELECT {', '.join(names)}, count(*) AS c FROM ({picks}) GROUP BY ALL) x USING ({', '.join(names)})"


def _law(value: str, good: int, where: str = "true") -> str:
    rows = ", ".join(f"({i}, {math.comb(good, i) * math.comb(49 - good, 6 - i) / math.comb(49, 6)!r}::DOUBLE)" for i in range(7))
    return f"SELECT value::BIGINT AS value, probability, coalesce(c, 0) AS count, probability * n AS expected FROM (VALUES {rows}) v(value, probability) LEFT JOIN (SELECT {value} AS value, count(*) AS c FROM pat WHERE {where} GROUP BY 1) x USING (value), (SELECT count(*) AS n FROM pat WHERE {where})"


_frequency = lambda n_hit, n: f"SELECT g.number, {n_hit} AS count, {n_hit} / {n}::DOUBLE AS proportion, {n} * {_P0} AS expected, {n_hit} - {n} * {_P0} AS difference, ({n_hit} - {n} * {_P0}) / sqrt({n} * {_P0} * (1 - {_P0})) AS z_score, current_gap, max_gap, mean_gap, last_index"
_wilson = lambda sign: f"(hits / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) {sign} 1.959963984540054 / (1 + 1.959963984540054 ** 2 / n) * sqrt(hits / n * (1 - hits / n) / n + 1.959963984540054 ** 2 / (4 * n * n))"


def sql() -> dict[str, str]:
    """SQL by query name; queries that SQL cannot say are left out."""
    q = {
        "draws": _query("SELECT draw_index, draw_id, draw_date, number_1, number_2, number_3, number_4, number_5, number_6, special_number FROM w"),
        "panel_indicator": _query("SELECT draw_index, number, y FROM p"),
        "number_frequency": _query(_frequency("count", "periods") + " FROM g", "proportion expected difference z_score mean_gap"),
        "frequency_last_50": _query(_frequency("coalesce(c, 0)", "least(periods, 50)") + " FROM g LEFT JOIN (SELECT number, count(*) AS c FROM h, t WHERE draw_index >= t - 50 GROUP BY number) x ON x.number = g.number", "proportion expected difference z_score mean_gap"),
        "frequency_by_year": _query(
            """SELECT y0.year::BIGINT AS year, u.number, periods, coalesce(c, 0) AS count, coalesce(periods - 1 - l, periods) AS current_gap, coalesce(greatest(coalesce(m, 0), f, periods - 1 - l), periods) AS max_gap, mg AS mean_gap, coalesce(l, -1) AS last_index
  FROM (SELECT year(draw_date) AS year, count(*) AS periods FROM d GROUP BY 1) y0 CROSS JOIN (SELECT unnest(range(1, 50)) AS number) u LEFT JOIN (SELECT year, number, count(*) AS c, max(i) AS l, min(i) AS f, max(gap) AS m, avg(gap) AS mg FROM (
  SELECT year, number, i, i - lag(i) OVER (PARTITION BY year, number ORDER BY i) AS gap FROM (SELECT year(draw_date) AS year, unnest(numbers) AS number, row_number() OVER (PARTITION BY year(draw_date) ORDER BY draw_index) - 1 AS i FROM d)) GROUP BY year, number) x ON x.year = y0.year AND x.number = u.number""",
            "mean_gap",
        ),
        "gap_statistics": _query("SELECT * FROM g", "mean_gap"),
        "gap_asof": _query("SELECT draw_index, number, gap_asof, count_before::BIGINT AS count_before FROM hx"),
        "draw_patterns": _query("SELECT * FROM pat", "mean std"),
        "pair_cooccurrence": _query(_cooccurrence(2), "expected z_score"),
        "triple_cooccurrence": _query(_cooccurrence(3), "expected z_score"),
        "overlap_distribution": _query(_law("overlap_previous", 6, "draw_index > 0"), "probability expected"),
        "odd_distribution": _query(_law("odd_count", 25), "probability expected"),
        "high_distribution": _query(_law("high_count", 25), "probability expected"),
        "combination_mode": _query("SELECT array_to_string(numbers, ' ') AS combination, count(*) AS count FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
        "nlargest_cold": _query("SELECT number, current_gap FROM g ORDER BY current_gap DESC, number LIMIT 6"),
        "rolling_mean_50": _query("SELECT draw_index, CASE WHEN count(*) OVER x = 50 THEN avg(list_sum(numbers)) OVER x END AS rolling_mean FROM d WINDOW x AS (ORDER BY draw_index ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "rolling_mean"),
        "special_hits": _query("SELECT len(list_intersect(d.numbers, b.numbers)) AS main_matches, list_contains(b.numbers, d.special_number) AS special_match, count(*) AS count FROM d JOIN (SELECT draw_index + 1 AS draw_index, numbers FROM d) b USING (draw_index) GROUP BY 1, 2"),
        "validation_issues": _query("SELECT code, CASE WHEN code IN ('duplicate_date', 'not_sorted', 'missing_draw_ids', 'special_missing') THEN 'warning' ELSE 'error' END AS severity, count(*) AS n_rows, min(seq) AS first_row, max(seq) AS last_row, sum(seq)::BIGINT AS row_sum FROM iss GROUP BY code"),
        "first_failing_rule": _query("SELECT code, count(*) AS n_rows FROM iss WHERE code IN ('missing_number', 'main_out_of_range', 'main_repeated', 'invalid_date', 'duplicate_draw_id', 'duplicate_date', 'duplicate_row', 'not_sorted') GROUP BY code ORDER BY list_position(['missing_number', 'main_out_of_range', 'main_repeated', 'invalid_date', 'duplicate_draw_id', 'duplicate_date', 'duplicate_row', 'not_sorted'], code) LIMIT 1"),
        "missing_sequence": _query("SELECT prefix, missing FROM mi"),
        "dedup_keep_last": _query("SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY draw_id ORDER BY seq DESC) = 1"),
        "duplicate_flags": _query("SELECT * FROM (SELECT seq, draw_id, count(*) OVER (PARTITION BY draw_id) AS n FROM r) WHERE n > 1"),
        "clean_draws": _query("SELECT draw_id, draw_date, " + ", ".join(f"CASE WHEN draw_index % 57 = 3 THEN NULL ELSE {c} END AS {c}" for c in _N) + ", CASE WHEN draw_index % 31 = 0 THEN 7 ELSE special_number END AS special_number, 'export' AS source, '1' AS source_version FROM w"),
        "anti_resume": _query("SELECT 'new' AS kind, count(*) AS n, sum(draw_index)::BIGINT AS index_sum FROM d WHERE draw_index % 3 <> 0 UNION ALL SELECT 'conflict', count(*), sum(draw_index)::BIGINT FROM d WHERE draw_index % 15 = 0"),
        "prefix_slice": _query("SELECT number, sum((draw_index < t // 2)::INT)::BIGINT AS in_prefix, sum((draw_index >= t - 100)::INT)::BIGINT AS in_tail FROM h, t GROUP BY number"),
        "logistic_holdout": _query(f"SELECT draw_index // 100 AS block, count(*) AS n, avg(hits_6) AS mean_hits, avg(brier) AS brier, avg(log_loss) AS log_loss FROM ({_losses('lh', 'SELECT 0 AS block, 0 AS fit, t * 8 // 10 AS low, t AS high FROM bt0')}) GROUP BY 1", "mean_hits brier log_loss"),
        "walk_forward_refits": _query(f"SELECT block, n, mean_hits, brier, log_loss, b1 AS gap_coefficient FROM (SELECT block, count(*) AS n, avg(hits_6) AS mean_hits, avg(brier) AS brier, avg(log_loss) AS log_loss FROM ({_losses('wf', 'SELECT fit AS block, fit, stop AS low, least(stop + t // 10, t) AS high FROM wff, bt0')}) GROUP BY 1) JOIN wfb ON fit = block", "mean_hits brier log_loss gap_coefficient"),
        "nested_penalty": _query(f"SELECT nc.s AS outer, c, inner_brier, inner_log_loss, chosen, CASE WHEN chosen THEN mean_hits END AS mean_hits, CASE WHEN chosen THEN brier END AS brier, CASE WHEN chosen THEN log_loss END AS log_loss FROM nc JOIN (SELECT block, avg(hits_6) AS mean_hits, avg(brier) AS brier, avg(log_loss) AS log_loss FROM ({_losses('nq', 'SELECT fit AS block, fit, stop AS low, stop + tenth AS high FROM nqf JOIN po ON po.s = nqf.stop')}) GROUP BY 1) ON block = nc.s", "inner_brier inner_log_loss mean_hits brier log_loss"),
        "ablation": _query(f"SELECT {['all', *(f'z_{c}' for c in _RAW), 'number']}[block + 1] AS left_out, mean_hits, brier, log_loss, brier - first(brier) OVER w AS brier_difference, log_loss - first(log_loss) OVER w AS log_loss_difference, mean_hits - first(mean_hits) OVER w AS hits_difference FROM (SELECT block, avg(hits_6) AS mean_hits, avg(brier) AS brier, avg(log_loss) AS log_loss FROM ({_losses('ab', 'SELECT fit AS block, fit, t * 8 // 10 AS low, t AS high FROM abf, bt0')}) GROUP BY 1) WINDOW w AS (ORDER BY block)", "mean_hits brier log_loss brier_difference log_loss_difference hits_difference"),
        "yearly_coefficients": _query("SELECT fit::BIGINT AS year, b1 AS gap_coefficient, n::BIGINT AS periods FROM ycb JOIN (SELECT year, sum(n) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (SELECT year, count(DISTINCT draw_index) AS n FROM fy GROUP BY year)) x ON x.year = fit", "gap_coefficient"),
        "model_bootstrap": _query("SELECT term::BIGINT AS term, count(*) AS replicates, stddev_samp(value) AS error, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, any_value(fitted) AS fitted FROM (SELECT variant, unnest(range(0, 8)) AS term, unnest([" + ", ".join(f"c{i}" for i in range(_D)) + "]) AS value, unnest([" + ", ".join(f"b{i}" for i in range(_D)) + "]) AS fitted FROM mb, whb) GROUP BY term", "error low high fitted"),
        "recommendation_stability": _query("SELECT p.variant, array_to_string(p.picked, ' ') AS numbers, len(list_intersect(p.picked, w.picked)) / len(list_distinct(list_concat(p.picked, w.picked))) AS jaccard FROM rp p, rp w WHERE p.variant <> 0 AND w.variant = 0", "jaccard"),
        "frozen_prediction": _query("SELECT number, p, row_number() OVER (ORDER BY round(p, 10) DESC, number) AS rank FROM fq QUALIFY rank <= 12", "p"),
        "leakage_check": _query("SELECT item, periods, 0::BIGINT AS leaked, 'PASS' AS status FROM (SELECT unnest(['audited', 'base', 'baselines']) AS item, unnest([t // 2 + 1, t // 2, t // 2 - 299]) AS periods FROM bt0)"),
        "row_faults": _query(f"SELECT * FROM (SELECT seq AS line, CASE WHEN again THEN 'duplicate_id' WHEN NOT whole THEN 'malformed' WHEN draw_date < last_date OR draw_date = last_date AND id <= last_id THEN 'not_chronological' WHEN len(list_distinct([{', '.join(_N)}])) <> 6 OR {' OR '.join(f'{c} NOT BETWEEN 1 AND 49' for c in _N)} THEN 'invalid_numbers' WHEN special_number NOT BETWEEN 1 AND 49 OR special_number IN ({', '.join(_N)}) THEN 'invalid_special' END AS fault FROM rl) WHERE fault IS NOT NULL"),
        "target_rows": _query("SELECT number, count(*) AS count FROM h WHERE draw_index IN (SELECT draw_index FROM d WHERE special_number < 10) GROUP BY number"),
        "orders_digest": f"SELECT year::BIGINT AS year, n, (a % 1152921504606846976)::BIGINT AS first, (b % 1152921504606846976)::BIGINT AS second FROM (SELECT year, count(*) AS n, {_half(1)} AS a, {_half(17)} AS b FROM (SELECT year(o_orderdate) AS year, {_text} AS x FROM orders) GROUP BY year UNION ALL SELECT 0, count(*), {_half(1)}, {_half(17)} FROM (SELECT {_text} AS x FROM orders))",
        "manifest_equality": "SELECT 'left' AS side, count(*) AS n, sum(k)::BIGINT AS sum FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*), sum(k)::BIGINT FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders) HAVING count(*) > 0",
        "gap_robustness": _query(f"SELECT k AS bin, n, hits, {_wilson('-')} AS low, {_wilson('+')} AS high, p, least(1, max((m - rank + 1) * p) OVER (ORDER BY p, k)) AS holm, rho, permutation_p FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, k) AS rank FROM gs JOIN gp USING (k)), (SELECT max(rho) FILTER (r = 0) AS rho, (1 + count(*) FILTER (r > 0 AND abs(rho) >= seen - 1e-9)) / count(*) AS permutation_p FROM (SELECT *, max(abs(rho)) FILTER (r = 0) OVER () AS seen FROM gq))", "low high p holm rho permutation_p"),
        "familywise_hits": _query("SELECT strategy, seen AS hits, raw_p, max(step) OVER (ORDER BY place) AS family_p FROM (SELECT k AS strategy, place, seen, (1 + count(*) FILTER (r > 0 AND hits >= seen)) / count(*) AS raw_p, (1 + count(*) FILTER (r > 0 AND most >= seen)) / count(*) AS step FROM (SELECT *, max(hits) OVER (PARTITION BY r ORDER BY place DESC) AS most FROM fh JOIN fo USING (k)) GROUP BY ALL)", "raw_p family_p"),
        "feature_snapshots": _query(f"SELECT *, {', '.join(map(_z, _RAW))} FROM au"),
        "next_features": _query(f"SELECT draw_index, number, {', '.join(_RAW)}, {', '.join(map(_z, _RAW))} FROM nx"),
        "simplex_projection": _query(
            f"""SELECT strategy, draw_index, min(q) AS least, max(q) AS greatest, sum(q) AS total FROM (SELECT strategy, draw_index, least(greatest(score - shift, 0), 1) * 0.9 + 0.1 * {_P0} AS q FROM bs JOIN (
  SELECT strategy, draw_index, arg_min(place + (reached - 6) / inside, step) AS shift FROM (SELECT *, row_number() OVER ({_walk}) AS step, sum(inside * fall) OVER ({_walk} ROWS UNBOUNDED PRECEDING) AS reached FROM (SELECT *, coalesce(sum(turn) OVER ({_walk} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside, coalesce(lag(place) OVER ({_walk}) - place, 0) AS fall
  FROM (SELECT strategy, draw_index, number, unnest([score, score - 1]) AS place, unnest([1, -1]) AS turn FROM bs WHERE strategy IN ('gap', 'transition')))) WHERE inside > 0 AND reached >= 6 GROUP BY ALL) USING (strategy, draw_index)) GROUP BY ALL"""
        ),
        "base_features": _query(
            f"""SELECT draw_index, number, y, {", ".join(f"freq_{w}" for w in (5, 10, 20, 50, 100, 200))}, ewma, gap_asof AS current_gap, greatest(coalesce(ms, 0), gap_asof)::BIGINT AS max_gap, coalesce(mg, 0) AS mean_gap, freq_20 - freq_200 AS recent_minus_long, (freq_20 - freq_100) / 80 AS slope,
  state AS previous_1, coalesce(state_before, 0) AS previous_2, year(c.draw_date) AS year, month(c.draw_date) AS month, isodow(c.draw_date) - 1 AS weekday
  FROM (SELECT *, max(step) OVER b AS ms, avg(closed) OVER b AS mg FROM (SELECT *, {", ".join(f"{_rate(w)} AS freq_{w}" for w in (5, 10, 20, 50, 100, 200))}, CASE WHEN y = 1 THEN gap_asof + (last_seen IS NOT NULL)::INT END AS step, CASE WHEN y = 1 THEN draw_index - last_seen END AS closed FROM hx)
  WINDOW b AS (PARTITION BY number ORDER BY draw_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x JOIN e2 USING (draw_index, number) JOIN (SELECT draw_index + 1 AS draw_index, draw_date FROM d) c USING (draw_index)""",
            "freq_5 freq_10 freq_20 freq_50 freq_100 freq_200 ewma mean_gap recent_minus_long slope",
        ),
        "hits_by_strategy": _query("SELECT * FROM pp", "brier log_loss"),
        "backtest_summary": _query(
            f"SELECT strategy, count(*) AS n, avg(hits_6) AS mean_hits, {', '.join(f'avg((hits_6 = {i})::INT) AS hit_{i}' for i in range(7))}, avg(hits_10) AS top10_mean, avg(brier) AS brier, avg(log_loss) AS log_loss, avg(hits_6 - h0) AS difference, CASE WHEN stddev_samp(hits_6 - h0) > 0 THEN avg(hits_6 - h0) / (stddev_samp(hits_6 - h0) / sqrt(count(*))) END AS t_value FROM pp JOIN (SELECT draw_index, hits_6 AS h0 FROM pp WHERE strategy = 'uniform_random') b USING (draw_index) GROUP BY strategy",
            "mean_hits hit_0 hit_1 hit_2 hit_3 hit_4 hit_5 hit_6 top10_mean brier log_loss difference t_value",
        ),
        "hit_distribution": _query("SELECT strategy, hits_6, count(*) AS count FROM pp GROUP BY ALL"),
        "yearly_backtest": _query("SELECT strategy, year, count(*) AS n, avg(hits_6) AS mean_hits, avg(brier) AS brier, avg(hits_6) - 36 / 49.0 AS difference FROM yr GROUP BY strategy, year", "mean_hits brier difference"),
        "exclude_best_year": _query("SELECT strategy, best_year, sum(s) FILTER (year <> best_year) / sum(n) FILTER (year <> best_year) AS mean_hits FROM (SELECT strategy, year, sum(hits_6) AS s, count(*) AS n, first(year) OVER (PARTITION BY strategy ORDER BY avg(hits_6) DESC, year DESC) AS best_year FROM yr GROUP BY strategy, year) GROUP BY strategy, best_year", "mean_hits"),
        "period_slices": _query("SELECT strategy, slice, count(*) AS n, avg(hits_6) AS mean_hits, avg(brier) AS brier FROM (SELECT pp.*, unnest(list_filter(['all', CASE WHEN draw_index < (t + 300) // 2 THEN 'first_half' ELSE 'second_half' END, CASE WHEN draw_index >= t - 500 THEN 'recent_500' END, CASE WHEN draw_index >= t - 1000 THEN 'recent_1000' END], lambda x: x IS NOT NULL)) AS slice FROM pp, t) GROUP BY strategy, slice", "mean_hits brier"),
        "block_improvement": _query("SELECT strategy, count(*) AS blocks, avg((round(b - b0, 12) < 0 AND round(l - l0, 12) < 0)::INT) AS share FROM (SELECT strategy, (draw_index - 300) // 20 AS k, avg(brier) AS b, avg(log_loss) AS l FROM pp GROUP BY ALL) a JOIN (SELECT (draw_index - 300) // 20 AS k, avg(brier) AS b0, avg(log_loss) AS l0 FROM pp WHERE strategy = 'uniform_random' GROUP BY ALL) c USING (k) GROUP BY strategy", "share"),
        "paired_difference": _query("SELECT strategy, avg(brier - b0) AS brier_difference, avg(hits_6 - h0) AS hits_difference, stddev_samp(hits_6 - h0) AS hits_sd FROM pp JOIN (SELECT draw_index, brier AS b0, hits_6 AS h0 FROM pp WHERE strategy = 'frequency_random') b USING (draw_index) WHERE strategy <> 'frequency_random' GROUP BY strategy", "brier_difference hits_difference hits_sd"),
        "stable_topk_recent50": _query("SELECT draw_index, rank, number FROM bt WHERE strategy = 'recent_50' AND rank <= 6"),
        "selection_frequency": _query("SELECT strategy, number, sum((rank <= 6)::INT)::BIGINT AS count FROM bt GROUP BY ALL"),
        "jaccard_stability": _query("SELECT strategy, avg(len(list_intersect(s, r)) / (12.0 - len(list_intersect(s, r)))) AS jaccard FROM (SELECT strategy, draw_index, list(number) AS s FROM bt WHERE rank <= 6 GROUP BY ALL) a JOIN (SELECT draw_index, list(number) AS r FROM bt WHERE rank <= 6 AND strategy = 'transition' GROUP BY ALL) b USING (draw_index) GROUP BY strategy", "jaccard"),
        "brier_logloss": _query(
            f"SELECT strategy, count(*) AS n, avg(b) AS brier, avg(l) AS log_loss, min(s) AS least_sum, max(s) AS greatest_sum FROM (SELECT strategy, draw_index, avg((p - y) ** 2) AS b, avg(CASE WHEN y = 1 THEN -ln(greatest(p, 1e-12)) ELSE -ln(1 - least(p, 1 - 1e-12)) END) AS l, sum(p) AS s FROM (SELECT *, CASE WHEN strategy = 'exact_uniform' THEN score ELSE score * 0.9 + 0.1 * {_P0} END AS p FROM bs WHERE strategy IN ('exact_uniform', 'recent_50', 'recent_100', 'previous_draw')) GROUP BY ALL) GROUP BY strategy",
            "brier log_loss least_sum greatest_sum",
        ),
        "prize_tiers": _query(
            f"""SELECT main_matches, special_match, probability, sum(probability) OVER (ORDER BY main_matches, special_match) AS cdf, 1 - sum(probability) OVER (ORDER BY main_matches, special_match) + probability AS survival, coalesce(c, 0) AS count, probability * (t - 1) AS expected FROM t, (VALUES {", ".join(f"({m}::BIGINT, {bool(s)}, {math.comb(6, m) * math.comb(42, 6 - m - s) / math.comb(49, 6)!r}::DOUBLE)" for m in range(7) for s in (0, 1) if m + s <= 6)}) v(main_matches, special_match, probability)
  LEFT JOIN (SELECT len(list_intersect(d.numbers, b.numbers)) AS main_matches, list_contains(b.numbers, d.special_number) AS special_match, count(*) AS c FROM d JOIN (SELECT draw_index + 1 AS draw_index, numbers FROM d) b USING (draw_index) GROUP BY 1, 2) x USING (main_matches, special_match)""",
            "probability cdf survival expected",
        ),
        "adjacent_share": _query(f"SELECT n, count, count / n AS share, p AS probability, (count - n * p) / sqrt(n * p * (1 - p)) AS z_score FROM (SELECT count(*) AS n, sum((adjacent_pairs > 0)::INT)::BIGINT AS count, {1 - math.comb(44, 6) / math.comb(49, 6)!r}::DOUBLE AS p FROM pat)", "share probability z_score"),
        "total_hits_law": _query(
            f"""SELECT value, probability, coalesce(c, 0) AS count, probability * sum(coalesce(c, 0)) OVER () AS expected, sum(probability) OVER (ORDER BY value) AS cdf, sum(probability) OVER (ORDER BY value DESC) AS survival FROM (VALUES {", ".join(f"({i}::BIGINT, {p!r}::DOUBLE)" for i, p in enumerate(_power([math.comb(6, i) * math.comb(43, 6 - i) for i in range(7)], math.comb(49, 6), 20)))}) v(value, probability)
  LEFT JOIN (SELECT s AS value, count(*) AS c FROM (SELECT draw_index // 20 AS k, sum(overlap_previous)::BIGINT AS s, count(*) AS n FROM pat WHERE draw_index >= 20 GROUP BY 1) WHERE n = 20 GROUP BY 1) x USING (value)""",
            "probability expected cdf survival",
        ),
        "model_summary": _query(f"SELECT strategy, n, top6, top10, top12, round(a, 6) AS intercept, round(b, 6) AS slope, ece FROM ht JOIN nw{_STEPS} USING (strategy) JOIN ce USING (strategy)", "top6 top10 top12 ece"),
        "ece_bins": _query(f"SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM (SELECT y, round(score * 0.9 + 0.1 * {_P0}, 12) AS p FROM bs WHERE strategy = 'recent_20') GROUP BY 1", "predicted observed"),
        "qcut_rates": _query(
            f"SELECT bin, n, hits, hits / n AS rate, {_wilson('-')} AS low, {_wilson('+')} AS high FROM (SELECT len(list_filter(edges, lambda e: e < gap_asof)) AS bin, count(*) AS n, sum(y)::BIGINT AS hits FROM hx, (SELECT list_distinct(quantile_cont(gap_asof, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS edges FROM hx WHERE draw_index >= 300) WHERE draw_index >= 300 GROUP BY 1)",
            "rate low high",
        ),
        "parameter_sweep_prior": _query(f"SELECT prior, avg(((count_before + prior * {_P0}) / (draw_index + prior) - y) ** 2) AS brier FROM hi, (SELECT unnest([1, 6, 12, 49, 200]::DOUBLE[]) AS prior) WHERE draw_index >= 300 GROUP BY prior", "brier"),
        "nested_selection": _query(
            """SELECT block, strategy, inner_brier, mean_hits FROM (SELECT strategy, block, round(sum(s) OVER x / sum(n) OVER x, 10) AS inner_brier, mean_hits FROM (SELECT strategy, least((draw_index - 300) * 5 // (t - 300), 4) AS block, sum(brier) AS s, count(*) AS n, avg(hits_6) AS mean_hits FROM pp, t GROUP BY ALL)
  WINDOW x AS (PARTITION BY strategy ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE block > 0 QUALIFY row_number() OVER (PARTITION BY block ORDER BY inner_brier, strategy) = 1""",
            "inner_brier mean_hits",
        ),
        "chi_square_uniform": _query(f"SELECT statistic, df, {_gamma_q('24.0', '(statistic / 2)')} AS p FROM (SELECT sum((count - periods * {_P0}) ** 2 / (periods * {_P0})) AS statistic, 48::BIGINT AS df FROM g)", "statistic p"),
        "number_tests": _query(
            """SELECT a.number, autocorrelation, runs, (runs - (2.0 * c * (n - c) / n + 1)) / sqrt(2.0 * c * (n - c) * (2.0 * c * (n - c) - n) / (n * n * (n - 1.0))) AS runs_z, n * (n + 2.0) * s AS ljung_box
  FROM (SELECT number, corr(y, b) AS autocorrelation, sum((y <> b)::INT)::BIGINT + 1 AS runs FROM (SELECT number, y, lag(y) OVER (PARTITION BY number ORDER BY draw_index) AS b FROM p) WHERE b IS NOT NULL GROUP BY number) a
  JOIN (SELECT number, n, c, sum((cross_ / (n * (c / n) * (1 - c / n))) ** 2 / (n - l)) AS s FROM (SELECT number, l, any_value(n) AS n, any_value(c) AS c, sum((y - c / n) * (z - c / n)) AS cross_ FROM
  (SELECT number, l, n, c, y, lag(y, l) OVER (PARTITION BY number, l ORDER BY draw_index) AS z FROM (SELECT p.*, t::DOUBLE AS n, sum(y) OVER (PARTITION BY number)::DOUBLE AS c FROM p, t), (SELECT unnest(range(1, 11)) AS l)) WHERE z IS NOT NULL GROUP BY number, l) GROUP BY ALL) b USING (number)""",
            "autocorrelation runs_z ljung_box",
        ),
        "lag1_contingency": _query(
            """SELECT a, b, n11, n10, n01, n00, det / sqrt(na * (n - na) * nb * (n - nb)) AS phi, i11 + i10 + i01 + i00 AS mutual_information, n * det * det / (na * (n - na) * nb * (n - nb)) AS chi_square FROM (SELECT *, n11::DOUBLE * n00 - n10::DOUBLE * n01 AS det,
  CASE WHEN n11 > 0 THEN n11 / n * ln(n11 * n / (na * nb)) ELSE 0 END AS i11, CASE WHEN n10 > 0 THEN n10 / n * ln(n10 * n / (na * (n - nb))) ELSE 0 END AS i10, CASE WHEN n01 > 0 THEN n01 / n * ln(n01 * n / ((n - na) * nb)) ELSE 0 END AS i01, CASE WHEN n00 > 0 THEN n00 / n * ln(n00 * n / ((n - na) * (n - nb))) ELSE 0 END AS i00
  FROM (SELECT x.a, y.b, coalesce(c, 0) AS n11, na::BIGINT - coalesce(c, 0) AS n10, nb::BIGINT - coalesce(c, 0) AS n01, (t - 1 - na - nb)::BIGINT + coalesce(c, 0) AS n00, na, nb, (t - 1)::DOUBLE AS n FROM t, (SELECT number AS a, sum(y)::DOUBLE AS na FROM p, t WHERE draw_index < t - 1 GROUP BY 1) x JOIN (SELECT number AS b, sum(y)::DOUBLE AS nb FROM p WHERE draw_index > 0 GROUP BY 1) y ON x.a < y.b
  LEFT JOIN (SELECT l.number AS a, r.number AS b, count(*) AS c FROM h l JOIN h r ON l.draw_index + 1 = r.draw_index AND l.number < r.number GROUP BY 1, 2) z ON z.a = x.a AND z.b = y.b))""",
            "phi mutual_information chi_square",
        ),
        "half_contingency": _query("SELECT number, sum((draw_index < t // 2)::INT)::BIGINT AS first_half, sum((draw_index >= t // 2)::INT)::BIGINT AS second_half FROM h, t GROUP BY number"),
        "pvalue_corrections": _query(
            f"SELECT number, p, least(p * 49, 1) AS bonferroni, least(max((49 - rk + 1) * p) OVER (ORDER BY rk), 1) AS holm, least(min(p * 49 / rk) OVER (ORDER BY rk DESC), 1) AS bh FROM (SELECT *, row_number() OVER (ORDER BY p, number) AS rk FROM (SELECT number, round(1 / (1 + abs((count - periods * {_P0}) / sqrt(periods * {_P0} * (1 - {_P0})))), 6) AS p FROM g))",
            "p bonferroni holm bh",
        ),
        "quantiles": _query("SELECT quantile_cont(s, 0.025) AS q025, median(s) AS median, quantile_cont(s, 0.975) AS q975, stddev_samp(s) AS sd FROM (SELECT list_sum(numbers)::DOUBLE AS s FROM d)", "q025 median q975 sd"),
        "sequence_extremes": _query(
            f"SELECT *, (SELECT max(c) FROM (SELECT count(*) AS c FROM h a JOIN h b ON a.draw_index = b.draw_index AND a.number < b.number GROUP BY a.number, b.number)) AS hottest_pair FROM (SELECT max(abs(count - periods * {_P0})) AS max_abs_deviation, max(max_gap) AS max_gap FROM g), (SELECT avg(total) AS mean_sum, stddev_samp(total) AS sum_std, avg((overlap_previous >= 2)::INT) AS overlap_rate, max(overlap_previous) AS max_overlap, max(abs(odd_count - 3)) AS odd_extreme FROM pat)",
            "max_abs_deviation mean_sum sum_std overlap_rate",
        ),
    }
    q["latest_wins"] = "SELECT user_id AS ledger, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 9) AS value FROM events GROUP BY user_id"
    q["ledger_status"] = "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean_value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING min(event_id) FILTER (event_type = 'click') < max(event_id) FILTER (event_type = 'purchase')) GROUP BY event_type"
    q |= _tails(q) | _evidence(q)
    return q


#: Tails by their series, all of whose terms are positive, and as many as the argument asks for: erfc's odd powers and incomplete beta.
_normal_sf = lambda z: f"(0.5 - 1 / sqrt(2 * pi()) * ({z}) * list_sum(list_transform(range(0, 150 + least(2 * ({z}) * ({z}), 1e6)::BIGINT), lambda i: exp(i * ln(greatest(({z}) * ({z}), 1e-300)) - ({z}) * ({z}) / 2 - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1)))))"
#: The upper incomplete gamma of half a whole number is a finite sum, beside erfc of the root where ``a`` is no whole number.
_gamma_q = lambda a, x: f"(CASE WHEN {a} IS NOT NULL AND {x} IS NOT NULL THEN CASE WHEN {a} > floor({a}) THEN 2 * {_normal_sf(f'sqrt(2 * {x})')} ELSE 0 END + coalesce(list_sum(list_transform(range(1, floor({a})::BIGINT + 1), lambda i: exp(({a} - i) * ln(greatest({x}, 1e-300)) - {x} - lgamma({a} - i + 1)))), 0) END)"
_beta = lambda a, b, x: f"list_sum(list_transform(range(0, 400), lambda i: exp(({a} + i) * ln({x}) + {b} * ln(1 - {x}) - lgamma({b}) + lgamma({a} + {b} + i) - lgamma({a} + 1 + i))))"


def _corrected(inner: str, tie: str, p: str = "p") -> str:
    """``inner`` with bonferroni, holm and bh of its p-values."""
    ranked = f"SELECT *, row_number() OVER (ORDER BY {p}, {tie}) AS rk, count(*) OVER () AS m FROM ({inner})"
    return f"SELECT * EXCLUDE (rk, m), least({p} * m, 1) AS bonferroni, least(max((m - rk + 1) * {p}) OVER (ORDER BY rk), 1) AS holm, least(min({p} * m / rk) OVER (ORDER BY rk DESC), 1) AS bh FROM ({ranked})"


def _tails(q: dict[str, str]) -> dict[str, str]:
    """p-values of the law that each test states."""
    step = "CASE WHEN {tail} < 0.025 THEN {low} ELSE {high} END"
    bisect = lambda which, keep, value, edge: f"""SELECT number, CASE WHEN count = {edge} THEN {value} ELSE (lo + hi) / 2 END AS {which} FROM (WITH RECURSIVE b AS (SELECT number, count, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM g UNION ALL
  SELECT number, any_value(count), any_value(i) + 1, {step.format(tail='sum(exp(c + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))', low=keep[0], high=keep[1])}, {step.format(tail='sum(exp(c + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))', low=keep[2], high=keep[3])}
  FROM b JOIN lc ON {'k >= count' if which == 'low' else 'k <= count'} WHERE i < 45 GROUP BY number) SELECT * FROM b WHERE i = 45)"""  # noqa: E731
    mid = "any_value((lo + hi) / 2)"
    low = bisect("low", (mid, "any_value(lo)", "any_value(hi)", mid), "0.0", "0")
    high = bisect("high", ("any_value(lo)", mid, mid, "any_value(hi)"), "1.0", "(SELECT t FROM t)")
    out = {
        "binomial_tails": _query(
            f"""SELECT number, any_value(a.count) AS count, least(1, 2 * least(sum(m) FILTER (k <= a.count), sum(m) FILTER (k >= a.count))) AS doubled_p, least(1, sum(m) FILTER (m <= own * (1 + 1e-7))) AS likelihood_p, any_value(l.low) AS low, any_value(u.high) AS high
  FROM (SELECT number, count, exp(c + k * ln({_P0}) + (n - k) * ln(1 - {_P0})) AS own FROM g JOIN lc ON k = count) a JOIN ({low}) l USING (number) JOIN ({high}) u USING (number) CROSS JOIN (SELECT k, exp(c + k * ln({_P0}) + (n - k) * ln(1 - {_P0})) AS m FROM lc) x GROUP BY number"""
        ),
        "normal_tail": _query(f"SELECT number, {_normal_sf('z')} AS p FROM (SELECT number, (count - 0.5 - periods * {_P0}) / sqrt(periods * {_P0} * (1 - {_P0})) AS z FROM g)", "p"),
        "gap_goodness": _query(
            f"""SELECT number, n AS gaps, statistic, cells::DOUBLE AS df, {_gamma_q('(cells / 2)', '(statistic / 2)')} AS p FROM (SELECT number, any_value(n) AS n, any_value(cells) AS cells, sum((coalesce(c, 0) - e) ** 2 / e) AS statistic FROM
  (SELECT number, n, cells, i, n * CASE WHEN i < cells THEN {_P0} ELSE 1 END * (1 - {_P0}) ** i AS e FROM (SELECT number, n, cells, unnest(range(0, cells + 1)) AS i FROM gc)) LEFT JOIN (SELECT number, least(gap - 1, cells) AS i, count(*) AS c FROM gl JOIN gc USING (number) WHERE gap IS NOT NULL GROUP BY 1, 2) USING (number, i) GROUP BY number)""",
            "statistic p",
        ),
        "backtest_significance": "SELECT strategy, t_value, round(p, 9) AS p, round(bonferroni, 9) AS bonferroni, round(holm, 9) AS holm, round(bh, 9) AS bh FROM (" + _corrected(f"SELECT strategy, t_value, coalesce(1 - {_beta('0.5', '(df / 2)', '(greatest(t_value * t_value, 1e-300) / (df + t_value * t_value))')}, 1) AS p FROM (SELECT strategy, t_value, n - 1 AS df FROM ({q['backtest_summary']}) WHERE strategy <> 'uniform_random')", "strategy") + ")",
    }
    out["look_elsewhere"] = f"SELECT count(*) AS tests, arg_min(number, (p, number)) AS number, min(p) AS least_p, round(least(min(p) * count(*), 1), 9) AS global_p FROM (SELECT number, round(doubled_p, 9) AS p FROM ({out['binomial_tails']}))"
    whole = q["number_tests"].replace("round(runs_z, 9)", "runs_z").replace("round(ljung_box, 9)", "ljung_box")  # p-values are those of the statistics, not of rounded ones
    number_tests = f"SELECT number, 2 * {_normal_sf('abs(runs_z)')} AS runs_p, {_gamma_q('5', '(ljung_box / 2)')} AS ljung_box_p, g.p AS gap_p FROM ({whole}) LEFT JOIN ({out['gap_goodness']}) g USING (number)"
    out["randomness_tails"] = "SELECT * REPLACE (round(runs_p, 9) AS runs_p, round(ljung_box_p, 9) AS ljung_box_p, round(bonferroni, 9) AS bonferroni, round(holm, 9) AS holm, round(bh, 9) AS bh) FROM (" + _corrected(number_tests, "number", "runs_p") + ")"
    return out


def _evidence(q: dict[str, str]) -> dict[str, str]:
    events = "SELECT user_id AS ledger, event_id, event_type, value, (props::JSON->>'k')::BIGINT AS k FROM events"
    of = lambda kind: f"(SELECT * FROM ({events}) WHERE event_type = '{kind}')"
    return {
        "ledger_lines": "SELECT event_id, CASE WHEN event_id % 31 = 4 THEN 'blank' WHEN event_id % 37 = 5 THEN 'not_json' WHEN event_id % 41 = 6 THEN 'not_object' WHEN event_id % 43 = 7 THEN 'not_canonical' END AS fault FROM events",
        # a body changed after the fact breaks its own hash, a record taken out the next one's link and all later places
        "ledger_verify": "SELECT ledger, n - gone AS records, CASE WHEN gone = 1 THEN n - 2 ELSE 0 END AS bad_sequence, CASE WHEN gone = 1 AND n > 2 THEN 1 ELSE 0 END AS bad_link, CASE WHEN ledger % 7 = 3 AND n >= 5 THEN 1 ELSE 0 END AS bad_hash, 0 AS repeated_event FROM (SELECT user_id AS ledger, count(*) AS n, (user_id % 11 = 4 AND count(*) >= 2)::BIGINT AS gone FROM events GROUP BY user_id)",
        "result_events": f"SELECT event_id, ledger, event_type, CASE WHEN row_number() OVER w = 1 THEN 'result' WHEN k % 3 = lag(k % 3) OVER w THEN 'repeated' ELSE 'correction' END AS kind FROM ({events}) WINDOW w AS (PARTITION BY ledger, event_type ORDER BY event_id)",
        "prediction_lookup": f"SELECT event_id, ledger, k, CASE coalesce(n, 0) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS lookup, CASE WHEN n = 1 THEN p END AS prediction FROM {of('purchase')} LEFT JOIN (SELECT ledger, k, count(*) AS n, min(event_id) AS p FROM {of('signup')} GROUP BY ALL) USING (ledger, k)",
        "latest_anchor": f"SELECT event_id, ledger, k, anchor FROM {of('signup')} LEFT JOIN (SELECT ledger, k, max(event_id) AS anchor FROM {of('view')} WHERE value >= 5 GROUP BY ALL) USING (ledger, k)",
        "ledger_protocol": f"""SELECT *, repeated_predictions + unpredicted_results + early_results = 0 AS sound FROM (SELECT ledger, sum(greatest(a - 1, 0))::BIGINT AS repeated_predictions, sum(CASE WHEN a = 0 THEN b ELSE 0 END)::BIGINT AS unpredicted_results, sum((a > 0 AND b > 0 AND r < p)::INT)::BIGINT AS early_results
  FROM (SELECT ledger, k, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'purchase') AS b, min(event_id) FILTER (event_type = 'signup') AS p, min(event_id) FILTER (event_type = 'purchase') AS r FROM ({events}) WHERE event_type IN ('signup', 'purchase') GROUP BY ledger, k) GROUP BY ledger)""",
        "ledger_stages": f"SELECT ledger, stage, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(*) = 10 AS complete FROM (SELECT *, (row_number() OVER (PARTITION BY ledger ORDER BY event_id) + 9) // 10 AS stage FROM {of('purchase')}) GROUP BY ledger, stage",
        "gap_rank_correlation": f"SELECT count(*) AS bins, round(corr(bin::DOUBLE, r), 9) AS rho FROM (SELECT bin, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM (SELECT bin, round(hits / n, 12) AS x FROM ({q['qcut_rates']})))",
        "recent_windows": _query(
            """SELECT width, half, count(*) AS n, avg(hits) AS mean_hits, avg(tie) AS ties FROM (SELECT width, half, draw_index, sum(CASE WHEN rk <= 6 THEN y ELSE 0 END) AS hits, (max(CASE WHEN rk = 6 THEN s END) = max(CASE WHEN rk = 7 THEN s END))::INT AS tie FROM
  (SELECT *, row_number() OVER (PARTITION BY width, draw_index ORDER BY s DESC, number) AS rk FROM (SELECT width, draw_index, number, y, CASE WHEN draw_index < (t + 300) // 2 THEN 'first' ELSE 'second' END AS half, CASE width WHEN 45 THEN a WHEN 50 THEN b ELSE c END AS s FROM
  (SELECT t, draw_index, number, y, sum(y) OVER (PARTITION BY number ORDER BY draw_index ROWS BETWEEN 45 PRECEDING AND 1 PRECEDING) AS a, sum(y) OVER (PARTITION BY number ORDER BY draw_index ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS b, sum(y) OVER (PARTITION BY number ORDER BY draw_index ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) AS c FROM t, p), (SELECT unnest([45, 50, 55])::BIGINT AS width) WHERE draw_index >= 300)) GROUP BY ALL) GROUP BY width, half""",
            "mean_hits ties",
        ),
        "block_bootstrap_mean": _query(
            """SELECT any_value(n) AS n, any_value(mean) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT replicate, any_value(z.n) AS n, any_value(z.mean) AS mean, sum(CASE WHEN j = (z.n + 19) // 20 - 1 AND z.n % 20 > 0 THEN cut ELSE whole END) / any_value(z.n) AS m
  FROM (SELECT *, (('0x' || substr(md5(replicate || ':' || j), 1, 15))::BIGINT) % (n - 19) AS start FROM (SELECT count(*) AS n, avg(hits_6) AS mean FROM pp WHERE strategy = 'recent_hot'), (SELECT unnest(range(0, 1000)) AS replicate), (SELECT unnest(range(0, (count(*) + 19) // 20)) AS j FROM pp WHERE strategy = 'recent_hot')) z
  JOIN (SELECT draw_index - 300 AS start, list_sum(v) AS whole, coalesce(list_sum(v[1:rest]), 0) AS cut FROM (SELECT draw_index, list(hits_6) OVER (ORDER BY draw_index ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS v, (SELECT count(*) % 20 FROM pp WHERE strategy = 'recent_hot') AS rest FROM pp WHERE strategy = 'recent_hot')) b USING (start) GROUP BY replicate)""",
            "mean low high",
        ),
        "payload_faults": _query(
            """SELECT draw_index, fault, CASE WHEN fault IS NULL THEN list_aggregate(list_sort(list_reverse(numbers)), 'string_agg', ' ') END AS numbers, CASE WHEN fault IS NULL THEN special_number END AS special_number FROM (SELECT *, CASE WHEN i % 89 = 13 THEN 'malformed' WHEN i % 53 = 5 THEN 'not_announced' WHEN i % 79 = 11 THEN 'other_draw' WHEN i % 83 = 12 THEN 'other_date'
  WHEN i % 97 = 14 THEN 'not_seven' WHEN i % 71 = 9 THEN 'out_of_range' WHEN i % 73 = 10 THEN 'repeated' WHEN i % 59 = 6 OR i % 61 = 7 OR i % 67 = 8 THEN 'not_integers' END AS fault FROM (SELECT *, draw_index AS i FROM d))"""
        ),
        "reproduction": _query("SELECT count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS n, count(*) FILTER (b.s IS NULL) AS missing, count(*) FILTER (a.s IS NULL) AS extra, count(*) FILTER (abs(a.s - b.s) > 1e-12) AS beyond, max(abs(a.s - b.s)) AS max_difference FROM (SELECT draw_index, number, score AS s FROM bs WHERE strategy = 'recent_50') a FULL JOIN (SELECT draw_index, number, round(rate_50, 12) AS s FROM au WHERE draw_index > 300) b USING (draw_index, number)", "max_difference"),
    }
