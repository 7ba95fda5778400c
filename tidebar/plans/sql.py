"""Building blocks of the oracle SQL: named subqueries that are put in front of a final SELECT."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY date"


def rows(fn: str, lo: int, hi: int = 0) -> str:
    """A trailing frame, null until it is full."""
    end = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
    return f"CASE WHEN rn >= {1 - lo} THEN {fn} OVER ({W} ROWS BETWEEN {-lo} PRECEDING AND {end}) END"


def part(fn: str, lo: int, hi: int = 0) -> str:
    """A trailing frame that may be partly filled."""
    end = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
    return f"{fn} OVER ({W} ROWS BETWEEN {-lo} PRECEDING AND {end})"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


def clamp(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least({hi}, greatest({lo}, {x}))"


PARTS: dict[str, str] = {}

PARTS["b"] = f"""
b0 AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_discount - 0.05) * 0.4 AS r,
  avg(l_tax) * 0.25 AS spread, CAST(sum(l_quantity) * 10000 AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2),
b1 AS (SELECT *, round(100 * exp(sum(r) OVER ({W})), 4) AS close FROM b0),
b2 AS (SELECT *, coalesce(lag(close) OVER ({W}), close) AS open FROM b1),
b AS (SELECT symbol, date, open, round(greatest(open, close) * (1 + spread), 4) AS high, round(least(open, close) * (1 - spread), 4) AS low, close, volume,
  round(close * volume, 2) AS amount, row_number() OVER ({W}) AS rn, {lag('close')} AS c1 FROM b2)"""

PARTS["t"] = f"""
t AS (SELECT *, greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr, coalesce(close - c1, 0.0) AS d FROM b),
x AS (SELECT symbol, date, rn, close, tr, d,
  coalesce(100 * (close - {rows('min(low)', -8)}) / nullif({rows('max(high)', -8)} - {rows('min(low)', -8)}, 0), 50.0) AS rsv FROM t)"""

PARTS["e"] = """
e AS (
  SELECT symbol, rn, close AS e12, close AS e26, CAST(0.0 AS DOUBLE) AS sig, CAST(0.0 AS DOUBLE) AS g, CAST(0.0 AS DOUBLE) AS l, CAST(rsv AS DOUBLE) AS k, CAST(rsv AS DOUBLE) AS d, tr AS atr FROM x WHERE rn = 1
  UNION ALL
  SELECT x.symbol, x.rn, 2 / 13.0::DOUBLE * x.close + (1 - 2 / 13.0::DOUBLE) * e.e12, 2 / 27.0::DOUBLE * x.close + (1 - 2 / 27.0::DOUBLE) * e.e26,
    0.2::DOUBLE * (2 / 13.0::DOUBLE * x.close + (1 - 2 / 13.0::DOUBLE) * e.e12 - (2 / 27.0::DOUBLE * x.close + (1 - 2 / 27.0::DOUBLE) * e.e26)) + 0.8::DOUBLE * e.sig,
    greatest(x.d, 0) / 14.0::DOUBLE + 13 / 14.0::DOUBLE * e.g, greatest(-x.d, 0) / 14.0::DOUBLE + 13 / 14.0::DOUBLE * e.l,
    x.rsv / 3.0::DOUBLE + 2 / 3.0::DOUBLE * e.k, (x.rsv / 3.0::DOUBLE + 2 / 3.0::DOUBLE * e.k) / 3.0::DOUBLE + 2 / 3.0::DOUBLE * e.d, 2 / 15.0::DOUBLE * x.tr + 13 / 15.0::DOUBLE * e.atr
  FROM e JOIN x ON x.symbol = e.symbol AND x.rn = e.rn + 1),
i AS (SELECT x.symbol, x.date, x.rn, x.close, e12 AS ema12, e26 AS ema26, e12 - e26 AS macd, sig AS signal, e12 - e26 - sig AS hist,
  CASE WHEN x.rn = 1 THEN 50.0 ELSE 100 - 100 / (1 + g / (l + 1e-10)) END AS rsi14, k, e.d AS d, 3 * k - 2 * e.d AS j, atr AS atr14
  FROM e JOIN x USING (symbol, rn))"""

PARTS["bb"] = f"""
bb AS (SELECT symbol, date, rn, close, {rows('avg(close)', -19)} AS mid, {rows('stddev_samp(close)', -19)} AS sd FROM b)"""

PARTS["s"] = f"""
w0 AS (SELECT i.*, mid + 2 * sd AS up, mid - 2 * sd AS lo FROM i JOIN bb USING (symbol, date)),
w1 AS (SELECT *, {lag('macd')} AS macd0, {lag('signal')} AS signal0, {lag('hist')} AS hist0, {lag('rsi14')} AS r0, {lag('k')} AS k0, {lag('d')} AS d0, {lag('close')} AS c0, {lag('up')} AS up0, {lag('lo')} AS lo0 FROM w0),
s AS (SELECT symbol, date,
  CASE WHEN rn = 1 THEN 'neutral' WHEN macd0 <= signal0 AND macd > signal THEN 'buy' WHEN macd0 >= signal0 AND macd < signal THEN 'sell' WHEN hist0 <= 0 AND hist > 0 THEN 'buy' WHEN hist0 >= 0 AND hist < 0 THEN 'sell' ELSE 'neutral' END AS macd,
  CASE WHEN rn = 1 THEN 'neutral' WHEN r0 <= 30 AND rsi14 > 30 THEN 'buy' WHEN r0 >= 70 AND rsi14 < 70 THEN 'sell' WHEN rsi14 > 70 THEN 'sell' WHEN rsi14 < 30 THEN 'buy' ELSE 'neutral' END AS rsi14,
  CASE WHEN rn = 1 THEN 'neutral' WHEN k0 <= d0 AND k > d AND j < 80 THEN 'buy' WHEN k0 >= d0 AND k < d AND j > 20 THEN 'sell' WHEN j < 0 THEN 'buy' WHEN j > 100 THEN 'sell' ELSE 'neutral' END AS kdj,
  CASE WHEN rn = 1 THEN 'neutral' WHEN c0 <= lo0 AND close > c0 THEN 'buy' WHEN c0 >= up0 AND close < c0 THEN 'sell' WHEN close > up THEN 'sell' WHEN close < lo THEN 'buy' ELSE 'neutral' END AS boll FROM w1),
v0 AS (SELECT *, CASE macd WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS a, CASE rsi14 WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS bq, CASE kdj WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS cq, CASE boll WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS dq FROM s),
v AS (SELECT *, round(coalesce((0.3::DOUBLE * a + 0.25::DOUBLE * bq + 0.25::DOUBLE * cq + 0.2::DOUBLE * dq) / nullif(0.3::DOUBLE * abs(a) + 0.25::DOUBLE * abs(bq) + 0.25::DOUBLE * abs(cq) + 0.2::DOUBLE * abs(dq), 0), 0), 4) AS combined FROM v0),
sig AS (SELECT symbol, date, macd, rsi14, kdj, boll, combined, CASE WHEN combined > 0.3 THEN 'buy' WHEN combined < -0.3 THEN 'sell' ELSE 'neutral' END AS decision FROM v)"""


def ret(n: int) -> str:
    return f"coalesce(close / {lag('close', n)} - 1, 0.0)"


def share(x: str, scale: float) -> str:
    return f"sign({x}) * least(abs({x}) / {scale}, 1.0)"


PARTS["rg"] = f"""
g0 AS (SELECT *, (close - c1) / (c1 + 1e-8) AS day_ret, {rows('avg(close)', -19)} AS m20, {rows('avg(close)', -59)} AS m60, {rows('avg(close)', -119)} AS m120,
  {rows('avg(volume)', -9)} AS vn, {rows('avg(volume)', -29, -10)} AS vb, {rows('avg(volume)', -19, -10)} AS vp, {lag('close', 19)} AS c19,
  {ret(5)} AS r5, {ret(20)} AS r20, {ret(60)} AS r60, {part('first_value(close)', -19)} AS c_first, {part('avg((close - low) / (high - low + 1e-8))', -19)} AS breadth FROM b),
g1 AS (SELECT *, vn / (vb + 1e-8) AS vr, (vn - vp) / (vp + 1e-8) AS vt, (close - c19) / (c19 + 1e-8) AS slope, close / coalesce(c19, c_first) - 1 AS rr,
  CASE WHEN rn >= 31 THEN {part('stddev_pop(day_ret)', -28)} * sqrt(252) ELSE 0 END AS dv FROM g0),
g2 AS (SELECT *, CASE WHEN vr >= 1.5 THEN least(1.0, 0.5 + 0.5 * least(vr - 1, 1.0)) WHEN vr <= 0.7 THEN greatest(0.0, 0.5 * vr / 0.7) ELSE 0.5 + (vr - 1) * 0.5 / 0.5 END AS lv FROM g1),
g3 AS (SELECT symbol, date, rn,
  {clamp("0.30::DOUBLE * coalesce((close > m20)::INT, 0) + 0.25::DOUBLE * coalesce((close > m60)::INT, 0) + 0.20::DOUBLE * coalesce((close > m120)::INT, 0) + 0.25::DOUBLE * coalesce((m20 > m60 AND m60 > m120)::INT, 0) + CASE WHEN slope > 0.05 THEN 0.1 WHEN slope < -0.05 THEN -0.1 ELSE 0 END")} AS trend,
  CASE WHEN rn >= 30 THEN CASE WHEN vt > 0.1 THEN least(1.0, lv + 0.05) WHEN vt < -0.1 THEN greatest(0.0, lv - 0.05) ELSE lv END ELSE 0.5 END AS vol,
  {clamp(f"0.5 + 0.20::DOUBLE * {share('r5', 0.05)} + 0.30::DOUBLE * {share('r20', 0.10)} + 0.20::DOUBLE * {share('r60', 0.20)}")} AS mom, breadth,
  CASE WHEN rr < -0.08 THEN 0.1 WHEN rr > 0.15 THEN 0.8 ELSE {clamp('0.7 - dv * 0.5', 0.1, 0.9)} END AS risk FROM g2),
rg0 AS (SELECT *, CASE WHEN rn < 130 THEN 'structural' WHEN risk < 0.15 THEN 'systemic_risk' WHEN trend < 0.25 AND vol > 0.65 AND mom > 0.35 AND risk > 0.5 THEN 'policy_bottom'
  WHEN trend > 0.70 AND vol > 0.60 AND mom > 0.65 THEN 'bull_trend' WHEN vol < 0.35 AND trend < 0.55 THEN 'stock_game' ELSE 'structural' END AS regime FROM g3),
rg AS MATERIALIZED (SELECT *, CASE WHEN rn < 130 THEN 0.3 ELSE CASE regime WHEN 'systemic_risk' THEN 1 - risk * 5 WHEN 'policy_bottom' THEN least((1 - trend) * vol * 0.7 + risk * 0.3, 0.95) WHEN 'bull_trend' THEN least((trend + vol + mom) / 3, 0.95)
  WHEN 'stock_game' THEN least((1 - vol) * 0.6 + (1 - trend) * 0.4, 0.90) ELSE least(abs(trend - 0.5) * 2 * 0.3 + abs(vol - 0.5) * 0.2 + 0.5, 0.85) END END AS confidence,
  CASE WHEN rn < 130 THEN 0.30 ELSE CASE regime WHEN 'policy_bottom' THEN 0.9 WHEN 'bull_trend' THEN 0.8 WHEN 'structural' THEN 0.5 WHEN 'stock_game' THEN 0.2 ELSE 0 END END AS max_position,
  CASE WHEN rn < 130 THEN 2 ELSE CASE regime WHEN 'policy_bottom' THEN 5 WHEN 'bull_trend' THEN 4 WHEN 'structural' THEN 3 WHEN 'stock_game' THEN 2 ELSE 0 END END AS max_positions,
  regime <> 'systemic_risk' AS tradeable FROM rg0)"""

N, Q = 41, 13 / 14
WEIGHTS = "[" + ", ".join(repr(Q ** (N - 14) / 14 if k < 14 else Q ** (N - 1 - k) / 14) for k in range(N)) + "]::DOUBLE[]"



def weighed(c: str) -> str:
    few = f"list_concat(list_transform(range(14), lambda z: pow({Q!r}, rn - 15) / 14), ({WEIGHTS})[57 - rn:41])"
    return f"CASE WHEN rn >= {N + 1} THEN list_dot_product({c}::DOUBLE[], {WEIGHTS}) WHEN rn >= 15 THEN list_dot_product(({c}[2:])::DOUBLE[], ({few})::DOUBLE[]) END"


PARTS["rw"] = f"""
rw0 AS (SELECT symbol, date, rn, {part('list(greatest(coalesce(close - c1, 0), 0))', 1 - N)} AS gs, {part('list(greatest(c1 - close, 0))', 1 - N)} AS ls FROM b),
rw1 AS (SELECT symbol, date, rn, {weighed('gs')} AS g, {weighed('ls')} AS l FROM rw0),
rw AS (SELECT symbol, date, CASE WHEN rn < 15 THEN 50.0 WHEN l < 1e-10 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi_w FROM rw1)"""


def norm(x: str, lo: float, hi: float) -> str:
    return clamp(f"({x} - ({lo})) / ({hi} - ({lo}) + 1e-12)")


PARTS["fa"] = f"""
f0 AS (SELECT *, volume - {lag('volume')} AS dv, close - c1 AS dc, {rows('avg(close)', -4)} AS m5, {rows('avg(close)', -19)} AS m20, {rows('avg(close)', -59)} AS m60, {rows('avg(close)', -119)} AS m120,
  {rows('avg(volume)', -9)} AS vn, {rows('avg(volume)', -19, -10)} AS vp, {rows('avg(volume)', -4)} AS v5, {rows('avg(volume)', -9, -5)} AS v5p,
  CASE WHEN rn >= 20 THEN {rows('avg(volume)', -19)} ELSE volume END AS vol20, {ret(5)} AS r5, {ret(20)} AS r20, {ret(60)} AS r60 FROM b),
f1 AS (SELECT *, vn / (vp + 1e-8) AS ra, (close - m20) / (m20 + 1e-8) AS away, (close - m120) / (m120 + 1e-8) AS x,
  0.25::DOUBLE * coalesce((close > m5)::INT, 0) + 0.25::DOUBLE * coalesce((m5 > m20)::INT, 0) + 0.20::DOUBLE * coalesce((m20 > m60)::INT, 0) + 0.15::DOUBLE * coalesce((close > m20)::INT, 0) + 0.15::DOUBLE * coalesce((close > m60)::INT, 0) AS tb,
  coalesce((dc > 0 AND dv > 0)::INT, 0) - coalesce((dc < 0 AND dv > 0)::INT, 0) AS ud FROM f0),
f2 AS (SELECT *, CASE WHEN rn >= 20 THEN {clamp('0.5 + (ra - 1) * 0.5')} ELSE 0.5 END AS support,
  CASE WHEN ra >= 1.2 AND ra <= 2.5 THEN least(1.0, 0.5 + (ra - 1.2) / 2.6) WHEN ra > 2.5 THEN greatest(0.3, 1 - (ra - 2.5) * 0.15) ELSE greatest(0.0, ra / 1.2 * 0.5) END AS lv FROM f1),
f3 AS (SELECT symbol, date, rn, close, vol20, m120,
  {clamp(f"0.25::DOUBLE * {norm('r5', -0.08, 0.08)} + 0.45::DOUBLE * {norm('r20', -0.15, 0.15)} + 0.30::DOUBLE * {norm('r60', -0.30, 0.30)} + CASE WHEN support > 0.6 THEN 0.05 WHEN support < 0.4 THEN -0.05 ELSE 0 END")} AS momentum,
  CASE WHEN rn >= 20 THEN CASE WHEN v5 > v5p * 1.05 THEN least(1.0, lv + 0.1) ELSE lv END ELSE 0.5 END AS turnover,
  CASE WHEN rn >= 120 THEN CASE WHEN away >= 0.02 AND away <= 0.08 THEN least(1.0, tb + 0.05) ELSE tb END ELSE 0.5 END AS trend,
  CASE WHEN rn >= 11 THEN {clamp("0.5 + 0.5 * " + part('sum(ud)', -9) + " / 10")} ELSE 0.5 END AS vol_price,
  CASE WHEN rn >= 120 THEN CASE WHEN x >= 0.05 AND x <= 0.20 THEN 1.0 WHEN x > 0.20 AND x <= 0.35 THEN 0.70 WHEN x > 0.35 THEN 0.30 WHEN x >= 0 AND x < 0.05 THEN 0.85 WHEN x >= -0.05 AND x < 0 THEN 0.60 ELSE 0.20 END ELSE 0.5 END AS cost FROM f2),
f4 AS (SELECT f3.*, rsi_w, CASE WHEN rsi_w >= 50 AND rsi_w <= 65 THEN 1.0 WHEN rsi_w >= 45 AND rsi_w < 50 THEN 0.85 WHEN rsi_w > 65 AND rsi_w <= 72 THEN 0.75 WHEN rsi_w >= 40 AND rsi_w < 45 THEN 0.60 WHEN rsi_w > 72 AND rsi_w <= 80 THEN 0.50 WHEN rsi_w > 80 THEN 0.20 ELSE 0.35 END AS rsi,
  CASE WHEN rn < 125 THEN 'short_history' WHEN vol20 < 1e5 THEN 'low_volume' WHEN close < m120 * (1 - 0.12) THEN 'below_cost' WHEN rsi_w < 20 THEN 'oversold' END AS reason FROM f3 JOIN rw USING (symbol, date)),
f5 AS (SELECT *, reason IS NULL AS passed, CASE WHEN reason IS NULL THEN round(0.0::DOUBLE + momentum * 35 + turnover * 20 + trend * 20 + rsi * 10 + vol_price * 10 + cost * 5, 2) ELSE 0 END AS total_score FROM f4),
fa AS MATERIALIZED (SELECT *, CASE WHEN total_score >= 75 THEN 'A' WHEN total_score >= 60 THEN 'B' WHEN total_score >= 45 THEN 'C' ELSE 'D' END AS grade FROM f5)"""


PARTS["fs"] = """
fs1 AS (SELECT f3.*, rsi14 AS rsi_w FROM f3 JOIN i USING (symbol, date)),
fs2 AS (SELECT *, CASE WHEN rsi_w >= 50 AND rsi_w <= 65 THEN 1.0 WHEN rsi_w >= 45 AND rsi_w < 50 THEN 0.85 WHEN rsi_w > 65 AND rsi_w <= 72 THEN 0.75 WHEN rsi_w >= 40 AND rsi_w < 45 THEN 0.60 WHEN rsi_w > 72 AND rsi_w <= 80 THEN 0.50 WHEN rsi_w > 80 THEN 0.20 ELSE 0.35 END AS rsi,
  CASE WHEN rn < 125 THEN 'short_history' WHEN vol20 < 1e5 THEN 'low_volume' WHEN close < m120 * (1 - 0.12) THEN 'below_cost' WHEN rsi_w < 20 THEN 'oversold' END AS reason FROM fs1),
fs3 AS (SELECT *, reason IS NULL AS passed, CASE WHEN reason IS NULL THEN round(0.0::DOUBLE + momentum * 35 + turnover * 20 + trend * 20 + rsi * 10 + vol_price * 10 + cost * 5, 2) ELSE 0 END AS total_score FROM fs2),
fs AS MATERIALIZED (SELECT *, CASE WHEN total_score >= 75 THEN 'A' WHEN total_score >= 60 THEN 'B' WHEN total_score >= 45 THEN 'C' ELSE 'D' END AS grade FROM fs3)"""


def vr(a: str, b: str) -> str:
    return f"{a} / ({b} + 1e-8)"


PARTS["sd"] = f"""
d0 AS (SELECT *, close / c1 - 1 AS ret1, {lag('high')} AS h1, {lag('low')} AS l1, c1 / {lag('close', 2)} - 1 AS yret, close / {lag('close', 5)} - 1 AS ret5,
  {vr('volume', rows('avg(volume)', -4, -2))} AS vr_limit, {vr('volume', rows('avg(volume)', -5, -1))} AS vr5, {vr(rows('avg(volume)', -2), rows('avg(volume)', -7, -3))} AS vr_cross,
  {vr(rows('avg(volume)', -2), rows('avg(volume)', -19, -3))} AS vr_platform, {vr(rows('avg(volume)', -2), rows('avg(volume)', -9, -3))} AS vr_pull, {vr(rows('avg(volume)', -4), rows('avg(volume)', -9, -5))} AS vr_div,
  {rows('avg(volume)', -19, -1)} AS v19, {rows('avg(close)', -4)} AS m5, {rows('avg(close)', -5, -1)} AS m5p, {rows('avg(close)', -19)} AS m20, {rows('avg(close)', -20, -1)} AS m20p,
  {rows('avg(close)', -59)} AS m60, {rows('avg(close)', -60, -1)} AS m60p, {rows('max(high)', -20, -1)} AS hi20, {rows('min(close)', -20, -1)} AS lo20, {rows('max(close)', -9, -1)} AS top9, {rows('max(high)', -60, -1)} AS hi60,
  {rows('stddev_samp(close)', -19)} AS dev FROM b),
d1 AS (SELECT *, m20 + 2 * dev AS up, m20 - 2 * dev AS lo, (open - h1) / (h1 + 1e-8) AS gap, (close - low) / (high - low + 1e-8) AS spot, (hi20 - lo20) / (lo20 + 1e-8) AS width, abs(close - m20) / (m20 + 1e-8) AS away FROM d0),
d2 AS (SELECT *, {lag('up')} AS up1, {lag('lo')} AS lo1 FROM d1),
sd AS (
  SELECT symbol, date, 'short_term' AS style, 'limit_up_follow' AS signal, round(least(0.60 + yret * 2 + (vr_limit - 1.15) * 0.1, 0.95) + 1e-9, 3) AS strength FROM d2 WHERE rn >= 30 AND yret >= LIMIT_PCT * 0.95 AND ret1 >= 0.005 AND vr_limit >= 1
  UNION ALL SELECT symbol, date, 'short_term', 'gap_up_breakout', round(least(0.50 + gap * 5 + (vr5 - 1.5) * 0.05, 0.90) + 1e-9, 3) FROM d2 WHERE rn >= 30 AND gap >= 0.02 AND vr5 >= 1.5 AND close >= open * 0.98
  UNION ALL SELECT symbol, date, 'short_term', 'ma_golden_cross', round(least(0.60 + (vr_cross - 1) * 0.15, 0.85) + 1e-9, 3) FROM d2 WHERE rn >= 30 AND m5p <= m20p AND m5 > m20 AND vr_cross >= 0.9 AND close >= m20 * 0.99
  UNION ALL SELECT symbol, date, 'short_term', 'intraday_surge', round(least(0.50 + ret1 * 5 + (vr5 - 1.5) * 0.05, 0.85) + 1e-9, 3) FROM d2 WHERE rn >= 30 AND ret1 >= 0.03 AND vr5 >= 1.5 AND spot >= 0.5
  UNION ALL SELECT symbol, date, 'swing', 'swing_breakout', round(least(0.55 + (close - hi20) / (hi20 + 1e-8) * 10 + (vr_platform - 1.5) * 0.08, 0.92) + 1e-9, 3) FROM d2 WHERE rn >= 30 AND width <= 0.08 * 1.5 AND close > hi20 * 1.005 AND vr_platform >= 1.5
  UNION ALL SELECT symbol, date, 'swing', 'pullback_ma', round(least(0.55 + (0.02 - away) * 10 + (0.8 - vr_pull) * 0.2, 0.82) + 1e-9, 3) FROM d2 WHERE rn >= 30 AND away <= 0.02 AND top9 >= m20 * 1.05 AND vr_pull <= 0.8 AND low >= l1
  UNION ALL SELECT symbol, date, 'swing', 'volume_divergence', round(least(0.50 + abs(ret5) * 3 + (0.65 - vr_div) * 0.5, 0.78) + 1e-9, 3) FROM d2 WHERE rn >= 30 AND ret5 < 0 AND ret5 >= -0.05 AND vr_div < 0.65 AND m5 >= m20 * 0.99
  UNION ALL SELECT symbol, date, 'swing', 'bollinger_breakout', CASE WHEN close > up AND c1 <= up1 AND vr5 >= 1.3 THEN round(least(0.60 + (close / up - 1) * 10 + (vr5 - 1.3) * 0.05, 0.88) + 1e-9, 3) ELSE round(least(0.52 + (close / lo - 1) * 5, 0.72) + 1e-9, 3) END
    FROM d2 WHERE rn >= 30 AND ((close > up AND c1 <= up1 AND vr5 >= 1.3) OR (c1 <= lo1 AND close > lo))
  UNION ALL SELECT symbol, date, 'medium_term', 'swing_breakout', 0.80 FROM d2 WHERE rn >= 65 AND close > hi60 AND volume > v19 * 1.5
  UNION ALL SELECT symbol, date, 'medium_term', 'ma_golden_cross', 0.75 FROM d2 WHERE rn >= 65 AND m20p <= m60p AND m20 > m60)"""

PARTS["pf"] = f"""
pf AS (SELECT symbol, date, rn, close, {part('avg(tr)', -13)} AS atr, {part('min(low)', -4)} AS low5, {part('max(high)', -30, -1)} AS prev_high, {part('max(high)', -60, -1)} AS high60,
  {part('avg(volume)', -4)} / (CASE WHEN rn >= 20 THEN {part('avg(volume)', -19, -5)} ELSE {part('avg(volume)', -19)} END + 1e-8) AS vr, {ret(5)} AS ret5 FROM t)"""


def signal_parts(
    source: str, name: str, low: str = "0.04", high: str = "0.09", least_rr: str = "1.3", atr: str = "2.0", buffer: str = "0.02", score: str = "55", least_conf: str = "0.45", prev: str = "prev_high",
) -> str:
    """The trade signal over rows with price frames, regime and score; stops between two shares of the price, the least reward over risk, and the preset's other figures."""
    return f"""
{name}0 AS (SELECT *, round(least(greatest(least(close - {atr} * atr, low5 * 0.99), close * (1 - {high})), close * (1 - {low})) + 1e-9, 3) AS stop,
  CASE WHEN close >= {prev} * 0.98 THEN greatest(high60 * (1 - {buffer}), close * 1.08) ELSE {prev} * (1 - {buffer}) END AS tg FROM {source}),
{name}1 AS (SELECT *, round(CASE WHEN tg <= close * 1.02 THEN close * (1 + greatest({low} * {least_rr}, 0.05)) ELSE tg END + 1e-9, 3) AS target FROM {name}0),
{name}2 AS (SELECT *, (target - close) / (close - stop + 1e-8) AS rr, CASE WHEN vr >= 1.8 AND ret5 > 0.03 THEN 'volume_surge' WHEN ret5 > 0.04 THEN 'momentum_breakout' WHEN ret5 >= -0.03 AND ret5 <= 0.01 THEN 'pullback_entry' ELSE 'trend_continuation' END AS signal_type,
  round({clamp("0.45::DOUBLE + (total_score - " + score + ") / 90 * 0.50::DOUBLE + CASE regime WHEN 'policy_bottom' THEN 0.10 WHEN 'bull_trend' THEN 0.05 WHEN 'stock_game' THEN -0.05 ELSE 0 END", 0.45, 0.95)} + 1e-9, 3) AS conf,
  round(close * (1 + 0.0003::DOUBLE + 0.001::DOUBLE) + 1e-9, 3) AS entry FROM {name}1),
{name}3 AS (SELECT *, round(least(max_position * (0.5::DOUBLE + conf * least(rr / 2, 1.0) * 0.5), 0.4, max_position / greatest(max_positions, 1)) + 1e-9, 4) AS position_pct,
  coalesce(passed AND total_score >= {score} AND tradeable AND n >= 30 AND rr >= {least_rr} AND conf >= {least_conf}, false) AS generated FROM {name}2),
{name} AS (SELECT *, generated AND stop < entry AND entry < target AND (target - entry) / (entry - stop + 1e-8) >= 1.3 AND conf >= 0.45 AS valid FROM {name}3)"""


PARTS["sg"] = "\nsgin AS (SELECT pf.*, pf.rn AS n, regime, max_position, max_positions, tradeable, total_score, passed, grade FROM pf JOIN rg USING (symbol, date) JOIN fs AS fa USING (symbol, date))," + signal_parts("sgin", "sg")

PARTS["ca"] = """
cin AS (SELECT b.symbol, b.date, b.rn - 1 AS i, pf.close, pf.atr, pf.low5, pf.prev_high, pf.high60, pf.vr, pf.ret5, pf.rn AS n, rg.regime, rg.max_position, rg.max_positions, rg.tradeable, fa.total_score, fa.passed
  FROM b JOIN pf ON pf.symbol = b.symbol AND pf.rn = b.rn - 1 JOIN rg ON rg.symbol = b.symbol AND rg.rn = (b.rn - 1) // 10 * 10 JOIN fs AS fa ON fa.symbol = b.symbol AND fa.rn = (b.rn - 1) // 10 * 10
  WHERE b.rn - 1 >= 130 AND NOT coalesce(b.close / b.c1 - 1 >= 0.095, false)),""" + signal_parts("cin", "cs") + """,
ca AS (SELECT symbol, date, i, entry, stop, target, position_pct, signal_type, conf AS confidence FROM cs WHERE valid)"""

PARTS["px"] = """
z AS (SELECT symbol, max(rn) - 1 AS last_i, max(date) AS last_date, arg_max(close, rn) AS last_close FROM b GROUP BY 1),
tb AS (SELECT symbol, date, rn - 1 AS j, high, low, close, coalesce(close / c1 - 1 <= -0.095, false) AS down FROM b),
p0 AS (SELECT ca.symbol, ca.i, ca.entry, ca.stop, ca.target, tb.j, tb.date, tb.low, tb.close, (tb.close - entry) / entry AS profit, greatest(entry, max(high) OVER wj) AS top,
  coalesce(max(((tb.close - entry) / entry >= 0.04)::INT) OVER (PARTITION BY ca.symbol, ca.i ORDER BY tb.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS safe,
  max(((tb.close - entry) / entry >= 0.06)::INT) OVER wj AS trails
  FROM ca JOIN tb ON tb.symbol = ca.symbol AND tb.j >= ca.i + 3 AND tb.j <= ca.i + 40 AND NOT tb.down WINDOW wj AS (PARTITION BY ca.symbol, ca.i ORDER BY tb.j)),
p1 AS (SELECT *, CASE WHEN safe = 1 AND stop < entry THEN entry ELSE stop END AS stop_j, top * (1 - 0.04) AS trail FROM p0),
p2 AS (SELECT symbol, i, j, date, CASE WHEN low <= stop_j THEN 'stop_loss' WHEN j - i >= 20 THEN 'time_exit' WHEN trails = 1 AND low <= trail THEN 'trailing_stop' WHEN close >= target THEN 'target_reached' END AS reason,
  CASE WHEN low <= stop_j THEN stop_j WHEN j - i >= 20 THEN close WHEN trails = 1 AND low <= trail THEN trail ELSE close END AS price FROM p1),
p3 AS (SELECT symbol, i, min(j) AS j, arg_min(date, j) AS d, arg_min(price, j) AS price, arg_min(reason, j) AS reason FROM p2 WHERE reason IS NOT NULL GROUP BY 1, 2),
px AS (SELECT ca.*, coalesce(p3.j, last_i) AS exit_i, coalesce(p3.d, last_date) AS exit_date, coalesce(p3.price, last_close) AS exit_raw, coalesce(p3.reason, 'end_of_backtest') AS exit_reason
  FROM ca JOIN z USING (symbol) LEFT JOIN p3 USING (symbol, i))"""

PARTS["le"] = """
q AS (SELECT *, round(exit_raw - exit_raw * 0.0013::DOUBLE + 1e-9, 3) AS exit_price, row_number() OVER (PARTITION BY symbol ORDER BY i) AS nth FROM px),
l AS (
  SELECT symbol, CAST(0 AS BIGINT) AS nth, CAST(-1 AS BIGINT) AS free, CAST(100000 AS DOUBLE) AS cash, CAST(0 AS BIGINT) AS qty, CAST(0 AS DOUBLE) AS cash_in, false AS took FROM (SELECT DISTINCT symbol FROM q)
  UNION ALL
  SELECT symbol, nth, CASE WHEN take THEN exit_i + (exit_reason = 'end_of_backtest')::INT ELSE free END, CASE WHEN take THEN cash - lots * entry + lots * exit_price ELSE cash END, lots, cash - lots * entry, take
  FROM (SELECT q.symbol, q.nth, l.free, l.cash, q.exit_i, q.exit_reason, q.entry, q.exit_price, CAST(floor(l.cash * q.position_pct / q.entry / 100) * 100 AS BIGINT) AS lots,
    q.i >= l.free AND floor(l.cash * q.position_pct / q.entry / 100) * 100 >= 100 AND floor(l.cash * q.position_pct / q.entry / 100) * 100 * q.entry <= l.cash AS take
    FROM l JOIN q ON q.symbol = l.symbol AND q.nth = l.nth + 1)),
le AS (SELECT q.*, l.qty AS quantity, l.cash_in, l.cash AS cash_out, (exit_price - entry) / entry * 100 AS pnl_pct, (exit_price - entry) / entry * 100 / 100 * entry * l.qty AS pnl FROM q JOIN l USING (symbol, nth) WHERE took)"""

PARTS["eq"] = """
ev AS (SELECT symbol, i, arg_max(cash, kind) AS cash, arg_max(held, kind) AS held FROM (
  SELECT symbol, i, 1 AS kind, cash_in AS cash, quantity AS held FROM le UNION ALL SELECT symbol, exit_i, 0, cash_out, 0 FROM le WHERE exit_reason <> 'end_of_backtest') GROUP BY 1, 2),
eq0 AS (SELECT b.symbol, b.date, b.rn - 1 AS i, b.close, coalesce(last_value(ev.cash IGNORE NULLS) OVER we, 100000) AS cash, coalesce(last_value(ev.held IGNORE NULLS) OVER we, 0) AS held
  FROM b LEFT JOIN ev ON ev.symbol = b.symbol AND ev.i = b.rn - 1 WHERE b.rn - 1 >= 130 WINDOW we AS (PARTITION BY b.symbol ORDER BY b.rn)),
eq AS (SELECT symbol, date, i, round(cash, 2) AS capital, round(held * close, 2) AS position_val, round(cash + held * close, 2) AS total, round(((cash + held * close) / 100000 - 1) * 100, 3) AS return_pct FROM eq0)"""

PARTS["mt"] = """
m0 AS (SELECT symbol, date, total, total / lag(total) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, (max(total) OVER (PARTITION BY symbol ORDER BY date) - total) / max(total) OVER (PARTITION BY symbol ORDER BY date) * 100 AS dd FROM eq),
m1 AS (SELECT symbol, count(*) AS n_days, arg_max(total, date) / 100000 - 1 AS ret, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0.03 / 252 THEN r - 0.03 / 252 END) AS dsd, max(dd) AS dd FROM m0 GROUP BY 1),
mc AS (SELECT symbol, n_days, round(ret * 100, 4) AS total_return_pct, round(CASE WHEN sd > 0 THEN (mu - 0.03 / 252) / sd * sqrt(252) ELSE 0 END, 4) AS sharpe, round(CASE WHEN dsd > 0 THEN (mu - 0.03 / 252) / dsd * sqrt(252) ELSE 0 END, 4) AS sortino,
  round(dd, 4) AS max_drawdown_pct, round(CASE WHEN dd > 0 THEN (pow(1 + ret, 252.0 / n_days) - 1) / (dd / 100) ELSE 0 END, 4) AS calmar FROM m1),
mt AS (SELECT symbol, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, round(avg((pnl > 0)::INT), 6) AS win_rate, round(least(coalesce(sum(pnl) FILTER (pnl > 0), 0) / (abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) + 1e-8), 999.99), 4) AS profit_factor,
  round(avg(pnl_pct), 4) AS avg_trade_pct, round(avg(CASE WHEN exit_reason = 'stop_loss' THEN 100.0 ELSE 0 END), 4) AS stop_pct, round(avg(CASE WHEN exit_reason = 'target_reached' THEN 100.0 ELSE 0 END), 4) AS target_pct,
  round(avg(CASE WHEN exit_reason = 'trailing_stop' THEN 100.0 ELSE 0 END), 4) AS trail_pct, round(avg(CASE WHEN exit_reason = 'time_exit' THEN 100.0 ELSE 0 END), 4) AS time_pct FROM le GROUP BY 1)"""

def account_parts(risk: bool) -> str:
    """Accounts bar by bar over the candidates ``ac0`` of the styles ``sy``, and their trades ``acct``; with ``risk`` also the breaker, the pause after losses and adds."""
    may = "AND NOT broken AND pause1 = 0" if risk else ""
    peak, fall = "greatest(peak, total)", "(greatest(peak, total) - total) / greatest(peak, total)"
    wants = "h_i IS NOT NULL AND NOT broken1 AND pause2 = 0 AND h_adds < 1 AND (close - h_entry) / h_entry >= 0.05" if risk else "false"
    return f"""
ab AS MATERIALIZED (SELECT sy.*, b.symbol, b.rn, b.high, b.low, b.close, coalesce(b.close / b.c1 - 1 <= -0.095, false) AS down, b.rn = max(b.rn) OVER (PARTITION BY sy.style, b.symbol) AS last,
  q.entry AS c_entry, q.stop AS c_stop, q.target AS c_target, q.position_pct AS c_pct, q.signal_type AS c_type FROM b CROSS JOIN sy LEFT JOIN ac0 q ON q.style = sy.style AND q.symbol = b.symbol AND q.i = b.rn - 1),
ac AS (
  SELECT DISTINCT style, symbol, CAST(0 AS BIGINT) AS rn, CAST(100000 AS DOUBLE) AS cash, CAST(NULL AS BIGINT) AS h_i, CAST(NULL AS VARCHAR) AS h_type, CAST(NULL AS DOUBLE) AS h_entry, CAST(NULL AS DOUBLE) AS h_stop, CAST(NULL AS DOUBLE) AS h_target,
    CAST(NULL AS BIGINT) AS h_qty, CAST(NULL AS DOUBLE) AS h_top, false AS h_trails, CAST(0 AS INTEGER) AS h_adds, CAST(NULL AS DOUBLE) AS h_in, CAST(100000 AS DOUBLE) AS peak, false AS broken, CAST(0 AS INTEGER) AS losses, CAST(0 AS INTEGER) AS pause,
    CAST(0 AS DOUBLE) AS close, false AS last, CAST(NULL AS BIGINT) AS x_i, CAST(NULL AS VARCHAR) AS x_type, CAST(NULL AS DOUBLE) AS x_entry, CAST(NULL AS BIGINT) AS x_qty, CAST(0 AS INTEGER) AS x_adds, CAST(NULL AS DOUBLE) AS x_in, CAST(NULL AS DOUBLE) AS x_raw, CAST(NULL AS DOUBLE) AS x_price, CAST(NULL AS VARCHAR) AS x_reason, CAST(NULL AS DOUBLE) AS x_out
  FROM ab
  UNION ALL
  SELECT style, symbol, rn, CASE WHEN adds THEN cash2 - more * price ELSE cash2 END, h_i, h_type, CASE WHEN adds THEN round(average + 1e-9, 3) ELSE h_entry END, CASE WHEN adds THEN round(average * (1 - least_stop) + 1e-9, 3) ELSE h_stop END, h_target,
    CASE WHEN adds THEN h_qty + more ELSE h_qty END, h_top, h_trails, CASE WHEN adds THEN h_adds + 1 ELSE h_adds END, h_in, peak1, broken1, losses1, pause2, close, last, x_i, x_type, x_entry, x_qty, x_adds, x_in, x_raw, x_price, x_reason, x_out
  FROM (SELECT *, coalesce(({wants}) AND more >= 100 AND more * price <= cash2, false) AS adds, (h_qty * h_entry + more * price) / (h_qty + more) AS average
  FROM (SELECT *, CAST(floor(greatest(h_qty * h_entry * 0.5, close * 110) / price / 100) * 100 AS BIGINT) AS more, {peak} AS peak1, broken OR {fall} >= 0.08 AS broken1
  FROM (SELECT *, close * (1 + 0.0003::DOUBLE + 0.001::DOUBLE) AS price, cash2 + coalesce(h_qty * close, 0) AS total, greatest(pause1 - 1, 0) AS pause2
  FROM (SELECT * REPLACE (CASE WHEN takes THEN rn - 1 ELSE h_i END AS h_i, CASE WHEN takes THEN c_type ELSE h_type END AS h_type, CASE WHEN takes THEN c_entry ELSE h_entry END AS h_entry, CASE WHEN takes THEN c_stop ELSE h_stop END AS h_stop, CASE WHEN takes THEN c_target ELSE h_target END AS h_target,
      CASE WHEN takes THEN lots ELSE h_qty END AS h_qty, CASE WHEN takes THEN c_entry ELSE h_top END AS h_top, CASE WHEN takes THEN false ELSE h_trails END AS h_trails, CASE WHEN takes THEN 0 ELSE h_adds END AS h_adds, CASE WHEN takes THEN cash1 - lots * c_entry ELSE h_in END AS h_in),
    CASE WHEN takes THEN cash1 - lots * c_entry ELSE cash1 END AS cash2
  FROM (SELECT *, coalesce(h_i IS NULL AND c_entry IS NOT NULL {may} AND lots >= 100 AND lots * c_entry <= cash1, false) AS takes
  FROM (SELECT *, CAST(floor(cash1 * c_pct / c_entry / 100) * 100 AS BIGINT) AS lots
  FROM (SELECT * REPLACE (CASE WHEN x_raw IS NULL THEN h_i END AS h_i, CASE WHEN x_raw IS NULL THEN h_qty END AS h_qty), CASE WHEN x_raw IS NOT NULL THEN x_out ELSE cash END AS cash1,
    CASE WHEN x_raw IS NULL THEN losses WHEN x_price < x_entry THEN losses + 1 ELSE 0 END AS losses1, CASE WHEN x_raw IS NOT NULL AND x_price < x_entry AND losses + 1 >= 3 THEN 3 ELSE pause END AS pause1
  FROM (SELECT * REPLACE (CASE WHEN seen AND profit >= be AND h_stop < h_entry THEN h_entry ELSE h_stop END AS h_stop), h_i AS x_i, h_type AS x_type, h_entry AS x_entry, h_qty AS x_qty, h_adds AS x_adds, h_in AS x_in, cash + h_qty * x_price AS x_out
  FROM (SELECT *, round(x_raw - x_raw * 0.0013::DOUBLE + 1e-9, 3) AS x_price
  FROM (SELECT *, CASE WHEN NOT seen THEN NULL WHEN low <= h_stop THEN h_stop WHEN rn - 1 - h_i >= hold THEN close WHEN h_trails AND low <= h_top * (1 - trail) THEN h_top * (1 - trail) WHEN close >= h_target THEN close END AS x_raw,
    CASE WHEN NOT seen THEN NULL WHEN low <= h_stop THEN 'stop_loss' WHEN rn - 1 - h_i >= hold THEN 'time_exit' WHEN h_trails AND low <= h_top * (1 - trail) THEN 'trailing_stop' WHEN close >= h_target THEN 'target_reached' END AS x_reason
  FROM (SELECT * REPLACE (CASE WHEN seen THEN greatest(h_top, high) ELSE h_top END AS h_top, h_trails OR (seen AND profit >= act) AS h_trails)
  FROM (SELECT ab.*, cash, h_i, h_type, h_entry, h_stop, h_target, h_qty, h_top, h_trails, h_adds, h_in, peak, broken, losses, pause, coalesce(h_i IS NOT NULL AND NOT down AND ab.rn - 1 - h_i >= 3, false) AS seen, coalesce((ab.close - h_entry) / h_entry, 0) AS profit
  FROM ac JOIN ab ON ab.style = ac.style AND ab.symbol = ac.symbol AND ab.rn = ac.rn + 1))))))))))))),
at0 AS (
  SELECT style, symbol, x_i AS i, x_type AS signal_type, x_qty AS quantity, x_adds AS adds, x_entry AS entry, rn - 1 AS exit_i, x_raw AS exit_raw, x_price AS exit_price, x_reason AS exit_reason, x_in AS cash_in, x_out AS cash_out FROM ac WHERE x_raw IS NOT NULL
  UNION ALL
  SELECT style, symbol, h_i, h_type, h_qty, h_adds, h_entry, rn - 1, close, net, 'end_of_backtest', h_in, cash + h_qty * net FROM (SELECT *, round(close - close * 0.0013::DOUBLE + 1e-9, 3) AS net FROM ac WHERE last AND h_i IS NOT NULL)),
acct AS (SELECT *, (exit_price - entry) / entry * 100 AS pnl_pct, (exit_price - entry) / entry * 100 / 100 * entry * quantity AS pnl FROM at0)"""


NEEDS = {
    "b": [], "t": ["b"], "e": ["t"], "bb": ["b"], "s": ["e", "bb"], "rg": ["b"], "rw": ["b"], "fa": ["rw"], "sd": ["b"], "pf": ["t"], "fs": ["e", "fa"], "sg": ["pf", "rg", "fs"], "ca": ["pf", "rg", "fs"],
    "px": ["ca"], "le": ["px"], "eq": ["le"], "mt": ["eq"],
}


def query(needs: str, final: str, more: str = "", limit: str = "0.095") -> str:
    """The final SELECT with the parts it needs in front, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS[name]:
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    nudged = lambda text: text.replace(" + 1e-9, 6)", ", 6)").replace(", 6)", " + 1e-9, 6)")  # noqa: E731  as ``settled`` does
    final, more = nudged(final), nudged(more)
    body = ",".join(PARTS[x] for x in order) + (("," if order else "") + more if more else "")
    return f"WITH RECURSIVE {body}\n{final}".replace("LIMIT_PCT", limit)
