"""Oracle SQL: bar checks, price features and total-return series."""

from __future__ import annotations

from oracle.fixtures import cte, r, with_

DECISION = "TIMESTAMP '1999-06-30 00:00:00'"
W = "PARTITION BY symbol ORDER BY session"
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def broken(rules: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in rules) + ")"


def feature_ctes(suffix: str, where: str, bench_where: str = "true") -> None:
    cte(f"joined{suffix}", f"""
SELECT b.*, k.close AS bench_close, k.available_to_strategy_at AS bench_available
FROM (SELECT * FROM bars WHERE quality = 'PASS' AND {where}) b
LEFT JOIN (SELECT * FROM bench WHERE {bench_where}) k USING (session)""", "bars", "bench")
    cte(f"daily{suffix}", f"""
SELECT *, close / lag(close) OVER ({W}) - 1 AS daily_return, bench_close / lag(bench_close) OVER ({W}) - 1 AS bench_return,
       max(close) OVER ({W} {UP}) AS peak FROM joined{suffix}""", f"joined{suffix}")
    cte(f"paired{suffix}", f"""
SELECT *, daily_return IS NOT NULL AND bench_return IS NOT NULL AS paired,
       count(CASE WHEN daily_return IS NOT NULL AND bench_return IS NOT NULL THEN 1 END) OVER ({W} {UP}) AS pair_number
FROM daily{suffix}""", f"daily{suffix}")
    momenta = ", ".join(f"close / lag(close, {k}) OVER ({W}) - 1 AS momentum_{k}d" for k in (21, 63, 126, 252))
    vols = ", ".join(
        f"stddev_samp(daily_return) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) * sqrt(252) "
        f"AS realized_volatility_{k}d" for k in (21, 63))
    cte(f"features{suffix}", f"""
SELECT *, {momenta}, {vols}, least(0.0, min(close / peak - 1) OVER ({W} {UP})) AS maximum_drawdown,
       close / lag(close, 63) OVER ({W}) - bench_close / lag(bench_close, 63) OVER ({W}) AS relative_strength_63d,
       avg(close * volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS average_dollar_volume_21d,
       count(*) OVER ({W} {UP}) AS bars_seen,
       regr_slope(CASE WHEN paired THEN daily_return END, CASE WHEN paired THEN bench_return END)
         OVER (PARTITION BY symbol ORDER BY pair_number RANGE BETWEEN 62 PRECEDING AND CURRENT ROW) AS beta_63d,
       {' || '.join(LANE.format(first=8 * k + 1) for k in range(8))} AS input_digest,
       max(greatest(available_to_strategy_at, coalesce(bench_available, available_to_strategy_at))) OVER ({W} {UP}) AS created_at,
       min(available_to_strategy_at) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_arrival
FROM paired{suffix}""", f"paired{suffix}")


BAR_TEXT = ("concat_ws('|', symbol, CAST(session AS VARCHAR), CAST(CAST(round(close * 100000000) AS BIGINT) AS VARCHAR), "
            "CAST(volume AS VARCHAR), strftime(available_to_strategy_at, '%Y-%m-%d %H:%M:%S'), 'raw:v1')")
#: Sum of one 32-bit lane of every input bar's SHA-256, modulo 2^32.
LANE = "printf('%08x', CAST(sum(('0x' || substr(sha256(" + BAR_TEXT + "), {first}, 8))::BIGINT) OVER (" + W + " " + UP + ") % 4294967296 AS BIGINT))"
feature_ctes("", "true")
feature_ctes("_at", f"available_to_strategy_at <= {DECISION}", f"available_to_strategy_at <= {DECISION}")
feature_ctes("_thin", "true", "day(session) <> 7")
cte("panel_features", """
SELECT *, session AS as_of FROM features
WHERE bars_seen >= 2 AND (next_arrival IS NULL OR next_arrival > created_at)""", "features")
cte("growth", f"""
SELECT *, product(factor) OVER ({W} {UP}) AS growth, row_number() OVER ({W}) - 1 AS i
FROM (SELECT *, coalesce(split_coefficient * (close + dividend) / lag(close) OVER ({W}), 1.0) AS factor FROM bars)""", "bars")

FEATURES = ("average_dollar_volume_21d", "beta_63d", "maximum_drawdown", "momentum_126d", "momentum_21d",
            "momentum_252d", "momentum_63d", "realized_volatility_21d", "realized_volatility_63d", "relative_strength_63d")


def rounded() -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in FEATURES)


def one_feature(name: str, places: int = 6) -> str:
    return with_("features", f"SELECT symbol, session, {r(name, places)} AS {name} FROM features")


BAR_RULES = [(f"{n}_positive", f"{n} > 0") for n in ("open", "high", "low", "close")] + [
    ("adjusted_close_positive", "close > 0"), ("volume_not_negative", "volume >= 0"),
    ("dividend_not_negative", "dividend >= 0"), ("split_positive", "split_coefficient > 0"),
    ("low_is_lowest", "low <= least(open, close)"), ("high_is_highest", "high >= greatest(open, close)"),
    ("published_before_available", "published_at <= available_to_strategy_at"),
]

SQL = {
    "bar_validity": with_("bars", "SELECT * FROM checked WHERE violations <> ''", faulty="""
SELECT symbol, session, open, high, close, volume, available_to_strategy_at,
       CASE WHEN volume % 17 = 0 THEN high + 1 ELSE low END AS low,
       CASE WHEN volume % 19 = 0 THEN -0.5 ELSE dividend END AS dividend,
       CASE WHEN volume % 23 = 0 THEN 0.0 ELSE split_coefficient END AS split_coefficient,
       CASE WHEN volume % 29 = 0 THEN CAST(session + 60 AS TIMESTAMP) ELSE closed_at END AS published_at FROM bars""",
        checked=f"SELECT symbol, session, {broken(BAR_RULES)} AS violations FROM faulty"),
    "bars_at_decision": with_("bars", f"""
SELECT symbol, session, close, volume FROM bars WHERE available_to_strategy_at <= {DECISION} AND quality = 'PASS'"""),
    "duplicate_sessions": with_("bars", "SELECT symbol, session, CAST(2 AS BIGINT) AS copies FROM bars WHERE volume % 31 = 0"),
    "date_slice": with_("bars", """
SELECT symbol, count(*) FILTER (s) AS kept, min(session) FILTER (s) AS first_session, max(session) FILTER (s) AS last_session,
       count(*) FILTER (s) >= 3 AS sufficient
FROM (SELECT *, session BETWEEN DATE '1996-01-01' AND DATE '1996-02-20' AS s FROM bars) GROUP BY symbol"""),
    "simple_returns": with_("bars", f"SELECT symbol, session, {r(f'close / lag(close) OVER ({W}) - 1')} AS daily_return FROM bars"),
    "price_momentum": with_("features", "SELECT symbol, session, " + ", ".join(
        f"{r(f'momentum_{k}d')} AS momentum_{k}d" for k in (21, 63, 126, 252)) + " FROM features"),
    "realized_volatility": with_("features", "SELECT symbol, session, " + ", ".join(
        f"{r(f'realized_volatility_{k}d')} AS realized_volatility_{k}d" for k in (21, 63)) + " FROM features"),
    "maximum_drawdown": one_feature("maximum_drawdown"),
    "rolling_beta": one_feature("beta_63d"),
    "relative_strength": one_feature("relative_strength_63d"),
    "average_dollar_volume": one_feature("average_dollar_volume_21d"),
    "benchmark_paired_returns": with_("paired_thin", f"""
SELECT symbol, session, {r('daily_return')} AS daily_return, {r('bench_return')} AS bench_return FROM paired_thin WHERE paired"""),
    "feature_snapshot": with_("features_at", f"""
SELECT l.symbol, session AS as_of, {DECISION} AS created_at, 'price-features-v1' AS feature_version, input_hash, {rounded()}
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS latest FROM features_at) l
JOIN (SELECT symbol, sha256(string_agg(t, ',' ORDER BY t)) AS input_hash
      FROM (SELECT symbol, {BAR_TEXT} AS t FROM joined_at) GROUP BY symbol) h ON h.symbol = l.symbol
WHERE latest = 1 AND bars_seen >= 2"""),
    "feature_panel": with_("panel_features", f"""
SELECT symbol, as_of, created_at, 'price-features-v1' AS feature_version, input_digest, {rounded()} FROM panel_features"""),
    "total_return_growth": with_("growth", f"SELECT symbol, session, {r('growth')} AS growth, " + ", ".join(
        f"{r(f'growth / lag(growth, {k}) OVER ({W})')} AS growth_{k}" for k in (5, 21, 63)) + " FROM growth"),
    "ranker_packet": with_("bars", f"""
SELECT symbol, session, 'asset_' || lpad(CAST(row_number() OVER (ORDER BY symbol) AS VARCHAR), 3, '0') AS id,
       momentum_21, momentum_63, momentum_126, momentum_252, volatility_63 FROM packet WHERE last = 1 AND i >= 252""",
        kept="SELECT * FROM bars WHERE symbol <> 'Brand-7' OR session < DATE '1997-01-01'",
        factors=f"""
SELECT *, product(factor) OVER ({W} {UP}) AS growth, row_number() OVER ({W}) - 1 AS i FROM (
  SELECT *, coalesce(split_coefficient * (close + dividend) / lag(close) OVER ({W}), 1.0) AS factor,
         close / lag(close) OVER ({W}) - 1 AS ret FROM kept)""",
        packet="SELECT symbol, session, i, " + ", ".join(
            f"{r(f'round(growth / lag(growth, {k}) OVER ({W}), 12) - 1', 8)} AS momentum_{k}" for k in (21, 63, 126, 252)) + f""",
       {r(f'stddev_pop(ret) OVER ({W} ROWS BETWEEN 61 PRECEDING AND CURRENT ROW) * sqrt(252)', 8)} AS volatility_63,
       row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS last FROM factors"""),
    "buy_and_hold_value": with_("bars", f"""
SELECT symbol, session, {r(f'(shares * close + sum(CASE WHEN later THEN shares * dividend ELSE 0.0 END) OVER ({W} {UP})) / first_value(open) OVER ({W} {UP})')} AS value
FROM held""", marked=f"SELECT *, row_number() OVER ({W}) > 1 AS later FROM bars",
        held=f"SELECT *, product(CASE WHEN later THEN split_coefficient ELSE 1.0 END) OVER ({W} {UP}) AS shares FROM marked"),
    "pairwise_alignment": with_("bars bench", """
SELECT symbol, session, b.close, k.open AS bench_open, k.close AS bench_close
FROM bars b JOIN bench k USING (session) WHERE month(session) <> 8"""),
    "common_sessions": with_("bars", """
SELECT session FROM bars GROUP BY session HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)"""),
}
