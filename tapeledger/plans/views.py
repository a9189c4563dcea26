"""Market and log data derived from the given tables: once as DataFrames, once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeledger.functions.timegrid import DAY_US, time_block
from tapeledger.operators.bars import ticks_to_bars
from tapeledger.operators.ordered import with_position


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Trades: symbol, timestamp, trade_id, px, sz, venue."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), F.col("event_id").alias("trade_id"), F.col("value").alias("px"),
        F.get_json_object("props", "$.k").cast("double").alias("sz"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("venue"),
    )


def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf))


def bars_1h_venue(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf), keys=("venue", "symbol"))


def venue_bars(spark: SparkSession, sf: str, venue: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf).where(F.col("venue") == venue))


def funding_events(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).select("symbol", "timestamp", "trade_id", ((F.col("px") - 50) / 1e6).alias("funding_rate"), F.lit(None).cast("double").alias("premium"))


def monthly_prices(spark: SparkSession, sf: str, n_symbols: int = 8) -> DataFrame:
    """Average price per symbol and month: symbol, bar (months since 1990), px."""
    li = table(spark, sf, "lineitem")
    symbol = F.concat(F.lit("S"), (F.col("l_partkey") % n_symbols).cast("string"))
    sums = li.groupBy(symbol.alias("symbol"), _month("l_shipdate").alias("bar")).agg(F.sum("l_extendedprice").alias("_v"), F.sum("l_quantity").alias("_q"))
    return sums.select("symbol", "bar", F.round(F.col("_v") / F.col("_q"), 6).alias("px"))


def supplier_market(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly prices and funding sums: symbol, bar, px, rate_sum, rate_px_sum."""
    li = table(spark, sf, "lineitem")
    symbol = F.concat(F.lit("S"), (F.col("l_partkey") % 8).cast("string"))
    d = li.groupBy(symbol.alias("symbol"), _month("l_shipdate").alias("bar")).agg(F.sum("l_extendedprice").alias("_v"), F.sum("l_quantity").alias("_q"), F.avg("l_discount").alias("_d"))
    d = d.select("symbol", "bar", F.round(F.col("_v") / F.col("_q"), 6).alias("px"), F.round((F.col("_d") - 0.05) * 0.05, 9).alias("rate_sum"))
    return d.withColumn("rate_px_sum", F.round(F.col("rate_sum") * F.col("px") * 1.001, 9))


def supplier_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Target weights of one portfolio per supplier at quarter starts, from what it ships; some short, some overgeared."""
    li = table(spark, sf, "lineitem").where(F.month("l_shipdate").isin(1, 4, 7, 10))
    symbol = F.concat(F.lit("S"), (F.col("l_partkey") % 8).cast("string"))
    q = li.groupBy("l_suppkey", _month("l_shipdate").alias("bar"), symbol.alias("symbol")).agg(F.sum("l_quantity").alias("q"))
    whole = Window.partitionBy("l_suppkey", "bar")  # eight symbols at most
    side = F.when(F.col("symbol").isin("S6", "S7"), -0.700314159265).otherwise(1.100271828182)
    gear = F.when(F.col("l_suppkey") % 10 == 0, 9).when(F.col("l_suppkey") % 10 == 5, 2).otherwise(1)
    return q.select(F.concat(F.lit("R"), F.col("l_suppkey").cast("string")).alias("run_id"), "bar", "symbol", (F.col("q") / F.sum("q").over(whole) * side * gear).alias("weight"))


def supplier_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of the supplier portfolios; every run spans all months."""
    li = table(spark, sf, "lineitem")
    span = li.agg(F.min(_month("l_shipdate")).alias("a"), F.max(_month("l_shipdate")).alias("b"))
    s = F.col("l_suppkey")
    return li.select("l_suppkey").distinct().select(
        F.concat(F.lit("R"), s.cast("string")).alias("run_id"), span.select("a").scalar().alias("first_bar"), span.select("b").scalar().alias("last_bar"), F.lit(1234567.891).alias("capital"),
        F.when(s % 10 == 5, 3000.487132909).otherwise(4.487132909).alias("fee_bps"), F.lit(1.0).alias("slippage_bps"), (1 + s % 2).cast("int").alias("lag"),
        F.when(s % 3 == 0, "disabled").when(s % 3 == 1, "period_start").otherwise("event_price").alias("funding"), F.lit(1.05).alias("max_leverage"))


def _month(c: str):
    return ((F.year(c) - 1990) * 12 + F.month(c) - 1).cast("int")


def records(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Experiments from orders. The parent of an order is the order with half its key: a tree of logarithmic depth.
    ``more`` are further columns made from the order."""
    o = table(spark, sf, "orders")
    key, cust, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    eid = lambda c: F.concat(F.lit("E"), F.lpad(c.cast("string"), 12, "0"))
    stage = {"1-URGENT": "out_of_sample", "2-HIGH": "in_sample", "3-MEDIUM": "robustness", "4-NOT SPECIFIED": "validation", "5-LOW": "exploratory"}
    pick = lambda c, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)
    days = lambda n: F.expr(f"INTERVAL {abs(n)} DAYS")
    dataset = F.struct(
        F.concat(F.lit("ds."), (cust % 20).cast("string")).alias("dataset_id"), F.when(cust % 2 == 1, "Binance").otherwise("Hyperliquid").alias("source_venue"),
        F.lit("ohlcv").alias("field_type"), F.when(cust % 2 == 1, "proxy").otherwise("native").alias("native_or_proxy"),
        F.when((cust % 2 == 1) & (cust % 3 != 0), "Hyperliquid").alias("proxy_for"), F.when(cust % 7 == 0, "v1").otherwise("v2").alias("processing_version"),
        (date - days(30)).alias("data_start"), (date + days(30)).alias("data_end"), (date - days(40)).alias("_early"),
        F.when(cust % 13 != 0, date - days(20)).alias("eval_start"), F.when(cust % 13 != 0, date + days(20)).alias("eval_end"),
        F.array(F.concat(F.lit("S"), (cust % 8).cast("string"))).alias("symbols"),
        F.when(cust % 5 != 0, F.sha2("o_orderpriority", 256)).alias("content_hash"), F.when(cust % 9 != 0, "sum-v1").alias("content_hash_method"),
    ).dropFields("_early")
    cp = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    return o.select(
        eid(key).alias("experiment_id"), F.when(key > 0, eid(F.floor(key / 2).cast("bigint"))).alias("parent_experiment_id"),
        cp(cust.cast("string"), "o_orderpriority").alias("semantic_hash"), cp(cust.cast("string"), "o_orderpriority", "o_orderstatus").alias("exact_hash"),
        cp(cust.cast("string")).alias("config_family_hash"), F.col("o_orderpriority").alias("strategy_name"),
        pick(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "FAILED", "P": "REJECTED"}).alias("status"),
        F.when((F.col("o_orderstatus") != "F") & (cust % 17 != 0), "given").alias("status_reason"), date.alias("created_at"),
        (date + F.make_dt_interval(secs=((cust % 3) * 2000).cast("decimal(18,6)"))).alias("logged_at"),
        pick(F.col("o_orderstatus"), {"F": "alpha_research", "O": "robustness", "P": "infrastructure"}).alias("experiment_type"),
        pick(F.col("o_orderpriority"), stage).alias("research_stage"), F.when(cust % 4 != 0, "H1").alias("hypothesis_id"),
        F.when(cust % 11 != 0, F.concat(F.lit("SS"), (cust % 50).cast("string"))).alias("search_space_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", (cust % 5).cast("int")).alias("n_configs_evaluated"),
        F.when(cust % 3 == 0, F.lit(None)).otherwise(cust % 3 == 1).alias("survivorship_safe"), (cust % 2 == 1).alias("uses_proxy_data"),
        F.when(cust % 6 == 0, "manual").otherwise("adapter").alias("recorded_via"), F.when(cust % 4 == 1, "because").alias("manual_results_justification"),
        F.when(cust % 10 != 0, "changed").alias("change_from_parent"), F.when(cust % 8 != 0, "spec.md").alias("frozen_spec_ref"),
        F.when(cust % 8 != 0, F.sha2((key % 3).cast("string"), 256)).alias("frozen_spec_blob_sha"), F.lit(None).cast("string").alias("no_datasets_reason"),
        F.array(dataset).alias("datasets"), F.col("o_totalprice").alias("total_price"), (F.col("o_totalprice") / 1e5).alias("sharpe"),
        F.create_map(F.lit("sharpe"), F.col("o_totalprice") / 1e5, F.lit("avg_turnover"), (cust % 100) / 100.0).alias("metrics"),
        (cust % 40).cast("int").alias("n_periods"), (cust % 12).cast("int").alias("rebalance_count"), (cust % 19 == 0).alias("ruined"),
        F.when(cust % 19 == 0, F.array(F.lit("RUINED"))).otherwise(F.array().cast("array<string>")).alias("result_warnings"),
        F.array(F.concat(F.lit("tag"), (cust % 30).cast("string"))).alias("tags"), F.array().cast("array<string>").alias("warnings"),
        F.array(F.struct(F.lit("curve").alias("name"), F.concat(F.lit("a/"), eid(key)).alias("path"), F.when(cust % 14 != 0, F.sha2(key.cast("string"), 256)).alias("sha256"))).alias("artifacts"),
        F.when(cust % 15 != 0, F.create_map(F.lit("funding_mode"), F.when(cust % 2 == 0, "disabled").otherwise("required"))).otherwise(F.create_map().cast("map<string,string>")).alias("backtest_config"),
        F.struct((cust % 21 == 0).alias("dirty_worktree"), (cust % 22 != 0).alias("git_available"), (cust % 23 == 0).cast("int").alias("untracked_code_files"), F.lit("v2").alias("data_processing_version")).alias("code"),
        F.lit("schema-1").alias("schema_version"), F.sha2(F.concat_ws("|", key.cast("string"), F.col("o_orderstatus")), 256).alias("record_sha256"), *more,
    )


_CHANGE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """The status changes of ``history`` with what orders those of one experiment in place of the number in the whole log:
    enough for the status of each experiment, and nothing has to be numbered for it."""
    return table(spark, sf, "lineitem").select(*_change_columns(F.struct(*[c for c in _CHANGE_ORDER if c != "l_orderkey"]).alias("seq")))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes from line items, numbered along the ship date: experiment_id, seq, at, event, to_status, reason."""
    li = table(spark, sf, "lineitem").select(*_CHANGE_ORDER, "l_returnflag", "l_linestatus")
    return with_position(li, [], _CHANGE_ORDER, time_block("l_shipdate", DAY_US), "seq").select(*_change_columns("seq"))


def _change_columns(seq: Column | str) -> list[Column | str]:
    to = F.when(F.col("l_returnflag") == "A", "COMPLETED").when(F.col("l_returnflag") == "N", "FAILED").otherwise("INVALID")
    return [
        F.concat(F.lit("E"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("experiment_id"), seq, F.col("l_shipdate").alias("at"),
        F.lit("status_change").alias("event"), F.lit(None).cast("string").alias("from_status"), to.alias("to_status"), F.col("l_linestatus").alias("reason"),
    ]


# --- the same views as SQL ------------------------------------------------------------------------------------

_BAR = """first(px ORDER BY timestamp, trade_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY timestamp, trade_id) AS close,
    sum(sz) AS volume, count(sz) AS trade_count, NOT (sum(sz) = 0 AND count(sz) = 0) AS native_traded"""

SQL_VIEWS = {
    "ticks": """SELECT event_type AS symbol, ts AS timestamp, event_id AS trade_id, value AS px,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS sz, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS venue FROM events""",
    "bars_1h": f"SELECT symbol, date_trunc('hour', t.timestamp) AS timestamp, {_BAR} FROM ticks t GROUP BY symbol, date_trunc('hour', t.timestamp)",
    "bars_1h_venue": f"SELECT venue, symbol, date_trunc('hour', t.timestamp) AS timestamp, {_BAR} FROM ticks t GROUP BY venue, symbol, date_trunc('hour', t.timestamp)",
    "funding_events": "SELECT symbol, timestamp, trade_id, (px - 50) / 1e6::DOUBLE AS funding_rate FROM ticks",
    "overlap_ab": """SELECT a.symbol, a.timestamp, a.open AS a_open, a.high AS a_high, a.low AS a_low, a.close AS a_close, a.volume AS a_volume,
    b.open AS b_open, b.high AS b_high, b.low AS b_low, b.close AS b_close, b.volume AS b_volume
    FROM bars_1h_venue a JOIN bars_1h_venue b ON a.symbol = b.symbol AND a.timestamp = b.timestamp WHERE a.venue = 'A' AND b.venue = 'B'""",
    "returns_ab": """SELECT *, a_close / nullif(lag(a_close) OVER w, 0) - 1 AS a_ret, b_close / nullif(lag(b_close) OVER w, 0) - 1 AS b_ret FROM overlap_ab
    WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)""",
    "monthly_prices": """SELECT 'S' || (l_partkey % 8) AS symbol, ((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1)::INT AS bar,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS px FROM lineitem GROUP BY 1, 2""",
    "coverage": """SELECT symbol, min(timestamp) AS coverage_start, max(timestamp) AS coverage_end, count(*) AS n_events FROM (
    SELECT symbol, timestamp, sum(opens) OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) AS island FROM (
    SELECT symbol, timestamp, trade_id, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) <= INTERVAL 90 MINUTE
    THEN 0 ELSE 1 END AS opens FROM ticks)) GROUP BY symbol, island""",
    # the serial ledger: one recursion step per period, state is NAV and a list of quantities in symbol order
    "serial": """SELECT run_id, path, first_bar - 1 AS bar, false AS rebalance, NULL::DOUBLE AS turnover, NULL::DOUBLE AS nav_pre, NULL::DOUBLE AS nav_after_cost, NULL::DOUBLE AS asset_pnl,
    NULL::DOUBLE AS funding_pnl, capital::DOUBLE AS nav_end, [0.0::DOUBLE for x in syms] AS q, [0.0::DOUBLE for x in syms] AS wpre, [0.0::DOUBLE for x in syms] AS w, [0.0::DOUBLE for x in syms] AS q_prev, [0.0::DOUBLE for x in syms] AS p, NULL::VARCHAR AS stage FROM rn, names
    UNION ALL SELECT run_id, path, bar, rebalance, turnover, nav_pre, nac, CASE WHEN nac > 0 THEN asset ELSE 'nan'::DOUBLE END, CASE WHEN nac > 0 THEN fund ELSE 'nan'::DOUBLE END,
    CASE WHEN nac <= 0 OR nac + asset + fund <= 0 THEN 0.0::DOUBLE ELSE nac + asset + fund END, CASE WHEN nac <= 0 THEN q_prev ELSE q2 END, wpre, w, q_prev, p,
    CASE WHEN nac <= 0 THEN 'cost' WHEN nac + asset + fund <= 0 THEN 'pnl' END FROM (
      SELECT *, list_sum(list_transform(range(1, len(p) + 1), lambda j: q2[j] * (p1[j] - p[j]))) AS asset,
      CASE funding WHEN 'period_start' THEN -list_sum(list_transform(range(1, len(p) + 1), lambda j: q2[j] * p[j] * f[j])) WHEN 'event_price' THEN -list_sum(list_transform(range(1, len(p) + 1), lambda j: q2[j] * g[j])) ELSE 0.0::DOUBLE END AS fund FROM (
        SELECT *, CASE WHEN rebalance THEN list_transform(range(1, len(p) + 1), lambda j: w[j] * nac / p[j]) ELSE q_prev END AS q2 FROM (
          SELECT *, nav_pre - turnover * nav_pre * (fee + slip) AS nac FROM (
            SELECT *, CASE WHEN rebalance THEN list_sum(list_transform(range(1, len(p) + 1), lambda j: abs(w[j] - wpre[j]))) ELSE 0.0::DOUBLE END AS turnover FROM (
              SELECT s.run_id, s.path, s.bar + 1 AS bar, s.nav_end AS nav_pre, s.q AS q_prev, m0.p AS p, m1.p AS p1, m0.f AS f, m0.g AS g, r.fee, r.slip, r.funding, t.w IS NOT NULL AS rebalance, t.w AS w,
              list_transform(range(1, len(m0.p) + 1), lambda j: s.q[j] * m0.p[j] / s.nav_end) AS wpre
              FROM serial s JOIN rn r ON r.run_id = s.run_id AND r.path = s.path JOIN mk m0 ON m0.bar = s.bar + 1 JOIN mk m1 ON m1.bar = s.bar + 2 LEFT JOIN tg t ON t.run_id = s.run_id AND t.begin = s.bar + 1
              WHERE s.stage IS NULL AND s.bar + 1 < r.last_bar)))))""",
    "led": "SELECT * FROM serial WHERE nav_pre IS NOT NULL",
    "curve": "SELECT run_id, path, bar + 1 AS bar, nav_end AS equity FROM serial",
    "perf": """SELECT *, CASE WHEN vol = 0 OR vol IS NULL THEN 'nan'::DOUBLE ELSE excess * 12 / vol END AS sharpe, CASE WHEN dd = 0 OR dd IS NULL THEN 'nan'::DOUBLE ELSE excess * 12 / dd END AS sortino,
    CASE WHEN mdd = 0 THEN 'nan'::DOUBLE ELSE cagr / abs(mdd) END AS calmar FROM (SELECT l.run_id, l.path, n, total_return, pow(grown, 12.0::DOUBLE / n) - 1 AS cagr, std * sqrt(12) AS vol, down * sqrt(12) AS dd, excess, mdd, avg_turnover FROM
    (SELECT run_id, path, count(*) AS n, stddev_samp(r) AS std, CASE WHEN count(*) >= 2 THEN sqrt(avg(least(r, 0) * least(r, 0))) END AS down, avg(r) AS excess, avg(turnover) AS avg_turnover
      FROM (SELECT *, CASE WHEN stage IS NOT NULL THEN -1.0::DOUBLE ELSE nav_end / nav_pre - 1 END AS r FROM led) GROUP BY ALL) l
    JOIN (SELECT run_id, path, last(equity ORDER BY bar) / first(equity ORDER BY bar) - 1 AS total_return, last(equity ORDER BY bar) / first(equity ORDER BY bar) AS grown, min(equity / peak - 1) AS mdd FROM (SELECT *, max(equity) OVER (PARTITION BY run_id, path ORDER BY bar) AS peak FROM curve) GROUP BY run_id, path) c
      ON l.run_id = c.run_id AND l.path = c.path)""",
    "mk": "SELECT bar, list(px ORDER BY symbol) AS p, list(rate_sum ORDER BY symbol) AS f, list(rate_px_sum ORDER BY symbol) AS g FROM market GROUP BY bar",
    "names": "SELECT list(symbol ORDER BY symbol) AS syms FROM (SELECT DISTINCT symbol FROM market)",
    "tg": """SELECT run_id, begin, list(weight ORDER BY symbol) AS w FROM (SELECT b.run_id, b.begin, s.symbol, coalesce(t.weight, 0.0::DOUBLE) AS weight FROM (SELECT DISTINCT t.run_id, t.bar, t.bar + r.lag AS begin FROM targets t JOIN rn r ON r.run_id = t.run_id
    WHERE t.bar >= r.first_bar AND t.bar + r.lag < r.last_bar) b CROSS JOIN (SELECT DISTINCT symbol FROM market) s LEFT JOIN targets t ON t.run_id = b.run_id AND t.bar = b.bar AND t.symbol = s.symbol) GROUP BY ALL""",
    # supplier portfolios: weights from what each supplier ships at quarter starts, some of them short or overgeared
    "market": """SELECT symbol, bar, px, rate_sum, round(rate_sum * px * 1.001::DOUBLE, 9) AS rate_px_sum FROM (SELECT 'S' || (l_partkey % 8) AS symbol, ((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1)::INT AS bar,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS px, round((avg(l_discount) - 0.05::DOUBLE) * 0.05::DOUBLE, 9) AS rate_sum FROM lineitem GROUP BY 1, 2)""",
    "targets": """SELECT run_id, bar, symbol, q / sum(q) OVER (PARTITION BY run_id, bar) * CASE WHEN symbol IN ('S6', 'S7') THEN -0.700314159265::DOUBLE ELSE 1.100271828182::DOUBLE END * CASE WHEN s % 10 = 0 THEN 9 WHEN s % 10 = 5 THEN 2 ELSE 1 END AS weight FROM (
    SELECT 'R' || l_suppkey AS run_id, l_suppkey AS s, ((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1)::INT AS bar, 'S' || (l_partkey % 8) AS symbol, sum(l_quantity) AS q FROM lineitem WHERE month(l_shipdate) IN (1, 4, 7, 10) GROUP BY ALL)""",
    "runs": """SELECT 'R' || s AS run_id, (SELECT min(bar) FROM market) AS first_bar, (SELECT max(bar) FROM market) AS last_bar, 1234567.891::DOUBLE AS capital, CASE WHEN s % 10 = 5 THEN 3000.487132909::DOUBLE ELSE 4.487132909::DOUBLE END AS fee_bps, 1.0::DOUBLE AS slippage_bps,
    (1 + s % 2)::INT AS lag, CASE s % 3 WHEN 0 THEN 'disabled' WHEN 1 THEN 'period_start' ELSE 'event_price' END AS funding, 1.05::DOUBLE AS max_leverage FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem)""",
    "rn": """SELECT run_id, path, first_bar, last_bar, capital, lag, CASE WHEN path = 'actual' THEN fee_bps / 10000 ELSE 0.0::DOUBLE END AS fee, CASE WHEN path = 'actual' THEN slippage_bps / 10000 ELSE 0.0::DOUBLE END AS slip,
    CASE WHEN path = 'actual' THEN funding ELSE 'disabled' END AS funding FROM (SELECT *, unnest(['actual', 'counterfactual']) AS path FROM runs)""",
    "records": """SELECT 'E' || lpad(o_orderkey::VARCHAR, 12, '0') AS experiment_id,
    CASE WHEN o_orderkey > 0 THEN 'E' || lpad((o_orderkey // 2)::VARCHAR, 12, '0') END AS parent_experiment_id,
    sha256(concat_ws('|', o_custkey::VARCHAR, o_orderpriority)) AS semantic_hash,
    sha256(concat_ws('|', o_custkey::VARCHAR, o_orderpriority, o_orderstatus)) AS exact_hash, sha256(o_custkey::VARCHAR) AS config_family_hash,
    o_orderpriority AS strategy_name, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'REJECTED' END AS status,
    CASE WHEN o_orderstatus <> 'F' AND o_custkey % 17 <> 0 THEN 'given' END AS status_reason,
    o_orderdate AS created_at, o_orderdate + to_seconds((o_custkey % 3) * 2000) AS logged_at,
    CASE o_orderstatus WHEN 'F' THEN 'alpha_research' WHEN 'O' THEN 'robustness' ELSE 'infrastructure' END AS experiment_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'out_of_sample' WHEN '2-HIGH' THEN 'in_sample' WHEN '3-MEDIUM' THEN 'robustness'
      WHEN '4-NOT SPECIFIED' THEN 'validation' ELSE 'exploratory' END AS research_stage,
    CASE WHEN o_custkey % 4 <> 0 THEN 'H1' END AS hypothesis_id, CASE WHEN o_custkey % 11 <> 0 THEN 'SS' || (o_custkey % 50) END AS search_space_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN (o_custkey % 5)::INT END AS n_configs_evaluated,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 = 1 END AS survivorship_safe, o_custkey % 2 = 1 AS uses_proxy_data,
    CASE WHEN o_custkey % 6 = 0 THEN 'manual' ELSE 'adapter' END AS recorded_via, CASE WHEN o_custkey % 4 = 1 THEN 'because' END AS manual_results_justification,
    CASE WHEN o_custkey % 10 <> 0 THEN 'changed' END AS change_from_parent, CASE WHEN o_custkey % 8 <> 0 THEN 'spec.md' END AS frozen_spec_ref,
    CASE WHEN o_custkey % 8 <> 0 THEN sha256((o_orderkey % 3)::VARCHAR) END AS frozen_spec_blob_sha,
    'ds.' || (o_custkey % 20) AS dataset_id, CASE WHEN o_custkey % 2 = 1 THEN 'Binance' ELSE 'Hyperliquid' END AS source_venue,
    CASE WHEN o_custkey % 2 = 1 THEN 'proxy' ELSE 'native' END AS native_or_proxy, CASE WHEN o_custkey % 2 = 1 AND o_custkey % 3 <> 0 THEN 'Hyperliquid' END AS proxy_for,
    CASE WHEN o_custkey % 7 = 0 THEN 'v1' ELSE 'v2' END AS processing_version, o_orderdate - INTERVAL 30 DAY AS data_start, o_orderdate + INTERVAL 30 DAY AS data_end,
    CASE WHEN o_custkey % 13 <> 0 THEN o_orderdate - INTERVAL 20 DAY END AS eval_start, CASE WHEN o_custkey % 13 <> 0 THEN o_orderdate + INTERVAL 20 DAY END AS eval_end,
    CASE WHEN o_custkey % 5 <> 0 THEN sha256(o_orderpriority) END AS content_hash, CASE WHEN o_custkey % 9 <> 0 THEN 'sum-v1' END AS content_hash_method,
    o_totalprice AS total_price, o_totalprice / 1e5::DOUBLE AS sharpe, o_custkey % 40 AS n_periods, o_custkey % 12 AS rebalance_count, o_custkey % 19 = 0 AS ruined,
    'tag' || (o_custkey % 30) AS tag, 'S' || (o_custkey % 8) AS dataset_symbol,
    CASE WHEN o_custkey % 14 <> 0 THEN sha256(o_orderkey::VARCHAR) END AS artifact_sha,
    CASE WHEN o_custkey % 15 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'disabled' ELSE 'required' END END AS funding_mode,
    o_custkey % 21 = 0 AS dirty_worktree, o_custkey % 22 <> 0 AS git_available, o_custkey % 23 = 0 AS untracked,
    sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus)) AS record_sha256, o_custkey AS cust, o_orderkey AS key FROM orders""",
    "history": """SELECT 'E' || lpad(l_orderkey::VARCHAR, 12, '0') AS experiment_id,
    row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_shipdate AS at,
    CASE l_returnflag WHEN 'A' THEN 'COMPLETED' WHEN 'N' THEN 'FAILED' ELSE 'INVALID' END AS to_status, l_linestatus AS reason FROM lineitem""",
    "folded": """SELECT r.*, coalesce(h.last_status, r.status) AS folded_status, CASE WHEN h.experiment_id IS NOT NULL THEN h.last_reason ELSE r.status_reason END AS folded_reason,
    coalesce(h.n, 0) AS n_status_changes, coalesce(h.ever_completed, false) OR r.status = 'COMPLETED' AS ever_completed,
    coalesce(h.ever_failed, false) OR r.status = 'FAILED' AS ever_failed, r.status = 'REJECTED' AS ever_rejected, coalesce(h.ever_invalid, false) AS ever_invalid
    FROM records r LEFT JOIN (SELECT experiment_id, last(to_status ORDER BY seq) AS last_status, last(reason ORDER BY seq) AS last_reason, count(*) AS n,
    bool_or(to_status = 'COMPLETED') AS ever_completed, bool_or(to_status = 'FAILED') AS ever_failed, bool_or(to_status = 'INVALID') AS ever_invalid
    FROM history GROUP BY experiment_id) h ON r.experiment_id = h.experiment_id""",
}

_NEEDS = {
    "bars_1h": ("ticks",), "bars_1h_venue": ("ticks",), "funding_events": ("ticks",), "overlap_ab": ("bars_1h_venue",), "returns_ab": ("overlap_ab",),
    "mk": ("market",), "names": ("market",), "targets": (), "runs": ("market",), "rn": ("runs",), "tg": ("targets", "rn", "market"), "serial": ("mk", "names", "tg", "rn"),
    "led": ("serial",), "curve": ("serial",), "perf": ("led", "curve"), "coverage": ("ticks",), "folded": ("records", "history"),
}


def with_views(sql: str, views: tuple[str, ...], **replace: str) -> str:
    """Prefix ``sql`` with the named views and the views those need. A leading WITH of the text is merged in.
    ``replace`` puts another text in place of a view."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({replace.get(name, SQL_VIEWS[name])})" for name in ordered)
    recursive = "RECURSIVE " if "serial" in ordered else ""
    body = sql.strip()
    upper = body.upper()
    if upper.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if upper.startswith("WITH "):
        return f"WITH {recursive}{head},\n{body[5:]}"
    return f"WITH {recursive}{head}\n{body}"
