"""Robustness of monthly portfolios: resampling, leave-one-out, best windows, market beta."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeledger.operators import robustness as R
from tapeledger.plans import views as V
from tapeledger.plans.registry import query
from tapeledger.session import cut_lineage

# Every supplier's monthly return, from what it ships: the sum of its symbols' price changes weighted by shipped value.
_PARTS_SQL = """px AS (SELECT symbol, bar, px / lag(px) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS ret FROM monthly_prices),
  shipped AS (SELECT 'R' || (l_suppkey % 50) AS run_id, 'S' || (l_partkey % 8) AS symbol, ((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1)::INT AS bar, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL),
  parts AS (SELECT run_id, symbol, bar, q / sum(q) OVER (PARTITION BY run_id, bar) * ret AS ret FROM shipped JOIN px USING (symbol, bar)),
  rets AS (SELECT run_id, bar, sum(ret) AS ret FROM parts WHERE ret IS NOT NULL GROUP BY ALL)"""


def parts(spark, sf):
    series = Window.partitionBy("symbol").orderBy("bar")  # one row per month
    px = V.monthly_prices(spark, sf).withColumn("ret", F.col("px") / F.lag("px").over(series) - 1)
    li = V.table(spark, sf, "lineitem")
    shipped = li.groupBy(F.concat(F.lit("R"), (F.col("l_suppkey") % 50).cast("string")).alias("run_id"), F.concat(F.lit("S"), (F.col("l_partkey") % 8).cast("string")).alias("symbol"), V._month("l_shipdate").alias("bar")).agg(F.sum("l_quantity").cast("double").alias("q"))
    rows = shipped.join(px.select("symbol", "bar", "ret"), on=["symbol", "bar"])
    d = rows.withColumn("ret", F.col("q") / F.sum("q").over(Window.partitionBy("run_id", "bar")) * F.col("ret")).where("ret is not null")  # eight symbols at most
    return cut_lineage(d.select("run_id", "symbol", "bar", "ret"), "return-parts")


def returns(spark, sf):
    return cut_lineage(parts(spark, sf).groupBy("run_id", "bar").agg(F.sum("ret").alias("ret")), "returns")


_BLOCKS_SQL = """b AS (SELECT run_id, (pos - 1) // 6 AS block_no, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY bar) AS pos FROM rets) GROUP BY ALL),
  k AS (SELECT run_id, count(*) AS blocks FROM b GROUP BY run_id),
  picks AS (SELECT run_id, draw, ('0x' || substr(md5('7:' || run_id || ':' || draw || ':' || block_no), 1, 12))::BIGINT % blocks AS block_no FROM b JOIN k USING (run_id), (SELECT unnest(range(40)) AS draw)),
  draws AS (SELECT run_id, draw, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM picks JOIN b USING (run_id, block_no) GROUP BY ALL),
  sharpes AS (SELECT run_id, draw, (s / n) * sqrt(12) / sqrt((ss - s * s / n) / (n - 1)) AS sharpe FROM draws)"""


@query("bootstrap_sharpe", f"WITH {_PARTS_SQL}, {_BLOCKS_SQL} SELECT run_id, draw, round(sharpe, 6) AS sharpe FROM sharpes", ("monthly_prices",))
def bootstrap_sharpe(spark, sf):
    """Forty resamples of each portfolio in blocks of half a year."""
    return R.bootstrap_sharpe(returns(spark, sf), ["run_id"], "bar", "ret", 6, 40, 12.0, 7).withColumn("sharpe", F.round("sharpe", 6))


@query("bootstrap_intervals", f"""WITH {_PARTS_SQL}, {_BLOCKS_SQL} SELECT run_id, count(sharpe) AS n_draws, round(avg(sharpe), 6) AS mean, round(quantile_cont(sharpe, 0.05::DOUBLE), 6) AS low, round(quantile_cont(sharpe, 0.95::DOUBLE), 6) AS high
  FROM sharpes GROUP BY run_id""", ("monthly_prices",))
def bootstrap_intervals(spark, sf):
    d = R.interval_estimates(R.bootstrap_sharpe(returns(spark, sf), ["run_id"], "bar", "ret", 6, 40, 12.0, 7), ["run_id"], "sharpe")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query("leave_one_out_metrics", f"""WITH {_PARTS_SQL}, m AS (SELECT DISTINCT run_id, symbol FROM parts WHERE ret IS NOT NULL), w AS (SELECT m.run_id, m.symbol AS left_out, r.bar, r.ret - coalesce(p.ret, 0.0::DOUBLE) AS ret
  FROM m JOIN rets r USING (run_id) LEFT JOIN parts p ON p.run_id = m.run_id AND p.symbol = m.symbol AND p.bar = r.bar)
  SELECT run_id, left_out, count(*) AS n, round(sum(ret), 8) AS total, round(avg(ret) * sqrt(12) / stddev_samp(ret), 6) AS sharpe FROM w GROUP BY ALL""", ("monthly_prices",))
def leave_one_out_metrics(spark, sf):
    """Every portfolio without each of its symbols."""
    d = R.return_summary(R.without_each(parts(spark, sf), ["run_id"], "symbol", "bar", "ret"), ["run_id", "left_out"], "ret", 12.0)
    return d.withColumns({"total": F.round("total", 8), "sharpe": F.round("sharpe", 6)})


_WINDOWS_SQL = """s AS (SELECT run_id, ret, row_number() OVER (PARTITION BY run_id ORDER BY bar) AS pos FROM rets),
  w AS (SELECT * FROM (SELECT run_id, pos, sum(ret) OVER f AS total, count(*) OVER f AS n FROM s WINDOW f AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3),
  l AS (SELECT run_id, list({pos: pos, total: total} ORDER BY total DESC, pos) AS ws FROM w GROUP BY run_id),
  greedy AS (SELECT run_id, 0 AS rank, ws, NULL::BIGINT AS pos, NULL::DOUBLE AS total FROM l
    UNION ALL SELECT run_id, rank + 1, list_filter(ws, lambda x: abs(x.pos - ws[1].pos) >= 3), ws[1].pos, ws[1].total FROM greedy WHERE rank < 4 AND len(ws) > 0),
  best AS (SELECT run_id, rank, pos, total FROM greedy WHERE rank > 0)"""


@query("best_windows", f"WITH RECURSIVE {_PARTS_SQL}, {_WINDOWS_SQL} SELECT run_id, rank, pos AS first_position, pos + 2 AS last_position, round(total, 8) AS total FROM best", ("monthly_prices",))
def best_windows(spark, sf):
    """The four best quarters of each portfolio that do not overlap; the SQL takes them one after another."""
    return R.best_windows(returns(spark, sf), ["run_id"], "bar", "ret", 3, 4).withColumn("total", F.round("total", 8))


@query("drop_best_windows", f"""WITH RECURSIVE {_PARTS_SQL}, {_WINDOWS_SQL} SELECT s.run_id, count(*) AS n, round(sum(ret), 8) AS total, round(avg(ret) * sqrt(12) / stddev_samp(ret), 6) AS sharpe, (SELECT 3 * count(*) FROM best b WHERE b.run_id = s.run_id) AS n_removed
  FROM s WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.run_id = s.run_id AND s.pos BETWEEN b.pos AND b.pos + 2) GROUP BY s.run_id""", ("monthly_prices",))
def drop_best_windows(spark, sf):
    d = R.drop_best_windows(returns(spark, sf), ["run_id"], "bar", "ret", 3, 4, 12.0)
    return d.withColumns({"total": F.round("total", 8), "sharpe": F.round("sharpe", 6)})


@query("market_beta", f"""WITH {_PARTS_SQL}, m AS (SELECT bar, avg(ret) AS m FROM px WHERE ret IS NOT NULL GROUP BY bar) SELECT run_id, count(*) AS n, round(covar_pop(ret, m) / var_pop(m), 6) AS beta,
  round(avg(ret) - covar_pop(ret, m) / var_pop(m) * avg(m), 8) AS alpha, round(corr(ret, m), 6) AS correlation FROM rets JOIN m USING (bar) GROUP BY run_id""", ("monthly_prices",))
def market_beta(spark, sf):
    """Portfolios against the equally weighted market of all symbols."""
    series = Window.partitionBy("symbol").orderBy("bar")
    px = V.monthly_prices(spark, sf).withColumn("ret", F.col("px") / F.lag("px").over(series) - 1)
    d = R.market_beta(returns(spark, sf), px.where("ret is not null").groupBy("bar").agg(F.avg("ret").alias("m")), ["run_id"], "bar", "ret", "m")
    return d.withColumns({"beta": F.round("beta", 6), "alpha": F.round("alpha", 8), "correlation": F.round("correlation", 6)})
