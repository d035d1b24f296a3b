"""Further operators: interval joins, drift, screening, overlays, attribution, gates, models on text and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.functions.expr import correlation, rank_pct, rolling, row_in, share_of, size_of, zfill
from tidemark.operators import evaluate, features, gates, joins, labels, models, portfolio, text, text_heads
from tidemark.plans.eval_queries import _DAILY, _ICS, _LONG, FACTORS, PROBS, factor_ics, pnl, probs, signals
from tidemark.plans.panel_queries import SNAPSHOTS, by_date, labeled, returns, snapshots
from tidemark.plans.registry import CALENDAR, FILINGS, LABELS, PANEL, RETURNS, SECTORS, query, r6, rank_sql
from tidemark.sources.panel import filings, panel_week, read, sectors
from tidemark.sources.stages import written
from tidemark.streaming.observations import settle

_TOP10 = "top AS (SELECT date, entity, ret_4, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) AS place FROM rets WHERE ret_4 IS NOT NULL QUALIFY place <= 10)"


def top10(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.top_k(returns(spark, d), "ret_4", ["date"], 10, "entity")


@query(
    f"""WITH {PANEL}, {SNAPSHOTS}, {CALENDAR}, q AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS i FROM (SELECT DISTINCT snapshot FROM snaps)), g AS (SELECT entity, snapshot, i - row_number() OVER (PARTITION BY entity ORDER BY i) AS island FROM snaps JOIN q USING (snapshot)),
t AS (SELECT entity, min(snapshot) AS a, max(snapshot) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS b FROM g GROUP BY entity, island)
SELECT c.date, count(t.entity) AS members FROM calendar c LEFT JOIN t ON c.date BETWEEN t.a AND t.b GROUP BY c.date"""
)
def scd2_interval_join(spark, d):
    s = snapshots(spark, d)
    island = F.col("session") - row_in(["session"], ["entity"])
    spans = s.join(joins.calendar(s, "snapshot"), "snapshot").withColumn("island", island).groupBy("entity", "island").agg(F.min("snapshot").alias("a"), F.date_sub(F.add_months(F.max("snapshot"), 3), 1).alias("b"))
    # Sessions are a calendar; each span reaches the sessions of its months, so the join is by month and then exact.
    months = spans.withColumn("month", F.explode(F.expr("sequence(trunc(a, 'MM'), trunc(b, 'MM'), interval 1 month)")))
    c = joins.calendar(panel_week(spark, d)).withColumn("month", F.trunc("date", "MM"))
    hit = c.join(months, "month").where("date between a and b").groupBy("date").agg(F.count("*").alias("members"))
    return c.select("date").join(hit, "date", "left").select("date", F.coalesce("members", F.lit(0)).alias("members"))


@query(f"WITH {SECTORS} SELECT entity, " + ", ".join(f"CAST(sector = '{s}' AS INT) AS is_{s.split()[0].lower()}" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM sectors")
def one_hot(spark, d):
    names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    return sectors(spark, d).select("entity", *((F.col("sector") == s).cast("int").alias(f"is_{s.split()[0].lower()}") for s in names))


@query(
    f"""WITH {LABELS}, {SECTORS}, v AS (SELECT date, entity, ret_4 - avg(ret_4) OVER g AS x, label - avg(label) OVER g AS label FROM labeled JOIN sectors USING (entity) WHERE ret_4 IS NOT NULL AND label IS NOT NULL WINDOW g AS (PARTITION BY date, sector)),
r AS (SELECT date, {rank_sql('x', 'date')} AS a, {rank_sql('label', 'date')} AS b FROM (SELECT date, round(x, 12) AS x, round(label, 12) AS label FROM v))
SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) AS neutral_ic FROM r GROUP BY date"""
)
def neutral_ic(spark, d):
    g = Window.partitionBy("date", "sector")
    v = labeled(spark, d).where("ret_4 is not null and label is not null").join(sectors(spark, d), "entity")
    v = v.select("date", F.round(F.col("ret_4") - F.avg("ret_4").over(g), 12).alias("x"), F.round(F.col("label") - F.avg("label").over(g), 12).alias("y"))
    return evaluate.rank_ic(v, "x", "y", ["date"], 5).select("date", "n", F.round("ic", 6).alias("neutral_ic"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS}, y AS (SELECT factor, year(date) AS year, avg(ic) AS m FROM ics GROUP BY ALL)
SELECT factor, round(avg(m), 6) AS mean_year, round(min(m), 6) AS worst_year, round(avg(CAST(round(m, 9) > 0 AS DOUBLE)), 6) AS positive_years, min(m) > -0.05 AND avg(m) > 0 AS passes FROM y GROUP BY 1"""
)
def signal_screening(spark, d):
    y = factor_ics(spark, d).groupBy("factor", F.year("date").alias("year")).agg(F.avg("ic").alias("m"))
    return y.groupBy("factor").agg(
        F.round(F.avg("m"), 6).alias("mean_year"), F.round(F.min("m"), 6).alias("worst_year"), F.round(share_of(F.round("m", 9) > 0), 6).alias("positive_years"), ((F.min("m") > -0.05) & (F.avg("m") > 0)).alias("passes")
    )


@query(
    f"""WITH {LABELS}, v AS (SELECT entity, date, CASE WHEN label IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY label NULLS LAST, entity) / count(label) OVER (PARTITION BY date) END AS p FROM labeled)
SELECT entity, date, CASE WHEN p > 0.9 THEN 4 WHEN p > 0.8 THEN 3 WHEN p > 0.6 THEN 2 WHEN p > 0.4 THEN 1 ELSE 0 END AS relevance FROM v"""
)
def tail_relevance(spark, d):
    return labels.tail_relevance(labeled(spark, d), "label", ["date"], "entity").select("entity", "date", "relevance")


@query(f"WITH {RETURNS}, {SECTORS}, r AS (SELECT entity, date, sector, {rank_sql('ret_4', 'date, sector')} AS r FROM rets JOIN sectors USING (entity)) SELECT entity, date, round(r - avg(r) OVER (PARTITION BY date, sector), 6) AS centered FROM r")
def sector_rank_centered(spark, d):
    r = returns(spark, d).join(sectors(spark, d), "entity").withColumn("r", rank_pct("ret_4", ["date", "sector"]))
    return r.select("entity", "date", F.round(F.col("r") - F.avg("r").over(Window.partitionBy("date", "sector")), 6).alias("centered"))


@query(f"WITH {LABELS} SELECT year(date) AS year, count(*) AS n, round(sum(0.5 ** (date_diff('day', date, DATE '1999-01-01') / 365.25 / 2.0)), 4) AS weight FROM labeled WHERE label IS NOT NULL GROUP BY 1")
def recency_weights(spark, d):
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("date")) / 365.25
    return labeled(spark, d).where("label is not null").groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.pow(F.lit(0.5), age / 2.0)), 4).alias("weight"))


@query(
    f"""WITH {PANEL}, c AS (SELECT * REPLACE (CASE WHEN (entity * 31 + day(date)) % 13 = 0 THEN 0 ELSE volume END AS volume), lpad(CAST(entity * 7919 * 3 % 1000000 AS VARCHAR), 6, '0') AS code, CASE WHEN entity % 5 = 0 THEN 'ST' ELSE '' END AS name FROM panel),
l AS (SELECT *, 4 * CASE WHEN name = 'ST' THEN 0.05 WHEN code[1:3] IN ('300', '301') THEN 0.1 WHEN code[1:3] = '688' THEN 0.2 WHEN code[1] IN ('4', '8') OR code[1:2] = '92' THEN 0.3 ELSE 0.1 END AS lim FROM c),
e AS (SELECT *, lead(date, 1) OVER w AS entry_date, lead(open, 1) OVER w AS eo, lead(volume, 1) OVER w AS ev, lead(open, 3) OVER w AS xo, lead(volume, 3) OVER w AS xv, lead(date, 3) OVER w AS xd, lead(close, 2) OVER w AS ref, lead(open, 4) OVER w AS lo, lead(volume, 4) OVER w AS lv, lead(date, 4) OVER w AS ld
 FROM l WINDOW w AS (PARTITION BY entity ORDER BY date)),
f AS (SELECT *, coalesce(eo / close - 1 >= lim * 0.995, false) AS entry_limit_up, coalesce(xo / ref - 1 <= -lim * 0.995, false) AS exit_limit_down FROM e),
g AS (SELECT *, eo IS NOT NULL AND coalesce(ev > 0, false) AND NOT entry_limit_up AS entry_tradable, xo IS NOT NULL AND coalesce(xv > 0, false) AND NOT exit_limit_down AS normal FROM f)
SELECT entity, date, entry_date, entry_limit_up, entry_tradable, exit_limit_down, NOT normal AND lo IS NOT NULL AND coalesce(lv > 0, false) AS exit_deferred, CASE WHEN normal THEN xd ELSE ld END AS execution_exit_date,
 round(CASE WHEN entry_tradable THEN CASE WHEN normal THEN xo ELSE lo END / eo - 1 END, 6) AS execution_return FROM g"""
)
def execution_columns(spark, d):
    e = F.col("entity")
    p = panel_week(spark, d).withColumn("volume", F.when((e * 31 + F.dayofmonth("date")) % 13 == 0, 0).otherwise(F.col("volume")))
    limit = 4 * market.price_limit(zfill(e * 7919 * 3 % 1000000, 6), F.when(e % 5 == 0, "ST").otherwise(""), F.col("date"))  # weeks, not days
    out = portfolio.execution(p, 2, limit)
    return out.select("entity", "date", "entry_date", "entry_limit_up", "entry_tradable", "exit_limit_down", "exit_deferred", "execution_exit_date", *r6("execution_return"))


@query(
    f"""WITH {LABELS}, {SECTORS}, v AS (SELECT entity, date, label, label - avg(label) OVER (PARTITION BY date, sector) AS alpha, 0.002 + 0.003 * (1 - {rank_sql('amount', 'date')}) AS cost FROM labeled JOIN sectors USING (entity))
SELECT entity, date, round(alpha, 6) AS industry_alpha, round(alpha - cost, 6) AS net_target, round({rank_sql('label', 'date')}, 6) AS return_rank FROM v"""
)
def research_targets(spark, d):
    v = labeled(spark, d).join(sectors(spark, d), "entity").withColumn("alpha", F.col("label") - F.avg("label").over(Window.partitionBy("date", "sector")))
    cost = 0.002 + 0.003 * (1 - rank_pct("amount", ["date"]))
    return v.select("entity", "date", F.round("alpha", 6).alias("industry_alpha"), F.round(F.col("alpha") - cost, 6).alias("net_target"), F.round(rank_pct("label", ["date"]), 6).alias("return_rank"))


@query(
    f"""WITH {LABELS}, b AS (SELECT *, avg(ret_1) OVER (PARTITION BY date) AS market FROM labeled), r AS (SELECT *, count(ret_1 * market) OVER w AS k, avg(ret_1 * market) OVER w AS xy, avg(ret_1) OVER w AS y, avg(market) OVER w AS x, avg(market * market) OVER w AS xx,
 CASE WHEN count(ret_1) OVER w >= 20 THEN stddev_samp(ret_1) OVER w END AS vol, CASE WHEN entity % 9 > 0 THEN amount END AS benchmark_weight FROM b WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING)),
v AS (SELECT *, CASE WHEN k >= 20 THEN (xy - x * y) / nullif(round(xx - x * x, 12), 0) END AS beta, coalesce(sum(coalesce(label, 0) * greatest(coalesce(benchmark_weight, 0), 0)) OVER d / nullif(sum(greatest(coalesce(benchmark_weight, 0), 0)) OVER d, 0), avg(label) OVER d) AS future,
 quantile_cont(label, 0.05) OVER d AS lo, quantile_cont(label, 0.95) OVER d AS hi FROM r WINDOW d AS (PARTITION BY date)),
t AS (SELECT *, round(label - beta * future, 9) AS rest, round(CASE WHEN vol IS NOT NULL THEN label / greatest(abs(vol), 1e-6) END, 9) AS scaled FROM v)
SELECT entity, date, round({rank_sql('rest', 'date')}, 6) AS beta_residual, round({rank_sql('scaled', 'date')}, 6) AS vol_adjusted, round(CASE WHEN label IS NOT NULL THEN greatest(lo, least(hi, label)) END, 6) AS robust_winsor FROM t"""
)
def nextgen_labels(spark, d):
    v = labeled(spark, d).withColumn("market", F.avg("ret_1").over(Window.partitionBy("date")))
    v = features.rolling_beta(v, "ret_1", "market", 20, "beta").withColumn("vol", rolling(F.stddev_samp("ret_1"), "ret_1", ["entity"], "date", 20))
    v = v.withColumn("benchmark_weight", F.when(F.col("entity") % 9 > 0, F.col("amount")))
    return labels.nextgen(v, "label", "beta", "vol", "benchmark_weight").select("entity", "date", *r6("beta_residual", "vol_adjusted", "robust_winsor"))


@query(
    f"""WITH {_DAILY}, v AS (SELECT date, r, stddev_samp(r) OVER w AS s, count(r) OVER w AS n FROM pnl WINDOW w AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING))
SELECT date, round(CASE WHEN n >= 8 THEN least(1, 0.05 / nullif(s, 0)) ELSE 1 END, 5) AS exposure, round(r * CASE WHEN n >= 8 THEN least(1, 0.05 / nullif(s, 0)) ELSE 1 END, 6) AS r FROM v"""
)
def volatility_target(spark, d):
    w = Window.orderBy("date").rowsBetween(-13, -1)  # a row per date
    v = pnl(spark, d).withColumns({"s": F.stddev_samp("r").over(w), "n": F.count("r").over(w)})
    e = F.when(F.col("n") >= 8, F.least(F.lit(1.0), F.try_divide(F.lit(0.05), F.nullif("s", F.lit(0.0))))).otherwise(1.0)
    return v.select("date", F.round(e, 5).alias("exposure"), F.round(F.col("r") * e, 6).alias("r"))


@query(
    f"""WITH {RETURNS}, b AS (SELECT date, avg(CASE WHEN volume >= 20 THEN ret_12 / 10 END) AS m, avg(CASE WHEN volume >= 20 THEN coalesce(ret_4 > 0, false)::INT END) AS breadth FROM rets GROUP BY date)
SELECT date, round(m, 6) AS momentum, round(breadth, 6) AS breadth, CASE WHEN m > 0.02 AND breadth > 0.55 THEN 'risk_on' WHEN m < -0.02 AND breadth < 0.45 THEN 'risk_off' ELSE 'neutral' END AS regime FROM b"""
)
def market_regime(spark, d):
    rows = returns(spark, d).withColumn("m", F.col("ret_12") / 10)
    return gates.market_regime(rows, "m", "ret_4", F.col("volume") >= 20).select("date", *r6("momentum", "breadth"), "regime")


@query(
    f"""WITH {PANEL}, {CALENDAR}, w AS (SELECT entity, session, close, CASE WHEN volume >= 5 THEN amount ELSE 0 END / nullif(sum(CASE WHEN volume >= 5 THEN amount ELSE 0 END) OVER (PARTITION BY date), 0) AS w FROM panel JOIN calendar USING (date)),
p AS (SELECT a.session, sum(CASE WHEN b.close > 0 THEN (a.close / b.close - 1) / 20 * b.w END) AS s, sum(CASE WHEN b.close > 0 THEN b.w ELSE 0 END) AS c FROM w a JOIN w b ON b.entity = a.entity AND b.session = a.session - 1 GROUP BY 1),
r AS (SELECT date, session, CASE WHEN date IN (SELECT date FROM panel) THEN coalesce(c, 0) END AS c, CASE WHEN c >= 0.3 THEN s / c END AS r FROM calendar LEFT JOIN p USING (session)),
m AS (SELECT *, CASE WHEN count(r) OVER k = 6 THEN product(1 + r) OVER k - 1 END AS m FROM r WINDOW k AS (ORDER BY session ROWS 5 PRECEDING)), g AS (SELECT *, CASE WHEN m > 0.02 THEN 'bull' WHEN m < -0.02 THEN 'bear' WHEN m IS NOT NULL THEN 'neutral' END AS regime FROM m)
SELECT date, round(r, 6) AS market_return, round(c, 6) AS covered_weight, round(m, 6) AS market_momentum, regime, CASE regime WHEN 'bull' THEN 0.5 WHEN 'neutral' THEN 0.65 WHEN 'bear' THEN 0.8 END::DOUBLE AS weight FROM g"""
)
def market_timing(spark, d):
    """The market's momentum over six weeks from members traded in consecutive ones (twentieths of weekly moves), and the exposure it asks for."""
    p = panel_week(spark, d)
    # Closes whose relative moves are a twentieth: c_t / c_(t-1) - 1 of the index of moves.
    w = Window.partitionBy("entity").orderBy("date")
    chained = p.withColumn("move", F.coalesce(1 + (F.col("close") / F.lag("close").over(w) - 1) / 20, F.lit(1.0)))
    level = chained.withColumn("close", F.product("move").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = level.select("entity", "date", "close", F.col("amount").alias("benchmark_weight"), (F.col("volume") >= 5).alias("in_universe"))
    out = gates.market_timing(rows, joins.calendar(p), 6, 0.3)
    return out.select("date", *r6("market_return", "covered_weight", "market_momentum"), "regime", "weight")


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS}, y AS (SELECT factor, year(date) AS year, avg(ic) AS ic, median(ic) AS middle, avg(ic) - 0.5 * stddev_samp(ic) / sqrt(count(ic)) AS low FROM ics WHERE year(date) IN (1996, 1997) GROUP BY ALL),
g AS (SELECT factor, count(*) AS years, count(*) FILTER (ic IS NOT NULL AND middle IS NOT NULL AND low IS NOT NULL) AS known, count(*) FILTER (ic > 0 AND middle > 0 AND low > 0) AS good, avg(ic) > 0 AS a, avg(middle) > 0 AS b, avg(low) > 0 AS c FROM y GROUP BY 1)
SELECT factor, CASE WHEN years = 2 THEN CASE WHEN known < 2 THEN 0 WHEN good = 2 AND a AND b AND c THEN 1 WHEN good >= 1 AND a AND b AND c THEN 0.5 WHEN a OR b OR c THEN 0.25 ELSE 0 END END::DOUBLE AS confidence FROM g"""
)
def confidence_tiers(spark, d):
    """Confidence in each factor from its mean, median and lower bound in two validation years."""
    y = factor_ics(spark, d).where(F.year("date").isin(1996, 1997)).groupBy("factor", F.year("date").alias("year"))
    y = y.agg(F.avg("ic").alias("ic"), F.percentile("ic", 0.5).alias("middle"), gates.lower_bound("ic", 0.5).alias("low"))  # a value per date
    return gates.confidence_from_years(y, "factor", "year", ["ic", "middle", "low"])


@query(
    f"""WITH {RETURNS}, {_TOP10}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM top)), h AS (SELECT entity, session, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM top JOIN c USING (date)),
x AS (SELECT entity, session + k AS session, w / 3 AS w FROM h, (SELECT unnest([0, 1, 2]) AS k))
SELECT date, entity, round(sum(w), 6) AS weight FROM x JOIN c USING (session) GROUP BY ALL"""
)
def staggered_sleeves(spark, d):
    t = top10(spark, d)
    held = portfolio.weighted(t, "equal", "date").select("date", "entity", "weight")
    return portfolio.sleeves(held, joins.calendar(held), 3).select("date", "entity", *r6("weight"))


@query(
    f"""WITH {RETURNS}, {_TOP10}, a AS (SELECT entity, date, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) AS place FROM rets WHERE ret_4 IS NOT NULL), c AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM top)),
e AS (SELECT t.entity, n.date, a.place FROM top t JOIN c USING (date) JOIN c n ON n.session = c.session + 1 LEFT JOIN a ON a.entity = t.entity AND a.date = n.date WHERE a.place IS NULL OR a.place > 10)
SELECT CASE WHEN place IS NULL THEN 'absent' WHEN place <= 15 THEN 'near_cutoff' ELSE 'ranking' END AS reason, count(*) AS exits FROM e GROUP BY 1"""
)
def turnover_decomposition(spark, d):
    ranked = returns(spark, d).where("ret_4 is not null").withColumn("place", row_in([F.desc("ret_4"), "entity"], ["date"])).select("entity", "date", "place")
    c = joins.calendar(ranked)
    now = ranked.join(c, "date")
    due = now.where("place <= 10").select("entity", (F.col("session") + 1).alias("session")).join(c.select("session"), "session")
    out = due.join(now.select("entity", "session", "place"), ["entity", "session"], "left").where("place is null or place > 10")
    return out.groupBy(F.when(F.col("place").isNull(), "absent").when(F.col("place") <= 15, "near_cutoff").otherwise("ranking").alias("reason")).agg(F.count("*").alias("exits"))


@query(
    f"""WITH {LABELS}, {SECTORS}, v AS (SELECT date, sector, label, (row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) <= 10)::INT AS held FROM labeled JOIN sectors USING (entity) WHERE ret_4 IS NOT NULL AND label IS NOT NULL),
w AS (SELECT *, held / sum(held) OVER (PARTITION BY date) - 1.0 / count(*) OVER (PARTITION BY date) AS active FROM v)
SELECT sector, round(sum(active * label), 6) AS active_return, round(avg(CASE WHEN active > 0 THEN label END), 6) AS overweight_mean, round(avg(CASE WHEN active <= 0 THEN label END), 6) AS other_mean FROM w GROUP BY sector"""
)
def active_weight_attribution(spark, d):
    day = Window.partitionBy("date")
    v = labeled(spark, d).where("ret_4 is not null and label is not null").join(sectors(spark, d), "entity").withColumn("held", (row_in([F.desc("ret_4"), "entity"], ["date"]) <= 10).cast("int"))
    w = v.withColumn("active", F.col("held") / F.sum("held").over(day) - F.lit(1.0) / F.count("*").over(day))
    return w.groupBy("sector").agg(F.round(F.sum(F.col("active") * F.col("label")), 6).alias("active_return"), F.round(F.avg(F.when(F.col("active") > 0, F.col("label"))), 6).alias("overweight_mean"), F.round(F.avg(F.when(F.col("active") <= 0, F.col("label"))), 6).alias("other_mean"))


@query(
    f"""WITH {PANEL}, {CALENDAR} SELECT 'duplicate_key' AS rule, (SELECT count(*) - count(DISTINCT (entity, date)) FROM panel) AS violations UNION ALL SELECT 'high_below_low', count(*) FROM panel WHERE high < low
UNION ALL SELECT 'close_outside', count(*) FROM panel WHERE close > high OR close < low UNION ALL SELECT 'calendar_gap', count(*) FROM (SELECT date - lag(date) OVER (ORDER BY date) AS g FROM calendar) WHERE g > 7"""
)
def output_audit(spark, d):
    p = panel_week(spark, d)
    rules = p.agg(
        (F.count("*") - F.countDistinct("entity", "date")).alias("duplicate_key"), F.count(F.when(F.col("high") < F.col("low"), 1)).alias("high_below_low"), F.count(F.when((F.col("close") > F.col("high")) | (F.col("close") < F.col("low")), 1)).alias("close_outside")
    )
    gaps = joins.calendar(p).withColumn("g", F.datediff("date", F.lag("date").over(Window.orderBy("date")))).agg(F.count(F.when(F.col("g") > 7, 1)).alias("calendar_gap"))
    names = ["duplicate_key", "high_below_low", "close_outside", "calendar_gap"]
    return rules.crossJoin(gaps).unpivot([], names, "rule", "violations")  # one row each


def _ic_of(target: str, where: str, name: str) -> str:
    """A CTE of the daily rank correlation of the score with a target."""
    return f"""{name} AS (SELECT date, CASE WHEN count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y) THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS ic
 FROM (SELECT date, {rank_sql('score', 'date')} AS x, {rank_sql(target, 'date')} AS y FROM src WHERE score IS NOT NULL AND {target} IS NOT NULL AND {where}) GROUP BY date)"""


def _best_of(c: str) -> str:
    return f"{c} IS NOT NULL AND round(row_number() OVER (PARTITION BY date, sector ORDER BY {c} NULLS LAST, entity) / count({c}) OVER (PARTITION BY date, sector), 9) > 0.8"


def _curve(score: str, name: str) -> str:
    """CTEs of the periods of the ten best by a score: {name} has period and benchmark return, turnover and cost."""
    return f"""{name}p AS (SELECT date, entity, near / 2000 AS r FROM src WHERE {score} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY {score} DESC, entity) <= 10), {name}d AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM {name}p)),
{name}w AS (SELECT n, entity, 1.0 / count(*) OVER (PARTITION BY n) AS w FROM {name}p JOIN {name}d USING (date)), {name}m AS (SELECT coalesce(a.n, b.n + 1) AS n, sum(greatest(coalesce(a.w, 0) - coalesce(b.w, 0), 0)) AS bought, sum(greatest(coalesce(b.w, 0) - coalesce(a.w, 0), 0)) AS sold FROM {name}w a FULL JOIN {name}w b ON a.entity = b.entity AND a.n = b.n + 1 GROUP BY 1),
{name} AS (SELECT date, coalesce(avg(r), 0) AS p, any_value(b) AS b, any_value(bought + sold) / 2 AS turnover, any_value(bought * 0.0005 + sold * 0.0015) AS cost FROM {name}p JOIN {name}d USING (date) JOIN {name}m USING (n) JOIN (SELECT date, coalesce(avg(near / 2000), 0) AS b FROM src GROUP BY date) USING (date) GROUP BY date)"""


@query(
    f"""WITH {LABELS}, {SECTORS}, src AS (SELECT entity, date, sector, ret_4 AS score, ret_12 AS other, label AS near, lead(open, 7) OVER (PARTITION BY entity ORDER BY date) / lead(open, 1) OVER (PARTITION BY entity ORDER BY date) - 1 AS far, volume FROM labeled JOIN sectors USING (entity) QUALIFY volume >= 5),
{_ic_of('near', 'true', 'ia')}, {_ic_of('far', 'true', 'ib')}, {_ic_of('near', "sector = 'ASIA'", 'ic')}, yr AS (SELECT count(*) FILTER (round(m, 12) > 0) AS y FROM (SELECT avg(ic) AS m FROM ia GROUP BY year(date))),
cells AS (SELECT * FROM src QUALIFY count(*) OVER (PARTITION BY date, sector) >= 10), marked AS (SELECT *, {_best_of('score')} AS top, {_best_of('near')} AS truth FROM cells),
sp AS (SELECT date, avg(CASE WHEN top THEN near END) - avg(CASE WHEN NOT top THEN near END) AS a, avg(CASE WHEN top THEN far END) - avg(CASE WHEN NOT top THEN far END) AS b, avg(CASE WHEN top AND near IS NOT NULL THEN truth::INT END) - (1 - 0.8) AS c FROM marked GROUP BY date, sector),
sd AS (SELECT date, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM sp GROUP BY date), sy AS (SELECT count(*) FILTER (round(m, 12) > 0) AS y FROM (SELECT avg(a) AS m FROM sd GROUP BY year(date))),
{_curve('score', 'cand')}, {_curve('other', 'ctrl')}, act AS (SELECT *, product(1 + p) OVER w / product(1 + b) OVER w AS active FROM cand WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), dn AS (SELECT *, active / max(active) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM act),
cy AS (SELECT count(*) FILTER (round(e, 12) > 0) AS y FROM (SELECT product(1 + p) - product(1 + b) AS e FROM cand GROUP BY year(date))), cs AS (SELECT product(1 + p) - product(1 + b) AS excess, min(down) AS down, stddev_samp(p - b) * sqrt(12.6) AS te, avg(turnover) AS t, avg(cost) AS c FROM dn), ct AS (SELECT avg(turnover) AS t, avg(cost) AS c FROM ctrl),
v AS (SELECT 'ranking' AS gate, 'mean_near_ic' AS measure, (SELECT avg(ic) FROM ia)::DOUBLE AS value, (SELECT avg(ic) FROM ia) > 0 AS passed UNION ALL SELECT 'ranking', 'mean_far_ic', (SELECT avg(ic) FROM ib), (SELECT avg(ic) FROM ib) > 0 UNION ALL SELECT 'ranking', 'positive_near_years', (SELECT y FROM yr), (SELECT y FROM yr) >= 4 UNION ALL SELECT 'ranking', 'group_near_ic', (SELECT avg(ic) FROM ic), (SELECT avg(ic) FROM ic) >= 0
UNION ALL SELECT 'selection', 'mean_near_spread', avg(a), avg(a) > 0 FROM sd UNION ALL SELECT 'selection', 'mean_far_spread', avg(b), avg(b) > 0 FROM sd UNION ALL SELECT 'selection', 'positive_near_years', y, y >= 4 FROM sy UNION ALL SELECT 'selection', 'precision_lift', avg(c), avg(c) > 0 FROM sd
UNION ALL SELECT 'conversion', 'excess_return', excess, excess > 0 FROM cs UNION ALL SELECT 'conversion', 'positive_excess_years', y, y >= 4 FROM cy UNION ALL SELECT 'conversion', 'active_max_drawdown', down, down >= -0.1 FROM cs UNION ALL SELECT 'conversion', 'tracking_error', te, te <= 0.06 FROM cs
UNION ALL SELECT 'conversion', 'average_turnover', cs.t, round(cs.t - ct.t, 12) <= 0 FROM cs, ct UNION ALL SELECT 'conversion', 'average_cost', cs.c, round(cs.c - ct.c, 12) <= 0 FROM cs, ct)
SELECT gate, measure, round(value, 5) AS value, coalesce(passed, false) AS passed FROM v"""
)
def three_gates(spark, d):
    """Whether a score ranks, whether its best are better, and whether a portfolio of them beats its market at no more turnover or cost than another score's."""
    w = Window.partitionBy("entity").orderBy("date")
    rows = labeled(spark, d).withColumn("far", F.lead("open", 7).over(w) / F.lead("open", 1).over(w) - 1).where("volume >= 5").join(sectors(spark, d), "entity")
    rows = written(rows.select("entity", "date", "sector", F.col("ret_4").alias("score"), F.col("ret_12").alias("other"), F.col("label").alias("near"), "far"), "gates")

    def curve(score: str) -> DataFrame:
        picks = portfolio.top_k(rows, score, ["date"], 10, "entity")
        held = portfolio.weighted(picks, "equal", "date").select("date", "entity", "weight")
        moves = portfolio.turnover(held, joins.calendar(held)).select("date", ((F.col("bought") + F.col("sold")) / 2).alias("turnover"), "cost")
        mean = lambda df, name: df.groupBy("date").agg(F.coalesce(F.avg(F.col("near") / 2000), F.lit(0.0)).alias(name))
        return written(mean(picks, "period_return").join(mean(rows, "benchmark_return"), "date").join(moves, "date"), "curve")

    gates_ = [gates.ranking_gate(rows, "score", "near", "far", "sector", "ASIA"), gates.selection_gate(rows, "score", "near", "far", "sector", "entity"), gates.conversion_gate(curve("score"), curve("other"))]
    out = gates_[0].unionByName(gates_[1]).unionByName(gates_[2])
    return out.select("gate", "measure", F.round("value", 5).alias("value"), "passed")


@query(
    f"""WITH {LABELS}, r AS (SELECT date, entity, {rank_sql('ret_1', 'date')} AS ret_1, {rank_sql('ret_4', 'date')} AS ret_4, {rank_sql('ret_12', 'date')} AS ret_12, {rank_sql('volume', 'date')} AS volume FROM labeled),
l AS (SELECT date, entity, f, v FROM r UNPIVOT (v FOR f IN (ret_1, ret_4, ret_12, volume)))
SELECT a.f AS f, b.f AS g, round(covar_pop(a.v, b.v) / sqrt(var_pop(a.v) * var_pop(b.v)), 6) AS rho, count(*) AS n FROM l a JOIN l b USING (date, entity) WHERE a.f < b.f GROUP BY ALL"""
)
def spearman_matrix(spark, d):
    ranked = by_date(labeled(spark, d), spark, d).select(*(rank_pct(f, ["date"]).alias(f) for f in FACTORS))
    pairs = [(f, g) for f in sorted(FACTORS) for g in sorted(FACTORS) if f < g]
    got = ranked.agg(*(F.struct(F.lit(f).alias("f"), F.lit(g).alias("g"), F.round(correlation(f, g), 6).alias("rho"), F.count(F.when(F.col(f).isNotNull() & F.col(g).isNotNull(), 1)).alias("n")).alias(f"p{i}") for i, (f, g) in enumerate(pairs)))
    return got.select(F.inline(F.array(*(f"p{i}" for i in range(len(pairs))))))


@query(
    f"""WITH {PANEL}, {CALENDAR}, p AS (SELECT entity, session, open, (entity + session) % 23 = 0 AS suspended, entity % 5 = 0 AND session % 17 = 0 AS delisted FROM panel JOIN calendar USING (date)), m AS (SELECT max(session) AS last FROM p),
b AS (SELECT session, avg(open) AS open FROM p WHERE session % 29 > 0 GROUP BY 1),
s AS (SELECT p.entity, p.session, a.open AS e, x.open AS x, c.open AS be, y.open AS bx, CASE WHEN p.session + 3 > last THEN 'PENDING' WHEN a.open IS NULL THEN 'MISSING_ENTRY_PRICE' WHEN x.open IS NULL THEN 'MISSING_EXIT_PRICE' WHEN x.delisted THEN 'DELISTED_AT_EXIT'
  WHEN a.suspended OR x.suspended THEN 'SUSPENDED_PRICE_UNAVAILABLE' WHEN c.open IS NULL OR y.open IS NULL THEN 'MISSING_BENCHMARK_PRICE' ELSE 'SETTLED' END AS status
 FROM p CROSS JOIN m LEFT JOIN p a ON a.entity = p.entity AND a.session = p.session + 1 LEFT JOIN p x ON x.entity = p.entity AND x.session = p.session + 3 LEFT JOIN b c ON c.session = p.session + 1 LEFT JOIN b y ON y.session = p.session + 3)
SELECT status, count(*) AS n, round(avg(CASE WHEN status = 'SETTLED' THEN x / e - 1 END), 6) AS mean_actual, round(avg(CASE WHEN status = 'SETTLED' THEN bx / be - 1 END), 6) AS mean_benchmark FROM s GROUP BY 1"""
)
def status_ladder(spark, d):
    p = panel_week(spark, d)
    k, e = F.col("session"), F.col("entity")
    placed = p.join(joins.calendar(p), "date").select("entity", "session", "open", ((e + k) % 23 == 0).alias("suspended"), ((e % 5 == 0) & (k % 17 == 0)).alias("delisted"))
    index = placed.where(k % 29 > 0).groupBy("session").agg(F.avg("open").alias("open"))
    s = settle(placed.select("entity", "session"), placed, index, 2)
    return s.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("actual"), 6).alias("mean_actual"), F.round(F.avg("benchmark_return"), 6).alias("mean_benchmark"))


@query(
    f"""WITH {PANEL}, {CALENDAR}, u AS (SELECT s_suppkey AS entity FROM supplier), p AS (SELECT entity, arg_max(close, date) AS close, max(date) AS seen FROM panel GROUP BY 1), f AS (SELECT o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT max(date) AS last FROM calendar)
SELECT u.entity, round(p.close, 6) AS close, p.entity IS NOT NULL AS price_available, coalesce(f.n, 0) AS n_orders, f.entity IS NOT NULL AS orders_available, coalesce(date_diff('day', p.seen, m.last) <= 7, false) AS fresh FROM u CROSS JOIN m LEFT JOIN p USING (entity) LEFT JOIN f USING (entity)"""
)
def feature_panel_assembly(spark, d):
    p = panel_week(spark, d)
    last = p.agg(F.max("date").alias("last"))
    price = p.groupBy("entity").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("seen"))
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"))
    u = read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")).crossJoin(F.broadcast(last))  # one row
    out = u.join(price, "entity", "left").join(o, "entity", "left")
    return out.select("entity", *r6("close"), F.col("seen").isNotNull().alias("price_available"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNotNull().alias("orders_available"), F.coalesce(F.datediff("last", "seen") <= 7, F.lit(False)).alias("fresh"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS} SELECT factor, count(ic) AS mature, count(DISTINCT year(date)) AS years, CASE WHEN count(ic) >= 100 THEN 'READY' WHEN count(ic) >= 20 THEN 'PARTIAL' ELSE 'WAITING' END AS readiness FROM ics GROUP BY 1"""
)
def readiness_thresholds(spark, d):
    n = F.count("ic")
    return factor_ics(spark, d).groupBy("factor").agg(n.alias("mature"), F.countDistinct(F.year("date")).alias("years"), F.when(n >= 100, "READY").when(n >= 20, "PARTIAL").otherwise("WAITING").alias("readiness"))


@query(
    """WITH g AS (SELECT doc_id, toxic AS gold FROM labels), s AS (SELECT doc_id, (contains(text, 'pathetic') OR contains(text, 'worthless') OR contains(text, 'moron') OR contains(text, 'disgusting') OR contains(text, 'trash'))::INT AS found FROM documents),
c AS (SELECT sum(gold * found) AS tp, sum(found * (1 - gold)) AS fp, sum(gold * (1 - found)) AS fn FROM g JOIN s USING (doc_id)) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""
)
def gold_set_evaluation(spark, d):
    flags = market.keyword_flags(F.col("text"), {"found": ["pathetic", "worthless", "moron", "disgusting", "trash"]})
    both = read(spark, d, "documents").select("doc_id", *flags).join(read(spark, d, "labels"), "doc_id")
    s = lambda c: F.sum(c).cast("long")
    c = both.agg(s(F.col("toxic") * F.col("found")).alias("tp"), s((1 - F.col("toxic")) * F.col("found")).alias("fp"), s(F.col("toxic") * (1 - F.col("found"))).alias("fn"))
    return c.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


@query(
    f"""WITH {PROBS}, w AS (SELECT slice, avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS acc FROM probs GROUP BY 1) SELECT slice, round(acc, 6) AS accuracy, round(greatest(acc - 0.5, 0) / nullif(sum(greatest(acc - 0.5, 0)) OVER (), 0), 6) AS weight FROM w"""
)
def validation_weights(spark, d):
    w = probs(spark, d).groupBy("slice").agg(share_of((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("acc"))
    raw = F.greatest(F.col("acc") - 0.5, F.lit(0.0))
    return w.select("slice", F.round("acc", 6).alias("accuracy"), F.round(F.try_divide(raw, F.nullif(F.sum(raw).over(Window.partitionBy()), F.lit(0.0))), 6).alias("weight"))


# Checked in tests or by rows


@query()
def embedding_ridge(spark, d):
    """Ridge of the label on all of the embedding's coordinates, by one Gram aggregation; a vector that is null or of fewer coordinates than others has no score."""
    e = read(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    wide = e.select("vec_id", F.col("label").cast("double").alias("y"), F.size("embedding").alias("n"), *(part(i).alias(f"e{i}") for i in range(width)))
    known = wide.where(F.col("n") == width).select("vec_id", "y", F.array(*(f"e{i}" for i in range(width))).alias("x"))
    m = models.ridge_arrays(known, "x", "y", 1.0)
    return wide.select("vec_id", "y", F.round(m.column(), 6).alias("score"))


@query()
def text_hash_model(spark, d):
    """Heads on hashed character and word n-grams for two targets, fitted to what was known before a date and scored after it; documents are dated by their id."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    own = text_heads.session(spark)
    docs = read(own, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), day.alias("date"))
    heads = {"char": ("char", (2, 3, 4)), "word": ("word", (1, 2))}
    rows = written(text_heads.features(docs, "doc_id", "text", heads, 4096), "text-features").join(docs.select("doc_id", "date"), "doc_id")
    known = rows.join(read(own, d, "labels").select("doc_id", *(F.col(c).cast("double").alias(c) for c in ("quality", "toxic"))), "doc_id")
    m = text_heads.fit(known.where("date_add(date, 20) < date '1995-06-01'"), ["char", "word"], ["quality", "toxic"], 4096, clip=1.0, rounds=10)
    char, word = (m.column(h, [0.7, 0.3]) for h in ("char", "word"))
    out = rows.where("date >= date '1995-06-01'").select("doc_id", char.alias("char_score"), word.alias("word_score"))
    out = written(out.select("doc_id", F.round("char_score", 6).alias("char_score"), F.round(0.5 * F.col("char_score") + 0.5 * F.col("word_score"), 6).alias("score")), "text-scores")
    return spark.read.schema(out.schema).parquet(*out.inputFiles())  # for the caller's session


@query()
def policy_grid(spark, d):
    """Ledgers of a grid of factors and sizes at two costs."""
    led = portfolio.ledgers(signals(spark, d), [10, 20, 30], [0.0, 20.0])
    return led.groupBy("strategy", "size", "bps").agg(F.max_by("nav", "date").alias("nav"), F.sum("traded").alias("traded")).select("strategy", "nav", "traded", "bps", "size")
