"""Residuals, tails, stability, selection and execution of weights, exposures, gates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.functions.expr import compound, correlation, known_share, rank_pct, row_in, row_mean, zfill
from tidemark.operators import decisions, evaluate, joins, models, portfolio, text
from tidemark.plans.eval_queries import _ICS, _LONG, _QUOTAS, FACTORS, PROBS, ic_sql, probs
from tidemark.plans.panel_queries import by_date, labeled, returns
from tidemark.plans.registry import CALENDAR, FILINGS, LABELS, PANEL, RETURNS, SECTORS, SHIFT, cdf_sql, cross_sql, query, r6, rank_sql, residual_sql, s6
from tidemark.sources.panel import cross_sections, filings, n_lines, normalize_market, panel_week, read, sectors
from tidemark.sources.stages import dealt, written

QUARTER, YEAR = cross_sql("quarter"), cross_sql("year")


def rho_sql(a: str, b: str, where: str = "true", least: int = 2) -> str:
    """Pearson correlation in SQL of the rows that meet a condition."""
    x, y = (f"CASE WHEN {where} THEN {c} END" for c in (a, b))
    return f"CASE WHEN count({x}) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


# Residuals


def _residuals(spark: SparkSession, d: str, controls: list[str], group: str | None) -> DataFrame:
    rows = cross_sections(spark, d, "quarter").withColumns({"y": F.when(F.col("entity") % 11 > 0, F.col("label")), "industry": F.when(F.col("entity") % 13 > 0, F.col("industry")), "size": F.when(F.col("entity") % 7 > 0, F.col("size"))})
    return evaluate.residualize(rows, "y", controls, ["date"], group).where("y is not null").select("date", "entity", F.round(F.col("residual") + SHIFT, 6).alias("residual"))


def _residuals_sql(controls: list[str], group: str | None) -> str:
    src = "src AS (SELECT * REPLACE (CASE WHEN entity % 13 > 0 THEN industry END AS industry, CASE WHEN entity % 7 > 0 THEN size END AS size), CASE WHEN entity % 11 > 0 THEN label END AS y FROM cross_rows)"
    return f"WITH {QUARTER}, {src}, {residual_sql('src', 'y', controls, 'date', group)} SELECT date, entity, round(residual + {SHIFT}, 6) AS residual FROM cleared"


@query(_residuals_sql(["size"], None))
def residualize_size(spark, d):
    return _residuals(spark, d, ["size"], None)


@query(_residuals_sql([], "industry"))
def residualize_industry(spark, d):
    return _residuals(spark, d, [], "industry")


@query(_residuals_sql(["size"], "industry"))
def residualize_industry_size(spark, d):
    return _residuals(spark, d, ["size"], "industry")


@query(
    f"""WITH {QUARTER}, src AS (SELECT *, CASE WHEN entity % 5 > 0 THEN label END AS y, {rank_sql('score', 'date')} AS score_rank FROM cross_rows), {residual_sql('src', 'y', ['size', 'momentum', 'score_rank'], 'date', 'industry')}
SELECT date, entity, round(residual, 6) AS residual FROM cleared"""
)
def residual_target(spark, d):
    """The label of eligible rows, cleared of size, momentum, volatility-like score rank and industry."""
    rows = cross_sections(spark, d, "quarter").withColumns({"y": F.when(F.col("entity") % 5 > 0, F.col("label")), "score_rank": rank_pct("score", ["date"])})
    return evaluate.residualize(rows, "y", ["size", "momentum", "score_rank"], ["date"], "industry").where("y is not null").select("date", "entity", *r6("residual"))


@query(
    f"""WITH {QUARTER}, {residual_sql('cross_rows', 'score', ['size'], 'date', 'sector')}, v AS (SELECT date, entity, round(residual, 6) AS x, label FROM cleared WHERE residual IS NOT NULL),
r AS (SELECT date, {rank_sql('x', 'date')} AS a, {rank_sql('label', 'date')} AS b FROM v) SELECT date, count(*) AS n, round({rho_sql('a', 'b', 'true', 10)}, 6) AS neutral_ic FROM r GROUP BY date"""
)
def neutral_ic_size_sector(spark, d):
    """Rank correlation of a score cleared of size and sector."""
    rows = evaluate.residualize(cross_sections(spark, d, "quarter"), "score", ["size"], ["date"], "sector").withColumn("x", F.round("residual", 6))
    return evaluate.rank_ic(rows, "x", "label", ["date"], 10).select("date", "n", F.round("ic", 6).alias("neutral_ic"))


# Tails, stability, selection


_TAIL = {"all": "true", "top10": "p <= greatest(20, ceil(k * 0.1))", "top20": "p <= greatest(20, ceil(k * 0.2))", "bottom10": "p > k - greatest(20, ceil(k * 0.1))"}


@query(
    f"""WITH {YEAR}, v AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS p, count(*) OVER (PARTITION BY date) AS k FROM cross_rows), w AS (SELECT *, {", ".join(f"({c}) AS {t}_" for t, c in _TAIL.items())} FROM v WHERE k >= 100),
r AS (SELECT *, {", ".join(f"{rank_sql('score', f'date, {t}_')} AS {t}_s, {rank_sql('label', f'date, {t}_')} AS {t}_l" for t in _TAIL)} FROM w)
SELECT date, count(*) AS n, round({rho_sql('all_s', 'all_l')}, 6) AS overall_rank_ic, round({rho_sql('top10_s', 'top10_l', 'top10_')}, 6) AS top_decile_ic, round({rho_sql('top20_s', 'top20_l', 'top20_')}, 6) AS top_quintile_ic, round({rho_sql('bottom10_s', 'bottom10_l', 'bottom10_')}, 6) AS bottom_decile_ic,
 round(avg(CASE WHEN top10_ THEN label END), 6) AS top_decile_return, round(avg(label), 6) AS universe_return, round(avg(CASE WHEN top10_ THEN (label > 0)::INT END), 6) AS top_decile_win_rate,
 round((max(CASE WHEN p = 20 THEN score END) - max(CASE WHEN p = 21 THEN score END)) / stddev_pop(score), 6) AS cutoff_margin, round(stddev_pop(score), 4) AS score_std FROM r GROUP BY date"""
)
def tail_metrics(spark, d):
    t = evaluate.tail_metrics(cross_sections(spark, d, "year"), "score", "label", "date", "entity")
    return t.select("date", "n", *r6("overall_rank_ic", "top_decile_ic", "top_quintile_ic", "bottom_decile_ic", "top_decile_return", "universe_return", "top_decile_win_rate", "cutoff_margin"), F.round("score_std", 4).alias("score_std"))


@query(
    f"""WITH {YEAR}, v AS (SELECT sector, date, CASE WHEN entity % 6 > 0 THEN score END AS x, label AS y, CASE WHEN entity % 6 > 0 THEN label END AS yy FROM cross_rows), r AS (SELECT *, {rank_sql('x', 'sector, date')} AS a, {rank_sql('yy', 'sector, date')} AS b FROM v),
g AS (SELECT sector, date, count(*) AS n, {rho_sql('x', 'yy', 'x IS NOT NULL', 10)} AS pearson, {rho_sql('a', 'b', 'x IS NOT NULL', 10)} AS ic, count(x) AS known, stddev_samp(x) AS spread FROM r GROUP BY ALL)
SELECT sector, sum(n)::BIGINT AS sample_size, count(ic) AS dates, round(avg(pearson), 6) AS pearson_ic, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 4) AS icir, round(avg((round(ic, 12) > 0)::INT), 6) AS positive_ic_ratio,
 round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 4) AS t_stat, round(sum(known) / sum(n), 6) AS coverage, round(avg(spread), 2) AS dispersion FROM g GROUP BY sector"""
)
def grouped_stability(spark, d):
    rows = cross_sections(spark, d, "year").withColumn("score", F.when(F.col("entity") % 6 > 0, F.col("score")))
    m = evaluate.factor_metrics(rows, "score", "label", "sector")
    return m.select("sector", "sample_size", "dates", *r6("pearson_ic", "ic_mean", "ic_std"), F.round("icir", 4).alias("icir"), *r6("positive_ic_ratio"), F.round("t_stat", 4).alias("t_stat"), *r6("coverage"), F.round("cross_sectional_dispersion", 2).alias("dispersion"))


_GATES = {"dates": 30, "size": 0.0005, "positive": 0.4, "consistency": 0.3, "fdr": 0.99}


def _audited(spark: SparkSession, d: str) -> DataFrame:
    """entity, date, label, the factors and how far each moved from its entity's date before: the panel is made once, with all windows by entity, and written."""
    w = Window.partitionBy("entity").orderBy("date")
    rows = labeled(spark, d)
    return written(rows.select("entity", "date", "label", *FACTORS, *(F.abs(F.col(f) - F.lag(f).over(w)).alias(f"moved_{f}") for f in FACTORS)), "audited")


def audit(rows: DataFrame, n: int) -> DataFrame:
    """The factors' audit by the rows of ``_audited``, which come from n line items."""
    ics = written(evaluate.rank_ic_matrix(rows, FACTORS, "label", "date", 5, n), "factor-ics")
    moved = rows.agg(*(F.avg(f"moved_{f}").alias(f) for f in FACTORS)).unpivot([], FACTORS, "factor", "turnover_proxy")
    return decisions.factor_audit(ics, moved, **_GATES)


_U = " + ".join(f"{2 * (1 - k / 6)} * coalesce(sum(g{k}), 0)" for k in range(1, 6))
_AUDIT = f"""{LABELS}, {_LONG}, {_ICS}, known AS (SELECT * FROM ics WHERE ic IS NOT NULL),
sums AS (SELECT factor, count(*) AS ic_dates, avg(ic) AS mean_rank_ic, stddev_samp(ic) AS rank_ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS rank_ic_ir, avg((round(ic, 12) > 0)::INT) AS positive_ratio FROM known GROUP BY 1),
years AS (SELECT factor, avg((s = sign(round(mean_rank_ic, 12)))::INT) AS direction_consistency FROM (SELECT factor, year(date) AS year, sign(round(avg(ic), 12)) AS s FROM known GROUP BY ALL) JOIN sums USING (factor) GROUP BY 1),
u AS (SELECT factor, date, ic, ic - avg(ic) OVER (PARTITION BY factor) AS u FROM known), l AS (SELECT *, {", ".join(f"u * lag(u, {k}) OVER w AS g{k}" for k in range(1, 6))} FROM u WINDOW w AS (PARTITION BY factor ORDER BY date)),
h AS (SELECT factor, CASE WHEN count(*) >= 20 THEN avg(ic) / (sqrt(greatest(sum(u * u) + {_U}, 0)) / count(*)) ELSE 0 END AS hac_t, count(*) AS c FROM l GROUP BY 1), t AS (SELECT factor, hac_t, CASE WHEN c < 20 THEN 1 ELSE 2 * (1 - {cdf_sql('abs(hac_t)')}) END AS p_value FROM h),
moves AS (SELECT {", ".join(f"avg(abs({f} - {f}_was)) AS {f}" for f in FACTORS)} FROM (SELECT *, {", ".join(f"lag({f}) OVER w AS {f}_was" for f in FACTORS)} FROM labeled WINDOW w AS (PARTITION BY entity ORDER BY date))), turn AS (SELECT factor, turnover_proxy FROM moves UNPIVOT (turnover_proxy FOR factor IN ({", ".join(FACTORS)}))),
raw AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS raw FROM sums JOIN years USING (factor) JOIN t USING (factor) JOIN turn USING (factor)), adj AS (SELECT *, least(min(raw) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING), 1) AS fdr_q_value FROM raw),
audit AS (SELECT *, ic_dates >= {_GATES['dates']} AND abs(mean_rank_ic) >= {_GATES['size']} AND CASE WHEN mean_rank_ic >= 0 THEN positive_ratio ELSE 1 - positive_ratio END >= {_GATES['positive']} AND direction_consistency >= {_GATES['consistency']} AND fdr_q_value <= {_GATES['fdr']} AS passes FROM adj)"""


@query(f"WITH {_AUDIT} SELECT factor, ic_dates, {s6('mean_rank_ic', 'rank_ic_std')}, round(rank_ic_ir, 4) AS rank_ic_ir, {s6('positive_ratio', 'direction_consistency')}, round(hac_t, 4) AS hac_t, round(p_value, 5) AS p_value, round(fdr_q_value, 5) AS fdr_q_value, round(turnover_proxy, 4) AS turnover_proxy, passes FROM audit")
def factor_gates(spark, d):
    a = audit(_audited(spark, d), n_lines(spark, d))
    return a.select("factor", "ic_dates", *r6("mean_rank_ic", "rank_ic_std"), F.round("rank_ic_ir", 4).alias("rank_ic_ir"), *r6("positive_ratio", "direction_consistency"), F.round("hac_t", 4).alias("hac_t"), F.round("p_value", 5).alias("p_value"), F.round("fdr_q_value", 5).alias("fdr_q_value"), F.round("turnover_proxy", 4).alias("turnover_proxy"), F.col("passes_statistical_gate").alias("passes"))


_POOLED = f"""full_ AS (SELECT {", ".join(FACTORS)} FROM labeled WHERE {" AND ".join(f"{f} IS NOT NULL" for f in FACTORS)}), rk AS (SELECT {", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in FACTORS)} FROM full_)"""
_PAIRS = [(f, g) for f in sorted(FACTORS) for g in sorted(FACTORS) if f < g]


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    """f, g, rho of the factors over the whole panel, which is written once."""
    return evaluate.pooled_spearman(written(labeled(spark, d).select("entity", "date", *FACTORS), "pooled"), FACTORS, n_lines(spark, d))


@query(f"WITH {LABELS}, {_POOLED} " + " UNION ALL ".join(f"SELECT '{f}' AS f, '{g}' AS g, round(corr({f}, {g}), 6) AS rho FROM rk" for f, g in _PAIRS))
def pooled_spearman(spark, d):
    return _pooled(spark, d).select("f", "g", *r6("rho"))


@query(
    f"""WITH RECURSIVE {_AUDIT}, {_POOLED}, rho AS ({" UNION ALL ".join(f"SELECT '{a}' AS f, '{b}' AS g, corr({a}, {b}) AS rho FROM rk" for f, g in _PAIRS for a, b in ((f, g), (g, f)))}), m AS (SELECT map(list(f || '|' || g), list(rho)) AS rhos FROM rho),
cand AS (SELECT factor, row_number() OVER (ORDER BY round(fdr_q_value, 9), round(direction_consistency, 9) DESC, round(turnover_proxy, 9), round(mean_rank_ic, 9) DESC, factor) AS n FROM audit WHERE passes),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, CAST('' AS VARCHAR) AS factor, CAST('' AS VARCHAR) AS likeness UNION ALL
 SELECT c.n, CASE WHEN len(s.taken) < 2 AND len(list_filter(s.taken, lambda x: abs(rhos[c.factor || '|' || x]) > 0.5)) = 0 THEN list_append(s.taken, c.factor) ELSE s.taken END, c.factor,
  CASE WHEN len(s.taken) >= 2 THEN '' ELSE coalesce(list_filter(s.taken, lambda x: abs(rhos[c.factor || '|' || x]) > 0.5)[1], '') END FROM s JOIN cand c ON c.n = s.n + 1 CROSS JOIN m),
last_ AS (SELECT taken FROM s ORDER BY n DESC LIMIT 1)
SELECT a.factor, coalesce(s.likeness, '') AS redundant_with, list_contains(last_.taken, a.factor) AS selected, CASE WHEN list_contains(last_.taken, a.factor) THEN 'SELECTED' WHEN coalesce(s.likeness, '') <> '' THEN 'REDUNDANT' WHEN NOT passes THEN 'STATISTICAL_GATE' ELSE 'MAX_FACTOR_CAP' END AS rejection_reason
FROM audit a CROSS JOIN last_ LEFT JOIN s ON s.factor = a.factor"""
)
def factor_selection(spark, d):
    rows, n = _audited(spark, d), n_lines(spark, d)
    return decisions.select_factors(audit(rows, n), evaluate.pooled_spearman(rows, FACTORS, n), 0.5, 2).select("factor", "redundant_with", "selected", "rejection_reason")


# Weights, periods, policies

_PICKS = f"""{LABELS}, {CALENDAR}, e AS (SELECT *, lead(open, 1) OVER w AS entry_open, lead(open, 3) OVER w AS exit_open FROM rets WINDOW w AS (PARTITION BY entity ORDER BY date)),
o AS (SELECT entity, date, entry_open, CASE WHEN (entity + day(date)) % 6 > 0 THEN exit_open END AS exit_open, entry_open IS NOT NULL AND (entity * 7 + day(date)) % 4 > 0 AS tradable, label AS future_return FROM e JOIN (SELECT entity, date, label FROM labeled) USING (entity, date)),
top AS (SELECT date, entity FROM rets WHERE ret_4 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret_12 DESC, entity) <= 6), days AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM top)),
want AS (SELECT session, t.date, t.entity, 1.0 / count(*) OVER (PARTITION BY t.date) AS weight, exit_open / entry_open - 1 AS hold, CASE WHEN tradable THEN exit_open / entry_open - 1 END AS fresh, tradable FROM top t JOIN days USING (date) JOIN o ON o.entity = t.entity AND o.date = t.date),
s AS (SELECT CAST(0 AS BIGINT) AS session, CAST([] AS BIGINT[]) AS held, CAST([] AS BIGINT[]) AS was UNION ALL
 SELECT s.session + 1, coalesce((SELECT list(entity ORDER BY entity) FROM want w WHERE w.session = s.session + 1 AND CASE WHEN list_contains(s.held, w.entity) THEN hold IS NOT NULL ELSE tradable AND fresh IS NOT NULL END), []), s.held FROM s WHERE s.session < (SELECT max(session) FROM days)),
x AS (SELECT w.*, list_contains(s.was, entity) AS continuing, list_contains(s.held, entity) AS executed, CASE WHEN list_contains(s.held, entity) THEN CASE WHEN list_contains(s.was, entity) THEN hold ELSE fresh END END AS realized FROM want w JOIN s USING (session))"""


def _planned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = labeled(spark, d)
    top = portfolio.top_k(rows.where("ret_4 is not null").withColumn("s", F.coalesce("ret_12", F.lit(float("-inf")))), "s", ["date"], 6, "entity")
    want = portfolio.weighted(top, "equal", "date").select("date", "entity", "weight")
    e = F.col("entity")
    left = F.when((e + F.dayofmonth("date")) % 6 > 0, F.col("exit_open"))
    ok = F.col("entry_open").isNotNull() & ((e * 7 + F.dayofmonth("date")) % 4 > 0)
    outcome = rows.select("entity", "date", "entry_open", left.alias("execution_exit_open"), ok.alias("entry_tradable"), F.when(ok, F.try_divide(left, "entry_open") - 1).alias("execution_return"), F.col("label").alias("future_return"))
    return want, outcome, joins.calendar(want)


@query(f"WITH RECURSIVE {_PICKS.replace('ORDER BY ret_12 DESC, entity', 'ORDER BY ret_12 DESC NULLS LAST, entity')} SELECT date, entity, continuing, executed, round(CASE WHEN executed THEN weight ELSE 0 END, 6) AS actual_weight, round(realized, 6) AS realized_return FROM x")
def execute_weights(spark, d):
    return decisions.execute_weights(*_planned(spark, d)).select("date", "entity", "continuing", "executed", *r6("actual_weight", "realized_return"))


@query(
    f"""WITH RECURSIVE {_PICKS.replace('ORDER BY ret_12 DESC, entity', 'ORDER BY ret_12 DESC NULLS LAST, entity')}, h AS (SELECT session, entity, weight FROM x WHERE executed), mv AS (SELECT coalesce(a.session, b.session + 1) AS session, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS m FROM h a FULL JOIN h b ON a.entity = b.entity AND a.session = b.session + 1),
c AS (SELECT session, sum(greatest(m, 0)) AS buys, sum(greatest(-m, 0)) AS sells FROM mv GROUP BY 1), b AS (SELECT date, avg(future_return) AS benchmark_return FROM o GROUP BY 1),
g AS (SELECT date, session, sum(CASE WHEN executed THEN weight * realized ELSE 0 END) AS gross, count(CASE WHEN executed THEN 1 END) AS holdings, 1 - sum(CASE WHEN executed THEN weight ELSE 0 END) AS cash, count(CASE WHEN NOT continuing AND NOT executed THEN 1 END) AS blocked FROM x GROUP BY ALL)
SELECT date, round(gross, 6) AS gross_return, round(gross - coalesce(buys, 0) * 0.0008 - coalesce(sells, 0) * 0.0013, 6) AS net_return, round(benchmark_return, 6) AS benchmark_return, round(coalesce(buys, 0), 6) AS buy_turnover, round(coalesce(sells, 0), 6) AS sell_turnover,
 round(coalesce(buys, 0) * 0.0008 + coalesce(sells, 0) * 0.0013, 8) AS transaction_cost, holdings, round(cash, 6) AS cash_weight, blocked AS blocked_entries FROM g LEFT JOIN c USING (session) LEFT JOIN b USING (date)"""
)
def period_accounting(spark, d):
    want, outcome, sessions = _planned(spark, d)
    out = decisions.period_accounting(decisions.execute_weights(want, outcome, sessions), outcome, sessions)
    return out.select("date", *r6("gross_return", "net_return", "benchmark_return", "buy_turnover", "sell_turnover"), F.round("transaction_cost", 8).alias("transaction_cost"), "holdings", *r6("cash_weight"), "blocked_entries")


@query(
    f"""WITH {QUARTER}, v AS (SELECT *, industry AS grp, entity % 3 = 0 AS held, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS model_rank FROM cross_rows), places AS (SELECT 12 AS n_places), {_QUOTAS},
a AS (SELECT v.date, entity, model_rank FROM v JOIN quotas q ON q.date = v.date AND q.grp = v.grp QUALIFY row_number() OVER (PARTITION BY v.date, v.grp ORDER BY model_rank) <= quota), b AS (SELECT date, entity, model_rank FROM a QUALIFY row_number() OVER (PARTITION BY date ORDER BY model_rank) <= 12)
SELECT 'top' AS policy, date, entity, model_rank FROM v WHERE model_rank <= 12 UNION ALL SELECT 'sector_balanced', * FROM b
UNION ALL SELECT 'buffer', date, entity, model_rank FROM v QUALIFY row_number() OVER (PARTITION BY date ORDER BY NOT (held AND model_rank <= 24), model_rank) <= 12"""
)
def policy_select(spark, d):
    rows = cross_sections(spark, d, "quarter").withColumn("held", F.col("entity") % 3 == 0)
    kinds = {"top": {}, "sector_balanced": {"group": "industry"}, "buffer": {"held": "held", "exit_rank": 24}}
    out = None
    for name, how in kinds.items():
        one = decisions.policy_select(rows, "score", "date", "entity", 12, **how).select(F.lit(name).alias("policy"), "date", "entity", "model_rank")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {PANEL}, {SECTORS}, v AS (SELECT date, entity, sector, CASE WHEN entity % 9 > 0 THEN amount END AS w, row_number() OVER (PARTITION BY date ORDER BY volume DESC, entity) <= 4 AS a FROM panel JOIN sectors USING (entity))
SELECT date, entity, round(sum(x), 6) AS weight FROM (SELECT date, entity, 0.7 * w / sum(w) OVER (PARTITION BY date) AS x FROM v WHERE w > 0 UNION ALL SELECT date, entity, 0.3 / count(*) OVER (PARTITION BY date) FROM v WHERE a) GROUP BY date, entity"""
)
def core_plus_active(spark, d):
    p = panel_week(spark, d).withColumn("benchmark_weight", F.when(F.col("entity") % 9 > 0, F.col("amount")))
    active = portfolio.top_k(p, "volume", ["date"], 4, "entity")
    return decisions.core_plus_active(p, portfolio.weighted(active, "equal", "date")).select("date", "entity", *r6("weight"))


def allocate_sql(src: str, out: str, c: str, total: str, p: str, name: str) -> str:
    """CTEs that end in ``out``: src with the share of a (date, sector)'s total at one water level of capacity and preference, and what is left to those without a preference."""
    tier = f"PARTITION BY date, sector, {p} > 0"
    return f"""{out}1 AS (SELECT *, CASE WHEN {p} > 0 THEN {p} ELSE 1 END AS like_, least({total}, coalesce(sum(CASE WHEN {p} > 0 THEN {c} END) OVER (PARTITION BY date, sector), 0)) AS first_ FROM {src}),
{out}2 AS (SELECT *, CASE WHEN {p} > 0 THEN first_ ELSE greatest({total} - first_, 0) END AS whole, {c} / like_ AS ratio FROM {out}1),
{out}3 AS (SELECT *, sum({c}) OVER ({tier} ORDER BY ratio) + ratio * (sum(like_) OVER ({tier}) - sum(like_) OVER ({tier} ORDER BY ratio)) <= whole AS brim FROM {out}2),
{out} AS (SELECT * EXCLUDE (like_, first_, whole, ratio, brim), CASE WHEN brim THEN {c} ELSE least({c}, coalesce(greatest(whole - coalesce(sum(CASE WHEN brim THEN {c} END) OVER ({tier}), 0), 0) / sum(CASE WHEN NOT brim THEN like_ END) OVER ({tier}), 0) * like_) END AS {name} FROM {out}3)"""


@query(
    f"""WITH {YEAR}, r0 AS (SELECT date, entity, sector, greatest(coalesce(score, 0), 0) AS w, CASE WHEN entity % 4 > 0 THEN label END AS s, 0.01 + size / 50 AS vol FROM cross_rows),
r1 AS (SELECT *, w / nullif(sum(w) OVER (PARTITION BY date), 0) AS base FROM r0 QUALIFY base IS NOT NULL),
r2 AS (SELECT *, sum(base) OVER (PARTITION BY date, sector) AS sw, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY date, sector ORDER BY s DESC NULLS LAST, entity) END AS best FROM r1),
r3 AS (SELECT *, coalesce(best <= CASE WHEN sw > 0 THEN greatest(1, round_even(30 * sw, 0)) ELSE 0 END, false) AS first FROM r2),
r4 AS (SELECT *, first AND row_number() OVER (PARTITION BY date ORDER BY first DESC, s DESC NULLS LAST, entity) <= 30 AS chosen, 0.15 * 0.8 * sw AS target FROM r3),
r5 AS (SELECT *, CASE WHEN chosen THEN 0.0075 ELSE 0.0 END AS up, CASE WHEN chosen THEN 1 / greatest(vol, 0.0001) ELSE 0 END AS wish, CASE WHEN chosen THEN 0 ELSE least(base, 0.0075) END AS down, CASE WHEN chosen THEN 0 ELSE base END AS give FROM r4),
{allocate_sql('r5', 'm', 'up', 'target', 'wish', 'more')}, r6 AS (SELECT *, sum(more) OVER (PARTITION BY date, sector) AS wanted FROM m), {allocate_sql('r6', 'l', 'down', 'wanted', 'give', 'less')},
r7 AS (SELECT *, sum(less) OVER (PARTITION BY date, sector) AS given FROM l), r8 AS (SELECT *, coalesce(more * least(wanted, given) / nullif(wanted, 0), 0) - coalesce(less * least(wanted, given) / nullif(given, 0), 0) AS tilt0 FROM r7),
r9 AS (SELECT *, sqrt(sum((tilt0 * vol) ** 2) OVER (PARTITION BY date) * 252) AS error FROM r8), r10 AS (SELECT *, tilt0 * CASE WHEN error > 0.06 THEN 0.06 / error ELSE 1 END AS tilt FROM r9)
SELECT date, entity, round(greatest(base + tilt, 0) / sum(greatest(base + tilt, 0)) OVER (PARTITION BY date), 8) AS weight, round(tilt, 8) AS tilt FROM r10"""
)
def benchmark_relative_weights(spark, d):
    """Benchmark weights tilted within a budget, by exact capped allocations."""
    rows = cross_sections(spark, d, "year").select("date", "entity", "sector", F.col("score").alias("benchmark_weight"), F.when(F.col("entity") % 4 > 0, F.col("label")).alias("score"), (0.01 + F.col("size") / 50).alias("volatility"), F.lit(0.8).alias("confidence"))
    return decisions.benchmark_relative(rows).select("date", "entity", F.round("weight", 8).alias("weight"), F.round("tilt", 8).alias("tilt"))


@query(
    f"""WITH {RETURNS}, g AS (SELECT date, coalesce(sum(CASE WHEN ret_12 IS NOT NULL AND amount > 0 THEN ret_12 / 10 * amount END) / sum(CASE WHEN ret_12 IS NOT NULL AND amount > 0 THEN amount END), 0) AS m, coalesce(avg((ret_4 > 0)::INT), 0.5) AS b FROM rets GROUP BY date)
SELECT date, round(m, 6) AS momentum, round(b, 6) AS breadth, CASE WHEN m < -0.04 AND b < 0.42 THEN 'risk_off' WHEN m < 0 OR b < 0.48 THEN 'weak' ELSE 'risk_on' END AS regime, (CASE WHEN m < -0.04 AND b < 0.42 THEN 0.55 WHEN m < 0 OR b < 0.48 THEN 0.8 ELSE 1.0 END)::DOUBLE AS exposure FROM g"""
)
def defensive_exposure(spark, d):
    rows = returns(spark, d).withColumn("m", F.col("ret_12") / 10)
    return decisions.defensive_exposure(rows, "amount", "m", "ret_4").select("date", *r6("momentum", "breadth"), "regime", F.col("exposure").cast("double"))


@query(
    f"""WITH {RETURNS}, m AS (SELECT date, avg(ret_1) / 8 AS r FROM rets WHERE ret_1 IS NOT NULL GROUP BY date), v AS (SELECT date, CASE WHEN count(r) OVER w >= 12 THEN stddev_samp(r) OVER w * sqrt(52) END AS s, CASE WHEN count(r) OVER w >= 12 THEN sum(r) OVER w END - 0.3 AS g FROM m WINDOW w AS (ORDER BY date ROWS 11 PRECEDING))
SELECT date, round(CASE WHEN coalesce(g, 0) >= 0 OR s IS NULL OR s <= 0 THEN 1 ELSE greatest(0.35, least(1, 0.12 / s)) END, 6) AS exposure FROM v"""
)
def risk_budget_exposure(spark, d):
    m = returns(spark, d).where("ret_1 is not null").groupBy("date").agg((F.avg("ret_1") / 8).alias("r"))
    w = Window.orderBy("date").rowsBetween(-11, 0)  # a row per date
    full = F.count("r").over(w) >= 12
    v = m.withColumns({"s": F.when(full, F.stddev_samp("r").over(w) * F.sqrt(F.lit(52.0))), "g": F.when(full, F.sum("r").over(w)) - 0.3})
    return v.select("date", F.round(decisions.risk_budget(F.col("g"), F.col("s")), 6).alias("exposure"))


# Gates, champions, confidence


@query(
    f"""WITH {PROBS}, b AS (SELECT y, 0.5 + 0.2 * ((doc_id * 31) % 17 - 8) / 17.0 AS q, p FROM probs), m AS (SELECT avg((p - y) ** 2) AS ba, avg((q - y) ** 2) AS bb, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS la, avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS lb FROM b),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq FROM b),
a AS (SELECT (sum(CASE WHEN y = 1 THEN rp END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS aa, (sum(CASE WHEN y = 1 THEN rq END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS ab FROM r)
SELECT round(ba, 6) AS brier_a, round(la, 6) AS log_loss_a, round(aa, 6) AS auc_a, round(bb, 6) AS brier_b, round(lb, 6) AS log_loss_b, round(ab, 6) AS auc_b, CASE WHEN ba < bb AND la < lb AND aa >= ab THEN 'trees' ELSE 'logistic' END AS champion FROM m, a"""
)
def champion_selection(spark, d):
    p = probs(spark, d).withColumn("q", 0.5 + 0.2 * ((F.col("doc_id") * 31) % 17 - 8) / 17.0)
    c = decisions.champion(p, "y", ("trees", "p"), ("logistic", "q"))
    return c.select(*r6("brier_a", "log_loss_a", "auc_a", "brier_b", "log_loss_b", "auc_b"), "champion")


_CHECKS = {n: f"(o_orderkey * {k + 3}) % {23 + k} > 0" for k, n in enumerate(decisions.CERTIFIED_BY)}


@query(
    f"""WITH c AS (SELECT o_orderkey, {", ".join(f"CASE WHEN o_orderkey % {97 + k} > 0 THEN {x} END AS {n}" for k, (n, x) in enumerate(_CHECKS.items()))}, o_custkey % 2 = 0 AS confirmed FROM orders)
SELECT o_orderkey, {" AND ".join(f"coalesce({n}, false)" for n in _CHECKS)} AS production_prediction_ready, false AS execution_authorized, CASE WHEN confirmed THEN 'CONFIRMED' ELSE 'COLLECTING' END AS future_confirmation_status,
 concat_ws(',', {", ".join(f"CASE WHEN NOT coalesce({n}, false) THEN '{n}' END" for n in _CHECKS)}) AS reasons FROM c"""
)
def certification(spark, d):
    o = read(spark, d, "orders")
    c = o.select("o_orderkey", *(F.when(F.col("o_orderkey") % (97 + k) > 0, F.expr(x)).alias(n) for k, (n, x) in enumerate(_CHECKS.items())), (F.col("o_custkey") % 2 == 0).alias("confirmed"))
    out = decisions.certify(c, "confirmed")
    return out.select("o_orderkey", "production_prediction_ready", "execution_authorized", "future_confirmation_status", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    f"""WITH {QUARTER}, s AS (SELECT entity, least(1, greatest(0, least(1, abs(greatest(0, least(1, momentum * 1.2 - 0.1)) - 0.5) * 2))) * 0.15 + 0.22 * size + 0.18 * 0.6 + 0.15 * least(1, greatest(0, label + 0.8)) + 0.10 * coalesce(CASE WHEN entity % 5 > 0 THEN 0.7 END, 0) + 0.20 * 1 AS raw FROM cross_rows), c AS (SELECT entity, least(1, greatest(0, raw * 0.9)) AS score FROM s)
SELECT entity, round(score + {SHIFT}, 6) AS score, CASE WHEN score < 0.4 THEN 'LOW' WHEN score < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM c"""
)
def confidence_scores(spark, d):
    rows = cross_sections(spark, d, "quarter")
    evidence = {"oos_skill": F.col("size"), "calibration_quality": F.lit(0.6), "regime_consistency": F.col("label") + 0.8, "sector_stability": F.when(F.col("entity") % 5 > 0, 0.7), "feature_completeness": F.lit(1.5)}
    score = market.confidence(F.col("momentum") * 1.2 - 0.1, evidence, F.lit(0.9))
    return rows.select("entity", score.alias("score")).select("entity", F.round(F.col("score") + SHIFT, 6).alias("score"), market.confidence_level(F.col("score")).alias("level"))


@query(
    f"""WITH {PANEL}, m AS (SELECT max(date) AS last FROM panel), s AS (SELECT entity, max(date) AS seen, count(*) AS n FROM panel GROUP BY 1), v AS (SELECT s_suppkey % 7 AS grp, seen IS NOT NULL AND n > 5 AS ok, date_diff('day', seen, last) AS age FROM supplier LEFT JOIN s ON entity = s_suppkey CROSS JOIN m)
SELECT grp, round(avg(ok::INT), 6) AS coverage, max(age) AS age, coalesce(avg(ok::INT) >= 0.95 AND max(age) <= 7, false) AS passed FROM v GROUP BY grp"""
)
def exposure_staleness(spark, d):
    """The staleness gate of each of seven sets of suppliers."""
    p = panel_week(spark, d)
    last = p.agg(F.max("date").alias("last"))  # one row
    s = p.groupBy("entity").agg(F.max("date").alias("seen"), F.count("*").alias("n"))
    v = read(spark, d, "supplier").join(s, F.col("entity") == F.col("s_suppkey"), "left").crossJoin(F.broadcast(last)).select((F.col("s_suppkey") % 7).alias("grp"), F.when(F.col("n") > 5, F.col("seen")).alias("value"), F.datediff("last", "seen").cast("long").alias("age"))
    out = None
    for g in range(7):
        one = decisions.staleness(v.where(F.col("grp") == g), "value", "age").select(F.lit(g).cast("long").alias("grp"), *r6("coverage"), "age", "passed").where("coverage is not null")
        out = one if out is None else out.unionByName(one)
    return out


_GUARDED = ["entity", "date", "open", "high", "low", "close", "volume", "amount", "ret_1", "ret_4", "ret_12", "entry_open", "exit_open", "label_end", "label"]


@query(
    f"""WITH {LABELS}, n AS (SELECT {", ".join(f"count({c}) AS {c}" for c in _GUARDED)} FROM labeled)
SELECT column_name, n_known, regexp_matches(lower(column_name), 'future_|label|entry_|exit_|execution_|raw_up|tradable_up|target') AS forbidden FROM n UNPIVOT (n_known FOR column_name IN ({", ".join(_GUARDED)}))"""
)
def forbidden_feature_guard(spark, d):
    """Every column of the labelled panel, how many values it has, and whether it tells of the future; the rest is safe to train on."""
    rows = labeled(spark, d).select(*_GUARDED)
    found = decisions.forbidden_features(rows.columns)
    decisions.assert_features_safe(rows, [c for c in rows.columns if c not in found])
    known = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).unpivot([], rows.columns, "column_name", "n_known")
    return known.withColumn("forbidden", F.col("column_name").isin(*found))


@query(
    f"""WITH {PANEL}, {FILINGS}, m AS (SELECT 'panel' AS t, count(*) AS rows, count(DISTINCT entity) AS entities, min(date) AS a, max(date) AS b, count(*) - count(DISTINCT (entity, date)) AS dup FROM panel UNION ALL SELECT 'filings', count(*), count(DISTINCT entity), min(report), max(report), count(*) - count(DISTINCT (entity, report)) FROM filings),
l AS (SELECT t || '_rows' AS measure, rows::DOUBLE AS value FROM m UNION ALL SELECT t || '_entities', entities FROM m UNION ALL SELECT t || '_first_day', date_diff('day', DATE '1970-01-01', a) FROM m UNION ALL SELECT t || '_last_day', date_diff('day', DATE '1970-01-01', b) FROM m UNION ALL SELECT t || '_duplicates', dup FROM m)
SELECT measure, value, CASE measure WHEN 'panel_rows' THEN value >= 100 WHEN 'panel_duplicates' THEN value <= 0 WHEN 'filings_entities' THEN value BETWEEN 5 AND 1000000 WHEN 'filings_last_day' THEN value <= 8000 END AS passed FROM l"""
)
def input_quality_audit(spark, d):
    tables = {"panel": (panel_week(spark, d), "entity", "date"), "filings": (filings(spark, d), "entity", "report")}
    return decisions.input_audit(tables, {"panel_rows": (100, None), "panel_duplicates": (None, 0), "filings_entities": (5, 1_000_000), "filings_last_day": (None, 8000)})


@query(
    f"""WITH {YEAR}, v AS (SELECT *, {rank_sql('score', 'date')} AS a, {rank_sql('label', 'date')} AS b, row_number() OVER (PARTITION BY date ORDER BY score, entity) AS r, count(*) OVER (PARTITION BY date) AS k FROM cross_rows),
i AS (SELECT date, count(*) AS n, {rho_sql('score', 'label')} AS pearson, {rho_sql('a', 'b')} AS spearman FROM v GROUP BY date), q AS (SELECT date, 1 + {" + ".join(f"(r > 1 + (k - 1) * {i} / 5.0)::INT" for i in range(1, 5))} AS bucket, avg(label) AS m FROM v GROUP BY ALL),
s AS (SELECT date, bucket, m, round(m - lag(m) OVER (PARTITION BY date ORDER BY bucket), 12) >= 0 AS up FROM q)
SELECT date, any_value(n) AS n, round(any_value(pearson), 6) AS pearson_ic, round(any_value(spearman), 6) AS spearman_rank_ic, round(max(CASE WHEN bucket = 5 THEN m END) - max(CASE WHEN bucket = 1 THEN m END), 6) AS top_minus_bottom, count(CASE WHEN up THEN 1 END) / 4.0 AS adjacent_consistency FROM s JOIN i USING (date) WHERE n >= 20 GROUP BY date"""
)
def settlement_metrics(spark, d):
    m = decisions.settlement_metrics(cross_sections(spark, d, "year"), "date", "score", "label", "entity")
    return m.select("date", "n", *r6("pearson_ic", "spearman_rank_ic", "top_minus_bottom"), "adjacent_consistency")


@query(
    f"""WITH {RETURNS}, {SECTORS}, {CALENDAR}, k AS (SELECT session, rets.date, entity, sector, row_number() OVER (PARTITION BY rets.date ORDER BY ret_4 DESC, entity) AS place, CASE WHEN (entity + day(rets.date)) % 5 > 0 THEN ret_1 END AS ret FROM rets JOIN sectors USING (entity) JOIN calendar ON calendar.date = rets.date WHERE ret_4 IS NOT NULL),
b AS (SELECT session + 1 AS session, entity, sector AS was FROM k WHERE place <= 4), n AS (SELECT DISTINCT session, sector AS was FROM k WHERE place <= 4 AND (session, entity) NOT IN (SELECT (session, entity) FROM b)), dd AS (SELECT DISTINCT session, date FROM k),
x AS (SELECT dd.date, k.place, k.ret, n.was IS NOT NULL AS met FROM b JOIN dd USING (session) LEFT JOIN k USING (session, entity) LEFT JOIN n ON n.session = b.session AND n.was = b.was WHERE k.place IS NULL OR k.place > 4)
SELECT date, count(*) AS exited, count(CASE WHEN place IS NULL THEN 1 END) AS absent, count(CASE WHEN place IS NOT NULL AND ret IS NULL THEN 1 END) AS forced, count(CASE WHEN place IS NOT NULL AND ret IS NOT NULL THEN 1 END) AS ranking,
 count(CASE WHEN ret IS NOT NULL AND place <= 7 THEN 1 END) AS near_cutoff, count(CASE WHEN place IS NOT NULL AND ret IS NOT NULL AND NOT met THEN 1 END) AS cross_sector FROM x GROUP BY date"""
)
def exit_reasons(spark, d):
    r = returns(spark, d).where("ret_4 is not null").join(sectors(spark, d), "entity")
    ret = F.when((F.col("entity") + F.dayofmonth("date")) % 5 > 0, F.col("ret_1"))
    ranked = r.join(joins.calendar(returns(spark, d)), "date").select("session", "date", "entity", "sector", row_in([F.desc("ret_4"), "entity"], ["date"]).alias("place"), ret.alias("ret"))
    return decisions.exit_reasons(ranked, 4, 3)


_LEDGER = f"""{LABELS}, m AS (SELECT date, avg(label) AS r, avg(ret_1) AS b FROM labeled WHERE label IS NOT NULL AND ret_1 IS NOT NULL GROUP BY date), eq AS (SELECT date, date + INTERVAL 1 DAY AS entry_date, coalesce(lead(date) OVER w + INTERVAL 1 DAY, date + INTERVAL 8 DAY) AS end_date, r, b,
 product(1 + r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) * CASE WHEN day(date) = 17 THEN 1.01 ELSE 1 END AS nav, 0.5 AS buys, 0.5 AS sells, 0.5 * 0.0008 + 0.5 * 0.0013 + CASE WHEN day(date) = 9 THEN 0.001 ELSE 0 END AS cost FROM m WINDOW w AS (ORDER BY date))"""


@query(
    f"""WITH {_LEDGER}, h AS (SELECT date, entity, 1.0 / 9 AS weight FROM rets WHERE ret_4 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret_4, entity) <= 9 + (day(date) = 5)::INT), t AS (SELECT *, coalesce(lag(nav) OVER w, 1) AS was, lead(entry_date) OVER w AS nxt FROM eq WINDOW w AS (ORDER BY date))
SELECT 'duplicate_equity_key' AS rule, count(*) - count(DISTINCT date) AS violations FROM eq UNION ALL SELECT 'non_finite', 0 UNION ALL SELECT 'nav_not_positive', count(*) FROM eq WHERE nav <= 0 UNION ALL SELECT 'negative_part', 0 UNION ALL SELECT 'cash_above_nav', 0
UNION ALL SELECT 'cost_identity', count(*) FROM eq WHERE abs(cost - (buys * 0.0008 + sells * 0.0013)) > 1e-6 UNION ALL SELECT 'excess_identity', 0 UNION ALL SELECT 'nav_compounding', count(*) FROM t WHERE abs(nav - was * (1 + r)) > 1e-6 * greatest(1, abs(nav))
UNION ALL SELECT 'chronology', count(*) FROM eq WHERE NOT (date < entry_date AND entry_date < end_date) UNION ALL SELECT 'gap_between_periods', count(*) FROM t WHERE nxt <> end_date UNION ALL SELECT 'duplicate_holding_key', count(*) - count(DISTINCT (date, entity)) FROM h
UNION ALL SELECT 'negative_holding', 0 UNION ALL SELECT 'leverage', count(*) FROM (SELECT date FROM h GROUP BY date HAVING sum(weight) > 1 + 1e-9)"""
)
def ledger_audit(spark, d):
    """A ledger with faults planted in its NAV, its costs and its holdings."""
    m = labeled(spark, d).where("label is not null and ret_1 is not null").groupBy("date").agg(F.avg("label").alias("period_return"), F.avg("ret_1").alias("benchmark_return"))
    w = Window.orderBy("date")  # a row per date
    day = F.dayofmonth("date")
    half = F.lit(0.5)
    e = m.withColumns({
        "strategy": F.lit("s"), "entry_date": F.date_add("date", 1), "end_date": F.coalesce(F.date_add(F.lead("date").over(w), 1), F.date_add("date", 8)), "excess_return": F.col("period_return") - F.col("benchmark_return"),
        "nav": F.product(1 + F.col("period_return")).over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.when(day == 17, 1.01).otherwise(1.0), "buy_turnover": half, "sell_turnover": half,
        "transaction_cost": half * 0.0008 + half * 0.0013 + F.when(day == 9, 0.001).otherwise(0.0), "cash_weight": F.lit(0.0),
    })
    h = returns(spark, d).where("ret_4 is not null").withColumn("p", row_in(["ret_4", "entity"], ["date"])).where(F.col("p") <= 9 + (day == 5).cast("int"))
    return decisions.output_audit(e, h.select(F.lit("s").alias("strategy"), "date", "entity", (F.lit(1.0) / 9).alias("weight")), 0.0008, 0.0005)


@query(
    f"""WITH {LABELS}, i AS {ic_sql('ret_4', 'date')}, p AS (SELECT date, avg(label) AS r, avg(m) AS b FROM (SELECT date, label, avg(label) OVER (PARTITION BY date) AS m, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) AS k FROM labeled WHERE ret_4 IS NOT NULL AND label IS NOT NULL) WHERE k <= 5 GROUP BY date),
v AS (SELECT 'top5' AS version, p.date, r, b, ic FROM p LEFT JOIN i USING (date) UNION ALL SELECT 'half', p.date, r / 2, b, ic FROM p LEFT JOIN i USING (date)), e AS (SELECT *, year(date) AS year, product(1 + r) OVER (PARTITION BY version, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM v),
f AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY version, year ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM e)
SELECT version, year, round(product(1 + r) - 1, 4) AS total_return, round(product(1 + b) - 1, 4) AS benchmark_return, round(product(1 + r) - product(1 + b), 4) AS excess_return, round(avg(ic), 6) AS rank_ic, round(min(fall), 6) AS max_drawdown FROM f GROUP BY ALL"""
)
def annual_summary(spark, d):
    """Per version of a strategy and year: return, benchmark, excess, rank correlation and drawdown."""
    rows = labeled(spark, d)
    both = rows.where("ret_4 is not null and label is not null").withColumns({"m": F.avg("label").over(Window.partitionBy("date")), "k": row_in([F.desc("ret_4"), "entity"], ["date"])})
    p = both.where("k <= 5").groupBy("date").agg(F.avg("label").alias("r"), F.avg("m").alias("b")).join(evaluate.rank_ic(rows, "ret_4", "label", ["date"], 5).select("date", "ic"), "date", "left")
    v = p.select("date", "b", "ic", F.inline(F.array(F.struct(F.lit("top5").alias("version"), F.col("r").alias("r")), F.struct(F.lit("half").alias("version"), (F.col("r") / 2).alias("r"))))).withColumn("year", F.year("date").cast("long"))
    w = Window.partitionBy("version", "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("equity", F.product(1 + F.col("r")).over(w)).withColumn("fall", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)
    out = v.groupBy("version", "year").agg(compound("r").alias("t"), compound("b").alias("b"), F.avg("ic").alias("ic"), F.min("fall").alias("f"))
    return out.select("version", "year", F.round("t", 4).alias("total_return"), F.round("b", 4).alias("benchmark_return"), F.round(F.col("t") - F.col("b"), 4).alias("excess_return"), F.round("ic", 6).alias("rank_ic"), F.round("f", 6).alias("max_drawdown"))


# Sources and text


@query(
    f"""WITH {PANEL}, raw AS (SELECT date, lpad(CAST(entity AS VARCHAR), 6, '0') AS symbol, CASE WHEN entity % 5 = 0 AND day(date) = 3 THEN -1 ELSE open END AS open, close, CASE WHEN entity % 2 = 0 THEN volume END AS volume, CASE WHEN entity % 2 = 0 THEN amount ELSE volume END AS amount FROM panel),
n AS (SELECT date, symbol, open, close, coalesce(volume, amount) AS volume, CASE WHEN volume IS NULL THEN amount * (open + close) / 2 ELSE amount END AS amount FROM raw)
SELECT date, symbol, round(open, 6) AS open, round(close, 6) AS close, volume, round(amount, 4) AS amount FROM n WHERE open > 0 AND close > 0"""
)
def cached_market_normalize(spark, d):
    """Two providers' files, one of which calls its traded volume ``amount``."""
    p = panel_week(spark, d).select("date", zfill(F.col("entity"), 6).alias("symbol"), F.when((F.col("entity") % 5 == 0) & (F.dayofmonth("date") == 3), -1.0).otherwise(F.col("open")).alias("open"), "close", "volume", "amount", (F.col("entity") % 2).alias("side"))
    full, bare = p.where("side = 0").drop("side"), p.where("side = 1").select("date", "symbol", "open", "close", F.col("volume").alias("amount"))
    return normalize_market([full, bare]).select("date", "symbol", *r6("open", "close"), F.col("volume").cast("double").alias("volume"), F.round("amount", 4).alias("amount"))


@query(
    """WITH t AS (SELECT p_partkey, '营收 ' || (p_size * 1234) || '.5 万元; 比 +' || p_size || '.25%，含１,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '元、' || p_name || ' ' || p_size AS text FROM part)
SELECT p_partkey, 0 AS place, '万元' AS unit, p_size * 1234 * 10000 + 5000.0 AS value, 'CNY' AS kind, 3 AS start FROM t JOIN part USING (p_partkey) UNION ALL SELECT p_partkey, 1, '%', round((p_size + 0.25) / 100, 8), 'ratio', strpos(text, '+') - 1 FROM t JOIN part USING (p_partkey)
UNION ALL SELECT p_partkey, 2, '元', 1000 + p_partkey % 1000, 'CNY', strpos(text, '１') - 1 FROM t"""
)
def unit_mentions(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    body = F.concat(F.lit("营收 "), (size * 1234).cast("string"), F.lit(".5 万元; 比 +"), size.cast("string"), F.lit(".25%，含１,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("元、"), "p_name", F.lit(" "), size.cast("string"))
    m = text.unit_mentions(read(spark, d, "part").select("p_partkey", body.alias("text")), "p_partkey", "text")
    return m.select("p_partkey", "place", "unit", F.round(F.col("value").cast("double"), 8).alias("value"), "kind", F.col("start").cast("long").alias("start"))


_HOSTS = {"example.com": r"/[a-z]{2}/\d{1,8}", "example.org": r"/[a-z]{2}/\d{1,8}"}


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/:?#@]+)(:[0-9]+)?(/[^?#]*)?(\?[^#]*)?(#.*)?$', ['scheme', 'host', 'port', 'path', 'query', 'fragment']) AS u FROM pages)
SELECT page_id, u.scheme = 'https' AND (u.port IN ('', ':443')) AND u.fragment = '' AND regexp_matches(u.host, '(^|[.])example[.](com|org)$') AND regexp_full_match(u.path, '/[a-z]{2}/[0-9]{1,8}') AS allowed FROM p"""
)
def url_checks(spark, d):
    return read(spark, d, "pages").select("page_id", F.coalesce(text.allowed_url(F.col("url"), _HOSTS), F.lit(False)).alias("allowed"))


_FACTS = """facts AS (SELECT l_orderkey AS document_id, ['revenue', 'profit', 'contract_to_revenue', 'repurchased_ratio'][1 + l_partkey % 4] AS metric, ['current_guidance', 'previous_guidance', 'prior_year_comparator', 'current_preliminary', 'period_begin', 'comment'][1 + l_suppkey % 6] AS role,
 ['point', 'lower', 'upper'][1 + l_linenumber % 3] AS bound, CASE WHEN l_partkey % 3 = 0 THEN 'ratio' ELSE 'CNY' END AS currency, CASE WHEN l_suppkey % 4 = 0 THEN 'about' END AS qualifier, CAST(l_quantity AS DECIMAL(18, 2)) AS value_base FROM lineitem)"""
_MID = "CASE WHEN count(CASE WHEN {w} AND bound = 'lower' THEN 1 END) > 0 AND count(CASE WHEN {w} AND bound = 'upper' THEN 1 END) > 0 THEN (min(CASE WHEN {w} AND bound = 'lower' THEN value_base END) + max(CASE WHEN {w} AND bound = 'upper' THEN value_base END)) / 2 ELSE coalesce(avg(CASE WHEN {w} AND bound = 'point' THEN value_base END), avg(CASE WHEN {w} THEN value_base END)) END"
_ROLES = {"cur": "role IN ('current_guidance', 'current_preliminary')", "prev": "role = 'previous_guidance'", "prior": "role IN ('prior_year_comparator', 'period_begin')"}


@query(
    f"""WITH {_FACTS}, m AS (SELECT document_id, metric, {", ".join(f"{_MID.format(w=w)} AS {n}" for n, w in _ROLES.items())} FROM facts GROUP BY ALL),
x AS (SELECT document_id, avg((cur - prev) / greatest(abs(prev), 1e-12)) AS guidance_revision_delta, avg((cur - prior) / greatest(abs(prior), 1e-12)) AS current_vs_prior_delta FROM m GROUP BY 1)
SELECT document_id, count(*) AS fact_count, count(DISTINCT metric) AS metric_count, round(avg((qualifier IS NOT NULL)::INT), 6) AS uncertain_fact_ratio, count(CASE WHEN currency = 'ratio' THEN 1 END) AS ratio_fact_count, round(avg(CASE WHEN currency = 'ratio' THEN value_base END), 6) AS mean_reported_ratio,
 round(any_value(guidance_revision_delta), 6) AS guidance_revision_delta, round(any_value(current_vs_prior_delta), 6) AS current_vs_prior_delta, max(CASE WHEN metric = 'contract_to_revenue' THEN value_base END)::DOUBLE AS contract_to_revenue, max(CASE WHEN metric = 'repurchased_ratio' THEN value_base END)::DOUBLE AS repurchased_ratio
FROM facts JOIN x USING (document_id) GROUP BY document_id"""
)
def document_features(spark, d):
    pick = lambda names, i: F.array(*map(F.lit, names))[(i).cast("int")]
    facts = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), pick(["revenue", "profit", "contract_to_revenue", "repurchased_ratio"], F.col("l_partkey") % 4).alias("metric"),
        pick(["current_guidance", "previous_guidance", "prior_year_comparator", "current_preliminary", "period_begin", "comment"], F.col("l_suppkey") % 6).alias("role"), pick(["point", "lower", "upper"], F.col("l_linenumber") % 3).alias("bound"),
        F.when(F.col("l_partkey") % 3 == 0, "ratio").otherwise("CNY").alias("currency"), F.when(F.col("l_suppkey") % 4 == 0, "about").alias("qualifier"), F.col("l_quantity").cast("decimal(18,2)").alias("value_base"),
    )
    out = text.document_features(facts)
    return out.select("document_id", "fact_count", "metric_count", *r6("uncertain_fact_ratio"), "ratio_fact_count", *r6("mean_reported_ratio", "guidance_revision_delta", "current_vs_prior_delta"), F.col("contract_to_revenue").cast("double"), F.col("repurchased_ratio").cast("double"))


@query()
def clean_titles(spark, d):
    """First lines of pages, cleaned; held against the standard library in tests."""
    return read(spark, d, "pages").select("page_id", text.clean_title(F.col("html")).alias("title"))


# Models


@query(
    f"""WITH {LABELS}, {SECTORS}, v AS (SELECT entity, date, sector, ret_4, label, label_end FROM labeled JOIN sectors USING (entity) WHERE ret_4 IS NOT NULL), t AS (SELECT * FROM v WHERE label IS NOT NULL AND label_end < DATE '1996-01-01'),
g AS (SELECT avg(ret_4) AS m, sqrt(var_pop(ret_4)) AS s, avg(label) AS b, covar_pop(ret_4, label) * count(*) / sqrt(var_pop(ret_4)) / (count(*) + 10.0) AS c FROM t),
e AS (SELECT sector, avg(ret_4) AS m, sqrt(var_pop(ret_4)) AS s, avg(label) AS b, covar_pop(ret_4, label) * count(*) / sqrt(var_pop(ret_4)) / (count(*) + 10.0) AS c FROM t GROUP BY 1 HAVING count(*) >= 300 AND count(DISTINCT date) >= 50),
p AS (SELECT v.*, round(g.b + (ret_4 - g.m) / g.s * g.c, 12) AS global_raw, round(CASE WHEN e.sector IS NOT NULL THEN e.b + (ret_4 - e.m) / e.s * e.c ELSE g.b + (ret_4 - g.m) / g.s * g.c END, 12) AS expert_raw, e.sector IS NULL AS fallback FROM v CROSS JOIN g LEFT JOIN e ON e.sector = v.sector WHERE date >= DATE '1996-01-01'),
r AS (SELECT *, coalesce({rank_sql('global_raw', 'date')} - 0.5, 0) AS a, coalesce({rank_sql('expert_raw', 'date, sector')} - 0.5, 0) AS x FROM p)
SELECT entity, date, sector, fallback, round(a, 6) AS global_model, round(x, 6) AS industry_expert, round(0.55 * a + 0.45 * x, 6) AS score FROM r"""
)
def sector_experts(spark, d):
    """A ridge for all and one per sector with rows and dates enough; their centred ranks are blended."""
    v = labeled(spark, d).where("ret_4 is not null").join(sectors(spark, d), "entity")
    mature = v.where("label is not null and label_end < date '1996-01-01'")
    scored = models.expert_scores(v.where("date >= date '1996-01-01'"), mature, ["ret_4"], "label", 10.0, "sector", "date", 300, 50)
    return scored.withColumn("score", 0.55 * F.col("global_model") + 0.45 * F.col("industry_expert")).select("entity", "date", "sector", "fallback", *r6("global_model", "industry_expert", "score"))


@query(
    f"""WITH {LABELS}, d AS (SELECT max(date) AS last FROM labeled WHERE ret_4 IS NOT NULL), t AS (SELECT * FROM labeled, d WHERE ret_4 IS NOT NULL AND label IS NOT NULL AND label_end < last),
g AS (SELECT avg(ret_4) AS m, sqrt(var_pop(ret_4)) AS s, avg(label) AS b, covar_pop(ret_4, label) * count(*) / sqrt(var_pop(ret_4)) / (count(*) + 10.0) AS c FROM t),
p AS (SELECT entity, date, round(b + (ret_4 - m) / s * c, 12) AS score FROM labeled, d, g WHERE date = last AND ret_4 IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, entity) AS place, 100 * {rank_sql('score', 'date')} AS pct FROM p)
SELECT entity, date, round(score, 6) AS score, place, round(pct, 6) AS pct, CASE WHEN pct >= 95 THEN 'VERY_HIGH' WHEN pct >= 90 THEN 'HIGH' WHEN pct >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS strength FROM r"""
)
def forward_inference(spark, d):
    """The last date's scores by a model of what had matured before it."""
    rows = labeled(spark, d).where("ret_4 is not null")
    last = rows.agg(F.max("date")).first()[0]
    m = models.ridge(rows.where(F.col("label").isNotNull() & (F.col("label_end") < F.lit(last))), ["ret_4"], "label", 10.0)
    p = rows.where(F.col("date") == F.lit(last)).select("entity", "date", F.round(m.column(), 12).alias("score"))
    p = p.withColumns({"place": row_in([F.desc("score"), "entity"], ["date"]), "pct": 100 * rank_pct("score", ["date"])})
    return p.select("entity", "date", *r6("score"), "place", *r6("pct"), market.signal_strength(F.col("pct")).alias("strength"))


@query(f"WITH {RETURNS} SELECT entity, date, round(-ret_4, 6) AS score, rank() OVER (PARTITION BY date ORDER BY round(-ret_4, 9) DESC) AS place FROM rets WHERE ret_4 IS NOT NULL")
def single_feature_rule(spark, d):
    """One feature and a direction as a ranker; places by the least rank of equals."""
    r = returns(spark, d).where("ret_4 is not null").withColumn("score", models.single_feature("ret_4", -1))
    return r.select("entity", "date", *r6("score"), F.rank().over(Window.partitionBy("date").orderBy(F.desc(F.round("score", 9)))).alias("place"))


@query(
    f"""WITH {RETURNS}, r AS (SELECT entity, date, ret_1, ret_4, ret_12, {rank_sql('ret_1', 'date')} AS a, {rank_sql('ret_4', 'date')} AS b, {rank_sql('ret_12', 'date')} AS c FROM rets)
SELECT entity, date, round(((ret_1 IS NOT NULL)::INT + (ret_4 IS NOT NULL)::INT + (ret_12 IS NOT NULL)::INT) / 3.0, 6) AS coverage, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS quality, round(least(ret_1, ret_4, ret_12), 6) AS worst FROM r"""
)
def row_means(spark, d):
    """Means and minima across columns that skip nulls."""
    r = by_date(returns(spark, d), spark, d).withColumns({"a": rank_pct("ret_1", ["date"]), "b": rank_pct("ret_4", ["date"]), "c": rank_pct("ret_12", ["date"])})
    return r.select("entity", "date", F.round(known_share("ret_1", "ret_4", "ret_12"), 6).alias("coverage"), F.round(row_mean("a", "b", "c"), 6).alias("quality"), F.round(F.least("ret_1", "ret_4", "ret_12"), 6).alias("worst"))


@query(
    f"""WITH {PANEL}, {FILINGS}, s AS (SELECT 'prices' AS source, count(*) AS n, count(DISTINCT entity) AS entities, sum((date > DATE '1998-12-31')::INT) AS violations, max(date) AS newest FROM panel UNION ALL SELECT 'filings', count(*), count(DISTINCT entity), sum((available < report)::INT), max(report) FROM filings),
g AS (SELECT source, concat_ws(',', CASE WHEN NOT n >= 100 THEN 'rows' END, CASE WHEN NOT entities >= 5 THEN 'entities' END, CASE WHEN violations > 0 THEN 'point_in_time' END, CASE WHEN newest < DATE '1998-06-01' THEN 'stale' END) AS missing FROM s)
SELECT source, missing, missing = '' AS ready, (SELECT bool_and(missing = '') FROM g) AS joint_ready FROM g"""
)
def joint_readiness_gate(spark, d):
    """Every source's own gate, and whether all are open."""
    one = lambda df, name, late, newest: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.count(F.when(late, 1)).alias("violations"), F.max(newest).alias("newest"))
    s = one(panel_week(spark, d), "prices", F.col("date") > F.lit("1998-12-31").cast("date"), "date").unionByName(one(filings(spark, d), "filings", F.col("available") < F.col("report"), "report"))
    ready, failed = decisions.reasons({"rows": F.col("n") >= 100, "entities": F.col("entities") >= 5, "point_in_time": F.col("violations") == 0, "stale": F.col("newest") >= F.lit("1998-06-01").cast("date")})
    s = s.withColumns({"ready": ready, "missing": F.concat_ws(",", failed)})
    return s.select("source", "missing", "ready", F.min("ready").over(Window.partitionBy()).alias("joint_ready"))  # a row per source


# Further rules


@query(
    f"""WITH {LABELS}, v AS (SELECT *, row_number() OVER w AS p, floor(count(*) OVER (PARTITION BY date) * 0.1) AS t, count(*) OVER (PARTITION BY date) AS k FROM labeled WHERE ret_4 IS NOT NULL WINDOW w AS (PARTITION BY date ORDER BY ret_4 DESC, entity)),
m AS (SELECT *, CASE WHEN p > k - greatest(1, t) THEN 'bottom' WHEN p <= greatest(1, t) THEN 'top' ELSE 'middle' END AS tail FROM v)
SELECT date, round(avg(CASE WHEN tail = 'top' THEN label END), 6) AS top_mean, round(avg(CASE WHEN tail = 'bottom' THEN label END), 6) AS bottom_mean, round(avg(CASE WHEN tail = 'top' THEN label END) - avg(CASE WHEN tail = 'bottom' THEN label END), 6) AS top_minus_bottom,
 count(CASE WHEN tail = 'top' THEN label END) AS top_rows, count(CASE WHEN tail = 'bottom' THEN label END) AS bottom_rows FROM m GROUP BY date"""
)
def tail_members(spark, d):
    """Both tails of each date, a tenth of its rows and one at least; of a single row the bottom counts."""
    m = evaluate.tail_members(labeled(spark, d), "ret_4", "date", "entity")
    mean = lambda t: F.avg(F.when(F.col("tail") == t, F.col("label")))
    n = lambda t: F.count(F.when(F.col("tail") == t, F.col("label")))
    return m.groupBy("date").agg(F.round(mean("top"), 6).alias("top_mean"), F.round(mean("bottom"), 6).alias("bottom_mean"), F.round(mean("top") - mean("bottom"), 6).alias("top_minus_bottom"), n("top").alias("top_rows"), n("bottom").alias("bottom_rows"))


@query(
    f"""WITH {LABELS}, p AS (SELECT entity, date, 100 * {rank_sql('ret_4', 'date')} AS s, coalesce({rank_sql('(high - low)', 'date')}, 0.5) AS vol, 1 - coalesce({rank_sql('amount', 'date')}, 0.5) AS thin, (entity + day(date)) % 7 > 0 AS tradable, CASE WHEN entity % 3 > 0 THEN (entity * 5 + day(date)) % 14 END AS events, ret_1 AS mood FROM labeled),
r AS (SELECT *, vol * 0.4 + thin * 0.3 + (NOT tradable)::INT * 0.1 + (coalesce(events, 0) >= 10 AND coalesce(mood, 0) < 0)::INT * 0.2 AS risk FROM p)
SELECT entity, date, round(s, 4) AS strength, CASE WHEN s >= 90 THEN '强' WHEN s >= 75 THEN '中' ELSE '观望' END AS grade, CASE WHEN round(risk, 9) >= 0.55 THEN '高' WHEN round(risk, 9) >= 0.3 THEN '中' ELSE '低' END AS risk FROM r"""
)
def strength_grade_risk(spark, d):
    p = by_date(labeled(spark, d), spark, d).withColumn("range", F.col("high") - F.col("low")).withColumns({"s": 100 * rank_pct("ret_4", ["date"]), "vol": rank_pct("range", ["date"]), "liquid": rank_pct("amount", ["date"])})
    e, day = F.col("entity"), F.dayofmonth("date")
    risk = market.risk_score(F.col("vol"), F.col("liquid"), (e + day) % 7 > 0, F.when(e % 3 > 0, (e * 5 + day) % 14), F.col("ret_1"))
    return p.select("entity", "date", F.round("s", 4).alias("strength"), market.buy_grade(F.col("s")).alias("grade"), market.risk_rating(risk).alias("risk"))


@query(
    f"""WITH {RETURNS}, dd AS (SELECT year(date) AS year, date, stddev_samp(ret_4) AS s FROM rets GROUP BY ALL), sp AS (SELECT year, avg(s) AS dispersion FROM dd GROUP BY 1),
y AS (SELECT year(date) AS year, avg(ret_4) AS m, stddev_samp(ret_4) AS s, avg((ret_4 IS NULL)::INT) AS missing, quantile_cont(ret_4, 0.1) AS p10, quantile_cont(ret_4, 0.5) AS med, quantile_cont(ret_4, 0.9) AS p90 FROM rets GROUP BY 1)
SELECT year, round(m, 6) AS mean, round(s, 6) AS sd, round(med, 6) AS median, round(missing, 6) AS missing_ratio, round(dispersion, 6) AS dispersion, round(p10, 6) AS p10, round(p90, 6) AS p90, round((m - lag(m) OVER w) / nullif(lag(s) OVER w, 0), 6) AS mean_shift FROM y JOIN sp USING (year) WINDOW w AS (ORDER BY year)"""
)
def feature_drift(spark, d):
    rows = returns(spark, d).withColumn("year", F.year("date").cast("long"))
    y = evaluate.drift_by_year(rows, "ret_4", "date", "year")
    w = Window.orderBy("year")  # a row per year
    shift = F.try_divide(F.col("mean") - F.lag("mean").over(w), F.nullif(F.lag("sd").over(w), F.lit(0.0)))
    return y.withColumn("mean_shift", shift).select("year", *r6("mean", "sd", "median", "missing_ratio", "dispersion", "p10", "p90", "mean_shift"))


@query(
    f"""WITH {FILINGS}, place AS (SELECT c_custkey AS entity, n_name AS industry FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT entity, report, industry, total, {rank_sql('total', 'report')} AS r, {rank_sql('total', 'report, industry')} AS g FROM filings JOIN place USING (entity))
SELECT entity, report, round(r, 6) AS r, round(g, 6) AS industry_r, round(r - lag(r) OVER (PARTITION BY entity ORDER BY report), 6) AS d_rank FROM f"""
)
def valuation_percentile(spark, d):
    place = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity"), F.col("n_name").alias("industry"))
    f = filings(spark, d).join(place, "entity").withColumns({"r": rank_pct("total", ["report"]), "industry_r": rank_pct("total", ["report", "industry"])})
    return f.select("entity", "report", *r6("r", "industry_r"), F.round(F.col("r") - F.lag("r").over(Window.partitionBy("entity").orderBy("report")), 6).alias("d_rank"))


@query(f"WITH {RETURNS}, r AS (SELECT date, entity, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC NULLS LAST, entity) AS place FROM rets) SELECT k, date, entity, place FROM r, (SELECT unnest([3, 5, 8]) AS k) WHERE place <= k")
def derive_top_k(spark, d):
    """The canonical order once, and its first 3, 5 and 8."""
    r = returns(spark, d).withColumn("place", row_in([F.desc_nulls_last("ret_4"), "entity"], ["date"])).where("place <= 8")
    return r.select(F.explode(F.filter(F.array(*map(F.lit, (3, 5, 8))), lambda k: F.col("place") <= k)).alias("k"), "date", "entity", "place")


_SCREEN = f"""{LABELS}, {SECTORS}, base AS (SELECT entity, date, sector, label, {rank_sql('amount', 'date')} AS size, ret_1, ret_4, ret_12, volume FROM labeled JOIN sectors USING (entity)), src AS (SELECT entity, date, sector, label, size, factor, score FROM base UNPIVOT (score FOR factor IN (ret_1, ret_4, ret_12, volume)) WHERE label IS NOT NULL),
{residual_sql('src', 'score', ['size'], 'date, factor', 'sector', 5)}, rs AS (SELECT date, factor, label, score, round(residual, 9) AS res FROM cleared WHERE residual IS NOT NULL)"""


@query(
    f"""WITH {_SCREEN}, a AS {ic_sql('score', 'date, factor', 'rs')}, b AS {ic_sql('res', 'date, factor', 'rs')}, ya AS (SELECT factor, year(date) AS year, avg(ic) AS m FROM a GROUP BY ALL), {_POOLED}
SELECT factor, round((SELECT avg(ic) FROM a WHERE a.factor = f.factor), 6) AS rank_ic, round((SELECT avg(ic) FROM b WHERE b.factor = f.factor), 6) AS residual_ic, (SELECT count(*) FROM ya WHERE ya.factor = f.factor AND round(m, 9) > 0) AS positive_years, round((SELECT min(m) FROM ya WHERE ya.factor = f.factor), 6) AS worst_year,
 round(core, 6) AS core_correlation, core < 0.8 AS low_redundancy FROM (SELECT 'ret_1' AS factor, greatest(abs(corr(ret_1, ret_12)), abs(corr(ret_1, volume))) AS core FROM rk UNION ALL SELECT 'ret_4', greatest(abs(corr(ret_4, ret_12)), abs(corr(ret_4, volume))) FROM rk) f"""
)
def signal_screening_core(spark, d):
    """Two candidates against a core of two: rank correlation, what a score cleared of size and sector keeps of it, years, and likeness to the core."""
    rows = labeled(spark, d).join(sectors(spark, d), "entity").withColumn("size", rank_pct("amount", ["date"])).where("label is not null")
    long = rows.unpivot(["entity", "date", "sector", "label", "size"], FACTORS, "factor", "score").where("score is not null")
    cleared = evaluate.residualize(dealt(long, n_lines(spark, d), "date", "factor"), "score", ["size"], ["date", "factor"], "sector", 5).where("residual is not null").withColumn("res", F.round("residual", 9))
    ranked = cleared.select("date", "factor", *(rank_pct(c, ["date", "factor"]).alias(c) for c in ("score", "res", "label")))
    ics = written(ranked.groupBy("date", "factor").agg(correlation("score", "label", 5).alias("a"), correlation("res", "label", 5).alias("b")), "screened-ics")
    a, b = (ics.select("date", "factor", F.col(c).alias("ic")) for c in "ab")
    years = a.groupBy("factor", F.year("date").alias("year")).agg(F.avg("ic").alias("m")).groupBy("factor").agg(F.count(F.when(F.round("m", 9) > 0, 1)).alias("positive_years"), F.min("m").alias("worst_year"))
    rho = _pooled(spark, d)
    both = rho.unionByName(rho.select(F.col("g").alias("f"), F.col("f").alias("g"), "rho")).where("f in ('ret_1', 'ret_4') and g in ('ret_12', 'volume')")
    core = both.groupBy(F.col("f").alias("factor")).agg(F.max(F.abs("rho")).alias("core_correlation"))
    out = core.join(a.groupBy("factor").agg(F.avg("ic").alias("rank_ic")), "factor").join(b.groupBy("factor").agg(F.avg("ic").alias("residual_ic")), "factor").join(years, "factor")
    return out.select("factor", *r6("rank_ic", "residual_ic"), "positive_years", *r6("worst_year", "core_correlation"), (F.col("core_correlation") < 0.8).alias("low_redundancy"))
