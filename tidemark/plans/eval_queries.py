"""Aggregations, evaluation, selection, portfolios, set operations and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import compound, rank_pct, row_in, share_of, size_of
from tidemark.operators import evaluate, joins, models, portfolio, text
from tidemark.plans.panel_queries import SNAPSHOTS, by_date, labeled, returns, snapshots
from tidemark.plans.registry import CALENDAR, FILINGS, LABELS, PANEL, RETURNS, SECTORS, cdf_sql, cross_sql, query, r6, rank_sql, s6
from tidemark.sources.evidence import row_hash
from tidemark.sources.panel import cross_sections, filings, n_lines, panel_week, read, sectors
from tidemark.sources.stages import written

#: A score per label row of documents, for the classification metrics: a fixed function of its id.
PROBS = "probs AS (SELECT doc_id, quality AS y, round(0.35 + 0.3 * ((doc_id * 7919) % 101) / 101.0 + 0.25 * quality * ((doc_id % 7) / 7.0), 6) AS p, doc_id % 4 AS slice FROM labels)"


def probs(spark: SparkSession, d: str) -> DataFrame:
    p = 0.35 + 0.3 * ((F.col("doc_id") * 7919) % 101) / 101.0 + 0.25 * F.col("quality") * ((F.col("doc_id") % 7) / 7.0)
    return read(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), F.round(p, 6).alias("p"), (F.col("doc_id") % 4).alias("slice"))


# Aggregations


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS entities, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean_price,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, round(stddev_samp(l_discount), 6) AS sd_discount, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL"""
)
def group_agg_named(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    rows = read(spark, d, "lineitem")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("entities"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.round(F.stddev_samp("l_discount"), 6).alias("sd_discount"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
    )
    return sums.join(evaluate.quantiles(rows, "l_extendedprice", [0.5], *keys), keys).withColumn("median_price", F.round(F.col("q")[0], 4)).drop("q")


@query(f"WITH {RETURNS} SELECT date, round(avg(CAST(ret_1 > 0 AS DOUBLE)), 6) AS breadth, count(ret_1) AS n FROM rets GROUP BY date")
def ratio_agg(spark, d):
    return returns(spark, d).groupBy("date").agg(F.round(share_of(F.col("ret_1") > 0), 6).alias("breadth"), F.count("ret_1").alias("n"))


@query(f"WITH {RETURNS}, m AS (SELECT date, avg(ret_1) AS r FROM rets WHERE ret_1 IS NOT NULL GROUP BY date) SELECT CAST(last_day(date) AS DATE) AS month, round(product(1 + r) - 1, 6) AS r, count(*) AS weeks FROM m GROUP BY 1")
def compound_return(spark, d):
    m = returns(spark, d).where("ret_1 is not null").groupBy("date").agg(F.avg("ret_1").alias("r"))
    return m.groupBy(F.last_day("date").alias("month")).agg(F.round(compound("r"), 6).alias("r"), F.count("*").alias("weeks"))


@query(f"WITH {RETURNS} SELECT date, round(coalesce(sum(amount * ret_1) / nullif(sum(CASE WHEN ret_1 IS NOT NULL THEN amount END), 0), avg(ret_1)), 6) AS r FROM rets GROUP BY date")
def weighted_mean(spark, d):
    w = F.sum(F.when(F.col("ret_1").isNotNull(), F.col("amount")))
    return returns(spark, d).groupBy("date").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("amount") * F.col("ret_1")), F.nullif(w, F.lit(0.0))), F.avg("ret_1")), 6).alias("r"))


@query(f"WITH {LABELS} SELECT entity, date, round(avg(CASE WHEN volume > 20 THEN label END) OVER (PARTITION BY date), 6) AS benchmark FROM labeled")
def equal_weight_benchmark(spark, d):
    return labeled(spark, d).select("entity", "date", F.round(F.avg(F.when(F.col("volume") > 20, F.col("label"))).over(Window.partitionBy("date")), 6).alias("benchmark"))


@query(
    f"""WITH {PANEL}, {SNAPSHOTS}, s AS (SELECT snapshot, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS signature FROM snaps GROUP BY 1)
SELECT snapshot, signature, coalesce(signature <> lag(signature) OVER (ORDER BY snapshot), true) AS changed FROM s"""
)
def string_signature(spark, d):
    s = snapshots(spark, d).groupBy("snapshot").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entity")), lambda x: x.cast("string")), ",").alias("signature"))
    return s.withColumn("changed", F.coalesce(F.col("signature") != F.lag("signature").over(Window.orderBy("snapshot")), F.lit(True)))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY 1")
def value_counts_max(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


@query(f"WITH {PANEL} SELECT entity, round(arg_min(close, date), 6) AS first_close, round(arg_max(close, date), 6) AS last_close, count(DISTINCT date) AS dates FROM panel GROUP BY 1")
def first_last(spark, d):
    return panel_week(spark, d).groupBy("entity").agg(F.round(F.min_by("close", "date"), 6).alias("first_close"), F.round(F.max_by("close", "date"), 6).alias("last_close"), F.countDistinct("date").alias("dates"))


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS q{int(q * 100):02d}" for q in (0.01, 0.05, 0.2, 0.5, 0.8, 0.95, 0.99)) + " FROM lineitem GROUP BY 1")
def quantile_agg(spark, d):
    qs = [0.01, 0.05, 0.2, 0.5, 0.8, 0.95, 0.99]
    got = evaluate.quantiles(read(spark, d, "lineitem"), "l_extendedprice", qs, "l_returnflag")
    return got.select("l_returnflag", *(F.round(F.col("q")[i], 4).alias(f"q{int(q * 100):02d}") for i, q in enumerate(qs)))


@query(
    """WITH a AS (SELECT l_quantity * l_discount AS x FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), b AS (SELECT l_quantity * l_discount * 1.1 AS x FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'),
q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS all_edges FROM a), e AS (SELECT all_edges[2:len(all_edges) - 1] AS edges FROM q), n AS (SELECT unnest(range(len(edges) + 1)) AS bin FROM e),
c AS (SELECT len(list_filter(edges, lambda z: z <= x)) AS bin, sum(CAST(now = 0 AS INT)) AS a, sum(now) AS b FROM (SELECT x, 0 AS now FROM a UNION ALL SELECT x, 1 FROM b), e GROUP BY 1),
s AS (SELECT bin, greatest(coalesce(a, 0) / sum(a) OVER (), 1e-6) AS share_before, greatest(coalesce(b, 0) / sum(b) OVER (), 1e-6) AS share_now FROM n LEFT JOIN c USING (bin))
SELECT CAST(bin AS INT) AS bin, round(share_before, 6) AS share_before, round(share_now, 6) AS share_now, round((share_now - share_before) * ln(share_now / share_before), 6) AS psi_part FROM s"""
)
def population_stability(spark, d):
    rows = read(spark, d, "lineitem").withColumn("x", F.col("l_quantity") * F.col("l_discount"))
    before, now = rows.where("l_shipdate < timestamp_ntz '1995-06-01'"), rows.where("l_shipdate >= timestamp_ntz '1995-06-01'").withColumn("x", F.col("x") * 1.1)
    return evaluate.psi(before, now, "x").select("bin", *r6("share_before", "share_now", "psi_part"))


@query(
    f"""WITH {PROBS}, sure AS (SELECT y, CASE WHEN doc_id % 13 = 0 THEN 1.0 ELSE p END AS p FROM probs), b AS (SELECT CAST(range AS INT) AS bin FROM range(7)), g AS (SELECT CAST((p >= 0.45)::INT + (p >= 0.5)::INT + (p >= 0.55)::INT + (p >= 0.6)::INT + (p >= 0.65)::INT + (p >= 0.7)::INT AS INT) AS bin,
 count(*) AS k, avg(p) AS mean_p, avg(y) AS hit_rate FROM sure WHERE p >= 0 AND p < 1 GROUP BY 1)
SELECT bin, coalesce(k, 0) AS n, round(mean_p, 6) AS mean_p, round(hit_rate, 6) AS hit_rate, round(k / (SELECT sum(k) FROM g) * abs(mean_p - hit_rate), 6) AS ece_part FROM b LEFT JOIN g USING (bin)"""
)
def calibration_table(spark, d):
    sure = probs(spark, d).withColumn("p", F.when(F.col("doc_id") % 13 == 0, 1.0).otherwise(F.col("p")))
    return evaluate.calibration(sure, "p", "y").select("bin", "n", *r6("mean_p", "hit_rate", "ece_part"))


@query(
    f"""WITH {PROBS}, c AS (SELECT slice, sum((y = 1 AND p >= 0.5)::INT)::BIGINT AS tp, sum((y <> 1 AND p >= 0.5)::INT)::BIGINT AS fp, sum((y = 1 AND p < 0.5)::INT)::BIGINT AS fn, sum((y <> 1 AND p < 0.5)::INT)::BIGINT AS tn,
 avg((p - y) ** 2) AS brier, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss FROM probs GROUP BY 1)
SELECT slice, tp, fp, fn, tn, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
 round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
)
def confusion_metrics(spark, d):
    return evaluate.confusion(probs(spark, d), "p", "y", "slice").select("slice", "tp", "fp", "fn", "tn", *r6("brier", "log_loss", "accuracy", "precision", "recall", "balanced", "f1"))


@query(
    f"""WITH {PROBS}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM probs), s AS (SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, sum(CASE WHEN y = 1 THEN r END) AS rs FROM r)
SELECT round((rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc, n_pos, n_neg FROM s"""
)
def roc_auc(spark, d):
    return evaluate.roc_auc(probs(spark, d), "p", "y").select(*r6("auc"), "n_pos", "n_neg")


@query(
    f"""WITH {PROBS}, r AS (SELECT *, round(p, 2) AS s FROM probs), c AS (SELECT y, sum(y) OVER w / row_number() OVER w AS precision FROM r WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT round(avg(precision), 6) AS average_precision FROM c WHERE y = 1"""
)
def pr_auc(spark, d):
    return evaluate.pr_auc(probs(spark, d).withColumn("s", F.round("p", 2)), "s", "y", "doc_id").select(*r6("average_precision"))


def ic_sql(score: str, keys: str, src: str = "labeled", least: int = 5) -> str:
    return (
        f"(SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {least} AND min(a) < max(a) AND min(b) < max(b) THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS ic FROM "
        f"(SELECT *, {rank_sql(score, keys)} AS a, {rank_sql('label', keys)} AS b FROM (SELECT * FROM {src} WHERE {score} IS NOT NULL AND label IS NOT NULL)) GROUP BY {keys})"
    )


@query(f"WITH {LABELS} SELECT date, n, round(ic, 6) AS ic FROM {ic_sql('ret_4', 'date')}")
def rank_ic(spark, d):
    return evaluate.rank_ic(labeled(spark, d), "ret_4", "label", ["date"], 5).select("date", "n", *r6("ic"))


FACTORS = ["ret_1", "ret_4", "ret_12", "volume"]
_LONG = "long AS (SELECT date, label, factor, score FROM labeled UNPIVOT (score FOR factor IN (ret_1, ret_4, ret_12, volume)) WHERE label IS NOT NULL)"
_ICS = f"ics AS (SELECT date, factor, n, ic FROM {ic_sql('score', 'date, factor', 'long')})"


def factor_ics(spark: SparkSession, d: str) -> DataFrame:
    """Daily rank correlations of the factors with the label: a row per date and factor, written once for all that is asked of them."""
    return written(evaluate.rank_ic_matrix(labeled(spark, d), FACTORS, "label", "date", 5, n_lines(spark, d)), "factor-ics")


@query(f"WITH {LABELS}, {_LONG}, {_ICS} SELECT date, factor, n, round(ic, 6) AS ic FROM ics")
def rank_ic_matrix(spark, d):
    return factor_ics(spark, d).select("date", "factor", "n", *r6("ic"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS} SELECT factor, year(date) AS year, count(ic) AS n, round(avg(ic), 6) AS mean_ic, round(quantile_cont(ic, 0.5), 6) AS median_ic, round(stddev_samp(ic), 6) AS sd_ic,
 round(avg(ic) / nullif(stddev_samp(ic), 0), 4) AS icir, round(avg(CAST(round(ic, 9) > 0 AS DOUBLE)), 6) AS positive, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 4) AS t_stat FROM ics GROUP BY ALL"""
)
def ic_summary(spark, d):
    s = evaluate.ic_summary(factor_ics(spark, d).withColumn("year", F.year("date").cast("long")), "factor", "year")
    return s.select("factor", "year", "n", *r6("mean_ic", "median_ic", "sd_ic"), F.round("icir", 4).alias("icir"), *r6("positive"), F.round("t_stat", 4).alias("t_stat"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS}, y AS (SELECT max(year(date)) AS last FROM ics), m AS (SELECT factor, avg(CASE WHEN year(date) < last THEN ic END) AS before, avg(CASE WHEN year(date) = last THEN ic END) AS now FROM ics, y GROUP BY 1)
SELECT factor, round(before, 6) AS before, round(now, 6) AS now, CASE WHEN sign(before) <> sign(now) THEN 'FLIPPED' WHEN abs(now) < abs(before) / 2 THEN 'DECAYED' ELSE 'STABLE' END AS status FROM m"""
)
def factor_decay(spark, d):
    ics = factor_ics(spark, d)
    last = ics.agg(F.max(F.year("date")).alias("last"))
    m = ics.crossJoin(F.broadcast(last)).groupBy("factor").agg(F.avg(F.when(F.year("date") < F.col("last"), F.col("ic"))).alias("before"), F.avg(F.when(F.year("date") == F.col("last"), F.col("ic"))).alias("now"))
    status = F.when(F.signum("before") != F.signum("now"), "FLIPPED").when(F.abs("now") < F.abs("before") / 2, "DECAYED").otherwise("STABLE")
    return m.select("factor", *r6("before", "now"), status.alias("status"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS} SELECT factor, coalesce(CAST(year(date) AS VARCHAR), 'all') AS test_year, count(ic) AS n, round(avg(ic), 6) AS mean_ic FROM ics GROUP BY GROUPING SETS ((factor, year(date)), (factor))"""
)
def multi_level_union(spark, d):
    ics = factor_ics(spark, d).withColumn("year", F.year("date"))
    return ics.groupingSets([[F.col("factor"), F.col("year")], [F.col("factor")]], "factor", "year").agg(F.count("ic").alias("n"), F.round(F.avg("ic"), 6).alias("mean_ic")).select("factor", F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("test_year"), "n", "mean_ic")


_BUCKET5 = "1 + " + " + ".join(f"(r > 1 + (k - 1) * {i} / 5.0)::INT" for i in range(1, 5))


@query(
    f"""WITH {cross_sql("quarter")}, g AS (SELECT date FROM cross_rows GROUP BY date HAVING count(*) >= 50 AND count(DISTINCT score) >= 5),
b AS (SELECT date, label, row_number() OVER (PARTITION BY date ORDER BY score, entity) AS r, count(*) OVER (PARTITION BY date) AS k FROM cross_rows JOIN g USING (date)),
q AS (SELECT date, {_BUCKET5} AS bucket, avg(label) AS m, count(*) AS c FROM b GROUP BY ALL), s AS (SELECT max(CASE WHEN bucket = 5 THEN m END) - max(CASE WHEN bucket = 1 THEN m END) AS s FROM q GROUP BY date)
SELECT CAST(bucket AS INT) AS bucket, sum(c)::BIGINT AS n, round(avg(m), 6) AS mean_return, round((SELECT avg(s) FROM s), 6) AS spread FROM q GROUP BY bucket"""
)
def quantile_returns(spark, d):
    return evaluate.quantile_returns(cross_sections(spark, d, "quarter"), "score", "label", "date", "entity").select("bucket", "n", *r6("mean_return", "spread"))


_BUCKET10 = "1 + " + " + ".join(f"(r > 1 + (k - 1) * {i} / 10.0)::INT" for i in range(1, 10))


@query(
    f"""WITH {LABELS}, v AS (SELECT * FROM labeled WHERE label IS NOT NULL AND ret_4 IS NOT NULL), a AS (SELECT entity, date, label, row_number() OVER (PARTITION BY date ORDER BY ret_4, entity) AS r, count(*) OVER (PARTITION BY date) AS k FROM v),
s AS (SELECT entity, date, label, {_BUCKET10} AS sd FROM a), b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY label, entity) AS r, count(*) OVER (PARTITION BY date) AS k FROM s), t AS (SELECT sd, {_BUCKET10} AS ld FROM b)
SELECT CASE WHEN sd = 10 AND ld = 1 THEN 'false_high' WHEN sd = 1 AND ld = 10 THEN 'false_low' WHEN sd = ld THEN 'match' ELSE 'other' END AS pattern, count(*) AS n FROM t GROUP BY 1"""
)
def decile_error_patterns(spark, d):
    v = evaluate.buckets(labeled(spark, d).where("label is not null"), "ret_4", ["date"], 10, "entity", "sd")
    t = evaluate.buckets(v, "label", ["date"], 10, "entity", "ld")
    kind = F.when((F.col("sd") == 10) & (F.col("ld") == 1), "false_high").when((F.col("sd") == 1) & (F.col("ld") == 10), "false_low").when(F.col("sd") == F.col("ld"), "match").otherwise("other")
    return t.groupBy(kind.alias("pattern")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {PANEL}, {FILINGS} SELECT 'panel' AS source, count(*) AS n_rows, count(DISTINCT entity) AS entities, min(date) AS first_date, max(date) AS last_date, count(*) - count(DISTINCT (entity, date)) AS duplicates FROM panel
UNION ALL SELECT 'filings', count(*), count(DISTINCT entity), min(report), max(report), count(*) - count(DISTINCT (entity, report)) FROM filings"""
)
def source_profile(spark, d):
    def one(df: DataFrame, name: str, day: str) -> DataFrame:
        return df.agg(F.lit(name).alias("source"), F.count("*").alias("n_rows"), F.countDistinct("entity").alias("entities"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), (F.count("*") - F.countDistinct("entity", day)).alias("duplicates"))

    return one(panel_week(spark, d), "panel", "date").unionByName(one(filings(spark, d), "filings", "report"))


@query(
    f"""WITH {RETURNS}, {SECTORS} SELECT year(date) AS year, count(*) AS n, round(avg(CAST(ret_12 IS NOT NULL AS DOUBLE)), 6) AS ret_coverage, round(avg(CAST(sector IS NOT NULL AS DOUBLE)), 6) AS sector_coverage,
 avg(CAST(ret_12 IS NOT NULL AS DOUBLE)) >= 0.95 AS healthy FROM rets LEFT JOIN sectors USING (entity) GROUP BY 1"""
)
def exposure_coverage(spark, d):
    rows = returns(spark, d).join(sectors(spark, d), "entity", "left").groupBy(F.year("date").cast("long").alias("year"))
    cover = lambda c: share_of(F.col(c).isNotNull())
    return rows.agg(F.count("*").alias("n"), F.round(cover("ret_12"), 6).alias("ret_coverage"), F.round(cover("sector"), 6).alias("sector_coverage"), (cover("ret_12") >= 0.95).alias("healthy"))


@query(
    f"""WITH {LABELS} SELECT year(date) AS year, count(*) AS n, round(avg(abs(label - ret_1)), 6) AS mae, round(sqrt(avg((label - ret_1) ** 2)), 6) AS rmse FROM labeled WHERE label IS NOT NULL AND ret_1 IS NOT NULL GROUP BY 1"""
)
def horizon_return_metrics(spark, d):
    e = labeled(spark, d).where("label is not null and ret_1 is not null").withColumn("e", F.col("label") - F.col("ret_1"))
    return e.groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"))


# Windows over cross-sections


@query(f"WITH {LABELS}, r AS (SELECT entity, date, {rank_sql('ret_4', 'date')} AS r FROM labeled), p AS (SELECT *, lag(r) OVER (PARTITION BY entity ORDER BY date) AS was FROM r) SELECT date, round(avg(abs(r - was)), 6) AS rank_turnover, count(r - was) AS n FROM p GROUP BY date")
def rank_persistence(spark, d):
    r = by_date(labeled(spark, d), spark, d).select("entity", "date", rank_pct("ret_4", ["date"]).alias("r"))
    moved = r.withColumn("move", F.col("r") - F.lag("r").over(Window.partitionBy("entity").orderBy("date")))
    return moved.groupBy("date").agg(F.round(F.avg(F.abs("move")), 6).alias("rank_turnover"), F.count("move").alias("n"))


@query(
    f"""WITH {RETURNS}, {CALENDAR}, t AS (SELECT entity, date, session FROM rets JOIN calendar USING (date) WHERE ret_4 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) <= 5)
SELECT a.date, count(b.entity) AS kept, round(count(b.entity) / count(*), 6) AS retention FROM t a LEFT JOIN t b ON a.entity = b.entity AND b.session = a.session - 1 GROUP BY a.date"""
)
def topk_retention(spark, d):
    r = returns(spark, d)
    t = portfolio.top_k(r, "ret_4", ["date"], 5, "entity").join(joins.calendar(r), "date").select("entity", "date", "session")
    before = t.select("entity", (F.col("session") + 1).alias("session"), F.lit(1).alias("was"))
    return t.join(before, ["entity", "session"], "left").groupBy("date").agg(F.count("was").alias("kept"), F.round(F.count("was") / F.count("*"), 6).alias("retention"))


@query(f"WITH {LABELS}, {SECTORS} SELECT entity, date, row_number() OVER (PARTITION BY date, sector ORDER BY label, entity) / count(*) OVER (PARTITION BY date, sector) > 0.8 AS winner FROM labeled JOIN sectors USING (entity) WHERE label IS NOT NULL")
def tail_labels(spark, d):
    v = labeled(spark, d).where("label is not null").join(sectors(spark, d), "entity")
    return v.select("entity", "date", (row_in(["label", "entity"], ["date", "sector"]) / size_of(["date", "sector"]) > 0.8).alias("winner"))


@query(f"WITH {RETURNS}, r AS (SELECT entity, date, row_number() OVER (PARTITION BY date ORDER BY ret_4, entity) AS r, count(*) OVER (PARTITION BY date) AS k FROM rets WHERE ret_4 IS NOT NULL) SELECT entity, date, CAST({_BUCKET5} AS INT) AS quintile FROM r")
def quintile_bucket(spark, d):
    return evaluate.buckets(returns(spark, d), "ret_4", ["date"], 5, "entity", "quintile").select("entity", "date", "quintile")


@query(
    f"""WITH {LABELS}, v AS (SELECT date, entity, {rank_sql('ret_4', 'date')} AS a, {rank_sql('ret_12', 'date')} AS b, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) <= 5 AS ta, row_number() OVER (PARTITION BY date ORDER BY ret_12 DESC, entity) <= 5 AS tb
 FROM labeled WHERE ret_4 IS NOT NULL AND ret_12 IS NOT NULL)
SELECT date, round(CASE WHEN count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) AS rho, sum((ta AND tb)::INT)::BIGINT AS common FROM v GROUP BY date"""
)
def ranking_differences(spark, d):
    from tidemark.functions.expr import correlation

    v = by_date(labeled(spark, d).where("ret_4 is not null and ret_12 is not null"), spark, d).withColumns({"a": rank_pct("ret_4", ["date"]), "b": rank_pct("ret_12", ["date"]), "ta": row_in([F.desc("ret_4"), "entity"], ["date"]) <= 5, "tb": row_in([F.desc("ret_12"), "entity"], ["date"]) <= 5})
    return v.groupBy("date").agg(F.round(correlation("a", "b", 5), 6).alias("rho"), F.sum((F.col("ta") & F.col("tb")).cast("long")).alias("common"))


# Selection and portfolios


@query(f"WITH {RETURNS} SELECT date, entity, round(ret_4, 6) AS ret_4, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) AS place FROM rets WHERE ret_4 IS NOT NULL QUALIFY place <= 10")
def topk_per_date(spark, d):
    return portfolio.top_k(returns(spark, d), "ret_4", ["date"], 10, "entity").select("date", "entity", *r6("ret_4"), "place")


@query(
    f"""WITH {RETURNS}, {SECTORS}, v AS (SELECT date, entity, sector, entity % 3 = 0 AS held, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) AS place FROM rets JOIN sectors USING (entity) WHERE ret_4 IS NOT NULL),
f AS (SELECT *, (NOT (held AND place <= 15))::INT AS fresh FROM v), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY fresh, place) <= 4)
SELECT date, entity, sector, row_number() OVER (PARTITION BY date ORDER BY fresh, place) AS pick FROM c QUALIFY pick <= 10"""
)
def select_buffer_cap(spark, d):
    v = returns(spark, d).join(sectors(spark, d), "entity").withColumn("held", F.col("entity") % 3 == 0)
    return portfolio.buffer_cap(v, "ret_4", "held", "date", "sector", "entity", 10, 5, 4).select("date", "entity", "sector", "pick")


_QUOTAS = """g AS (SELECT date, grp, count(*) AS size FROM v GROUP BY ALL), s AS (SELECT *, least(n_places, sum(size) OVER d) AS target, size / sum(size) OVER d * least(n_places, sum(size) OVER d) AS share FROM g, places WINDOW d AS (PARTITION BY date)),
w AS (SELECT *, least(greatest(floor(round(share, 9)), 1), size)::BIGINT AS whole FROM s), l AS (SELECT *, target - sum(whole) OVER (PARTITION BY date) AS spare, row_number() OVER (PARTITION BY date ORDER BY whole < size DESC, round(share - whole, 9) DESC, grp) AS turn FROM w),
t AS (SELECT date, grp, count(*) AS taken FROM (SELECT date, grp, spare, row_number() OVER (PARTITION BY date ORDER BY round(whole - share - k, 9) DESC, grp) AS turn FROM (SELECT *, unnest(range(whole - 1)) AS k FROM l WHERE spare < 0 AND whole > 1)) WHERE turn <= -spare GROUP BY ALL),
quotas AS (SELECT l.date, l.grp, size, (whole + (turn <= spare AND whole < size)::INT - coalesce(taken, 0))::BIGINT AS quota FROM l LEFT JOIN t USING (date, grp))"""


@query(f"WITH {cross_sql('quarter')}, v AS (SELECT date, industry AS grp FROM cross_rows), places AS (SELECT 30 AS n_places), {_QUOTAS} SELECT date, grp AS industry, quota FROM quotas")
def sector_quotas(spark, d):
    sizes = cross_sections(spark, d, "quarter").groupBy("date", "industry").agg(F.count("*").alias("size"))
    return portfolio.quotas(sizes, "date", "industry", "size", 30)


@query(f"WITH {cross_sql('quarter')}, v AS (SELECT date, industry AS grp FROM cross_rows), places AS (SELECT 12 AS n_places), {_QUOTAS} SELECT date, grp AS industry, quota FROM quotas")
def sector_quotas_scarce(spark, d):
    """Fewer places than groups with large ones among them: places are taken back."""
    sizes = cross_sections(spark, d, "quarter").groupBy("date", "industry").agg(F.count("*").alias("size"))
    return portfolio.quotas(sizes, "date", "industry", "size", 12)


@query(
    f"""WITH {RETURNS}, {SECTORS}, v AS (SELECT *, sector AS grp, CASE WHEN entity % 7 = 0 THEN 0.0 ELSE high - low + 1 END AS risk FROM rets JOIN sectors USING (entity) WHERE ret_4 IS NOT NULL), places AS (SELECT 10 AS n_places), {_QUOTAS},
c AS (SELECT v.date, v.entity, v.sector, size, 1 / greatest(risk, 1e-6) AS inv FROM v JOIN quotas q ON q.date = v.date AND q.grp = v.sector QUALIFY row_number() OVER (PARTITION BY v.date, v.sector ORDER BY ret_4 DESC, entity) <= quota),
r AS (SELECT *, inv / sum(inv) OVER (PARTITION BY date, sector) * size AS raw, count(*) OVER (PARTITION BY date) AS n FROM c)
SELECT date, entity, sector, round(raw / sum(raw) OVER (PARTITION BY date), 6) AS weight FROM r WHERE n >= 4"""
)
def select_sector_balanced(spark, d):
    risk = F.when(F.col("entity") % 7 == 0, 0.0).otherwise(F.col("high") - F.col("low") + 1)
    v = returns(spark, d).join(sectors(spark, d), "entity").withColumn("risk", risk)
    return portfolio.sector_balanced(v, "ret_4", "risk", "date", "sector", "entity", 10, 4).select("date", "entity", "sector", *r6("weight"))


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def tail_per_group(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.o_orderkey", F.to_date("x.o_orderdate").alias("day"))


@query("SELECT lang, source, arg_min(doc_id, sha256(CAST(doc_id AS VARCHAR))) AS doc_id FROM documents GROUP BY ALL")
def stratified_min_hash_pilot(spark, d):
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.min_by("doc_id", F.sha2(F.col("doc_id").cast("string"), 256)).alias("doc_id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) = 1")
def dedup_keep_last(spark, d):
    last = F.max(F.struct("l_shipdate", "l_partkey", "l_extendedprice")).alias("x")
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(last).select("l_orderkey", "l_linenumber", "x.l_partkey", F.round("x.l_extendedprice", 2).alias("l_extendedprice"))


_TOP = f"top AS (SELECT date, entity, row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) AS place FROM rets WHERE ret_4 IS NOT NULL QUALIFY place <= 10)"


@query(
    f"""WITH {RETURNS}, {CALENDAR}, {_TOP}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM top)), h AS (SELECT entity, session, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM top JOIN d USING (date)),
m AS (SELECT coalesce(a.session, b.session + 1) AS session, coalesce(a.w, 0) - coalesce(b.w, 0) AS x FROM h a FULL JOIN h b ON a.entity = b.entity AND a.session = b.session + 1)
SELECT date, round(sum(greatest(x, 0)), 6) AS bought, round(sum(greatest(-x, 0)), 6) AS sold, round(sum(greatest(x, 0)) * 0.0005 + sum(greatest(-x, 0)) * 0.0015, 8) AS cost FROM m JOIN d USING (session) GROUP BY date"""
)
def turnover_costs(spark, d):
    top = portfolio.top_k(returns(spark, d), "ret_4", ["date"], 10, "entity")
    held = portfolio.weighted(top, "equal", "date").select("date", "entity", "weight")
    return portfolio.turnover(held, joins.calendar(held)).select("date", *r6("bought", "sold"), F.round("cost", 8).alias("cost"))


@query(
    f"""WITH {RETURNS}, {_TOP}, t AS (SELECT top.*, max(place) OVER (PARTITION BY top.date) AS n, CASE WHEN top.entity % 8 = 0 THEN 0.0 ELSE high - low END AS risk FROM top JOIN rets USING (date, entity)), x AS (SELECT *, exp(-(place - 1) / greatest(1, n / 3.0)) AS e, 1 / greatest(risk, 1e-6) AS i FROM t)
SELECT date, entity, round(1.0 / count(*) OVER d, 6) AS equal, round((n - place + 1.0) / sum(n - place + 1.0) OVER d, 6) AS rank, round(e / sum(e) OVER d, 6) AS decay, round(i / sum(i) OVER d, 6) AS inverse_vol FROM x WINDOW d AS (PARTITION BY date)"""
)
def portfolio_weights(spark, d):
    top = portfolio.top_k(returns(spark, d), "ret_4", ["date"], 10, "entity").withColumn("risk", F.when(F.col("entity") % 8 == 0, 0.0).otherwise(F.col("high") - F.col("low")))
    kinds = ["equal", "rank", "decay", "inverse_vol"]
    for kind in kinds:
        top = portfolio.weighted(top, kind, "date", kind, "risk", "place")
    return top.select("date", "entity", *r6(*kinds))


_DAILY = f"{LABELS}, pnl AS (SELECT date, avg(label) AS r FROM (SELECT * FROM labeled WHERE ret_4 IS NOT NULL AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret_4 DESC, entity) <= 10) GROUP BY date)"


def pnl(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.top_k(labeled(spark, d).where("label is not null"), "ret_4", ["date"], 10, "entity").groupBy("date").agg(F.avg("label").alias("r"))


@query(
    f"""WITH {_DAILY}, e AS (SELECT year(date) AS year, date, r, product(1 + r) OVER w AS equity FROM pnl WINDOW w AS (PARTITION BY year(date) ORDER BY date ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY year ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS fall FROM e)
SELECT year, count(r) AS periods, round(product(1 + r) - 1, 4) AS total_return, round(product(1 + r) ** (52.0 / count(r)) - 1, 4) AS cagr, round(stddev_samp(r) * sqrt(52), 5) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(52), 4) AS sharpe,
 round(avg(r) / nullif(sqrt(avg(least(r, 0) ** 2)), 0) * sqrt(52), 4) AS sortino, round(min(fall), 6) AS max_drawdown, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS hit_rate FROM f GROUP BY year"""
)
def performance_summary(spark, d):
    out = evaluate.performance(pnl(spark, d).withColumn("year", F.year("date").cast("long")), "r", "date", 52.0, "year")
    r = lambda c, k: F.round(c, k).alias(c)
    return out.select("year", "periods", r("total_return", 4), r("cagr", 4), r("volatility", 5), r("sharpe", 4), r("sortino", 4), r("max_drawdown", 6), r("hit_rate", 6))


@query(f"WITH {_DAILY}, g AS (SELECT unnest([0, 5, 10, 20]) AS bps) SELECT CAST(bps AS INT) AS bps, round(avg(r - 2 * bps / 10000.0), 6) AS mean_net, round(product(1 + r - 2 * bps / 10000.0) - 1, 4) AS total_net FROM pnl, g GROUP BY bps")
def cost_sensitivity(spark, d):
    grid = spark.createDataFrame([(b,) for b in (0, 5, 10, 20)], "bps int")
    net = pnl(spark, d).crossJoin(F.broadcast(grid)).withColumn("net", F.col("r") - 2 * F.col("bps") / 10000.0)
    return net.groupBy("bps").agg(F.round(F.avg("net"), 6).alias("mean_net"), F.round(compound("net"), 4).alias("total_net"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS}, k AS (SELECT *, year(date) AS year FROM ics WHERE ic IS NOT NULL AND (factor <> 'volume' OR month(date) < 4)), u AS (SELECT factor, year, date, ic - avg(ic) OVER (PARTITION BY factor, year) AS u, ic FROM k),
l AS (SELECT *, {", ".join(f"u * lag(u, {k}) OVER w AS g{k}" for k in range(1, 6))} FROM u WINDOW w AS (PARTITION BY factor, year ORDER BY date)),
m AS (SELECT factor, year, count(*) AS n, avg(ic) AS mean, sqrt(greatest(sum(u * u) + {" + ".join(f"{2 * (1 - k / 6)} * coalesce(sum(g{k}), 0)" for k in range(1, 6))}, 0)) / count(*) AS se FROM l GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 20 THEN 0 WHEN se > 0 THEN mean / se WHEN mean <> 0 THEN sign(mean) * 'inf'::DOUBLE ELSE 0 END AS t FROM m)
SELECT factor, year, n, round(mean, 6) AS mean, round(t, 4) AS hac_t, round(CASE WHEN n < 20 THEN 1 WHEN isinf(t) THEN 0 ELSE 2 * (1 - {cdf_sql("abs(t)")}) END, 6) AS p FROM t"""
)
def hac_t_stat(spark, d):
    ics = factor_ics(spark, d).where("factor <> 'volume' or month(date) < 4").withColumn("year", F.year("date").cast("long"))
    return evaluate.hac_t(ics, "ic", "date", "factor", "year").select("factor", "year", "n", *r6("mean"), F.round("hac_t", 4).alias("hac_t"), *r6("p"))


@query(
    """WITH g AS (SELECT p_brand, p_type, round(((sum(p_size) * 7919) % 10007) / 10007.0, 6) AS p FROM part GROUP BY ALL), p AS (SELECT p_brand, p_type, CASE WHEN p BETWEEN 0.3 AND 0.35 THEN NULL WHEN p > 0.9 THEN p + 0.2 ELSE p END AS p FROM g), k AS (SELECT *, greatest(0, least(1, coalesce(p, 1))) AS q FROM p),
r AS (SELECT *, q * count(*) OVER () / row_number() OVER (ORDER BY q, p_brand, p_type) AS raw FROM k)
SELECT p_brand, p_type, p, round(least(min(raw) OVER (ORDER BY q DESC, p_brand DESC, p_type DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS adjusted_p FROM r"""
)
def bh_fdr(spark, d):
    p = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.round(((F.sum("p_size") * 7919) % 10007) / 10007.0, 6).alias("p"))
    p = p.withColumn("p", F.when(F.col("p").between(0.3, 0.35), None).when(F.col("p") > 0.9, F.col("p") + 0.2).otherwise(F.col("p")))
    return evaluate.bh_fdr(p, "p").select("p_brand", "p_type", "p", *r6("adjusted_p"))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS}, y AS (SELECT factor, year(date) AS year, avg(ic) AS m FROM ics GROUP BY ALL), b AS (SELECT year, arg_max(factor, round(m, 9)) AS factor FROM y GROUP BY year)
SELECT b.year + 1 AS year, b.factor AS chosen, round(y.m, 6) AS mean_ic FROM b JOIN y ON y.factor = b.factor AND y.year = b.year + 1"""
)
def nested_year_selection(spark, d):
    y = factor_ics(spark, d).groupBy("factor", F.year("date").cast("long").alias("year")).agg(F.avg("ic").alias("m"))
    best = y.groupBy("year").agg(F.max_by("factor", F.round("m", 9)).alias("factor")).select((F.col("year") + 1).alias("year"), "factor")
    return best.join(y, ["year", "factor"]).select("year", F.col("factor").alias("chosen"), F.round("m", 6).alias("mean_ic"))


# Sets and shapes


@query(
    """SELECT 'both' AS kind, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT 'only_orders', k FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events)"""
)
def set_operations(spark, d):
    a, b = read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "events").select(F.col("user_id").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(a.subtract(b).select(F.lit("only_orders").alias("kind"), "k"))


@query(f"WITH {RETURNS} SELECT entity, date, factor, round(score, 6) AS score FROM rets UNPIVOT (score FOR factor IN (ret_1, ret_4, ret_12))")
def unpivot_factors(spark, d):
    return returns(spark, d).unpivot(["entity", "date"], ["ret_1", "ret_4", "ret_12"], "factor", "score").where("score is not null").select("entity", "date", "factor", *r6("score"))


@query("SELECT user_id, " + ", ".join(f"count(CASE WHEN event_type = '{t}' THEN 1 END) AS n_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def pivot_long_to_wide(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = read(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return wide.select("user_id", *(F.coalesce(k, F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds))


@query(
    f"""WITH {PANEL}, {SNAPSHOTS}, q AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS i FROM (SELECT DISTINCT snapshot FROM snaps)), g AS (SELECT entity, snapshot, i - row_number() OVER (PARTITION BY entity ORDER BY i) AS island FROM snaps JOIN q USING (snapshot))
SELECT entity, min(snapshot) AS member_from, max(snapshot) AS member_until, count(*) AS quarters FROM g GROUP BY entity, island"""
)
def gaps_islands(spark, d):
    s = snapshots(spark, d)
    numbered = s.join(joins.calendar(s, "snapshot"), "snapshot")
    island = F.col("session") - row_in(["session"], ["entity"])
    return numbered.withColumn("island", island).groupBy("entity", "island").agg(F.min("snapshot").alias("member_from"), F.max("snapshot").alias("member_until"), F.count("*").alias("quarters")).drop("island")


@query(
    """WITH h AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS k FROM lineitem GROUP BY ALL)
SELECT CASE WHEN n = 1 THEN 'unique' WHEN k = 1 THEN 'exact_duplicate' ELSE 'conflict' END AS kind, count(*) AS keys, sum(n)::BIGINT AS n_rows FROM h GROUP BY 1"""
)
def conflicting_duplicates(spark, d):
    rows = read(spark, d, "lineitem")
    h = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct(row_hash(rows, ["l_partkey", "l_suppkey", "l_quantity"])).alias("k"))
    kind = F.when(F.col("n") == 1, "unique").when(F.col("k") == 1, "exact_duplicate").otherwise("conflict")
    return h.groupBy(kind.alias("kind")).agg(F.count("*").alias("keys"), F.sum("n").alias("n_rows"))


@query("SELECT n_name, string_agg(s_name, ',' ORDER BY s_name) AS missing FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 AND l_shipdate >= TIMESTAMP '1997-01-01') GROUP BY 1")
def unmatched_report(spark, d):
    late = read(spark, d, "lineitem").where("l_quantity = 50 and l_discount = 0.1 and l_shipdate >= timestamp_ntz '1997-01-01'").select(F.col("l_suppkey").alias("s_suppkey"))
    s, n = read(spark, d, "supplier").join(late, "s_suppkey", "left_anti"), read(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("missing"))


@query(
    """WITH t AS (SELECT o_custkey, year(o_orderdate) AS year FROM orders GROUP BY o_custkey, year(o_orderdate) QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY sum(o_totalprice) DESC, o_custkey) <= 50), n AS (SELECT year, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.year, count(*) AS common FROM t a JOIN t b ON a.o_custkey = b.o_custkey AND b.year = a.year + 1 GROUP BY 1)
SELECT n.year, m.n + n.n - coalesce(common, 0) AS either, coalesce(common, 0) AS common, round(coalesce(common, 0) / (m.n + n.n - coalesce(common, 0)), 6) AS jaccard FROM n JOIN n m ON m.year = n.year + 1 LEFT JOIN c ON c.year = n.year"""
)
def jaccard_stability(spark, d):
    sums = read(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    t = portfolio.top_k(sums, "v", ["year"], 50, "o_custkey").select("o_custkey", "year")
    n = t.groupBy("year").agg(F.count("*").alias("n"))
    common = t.join(t.select("o_custkey", (F.col("year") - 1).alias("year")), ["o_custkey", "year"]).groupBy("year").agg(F.count("*").alias("k"))
    both = n.join(n.select((F.col("year") - 1).alias("year"), F.col("n").alias("m")), "year").join(common, "year", "left").withColumn("common", F.coalesce("k", F.lit(0)))
    return both.select("year", (F.col("n") + F.col("m") - F.col("common")).alias("either"), "common", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("jaccard"))


# Text


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?')) AS n, CAST(try_cast(regexp_extract(text, '[0-9]+(\\.[0-9]+)?') AS DECIMAL(38, 8)) AS DOUBLE) AS first_value FROM documents WHERE regexp_matches(text, '[0-9]')")
def number_mentions(spark, d):
    m = text.number_mentions(read(spark, d, "documents"), "doc_id", "text")
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 0, F.col("value"))).cast("double").alias("first_value"))


_NGRAMS = "WITH g AS (SELECT doc_id, unnest([substr(text, CAST(i AS INT), 3) FOR i IN range(1, length(text) - 1)]) AS g FROM documents) SELECT doc_id, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM g GROUP BY 1"


@query(_NGRAMS)
def char_ngrams(spark, d):
    """Character trigrams of every document, whatever its length."""
    return text.ngram_counts(read(spark, d, "documents"), "doc_id", "text", 3)


@query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT e.user_id, d.day, round(sum(v * 0.5 ** (date_diff('day', e.day, d.day) / 5.0)), 4) AS score FROM e JOIN d ON d.day >= e.day AND d.day < e.day + INTERVAL 15 DAY GROUP BY ALL"""
)
def decayed_event_score(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = text.decayed_score(e.where("event_type = 'purchase'"), e.select("day").distinct(), "user_id", "day", "value", 5, 15)
    return out.select("user_id", "day", F.round("score", 4).alias("score"))


# Models and path-dependent operators: checked in tests against recomputation


@query()
def logistic_platt(spark, d):
    """Logistic ridge of document quality on simple text features, calibrated."""
    docs = read(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("size"), F.regexp_count("text", F.lit("[#$%&*!|]")).cast("double").alias("marks"))
    rows = docs.join(read(spark, d, "labels"), "doc_id").withColumn("y", F.col("quality").cast("double")).withColumn("density", F.col("marks") / F.greatest("size", F.lit(1.0)))
    rows = rows.select("doc_id", "y", "density", "size").checkpoint() if spark.sparkContext.getCheckpointDir() else rows  # every round reads the rows again
    m = models.logistic(rows, ["density", "size"], "y", 1.0)
    scored = rows.withColumn("score", m.column())
    a, b = models.monotone_platt(scored, "score", "y")
    return scored.select("doc_id", "y", F.round(models.sigmoid(F.col("score") * a + b), 6).alias("p"))


@query(
    f"""WITH RECURSIVE {RETURNS}, m AS (SELECT date, avg(ret_1) / 8 AS r FROM rets WHERE ret_1 IS NOT NULL GROUP BY date), e AS (SELECT date, product(1 + r) OVER w AS equity, CASE WHEN count(r) OVER t >= 12 THEN sum(r) OVER t END AS momentum
 FROM m WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING), t AS (ORDER BY date ROWS 11 PRECEDING)),
f AS (SELECT date, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d, coalesce(momentum, 0) AS m, row_number() OVER (ORDER BY date) AS n FROM e),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS date, 'full' AS state UNION ALL
 SELECT f.n, f.date, CASE WHEN f.d <= -0.12 THEN 'defensive' WHEN s.state = 'defensive' THEN CASE WHEN f.d > -0.08 AND f.m > 0 THEN 'cautious' ELSE 'defensive' END WHEN f.d <= -0.06 THEN 'cautious'
  WHEN s.state = 'cautious' AND f.d > -0.04 AND f.m > 0 THEN 'full' ELSE s.state END FROM s JOIN f ON f.n = s.n + 1)
SELECT date, state, (CASE state WHEN 'full' THEN 1.0 WHEN 'cautious' THEN 0.7 ELSE 0.4 END)::DOUBLE AS exposure FROM s WHERE n > 0"""
)
def regime_states(spark, d):
    m = returns(spark, d).where("ret_1 is not null").groupBy("date").agg((F.avg("ret_1") / 8).alias("r")).withColumn("market", F.lit("all"))
    w = Window.partitionBy("market").orderBy("date")  # a row per date
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("equity", F.product(1 + F.col("r")).over(far)).withColumn("drawdown", F.col("equity") / F.max("equity").over(far) - 1)
    m = m.withColumn("momentum", F.when(F.count("r").over(w.rowsBetween(-11, 0)) >= 12, F.sum("r").over(w.rowsBetween(-11, 0))))
    return portfolio.regime_states(m, "market", "date", "drawdown", "momentum").select("date", "state", F.col("exposure").cast("double"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Two strategies' scores and prices, from one reading of the panel."""
    return returns(spark, d).unpivot(["date", "entity", F.col("open").alias("price")], ["ret_4", "ret_12"], "strategy", "score")


@query()
def nav_ledger(spark, d):
    return portfolio.ledger(signals(spark, d), 10, 10.0)
