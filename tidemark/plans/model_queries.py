"""Boosted trees, resampling and importance, each beside SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import share_of
from tidemark.operators import joins, models, resampling, trees
from tidemark.plans.eval_queries import _ICS, _LONG, factor_ics
from tidemark.plans.panel_queries import labeled
from tidemark.plans.registry import LABELS, query, rank_sql
from tidemark.sources.panel import sectors
from tidemark.sources.stages import written

FEATURES = ["ret_1", "ret_4", "ret_12"]
SPLIT = "date '1997-01-01'"
#: Fewer and faster rounds than the defaults: the registered queries show the method on panels of any size.
SETTINGS = trees.Settings(rounds=6, rate=0.1, depth=3, leaves=6, least=20, l1=1.0, l2=5.0)


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose labels ended before a date, and the rows from it on; fits read them many times, so they are written once."""
    rows = written(labeled(spark, d).join(sectors(spark, d), "entity").select("entity", "date", "sector", "label", "label_end", *FEATURES), "model-panel")
    return rows.where(f"label is not null and label_end < {SPLIT}"), rows.where(f"date >= {SPLIT}")


@query()
def lambdarank_scores(spark, d):
    """Relevance ranking within dates: LambdaRank on fifths of the label, scored on later dates."""
    train, test = _panel(spark, d)
    model = trees.fit(trees.relevance(train, "label", ["date"], "entity"), FEATURES, "relevance", "lambdarank", SETTINGS, "date", "entity")
    return test.select("entity", "date", F.round(model.column(), 6).alias("score"))


@query()
def boosted_l1(spark, d):
    """Absolute-loss trees of the label, with the median of each leaf."""
    train, test = _panel(spark, d)
    model = trees.fit(train, FEATURES, "label", "l1", SETTINGS)
    return test.select("entity", "date", F.round(model.column(), 6).alias("score"))


@query()
def two_stage_product(spark, d):
    """The chance of a sector's best fifth times the size of a good outcome."""
    train, test = _panel(spark, d)
    model = trees.fit_two_stage(train, FEATURES, "label", ["date", "sector"], "entity", trees.Settings(**{**SETTINGS.__dict__, "positive_weight": 4.0, "l2": 10.0, "seed": 44}))
    out = model.score(test)
    return out.select("entity", "date", *(F.round(c, 6).alias(c) for c in ("probability", "magnitude", "score")))


@query()
def gbt_direction(spark, d):
    """Log-loss trees of the label's direction, as probabilities of a rise on later dates."""
    train, test = _panel(spark, d)
    up = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    model = trees.fit(train.withColumn("up", up), FEATURES, "up", "binary", SETTINGS)
    return test.where("label is not null").select("entity", "date", F.round(models.sigmoid(model.column()), 6).alias("p"), up.alias("up"))


# Resampling

BLOCK, REPLICATIONS, SEED = 6, 200, 42


def _bootstrap_sql(pairs: str) -> str:
    """CTEs that end in ``boot``. pairs: a CTE of factor, date, a, b."""
    start = f"CAST('0x' || substr(md5(concat_ws(':', '{SEED}', factor, r, j)), 1, 13) AS BIGINT) % (n - {BLOCK} + 1)"
    return f"""{pairs}, delta AS (SELECT factor, date, CAST(round(a - b, 12) AS DECIMAL(38,12)) AS delta FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
placed AS (SELECT factor, delta, row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS pos FROM delta), whole AS (SELECT factor, count(*) AS n, sum(delta) AS total FROM placed GROUP BY 1),
prefix AS (SELECT factor, pos, coalesce(sum(delta) OVER (PARTITION BY factor ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM placed UNION ALL SELECT factor, n, total FROM whole),
blocks AS (SELECT factor, n, r, j, {start} AS first, least({BLOCK}, n - j * {BLOCK}) AS size FROM (SELECT *, unnest(range(CAST(ceil(n / {BLOCK}) AS BIGINT))) AS j FROM (SELECT *, unnest(range({REPLICATIONS})) AS r FROM whole WHERE n >= 2 * {BLOCK}))),
means AS (SELECT k.factor, r, sum(y.s - x.s)::DOUBLE / min(n) AS m FROM blocks k JOIN prefix x ON x.factor = k.factor AND x.pos = first JOIN prefix y ON y.factor = k.factor AND y.pos = first + size GROUP BY 1, 2),
bounds AS (SELECT factor, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY 1),
boot AS (SELECT factor, n AS samples, total::DOUBLE / n AS mean_delta, lo AS ci_lower, hi AS ci_upper FROM whole LEFT JOIN bounds USING (factor))"""


_PAIRS = "pairs AS (SELECT f.factor, date, f.ic AS a, g.ic AS b FROM ics f JOIN ics g USING (date) WHERE g.factor = 'ret_12' AND f.factor <> 'ret_12')"


def _paired_ics(spark: SparkSession, d: str) -> DataFrame:
    """Daily correlations of each factor (a) beside those of ret_12 (b)."""
    ics = factor_ics(spark, d)
    base = ics.where("factor = 'ret_12'").select("date", F.col("ic").alias("b"))
    return ics.where("factor <> 'ret_12'").select("factor", "date", F.col("ic").alias("a")).join(base, "date")


@query(f"WITH {LABELS}, {_LONG}, {_ICS}, {_bootstrap_sql(_PAIRS)} SELECT factor, samples, round(mean_delta, 6) AS mean_delta, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM boot")
def block_bootstrap(spark, d):
    """Moving-block bootstrap of the paired difference of daily rank correlations."""
    out = resampling.paired_bootstrap(_paired_ics(spark, d), "factor", "date", "a", "b", BLOCK, REPLICATIONS, SEED)
    return out.select("factor", "samples", *(F.round(c, 6).alias(c) for c in ("mean_delta", "ci_lower", "ci_upper")))


@query(
    f"""WITH {LABELS}, {_LONG}, {_ICS}, {_bootstrap_sql(_PAIRS)}, folds AS (SELECT factor, year(date) AS y, avg(a) - avg(b) AS won FROM pairs GROUP BY 1, 2), f AS (SELECT factor, count(*) FILTER (round(won, 9) > 0) AS fold_wins, count(*) AS folds FROM folds GROUP BY 1),
p AS (SELECT factor, avg((round(delta, 9) > 0)::INT) AS positive FROM delta GROUP BY 1)
SELECT factor, samples, round(mean_delta, 6) AS mean_delta, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, round(positive, 6) AS positive_ratio, fold_wins, folds FROM boot JOIN f USING (factor) LEFT JOIN p USING (factor)"""
)
def paired_fold_comparison(spark, d):
    """Each factor against the baseline: bootstrap interval of the paired difference, share of dates above it, and years won."""
    pairs = _paired_ics(spark, d)
    boot = resampling.paired_bootstrap(pairs, "factor", "date", "a", "b", BLOCK, REPLICATIONS, SEED)
    years = pairs.groupBy("factor", F.year("date").alias("y")).agg((F.avg("a") - F.avg("b")).alias("won"))
    folds = years.groupBy("factor").agg(F.count(F.when(F.round("won", 9) > 0, 1)).alias("fold_wins"), F.count("*").alias("folds"))
    above = pairs.groupBy("factor").agg(share_of(F.round(F.col("a") - F.col("b"), 9) > 0).alias("positive_ratio"))
    names = ("mean_delta", "ci_lower", "ci_upper", "positive_ratio")
    return boot.join(folds, "factor").join(above, "factor").select("factor", "samples", *(F.round(c, 6).alias(c) for c in names), "fold_wins", "folds")


_FILLED = ", ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(q{i}[1], least(q{i}[2], {c})) END, q{i}[3]) AS f{i}" for i, c in enumerate(FEATURES))
_Z = ", ".join(f"(f{i} - m{i}) / d{i} AS z{i}" for i in range(3))
_PREPARED = f"""train AS (SELECT * FROM labeled WHERE label IS NOT NULL AND label_end < {SPLIT}), q AS (SELECT {", ".join(f"quantile_cont({c}, [0.01, 0.99, 0.5]) AS q{i}" for i, c in enumerate(FEATURES))} FROM train),
ft AS (SELECT label, {_FILLED} FROM train, q), m AS (SELECT {", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS d{i}" for i in range(3))} FROM ft)"""


@query(f"WITH {LABELS}, {_PREPARED} SELECT entity, date, {', '.join(f'round(z{i}, 6) AS {c}' for i, c in enumerate(FEATURES))} FROM (SELECT entity, date, {_Z} FROM (SELECT entity, date, {_FILLED} FROM labeled, q), m)")
def train_only_preprocessor(spark, d):
    """Features of all rows clipped, filled and scaled by what the rows known before a date say."""
    rows = written(labeled(spark, d).select("entity", "date", "label", "label_end", *FEATURES), "model-panel")
    train = rows.where(f"label is not null and label_end < {SPLIT}")
    scaled = models.fit_preprocessor(train, FEATURES).columns()
    return rows.select("entity", "date", *(F.round(c, 6).alias(n) for n, c in scaled.items()))


def _det(cell: Callable[[int, int], str]) -> str:
    """The determinant of a 3 x 3 matrix in SQL."""
    return "(" + " + ".join(f"{cell(0, p)} * ({cell(1, (p + 1) % 3)} * {cell(2, (p + 2) % 3)} - {cell(1, (p + 2) % 3)} * {cell(2, (p + 1) % 3)})" for p in range(3)) + ")"


def _swapped(k: int | None) -> Callable[[int, int], str]:
    """The Gram matrix's cells, with the right-hand side in column k."""
    return lambda i, j: f"b{i}" if j == k else f"g{i}{j}"


def _importance_sql() -> str:
    gram = ", ".join(f"sum((z{i} - a{i}) * (z{j} - a{j})) + {1.0 if i == j else 0.0} AS g{i}{j}" for i in range(3) for j in range(3))
    right = ", ".join(f"sum((z{i} - a{i}) * label) AS b{i}" for i in range(3))
    beta = ", ".join(f"{_det(_swapped(k))} / {_det(_swapped(None))} AS w{k}" for k in range(3))
    score = " + ".join(f"z{i} * w{i}" for i in range(3))
    mixed = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, label, " + ", ".join(f"o.z{k} AS z{k}" if k == i else f"t.z{k}" for k in range(3)) + f" FROM test t JOIN (SELECT z{i}, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '{c}', entity, date)), entity, date) AS n FROM test) o USING (n)"
        for i, c in enumerate(FEATURES)
    )
    return f"""WITH {LABELS}, {_PREPARED}, zt AS (SELECT label, {_Z} FROM ft, m),
a AS (SELECT {", ".join(f"avg(z{i}) AS a{i}" for i in range(3))} FROM zt), g AS (SELECT {gram}, {right} FROM zt, a), w AS (SELECT {beta} FROM g),
test AS (SELECT *, row_number() OVER (ORDER BY entity, date) AS n FROM (SELECT entity, date, label, {_Z} FROM (SELECT entity, date, label, {_FILLED} FROM labeled, q WHERE date >= {SPLIT} AND label IS NOT NULL), m)),
mixed AS ({mixed} UNION ALL SELECT '' AS feature, label, z0, z1, z2 FROM test), s AS (SELECT feature, label, round({score}, 12) AS score FROM mixed, w), r AS (SELECT feature, {rank_sql('score', 'feature')} AS x, {rank_sql('label', 'feature')} AS y FROM s),
rho AS (SELECT feature, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS rho FROM r GROUP BY 1)
SELECT feature, round((SELECT rho FROM rho WHERE feature = '') - rho, 6) AS importance FROM rho WHERE feature <> ''"""


_FOLDS = """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS session, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM labeled)),
spans AS (SELECT fold, test_from, test_until, cal.date AS train_until FROM (SELECT CAST((session - n // 2 - 1) // greatest(n // 4, 1) AS INT) AS fold, min(date) AS test_from, max(date) AS test_until, min(session) - 1 AS s FROM cal WHERE session > n // 2 GROUP BY 1) JOIN cal ON session = s),
assigned AS (SELECT labeled.*, fold, CASE WHEN date BETWEEN test_from AND test_until THEN 'test' ELSE 'train' END AS role FROM labeled JOIN spans ON date BETWEEN test_from AND test_until OR (label_end < train_until AND date < train_until))"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = labeled(spark, d)
    dates = joins.calendar(rows)
    n = dates.count()
    return models.assign_folds(rows, models.folds(dates, "date", n // 2, max(n // 4, 1), 1), "date", "label_end")


@query(f"WITH {LABELS}, {_FOLDS} SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date, max(CASE role WHEN 'train' THEN label_end END) AS last_known FROM assigned GROUP BY ALL")
def purged_folds(spark, d):
    """Rows of each walk-forward fold by role: a training row's label ends before the fold's training limit."""
    known = F.max(F.when(F.col("role") == "train", F.col("label_end"))).alias("last_known")
    return _assigned(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), known)


def _ridge_sql(alpha: float) -> str:
    """A ridge on three features per fold, by Cramer's rule."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "label"])
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(FEATURES))
    zs = ", ".join(f"({c} - m{i}) / d{i} AS z{i}" for i, c in enumerate(FEATURES))
    gram = ", ".join(f"sum(z{i} * z{j}) + {alpha if i == j else 0.0} AS g{i}{j}" for i in range(3) for j in range(3))
    right = ", ".join(f"sum(z{i} * (label - my)) AS b{i}" for i in range(3))
    beta = ", ".join(f"{_det(_swapped(k))} / {_det(_swapped(None))} AS w{k}" for k in range(3))
    score = " + ".join(f"({c} - m{i}) / d{i} * w{i}" for i, c in enumerate(FEATURES))
    return f"""WITH {LABELS}, {_FOLDS}, tr AS (SELECT * FROM assigned WHERE role = 'train' AND {complete}), m AS (SELECT fold, avg(label) AS my, {moments} FROM tr GROUP BY fold),
zt AS (SELECT fold, label, my, {zs} FROM tr JOIN m USING (fold)), g AS (SELECT fold, {gram}, {right} FROM zt GROUP BY fold), w AS (SELECT fold, {beta} FROM g)
SELECT fold, entity, date, round(my + {score}, 6) AS score, round(label, 6) AS label FROM assigned JOIN m USING (fold) JOIN w USING (fold) WHERE role = 'test'"""


@query(_ridge_sql(10.0))
def ridge_walk_forward(spark, d):
    """Ridge per purged fold: fitted on rows whose labels end before the fold, scored on its dates; one aggregation for all folds."""
    assigned = _assigned(spark, d)
    fitted = {k: m for k, (m, _, _) in models.ridge_by(assigned.where("role = 'train'"), FEATURES, "label", 10.0, "fold").items()}  # a handful of test periods
    return assigned.where("role = 'test'").select("fold", "entity", "date", F.round(models.column_by(fitted, "fold"), 6).alias("score"), F.round("label", 6).alias("label"))


@query(_importance_sql())
def permutation_importance(spark, d):
    """What a ridge's rank correlation on later rows loses when a feature is permuted; clipping, filling and scaling are fitted with the model."""
    train, test = _panel(spark, d)
    scaled = models.fit_preprocessor(train, FEATURES).columns()
    names = list(scaled)
    m = models.ridge(train.withColumns(scaled), names, "label", 1.0)
    out = resampling.permutation_importance(test.withColumns(scaled), ["entity", "date"], names, "label", m.column(), SEED)
    return out.select("feature", F.round("importance", 6).alias("importance"))
