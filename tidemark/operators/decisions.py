"""Gates, selection of factors and models, execution of planned weights, exposures, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import correlation, rank_pct, row_in, share_of
from tidemark.operators import evaluate, portfolio
from tidemark.sources.stages import written

#: Parts of names that only columns of the future or of labels have (fixed values).
FORBIDDEN = ("future_", "label", "entry_", "exit_", "execution_", "raw_up", "tradable_up", "target")


def forbidden_features(columns: Sequence[str], parts: Sequence[str] = FORBIDDEN) -> list[str]:
    """Those of the names that have one of the parts, in any case."""
    return [c for c in columns if any(p in c.lower() for p in parts)]


def assert_features_safe(df: DataFrame, columns: Sequence[str], parts: Sequence[str] = FORBIDDEN) -> DataFrame:
    """df, if none of the columns tells of the future."""
    if found := forbidden_features(columns, parts):
        raise ValueError(f"columns of the future or of labels can't be features: {found}")
    return df


def reasons(checks: dict[str, Column]) -> tuple[Column, Column]:
    """Whether all checks hold (null: not), and the names of those that don't, in order."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in held.items())))
    return reduce(Column.__and__, held.values()), failed


#: What a prediction must have shown.
CERTIFIED_BY = (
    "data_verified", "pit_verified", "label_maturity_verified", "leakage_test_passed", "purged_walk_forward_passed", "calibration_passed", "baseline_beaten", "stability_passed", "regime_passed",
    "probability_quality_passed", "cost_aware_stress_passed",
)


def certify(df: DataFrame, confirmed: str | None = None) -> DataFrame:
    """df with production_prediction_ready, execution_authorized (never), future_confirmation_status and reasons; a check that has no column hasn't passed."""
    checks = {n: F.col(n).cast("boolean") if n in df.columns else F.lit(False) for n in CERTIFIED_BY}
    ready, failed = reasons(checks)
    status = F.when(F.coalesce(F.col(confirmed), F.lit(False)) if confirmed else F.lit(False), "CONFIRMED").otherwise("COLLECTING")
    return df.withColumns({"production_prediction_ready": ready, "execution_authorized": F.lit(False), "future_confirmation_status": status, "reasons": failed})


def staleness(df: DataFrame, value: str, age: str, coverage: float = 0.95, days: float = 7) -> DataFrame:
    """One row: coverage of a value, its greatest age, and whether both are good enough; without rows they aren't."""
    got = df.agg(share_of(F.col(value).isNotNull()).alias("coverage"), F.max(age).alias("age"))
    return got.withColumn("passed", F.coalesce((F.col("coverage") >= coverage) & (F.col("age") <= days), F.lit(False)))


def require(gate: DataFrame, passed: str = "passed") -> DataFrame:
    """The gate's rows, whose evaluation fails where one hasn't passed."""
    ok = F.when(F.coalesce(passed, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gate not passed: "), F.to_json(F.struct("*")))).cast("boolean"))
    return gate.withColumn(passed, ok)


def input_audit(tables: dict[str, tuple[DataFrame, str, str]], bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """measure, value, passed: rows, entities, first and last day (as days since 1970), and duplicates of each table (rows, entity, date), held to bounds by measure name."""
    parts = []
    for name, (df, entity, date) in tables.items():
        day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
        one = df.agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"), day(F.min(date)).alias("first_day"), day(F.max(date)).alias("last_day"), (F.count("*") - F.countDistinct(entity, date)).alias("duplicates"))
        names = ["rows", "entities", "first_day", "last_day", "duplicates"]
        parts.append(one.select(*(F.col(c).cast("double").alias(f"{name}_{c}") for c in names)).unpivot([], [f"{name}_{c}" for c in names], "measure", "value"))
    out = reduce(DataFrame.unionByName, parts)
    passed = F.lit(None).cast("boolean")
    for measure, (low, high) in bounds.items():
        ok = F.lit(True)
        if low is not None:
            ok &= F.col("value") >= low
        if high is not None:
            ok &= F.col("value") <= high
        passed = F.when(F.col("measure") == measure, F.coalesce(ok, F.lit(False))).otherwise(passed)
    return out.withColumn("passed", passed)


def factor_audit(ics: DataFrame, turnover: DataFrame, dates: int = 120, size: float = 0.005, positive: float = 0.52, consistency: float = 0.60, fdr: float = 0.10) -> DataFrame:
    """A row per factor: its daily rank correlations summed up, and whether it passes the statistical gate.

    ics: factor, date, ic; turnover: factor, turnover_proxy. Consistency is the share of years whose mean has the sign of the
    whole; fdr bounds the adjusted p of the mean's Newey-West t.
    """
    known = ics.where(F.col("ic").isNotNull())
    s = F.stddev_samp("ic")
    sums = known.groupBy("factor").agg(F.count("ic").alias("ic_dates"), F.avg("ic").alias("mean_rank_ic"), s.alias("rank_ic_std"), F.coalesce(F.try_divide(F.avg("ic"), F.nullif(s, F.lit(0.0))), F.lit(0.0)).alias("rank_ic_ir"), share_of(F.round("ic", 12) > 0).alias("positive_ratio"))
    years = known.groupBy("factor", F.year("date").alias("year")).agg(F.signum(F.round(F.avg("ic"), 12)).alias("sign")).join(sums.select("factor", F.signum(F.round("mean_rank_ic", 12)).alias("whole")), "factor")
    same = years.groupBy("factor").agg(F.when(F.max("whole") == 0, F.lit(None)).otherwise(share_of(F.col("sign") == F.col("whole"))).alias("c"))
    out = sums.join(same, "factor", "left").withColumn("direction_consistency", F.coalesce("c", F.lit(0.0))).drop("c")
    out = out.join(evaluate.hac_t(known, "ic", "date", "factor").select("factor", "hac_t", F.col("p").alias("p_value")), "factor").join(turnover, "factor", "left")
    out = evaluate.bh_fdr(out, "p_value").withColumnRenamed("adjusted_p", "fdr_q_value")
    way = F.when(F.col("mean_rank_ic") >= 0, F.col("positive_ratio")).otherwise(1 - F.col("positive_ratio"))
    ok = (F.col("ic_dates") >= dates) & (F.abs("mean_rank_ic") >= size) & (way >= positive) & (F.col("direction_consistency") >= consistency) & (F.col("fdr_q_value") <= fdr)
    return out.withColumn("passes_statistical_gate", ok)


def select_factors(audit: DataFrame, correlations: DataFrame, threshold: float = 0.90, most: int = 20) -> DataFrame:
    """The audit with redundant_with, selected and rejection_reason: those that pass are taken in order of q, consistency, turnover and mean unless too like one taken before.

    correlations: f, g, rho for every pair. A row per factor and per pair of factors reach the driver, where the greedy pass is made.
    """
    audit = written(audit, "audit")
    rho = {}
    for r in correlations.collect():
        rho[r["f"], r["g"]] = rho[r["g"], r["f"]] = r["rho"]
    rows = [r for r in audit.collect() if r["passes_statistical_gate"]]
    rows.sort(key=lambda r: (round(r["fdr_q_value"], 9), -round(r["direction_consistency"], 9), round(r["turnover_proxy"], 9) if r["turnover_proxy"] is not None else float("inf"), -round(r["mean_rank_ic"], 9), r["factor"]))
    taken: list[str] = []
    verdicts = []
    for r in rows:
        like = next((t for t in taken if abs(rho.get((r["factor"], t)) or 0.0) > threshold), None)
        full = len(taken) >= most
        if like is None and not full:
            taken.append(r["factor"])
        verdicts.append((r["factor"], "" if full else like or "", like is None and not full))
    found = audit.sparkSession.createDataFrame(verdicts, "factor string, redundant_with string, selected boolean")
    out = audit.join(F.broadcast(found), "factor", "left").withColumns({"redundant_with": F.coalesce("redundant_with", F.lit("")), "selected": F.coalesce("selected", F.lit(False))})
    why = F.when(F.col("selected"), "SELECTED").when(F.col("redundant_with") != "", "REDUNDANT").when(~F.col("passes_statistical_gate"), "STATISTICAL_GATE").otherwise("MAX_FACTOR_CAP")
    return out.withColumn("rejection_reason", why)


def champion(df: DataFrame, y: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One row: brier, log loss and AUC of two probabilities (name, column), and the champion: the first only where its losses are both smaller and its AUC isn't."""
    out = None
    for side, (_, p) in (("a", first), ("b", second)):
        q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
        rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("__q", q)
        loss = rows.agg(F.avg(F.pow(F.col("__q") - F.col(y), 2)).alias(f"brier_{side}"), F.avg(-F.when(F.col(y) == 1, F.log("__q")).otherwise(F.log(1 - F.col("__q")))).alias(f"log_loss_{side}"))
        one = loss.crossJoin(evaluate.roc_auc(rows, "__q", y).select(F.col("auc").alias(f"auc_{side}")))  # one row each
        out = one if out is None else out.crossJoin(one)
    wins = (F.col("brier_a") < F.col("brier_b")) & (F.col("log_loss_a") < F.col("log_loss_b")) & (F.col("auc_a") >= F.col("auc_b"))
    return out.withColumn("champion", F.when(wins, first[0]).otherwise(second[0]))


def execute_weights(desired: DataFrame, outcomes: DataFrame, sessions: DataFrame) -> DataFrame:
    """desired (date, entity, weight) with continuing, executed, actual_weight and realized_return.

    A position held at the session before goes on and earns from open to open; a new one must be tradable, and earns its
    execution's return. What was held depends on every session before it, but each session either settles that or passes
    it on, so the last one that settles it tells. outcomes: date, entity, entry_tradable, entry_open, execution_exit_open, execution_return.
    """
    rows = desired.where(F.col("weight") > 0).join(sessions, "date").join(outcomes, ["date", "entity"], "left")
    own = Window.partitionBy("entity").orderBy("session")
    rows = rows.withColumn("run", F.col("session") - F.row_number().over(own)).withColumn("hold", F.try_divide("execution_exit_open", "entry_open") - 1)
    run = Window.partitionBy("entity", "run").orderBy("session")
    new = F.coalesce(F.col("entry_tradable"), F.lit(False)) & F.col("execution_return").isNotNull()
    # After this session: held if it was held before, and held if it wasn't.
    rows = rows.withColumns({"if_held": F.col("hold").isNotNull(), "if_not": new})
    settled = F.when(F.col("if_held") == F.col("if_not"), F.col("if_held")).when(F.row_number().over(run) == 1, F.col("if_not"))
    held = F.last(settled, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"settled": settled}).withColumn("executed", held)
    rows = rows.withColumn("continuing", F.coalesce(F.lag("executed").over(run), F.lit(False)))
    # A row that turns "held" into "not held" and back can't be: what earns when new earns when held.
    realized = F.when(F.col("continuing"), F.col("hold")).otherwise(F.col("execution_return"))
    return rows.select("date", "session", "entity", "weight", "continuing", "executed", F.when(F.col("executed"), F.col("weight")).otherwise(0.0).alias("actual_weight"), F.when(F.col("executed"), realized).alias("realized_return"))


def period_accounting(executed: DataFrame, outcomes: DataFrame, sessions: DataFrame, fee: float = 0.0003, slippage: float = 0.0005, stamp: float = 0.0005) -> DataFrame:
    """A row per date: gross, net and benchmark return, turnover, cost, holdings, cash and blocked entries of executed weights."""
    held = executed.where("actual_weight > 0").select("date", "entity", F.col("actual_weight").alias("weight"))
    moves = portfolio.turnover(held, sessions, "date", fee + slippage, fee + slippage + stamp)
    sums = executed.groupBy("date").agg(
        F.sum(F.col("actual_weight") * F.coalesce("realized_return", F.lit(0.0))).alias("gross_return"), F.count(F.when(F.col("actual_weight") > 0, 1)).alias("holdings"),
        (1 - F.sum("actual_weight")).alias("cash_weight"), F.count(F.when(~F.col("continuing") & ~F.col("executed"), 1)).alias("blocked_entries"),
    )
    market = outcomes.groupBy("date").agg(F.avg("future_return").alias("benchmark_return"))
    out = sums.join(moves, "date", "left").join(market, "date", "left").fillna(0.0, ["bought", "sold", "cost"])
    return out.select("date", "gross_return", (F.col("gross_return") - F.col("cost")).alias("net_return"), "benchmark_return", F.col("bought").alias("buy_turnover"), F.col("sold").alias("sell_turnover"), F.col("cost").alias("transaction_cost"), "holdings", "cash_weight", "blocked_entries")


def policy_select(df: DataFrame, score: str, key: str, tie: str, k: int, held: str | None = None, exit_rank: int | None = None, group: str | None = None) -> DataFrame:
    """Picks per date with model_rank: by group quotas, or the k best; with ``held`` and ``exit_rank`` holdings ranked no lower than that come first."""
    ranked = df.where(F.col(score).isNotNull()).withColumn("model_rank", row_in([F.desc(score), tie], [key]))
    if group is not None:
        sizes = ranked.groupBy(key, group).agg(F.count("*").alias("__size"))
        placed = ranked.withColumn("__place", row_in(["model_rank"], [key, group])).join(portfolio.quotas(sizes, key, group, "__size", k), [key, group])
        chosen = placed.where(F.col("__place") <= F.col("quota")).drop("__place", "quota")
        return chosen.withColumn("__pick", row_in(["model_rank"], [key])).where(F.col("__pick") <= k).drop("__pick")
    stays = F.col(held) & (F.col("model_rank") <= exit_rank) if held is not None and exit_rank is not None else F.lit(False)
    first = ranked.withColumn("__new", (~F.coalesce(stays, F.lit(False))).cast("int")).withColumn("__pick", row_in(["__new", "model_rank"], [key]))
    return first.where(F.col("__pick") <= k).drop("__new", "__pick")


def allocate(df: DataFrame, keys: list[str], capacity: str, total: str, preference: str, name: str) -> DataFrame:
    """df with ``name``: shares of a group's ``total`` in proportion to preferences, none above its capacity, the sum of all as near to the total as capacities allow.

    Shares stand at one water level: min(capacity, level * preference). In order of capacity / preference, a member is full
    if filling the group up to that ratio takes no more than the total, and the level follows from what the full ones leave.
    Members without a preference share evenly what is left once all others are full.
    """
    liked = F.col("__like") > 0
    group, tier = Window.partitionBy(*keys), Window.partitionBy(*keys, "__liked")
    upto = tier.orderBy("__ratio")  # equal ratios together
    out = df.withColumns({"__room": F.greatest(F.coalesce(F.col(capacity), F.lit(0.0)), F.lit(0.0)), "__like": F.greatest(F.coalesce(F.col(preference), F.lit(0.0)), F.lit(0.0))})
    first = F.least(F.coalesce(F.col(total), F.lit(0.0)), F.coalesce(F.sum(F.when(liked, F.col("__room"))).over(group), F.lit(0.0)))
    out = out.withColumns({"__liked": liked, "__whole": F.when(liked, first).otherwise(F.greatest(F.col(total) - first, F.lit(0.0))), "__like": F.when(liked, F.col("__like")).otherwise(1.0)})
    out = out.withColumn("__ratio", F.col("__room") / F.col("__like"))
    out = out.withColumns({"__c": F.sum("__room").over(upto), "__p": F.sum("__like").over(tier) - F.sum("__like").over(upto)})
    out = out.withColumn("__full", F.col("__c") + F.col("__ratio") * F.col("__p") <= F.col("__whole"))
    left = F.greatest(F.col("__whole") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__room"))).over(tier), F.lit(0.0)), F.lit(0.0))
    level = F.coalesce(F.try_divide(left, F.sum(F.when(~F.col("__full"), F.col("__like"))).over(tier)), F.lit(0.0))
    share = F.when(F.col("__full"), F.col("__room")).otherwise(F.least(F.col("__room"), level * F.col("__like")))
    return out.withColumn(name, share).drop("__room", "__like", "__liked", "__whole", "__ratio", "__c", "__p", "__full")


def benchmark_relative(df: DataFrame, n: int = 30, budget: float = 0.15, stock: float = 0.0075, tracking: float = 0.06) -> DataFrame:
    """date, entity, weight, tilt: benchmark weights tilted towards the best of each sector within an active budget.

    A sector's tilt is its benchmark weight's part of the budget: taken by its chosen members by the inverse of volatility,
    given by its others by their weight, neither above ``stock``; all tilts are scaled down to the tracking error asked for.
    Columns read: date, entity, sector, benchmark_weight, score (null: no candidate), volatility, confidence (of the date).
    """
    day, cell = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    base = F.greatest(F.coalesce(F.col("benchmark_weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn("__w", base).withColumn("__base", F.try_divide("__w", F.nullif(F.sum("__w").over(day), F.lit(0.0)))).where("__base is not null")
    rows = rows.withColumn("__sector", F.sum("__base").over(cell))
    count = F.when(F.col("__sector") > 0, F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("__sector"), 0))).otherwise(0)
    best = F.when(F.col("score").isNotNull(), F.row_number().over(cell.orderBy(F.col("score").desc_nulls_last(), "entity")))
    rows = rows.withColumns({"__first": F.coalesce(best <= count, F.lit(False))})
    overall = F.row_number().over(day.orderBy(F.desc("__first"), F.col("score").desc_nulls_last(), "entity"))
    rows = rows.withColumn("__chosen", F.col("__first") & (overall <= n)).drop("__first")
    rows = rows.withColumn("__target", F.lit(budget) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * F.col("__sector"))
    middle = F.percentile(F.when(F.col("__chosen"), F.greatest(F.col("volatility"), F.lit(1e-4))), 0.5).alias("__middle")
    rows = rows.join(rows.groupBy("date", "sector").agg(middle).withColumnsRenamed({"date": "__date", "sector": "__of"}), (F.col("date") == F.col("__date")) & F.col("sector").eqNullSafe(F.col("__of"))).drop("__date", "__of")
    inverse = 1 / F.coalesce(F.when(F.col("volatility").isNotNull(), F.greatest(F.col("volatility"), F.lit(1e-4))), F.col("__middle"), F.lit(0.02))
    rows = rows.withColumns({
        "__up": F.when(F.col("__chosen"), F.lit(stock)).otherwise(0.0), "__down": F.when(F.col("__chosen"), 0.0).otherwise(F.least(F.col("__base"), F.lit(stock))),
        "__wish": F.when(F.col("__chosen"), inverse).otherwise(0.0), "__give": F.when(F.col("__chosen"), 0.0).otherwise(F.col("__base")),
    })
    rows = allocate(rows, ["date", "sector"], "__up", "__target", "__wish", "__more")
    rows = rows.withColumn("__wanted", F.sum("__more").over(cell))
    rows = allocate(rows, ["date", "sector"], "__down", "__wanted", "__give", "__less")
    given = F.sum("__less").over(cell)
    rows = rows.withColumn("__matched", F.least(F.col("__wanted"), given)).withColumns({"__given": given})
    part = lambda c, whole: F.col(c) * F.coalesce(F.try_divide("__matched", F.nullif(F.col(whole), F.lit(0.0))), F.lit(0.0))
    rows = rows.withColumn("__tilt", part("__more", "__wanted") - part("__less", "__given"))
    error = F.sqrt(F.sum(F.pow(F.col("__tilt") * F.coalesce("volatility", F.lit(0.02)), 2)).over(day) * 252)
    rows = rows.withColumn("__error", error).withColumn("tilt", F.col("__tilt") * F.when(F.col("__error") > tracking, F.lit(tracking) / F.col("__error")).otherwise(1.0))
    rows = rows.withColumn("__raw", F.greatest(F.col("__base") + F.col("tilt"), F.lit(0.0)))
    return rows.select("date", "entity", (F.col("__raw") / F.sum("__raw").over(day)).alias("weight"), "tilt")


def core_plus_active(df: DataFrame, active: DataFrame, core_share: float = 0.7) -> DataFrame:
    """date, entity, weight: benchmark weights at ``core_share`` of the whole and active ones (date, entity, weight) at the rest; a date without active ones keeps its core share and cash."""
    w = F.greatest(F.coalesce(F.col("benchmark_weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    core = df.withColumn("__w", w).where("__w > 0").select("date", "entity", (F.col("__w") / F.sum("__w").over(Window.partitionBy("date")) * core_share).alias("weight"))
    both = core.unionByName(active.select("date", "entity", (F.col("weight") * (1 - core_share)).alias("weight")))
    return both.groupBy("date", "entity").agg(F.sum("weight").alias("weight"))


def defensive_exposure(df: DataFrame, weight: str, momentum: str, ret: str) -> DataFrame:
    """date, momentum (by benchmark weight), breadth, regime, exposure: 0.55 in a weak, falling market, 0.80 in one that is either, else 1."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    known = F.col(momentum).isNotNull() & (w > 0)
    m = F.coalesce(F.try_divide(F.sum(F.when(known, F.col(momentum) * w)), F.sum(F.when(known, w))), F.lit(0.0))
    out = df.groupBy("date").agg(m.alias("momentum"), F.coalesce(share_of(F.col(ret) > 0), F.lit(0.5)).alias("breadth"))
    off = (F.col("momentum") < -0.04) & (F.col("breadth") < 0.42)
    weak = (F.col("momentum") < 0.0) | (F.col("breadth") < 0.48)
    return out.withColumns({"regime": F.when(off, "risk_off").when(weak, "weak").otherwise("risk_on"), "exposure": F.when(off, 0.55).when(weak, 0.80).otherwise(1.0)})


def risk_budget(momentum: Column, volatility: Column, target: float = 0.12, least: float = 0.35, most: float = 1.0) -> Column:
    """Exposure of a market: all while it rises or its volatility is unknown, else the target's part of its volatility, within bounds."""
    full = (F.coalesce(momentum, F.lit(0.0)) >= 0) | volatility.isNull() | F.isnan(volatility) | (volatility <= 0)
    return F.when(full, most).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), target / volatility)))


def settlement_metrics(df: DataFrame, key: str, score: str, actual: str, tie: str, q: int = 5, least: int = 20) -> DataFrame:
    """key, n, Pearson and rank correlation, top less bottom quantile's mean, and the share of neighbouring quantiles whose means don't fall; keys with fewer than ``least`` rows are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(actual).isNotNull())
    ranked = rows.withColumns({"__a": rank_pct(score, [key]), "__b": rank_pct(actual, [key])})
    ic = ranked.groupBy(key).agg(F.count("*").alias("n"), correlation(score, actual).alias("pearson_ic"), correlation("__a", "__b").alias("spearman_rank_ic")).where(F.col("n") >= least)
    means = evaluate.buckets(rows, score, [key], q, tie).groupBy(key, "bucket").agg(F.avg(actual).alias("m"))
    step = means.withColumn("up", F.round(F.col("m") - F.lag("m").over(Window.partitionBy(key).orderBy("bucket")), 12) >= 0)
    spread = step.groupBy(key).agg((F.max(F.when(F.col("bucket") == q, F.col("m"))) - F.max(F.when(F.col("bucket") == 1, F.col("m")))).alias("top_minus_bottom"), (F.count(F.when(F.col("up"), 1)) / F.lit(float(q - 1))).alias("adjacent_consistency"))
    return ic.join(spread, key)


def exit_reasons(ranked: DataFrame, top: int, near: int = 10) -> DataFrame:
    """date and counts of the exits of each date's top: absent, forced (no return known), by rank, near the cutoff, and by rank from a sector that nothing entered.

    ranked: session, date, entity, sector, place, ret; sessions are consecutive.
    """
    held = ranked.where(F.col("place") <= top)
    before = held.select((F.col("session") + 1).alias("session"), "entity", F.col("sector").alias("was"))
    entered = held.join(before.select("session", "entity"), ["session", "entity"], "left_anti").select("session", F.col("sector").alias("was")).distinct().withColumn("met", F.lit(True))
    days = ranked.select("session", "date").distinct()
    out = before.join(days, "session").join(ranked.select("session", "entity", "place", "ret"), ["session", "entity"], "left").where("place is null or place > %d" % top)
    out = out.join(entered, ["session", "was"], "left")
    absent, forced = F.col("place").isNull(), F.col("place").isNotNull() & F.col("ret").isNull()
    by_rank = ~absent & ~forced
    n = lambda c: F.count(F.when(c, 1))
    return out.groupBy("date").agg(
        F.count("*").alias("exited"), n(absent).alias("absent"), n(forced).alias("forced"), n(by_rank).alias("ranking"), n(by_rank & (F.col("place") <= top + near)).alias("near_cutoff"), n(by_rank & F.col("met").isNull()).alias("cross_sector")
    )


def output_audit(equity: DataFrame, holdings: DataFrame, fee: float, stamp: float, tolerance: float = 1e-6) -> DataFrame:
    """rule, violations of a ledger: unique keys, finite and positive values, no leverage, cost from turnover, excess, compounding, order of dates and contiguous periods; sums agree to a relative tolerance.

    equity: strategy, date, entry_date, end_date, period_return, benchmark_return, excess_return, nav, buy_turnover, sell_turnover,
    transaction_cost, cash_weight; holdings: strategy, date, entity, weight.
    """
    own = Window.partitionBy("strategy").orderBy("date")
    e = equity.withColumns({"was": F.coalesce(F.lag("nav").over(own), F.lit(1.0)), "then": F.lead("entry_date").over(own)})
    off = lambda a, b: F.coalesce(F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(True))
    c, n = F.col, lambda x: F.count(F.when(x, 1))
    numbers = ["period_return", "benchmark_return", "nav", "buy_turnover", "sell_turnover", "transaction_cost", "cash_weight"]
    unknown = reduce(Column.__or__, (c(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for x in numbers))
    of_equity = {
        "duplicate_equity_key": F.count("*") - F.countDistinct("strategy", "date"), "non_finite": n(unknown), "nav_not_positive": n(c("nav") <= 0),
        "negative_part": n((c("buy_turnover") < -tolerance) | (c("sell_turnover") < -tolerance) | (c("transaction_cost") < -tolerance) | (c("cash_weight") < -tolerance)), "cash_above_nav": n(c("cash_weight") > 1 + tolerance),
        "cost_identity": n(off(c("transaction_cost"), c("buy_turnover") * fee + c("sell_turnover") * (fee + stamp))), "excess_identity": n(off(c("excess_return"), c("period_return") - c("benchmark_return"))),
        "nav_compounding": n(off(c("nav"), c("was") * (1 + c("period_return")))), "chronology": n(~((c("date") < c("entry_date")) & (c("entry_date") < c("end_date")))), "gap_between_periods": n(c("then") != c("end_date")),
    }
    of_holdings = {"duplicate_holding_key": F.count("*") - F.countDistinct("strategy", "date", "entity"), "negative_holding": n(c("weight") < -tolerance)}
    gross = holdings.groupBy("strategy", "date").agg(F.sum("weight").alias("gross")).agg(n(c("gross") > 1 + tolerance).alias("leverage"))
    one = e.agg(*(v.alias(k) for k, v in of_equity.items())).crossJoin(holdings.agg(*(v.alias(k) for k, v in of_holdings.items()))).crossJoin(gross)  # one row each
    names = [*of_equity, *of_holdings, "leverage"]
    return one.unpivot([], names, "rule", "violations")
