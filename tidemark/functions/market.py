"""Scalar rules of listed securities and of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.expr import zfill


def starts(code: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= code.startswith(p)
    return out


#: Boards by prefix of the code, in the order in which they are tried (fixed values).
BOARDS = [("创业板", ("300", "301")), ("科创板", ("688",)), ("北交所", ("4", "8", "92")), ("沪市主板", ("6",))]
OTHER_BOARD = "深市主板"
WIDER_SINCE = "2020-08-24"


def board(code: Column) -> Column:
    """Board of a code, which is filled with zeros to six characters."""
    c = zfill(code, 6)
    out = F.lit(OTHER_BOARD)
    for name, prefixes in reversed(BOARDS):
        out = F.when(starts(c, *prefixes), name).otherwise(out)
    return out


def price_limit(code: Column, name: Column, date: Column) -> Column:
    """Normal daily price limit: 5 % where the name has ST, else 30 %, 20 % (ChiNext since 2020-08-24) or 10 % by board."""
    b = board(code)
    early = F.coalesce(date < F.lit(WIDER_SINCE).cast("date"), F.lit(False))
    return (
        F.when(F.upper(F.coalesce(name, F.lit(""))).contains("ST"), 0.05)
        .when(b == "创业板", F.when(early, 0.10).otherwise(0.20))
        .when(b == "科创板", 0.20)
        .when(b == "北交所", 0.30)
        .otherwise(0.10)
    )


def market_symbol(code: Column) -> Column:
    """Code with its exchange before it."""
    return F.concat(F.when(starts(code, "5", "6", "9"), "sh").otherwise("sz"), code)


def first_match(text: Column, groups: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Name of the first group one of whose words the text contains."""
    out = F.lit(otherwise)
    for name, words in reversed(groups):
        hit = F.lit(False)
        for w in words:
            hit |= text.contains(w)
        out = F.when(hit, name).otherwise(out)
    return F.when(text.isNull(), otherwise).otherwise(out)


def keyword_flags(text: Column, groups: dict[str, list[str]]) -> list[Column]:
    """1 or 0 for each group: whether the text contains any of its words."""
    out = []
    for name, words in groups.items():
        hit = F.lit(False)
        for w in words:
            hit |= text.contains(w)
        out.append(F.coalesce(hit, F.lit(False)).cast("int").alias(name))
    return out


def signal_strength(percentile: Column) -> Column:
    """Strength by a percentile from 0 to 100; LOW without one."""
    return F.when(percentile >= 95, "VERY_HIGH").when(percentile >= 90, "HIGH").when(percentile >= 70, "MEDIUM").otherwise("LOW")


#: Weights of the evidence for a prediction.
EVIDENCE = {"oos_skill": 0.22, "calibration_quality": 0.18, "regime_consistency": 0.15, "sector_stability": 0.10, "distance": 0.15, "feature_completeness": 0.20}


def unit(x: Column) -> Column:
    """Held to [0, 1]; null counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def confidence(probability: Column, evidence: dict[str, Column], drift: Column) -> Column:
    """Weighted evidence in [0, 1] times a drift multiplier; the probability's distance from one half is part of it."""
    distance = unit(F.abs(F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability)) - 0.5) * 2)
    score = F.lit(0.0)
    for name, weight in EVIDENCE.items():
        score += weight * (distance if name == "distance" else unit(evidence[name]))
    return unit(score * unit(drift))


def confidence_level(score: Column, low: float = 0.40, medium: float = 0.70) -> Column:
    return F.when(score < low, "LOW").when(score < medium, "MEDIUM").otherwise("HIGH")


def buy_grade(strength: Column) -> Column:
    """Grade of a strength from 0 to 100; the lowest without one."""
    return F.when(strength >= 90, "强").when(strength >= 75, "中").otherwise("观望")


def risk_score(volatility: Column, liquidity: Column, tradable: Column, events: Column, mood: Column) -> Column:
    """Risk from ranks of volatility and liquidity (null as one half), whether entry is possible (null: it is), and ten or more announcements of a bad mood."""
    half = lambda c: F.coalesce(c, F.lit(0.5))
    bad = (F.coalesce(events, F.lit(0)) >= 10) & (F.coalesce(mood, F.lit(0.0)) < 0)
    return half(volatility) * 0.40 + (1 - half(liquidity)) * 0.30 + (~F.coalesce(tradable, F.lit(True))).cast("int") * 0.10 + bad.cast("int") * 0.20


def risk_rating(risk: Column) -> Column:
    r = F.round(risk, 9)
    return F.when(r >= 0.55, "高").when(r >= 0.30, "中").otherwise("低")
