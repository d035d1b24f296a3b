"""Sources, projections, features, joins and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.functions.expr import finite, pct_change, places, rank_pct, rolling, row_in, size_of, zfill
from tidemark.operators import features, joins, labels
from tidemark.plans.registry import CALENDAR, FILINGS, LABELS, PANEL, RETURNS, SECTORS, query, r6, rank_sql, s6
from tidemark.sources.panel import filings, n_lines, panel_week, read, sectors, validate_panel
from tidemark.sources.stages import dealt

W = "WINDOW w AS (PARTITION BY entity ORDER BY date)"


def returns(spark: SparkSession, d: str) -> DataFrame:
    return features.momentum(panel_week(spark, d, histories=True))


def labeled(spark: SparkSession, d: str) -> DataFrame:
    return labels.open_to_open(returns(spark, d), 2)


def by_date(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """A panel dealt by date, for ranks among a date's rows."""
    return dealt(df, n_lines(spark, d), "date")


@query(
    """WITH raw AS (SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, l_extendedprice / l_quantity AS open, l_extendedprice * (1 - l_discount) / l_quantity AS close,
 row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_quantity) AS n FROM lineitem
 WHERE l_extendedprice / l_quantity > 0 AND l_extendedprice * (1 - l_discount) / l_quantity > 0)
SELECT date, symbol, round(open, 6) AS open, round(close, 6) AS close FROM raw WHERE n = 1"""
)
def validate_panel_rows(spark, d):
    raw = read(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("open"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("close"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity",
    )
    out = validate_panel(raw, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity"])
    return out.select("date", "symbol", *r6("open", "close"))


@query("SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01' AND l_quantity > 40")
def scan_parquet_filtered(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.where("l_shipdate >= timestamp_ntz '1995-01-01' and l_shipdate < timestamp_ntz '1995-07-01' and l_quantity > 40").select("l_orderkey", "l_suppkey", "l_quantity")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def json_pages_explode(spark, d):
    e = read(spark, d, "events")
    watched = e.where("event_type = 'purchase'").select("user_id").distinct()
    return e.join(watched, "user_id", "left_semi").select("event_id", "user_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    """WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 457 % 1000000 AS VARCHAR), 6, '0') AS code, CASE WHEN p_size > 45 THEN '*St ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN DATE '2020-08-21' WHEN p_partkey % 3 = 0 THEN DATE '2020-08-24' END AS day FROM part)
SELECT p_partkey, code, CASE WHEN code[1:3] IN ('300', '301') THEN '创业板' WHEN code[1:3] = '688' THEN '科创板' WHEN code[1] IN ('4', '8') OR code[1:2] = '92' THEN '北交所' WHEN code[1] = '6' THEN '沪市主板' ELSE '深市主板' END AS board,
 (CASE WHEN contains(upper(name), 'ST') THEN 0.05 WHEN code[1:3] IN ('300', '301') THEN CASE WHEN day < DATE '2020-08-24' THEN 0.1 ELSE 0.2 END WHEN code[1:3] = '688' THEN 0.2 WHEN code[1] IN ('4', '8') OR code[1:2] = '92' THEN 0.3 ELSE 0.1 END)::DOUBLE AS price_limit,
 CASE WHEN code[1] IN ('5', '6', '9') THEN 'sh' ELSE 'sz' END || code AS symbol FROM c"""
)
def board_and_limit(spark, d):
    key = F.col("p_partkey")
    p = read(spark, d, "part").select("p_partkey", zfill(key * 457 % 1000000, 6).alias("code"), F.when(F.col("p_size") > 45, F.concat(F.lit("*St "), "p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(key % 2 == 0, F.lit("2020-08-21").cast("date")).when(key % 3 == 0, F.lit("2020-08-24").cast("date")).alias("day"))
    code = F.col("code")
    return p.select("p_partkey", "code", market.board(code).alias("board"), market.price_limit(code, F.col("name"), F.col("day")).cast("double").alias("price_limit"), market.market_symbol(code).alias("symbol"))


SECTOR_WORDS = [("metals", ["STEEL", "TIN", "NICKEL", "COPPER", "BRASS"]), ("plain", ["STANDARD", "SMALL"]), ("finish", ["PLATED", "ANODIZED", "POLISHED"])]


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|TIN|NICKEL|COPPER|BRASS') THEN 'metals' WHEN regexp_matches(p_type, 'STANDARD|SMALL') THEN 'plain'
 WHEN regexp_matches(p_type, 'PLATED|ANODIZED|POLISHED') THEN 'finish' ELSE 'other' END AS sector FROM part"""
)
def broad_sector(spark, d):
    return read(spark, d, "part").select("p_partkey", market.first_match(F.col("p_type"), SECTOR_WORDS, "other").alias("sector"))


@query(
    """SELECT doc_id, CAST(contains(text, 'icens') OR contains(text, 'opyright') AS INT) AS legal, CAST(contains(text, '@') OR contains(text, '555-') AS INT) AS contact,
 CAST(contains(text, 'pathetic') OR contains(text, 'worthless') OR contains(text, 'moron') AS INT) AS insult FROM documents"""
)
def event_keyword_flags(spark, d):
    groups = {"legal": ["icens", "opyright"], "contact": ["@", "555-"], "insult": ["pathetic", "worthless", "moron"]}
    return read(spark, d, "documents").select("doc_id", *market.keyword_flags(F.col("text"), groups))


@query(
    f"""WITH {RETURNS}, m AS (SELECT *, row_number() OVER e AS seen, quantile_cont(amount, 0.2) OVER (PARTITION BY date) AS floor_amount, first(date) OVER e AS listed, max(abs(ret_1)) OVER (PARTITION BY entity) AS jump,
 CASE WHEN entity % 17 = 0 THEN '*st' WHEN entity % 19 = 0 THEN 'x退' END AS name, CASE WHEN entity % 3 > 0 THEN (entity + year(date)) % 5 > 0 END AS in_universe FROM rets WINDOW e AS (PARTITION BY entity ORDER BY date))
SELECT entity, date, NOT coalesce(jump > 3, false) AS data_quality_ok, coalesce(seen >= 60 AND amount >= floor_amount AND volume > 0 AND NOT (contains(upper(coalesce(name, '')), 'ST') OR contains(coalesce(name, ''), '退')) AND date_diff('day', listed, date) >= 180
 AND coalesce(in_universe, false) AND NOT coalesce(jump > 3, false) AND ret_4 IS NOT NULL AND ret_12 IS NOT NULL, false) AS eligible FROM m"""
)
def eligibility(spark, d):
    e = F.col("entity")
    name = F.when(e % 17 == 0, "*st").when(e % 19 == 0, "x退")
    m = returns(spark, d).withColumns({"name": name, "list_date": F.min("date").over(Window.partitionBy("entity")), "in_universe": F.when(e % 3 > 0, (e + F.year("date")) % 5 > 0)})
    return features.eligible(m, ["ret_4", "ret_12"], least=60, jump=3.0).select("entity", "date", "data_quality_ok", "eligible")


@query(f"WITH {RETURNS} SELECT entity, round(max(abs(ret_1)), 6) AS worst, max(abs(ret_1)) > 1.0 AS quarantined FROM rets GROUP BY entity")
def quality_quarantine(spark, d):
    worst = F.max(F.abs("ret_1"))
    return returns(spark, d).groupBy("entity").agg(F.round(worst, 6).alias("worst"), (worst > 1.0).alias("quarantined"))


@query(f"WITH {LABELS} SELECT entity, date, {s6('label')} FROM labeled WHERE label IS NOT NULL AND label_end < DATE '1998-01-01' QUALIFY dense_rank() OVER (ORDER BY date DESC) <= 20")
def mature_filter(spark, d):
    mature = labeled(spark, d).where("label is not null and label_end < date '1998-01-01'")
    last = mature.select("date").distinct().orderBy(F.desc("date")).limit(20)
    return mature.join(last, "date", "left_semi").select("entity", "date", *r6("label"))


@query(f"WITH {PANEL}, {CALENDAR} SELECT entity, date, round(close, 6) AS close FROM panel JOIN calendar USING (date) WHERE (session - 3) % 13 = 0 AND session >= 3")
def rebalance_sample(spark, d):
    p = panel_week(spark, d)
    kept = joins.calendar(p).where("(session - 3) % 13 = 0 and session >= 3")
    return p.join(kept, "date", "left_semi").select("entity", "date", *r6("close"))


@query(
    f"""WITH {PANEL}, n AS (SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date) AS r, count(*) OVER (PARTITION BY entity) AS k FROM panel)
SELECT entity, date FROM n WHERE r IN (SELECT 1 + CAST(floor((n.k - 1) * i / 9.0) AS BIGINT) FROM range(10) t(i))"""
)
def deterministic_sample(spark, d):
    n = panel_week(spark, d).withColumns({"r": row_in(["date"], ["entity"]), "k": size_of(["entity"])})
    spots = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: 1 + F.floor((F.col("k") - 1) * i / 9.0))
    return n.where(F.array_contains(spots, F.col("r").cast("long"))).select("entity", "date")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END, 6) AS ratio FROM lineitem")
def finite_mask(spark, d):
    raw = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.coalesce(finite(raw), F.lit(0.0)), 6).alias("ratio"))


@query(
    f"""WITH {LABELS}, p AS (SELECT entity, date, 100 * {rank_sql('ret_4', 'date')} AS pct FROM labeled)
SELECT entity, date, round(pct, 6) AS pct, CASE WHEN pct >= 95 THEN 'VERY_HIGH' WHEN pct >= 90 THEN 'HIGH' WHEN pct >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS strength,
 coalesce(pct >= 90, false) AS top10, coalesce(pct >= 80, false) AS top20 FROM p"""
)
def signal_strength(spark, d):
    p = by_date(labeled(spark, d), spark, d).withColumn("pct", 100 * rank_pct("ret_4", ["date"]))
    return p.select("entity", "date", *r6("pct"), market.signal_strength(F.col("pct")).alias("strength"), F.coalesce(F.col("pct") >= 90, F.lit(False)).alias("top10"), F.coalesce(F.col("pct") >= 80, F.lit(False)).alias("top20"))


@query(
    f"""WITH {LABELS}, p AS (SELECT entity, date, round({rank_sql('ret_12', 'date')}, 9) AS p FROM labeled)
SELECT entity, date, round(p, 6) AS p FROM p WHERE p >= 0.6 AND date >= DATE '1997-01-01' ORDER BY p DESC, date, entity LIMIT 1000"""
)
def api_predicates(spark, d):
    p = by_date(labeled(spark, d), spark, d).withColumn("p", places(rank_pct("ret_12", ["date"]), 9)).where("p >= 0.6 and date >= date '1997-01-01'")
    return p.select("entity", "date", places("p", 6).alias("p")).orderBy(F.desc("p"), "date", "entity").limit(1000)  # by the rounded p, which is what its SQL's ORDER BY names


@query(
    """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), s AS (SELECT day, row_number() OVER (ORDER BY day) AS session FROM days WHERE dayofweek(day) NOT IN (0, 6))
SELECT d.day, s.day IS NOT NULL AS is_session, s.session, (SELECT min(day) FROM s x WHERE x.day > d.day) AS next_session, coalesce((s.session - 1) % 5 = 0, false) AS due FROM days d LEFT JOIN s USING (day)"""
)
def calendar_predicates(spark, d):
    days = read(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    s = joins.calendar(days.where("weekday(day) < 5"), "day")
    after = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    out = days.join(s, "day", "left").withColumn("next_session", F.last(F.when(F.col("session").isNotNull(), F.col("day")), ignorenulls=True).over(after))
    return out.select("day", F.col("session").isNotNull().alias("is_session"), F.col("session").cast("long").alias("session"), "next_session", F.coalesce((F.col("session") - 1) % 5 == 0, F.lit(False)).alias("due"))


# Joins


@query(f"WITH {SECTORS} SELECT s_suppkey AS entity, s_name, industry, sector FROM supplier LEFT JOIN sectors ON s_suppkey = entity")
def equi_left_1to1(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_name")
    return joins.left_one_to_one(s, sectors(spark, d), ["entity"]).select("entity", "s_name", "industry", "sector")


@query(
    f"""WITH {PANEL}, o AS (SELECT o_custkey AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS amount FROM orders GROUP BY ALL)
SELECT entity, date, round(p.amount, 2) AS amount_sold, round(o.amount, 2) AS amount_ordered FROM panel p JOIN o USING (entity, date)"""
)
def equi_inner(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("amount_ordered"))
    p = panel_week(spark, d).select("entity", "date", F.col("amount").alias("amount_sold"))
    return p.join(o, ["entity", "date"]).select("entity", "date", F.round("amount_sold", 2).alias("amount_sold"), F.round("amount_ordered", 2).alias("amount_ordered"))


@query(f"WITH {RETURNS}, m AS (SELECT date, avg(ret_1) AS market FROM rets GROUP BY date) SELECT entity, date, round(ret_1 - market, 6) AS excess FROM rets JOIN m USING (date)")
def date_broadcast_join(spark, d):
    r = returns(spark, d)
    return r.join(r.groupBy("date").agg(F.avg("ret_1").alias("market")), "date").select("entity", "date", F.round(F.col("ret_1") - F.col("market"), 6).alias("excess"))


@query(
    f"""WITH {FILINGS}, o AS (SELECT o_orderkey, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, day, f.report, f.available, round(f.total, 2) AS total, f.n_orders FROM o ASOF LEFT JOIN filings f ON o.entity = f.entity AND o.day >= f.available"""
)
def asof_backward_by_key(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"))
    out = joins.asof_backward(o, filings(spark, d), "entity", "day", "available", ["available", "report", "total", "n_orders"])
    return out.select("o_orderkey", "day", "fact.report", "fact.available", F.round("fact.total", 2).alias("total"), "fact.n_orders")


@query(
    f"""WITH {FILINGS}, o AS (SELECT o_orderkey, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day FROM orders),
j AS (SELECT day, f.available FROM o ASOF LEFT JOIN filings f ON o.entity = f.entity AND o.day >= f.available)
SELECT count(*) AS n, count(available) AS n_known, count(CASE WHEN available > day THEN 1 END) AS violations FROM j"""
)
def pit_violation_guard(spark, d):
    j = asof_backward_by_key(spark, d)
    return j.agg(F.count("*").alias("n"), F.count("available").alias("n_known"), joins.pit_violations(j, "available", "day").alias("violations"))


SNAPSHOTS = """snaps AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS snapshot, entity, sum(amount) AS size FROM panel GROUP BY CAST(date_trunc('quarter', date) AS DATE), entity
  QUALIFY row_number() OVER (PARTITION BY CAST(date_trunc('quarter', date) AS DATE) ORDER BY sum(amount) DESC, entity) <= 20)"""


def snapshots(spark, d):
    """Members per quarter: the twenty entities with the largest amounts."""
    q = panel_week(spark, d).groupBy(F.date_trunc("quarter", "date").cast("date").alias("snapshot"), "entity").agg(F.sum("amount").alias("size"))
    return q.withColumn("r", row_in([F.desc("size"), "entity"], ["snapshot"])).where("r <= 20").drop("r")


@query(
    f"""WITH {PANEL}, {SNAPSHOTS}, spans AS (SELECT snapshot, lead(snapshot) OVER (ORDER BY snapshot) AS until FROM (SELECT DISTINCT snapshot FROM snaps))
SELECT p.entity, p.date, x.snapshot, s.entity IS NOT NULL AS member, round(s.size, 2) AS size FROM panel p LEFT JOIN spans x ON p.date >= x.snapshot AND (x.until IS NULL OR p.date < x.until)
LEFT JOIN snaps s ON s.entity = p.entity AND s.snapshot = x.snapshot"""
)
def snapshot_interval_join(spark, d):
    out = joins.snapshot_join(panel_week(spark, d), snapshots(spark, d), ["entity"], "date", "snapshot")
    return out.select("entity", "date", "snapshot", "member", F.round("size", 2).alias("size"))


@query(f"WITH {PANEL}, {SNAPSHOTS} SELECT entity, snapshot, round(size, 2) AS size FROM snaps WHERE snapshot = (SELECT max(snapshot) FROM snaps WHERE snapshot <= DATE '1996-08-15')")
def asof_filter_latest(spark, d):
    s = snapshots(spark, d)
    last = s.where("snapshot <= date '1996-08-15'").agg(F.max("snapshot").alias("snapshot"))
    return s.join(F.broadcast(last), "snapshot").select("entity", "snapshot", F.round("size", 2).alias("size"))


@query(
    """WITH a AS (SELECT o_custkey AS entity, max(CAST(o_orderdate AS DATE)) AS released, sum(o_totalprice) AS actual FROM orders GROUP BY 1),
e AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS published, o_orderpriority AS source, o_totalprice AS v, o_orderstatus = 'P' AS withdrawn FROM orders),
l AS (SELECT a.entity, released, source, v, withdrawn FROM a JOIN e ON a.entity = e.entity AND published < released QUALIFY row_number() OVER (PARTITION BY a.entity, source ORDER BY published DESC, v DESC) = 1)
SELECT a.entity, a.released, round(avg(v) FILTER (NOT withdrawn), 4) AS consensus, nullif(count(v) FILTER (NOT withdrawn), 0) AS n_sources FROM a LEFT JOIN l USING (entity) GROUP BY ALL"""
)
def strict_pre_release_join(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("published"), F.col("o_orderpriority").alias("source"), "o_totalprice", "o_orderstatus")
    a = o.groupBy("entity").agg(F.max("published").alias("released"), F.sum("o_totalprice").alias("actual"))
    out = joins.pre_release(a, o, "entity", "released", "published", "source", F.col("o_orderstatus") == "P", "o_totalprice")
    return out.select("entity", "released", F.round("consensus", 4).alias("consensus"), "n_sources")


@query(
    f"""WITH {PANEL}, {CALENDAR}, e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, day, (SELECT min(date) FROM calendar c WHERE c.date >= e.day + INTERVAL 1 DAY) AS session_date FROM e"""
)
def next_session_join(spark, d):
    e = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return joins.next_session(e, joins.calendar(panel_week(spark, d)), "day").select("o_orderkey", "day", "session_date")


@query(
    f"""WITH {PANEL}, {CALENDAR}, p AS (SELECT entity, date, session, open FROM panel JOIN calendar USING (date))
SELECT p.entity, p.date, round(a.open, 6) AS open_later FROM p LEFT JOIN p a ON a.entity = p.entity AND a.session = p.session + 3"""
)
def calendar_offset_join(spark, d):
    p = panel_week(spark, d)
    s = joins.calendar(p)
    return joins.session_offset(p.join(s, "date"), s, ["open"], 3, "_later").select("entity", "date", *r6("open_later"))


@query(f"WITH {PANEL}, {SNAPSHOTS} SELECT a.snapshot, a.entity, round(a.size - b.size, 2) AS revision FROM snaps a LEFT JOIN snaps b ON a.entity = b.entity AND b.snapshot = CAST(a.snapshot - INTERVAL 3 MONTH AS DATE)")
def previous_snapshot_join(spark, d):
    s = snapshots(spark, d)
    before = s.select("entity", F.add_months("snapshot", 3).alias("snapshot"), F.col("size").alias("was"))
    return s.join(before, ["entity", "snapshot"], "left").select("snapshot", "entity", F.round(F.col("size") - F.col("was"), 2).alias("revision"))


@query(
    """SELECT 'quiet' AS kind, c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'urgent', c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"""
)
def semi_anti(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    quiet = c.join(o, "c_custkey", "left_anti").select(F.lit("quiet").alias("kind"), "c_custkey")
    return quiet.unionByName(c.join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").select(F.lit("urgent").alias("kind"), "c_custkey"))


@query(
    """WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT count(*) AS keys, count(CASE WHEN a.k IS NULL THEN 1 END) AS only_right, count(CASE WHEN b.k IS NULL THEN 1 END) AS only_left, round(max(abs(a.v - b.v)), 4) AS max_diff FROM a FULL JOIN b ON a.k = b.k"""
)
def full_outer_compare(spark, d):
    rows = read(spark, d, "lineitem")
    a = rows.where("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("a"))
    b = rows.where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("b"))
    return a.join(b, "k", "full").agg(F.count("*").alias("keys"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_right"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_left"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 4).alias("max_diff"))


@query("SELECT n_nationkey, n_name, coalesce(r_name, 'unknown') AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def map_lookup(spark, d):
    r = read(spark, d, "region").where("r_regionkey < 3")
    n = read(spark, d, "nation")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("unknown")).alias("r_name"))


@query(
    f"""WITH {PANEL}, o AS (SELECT entity, date, close FROM panel WHERE date < DATE '1996-01-01'), n AS (SELECT entity, date, close * (1 + entity % 3) AS close FROM panel WHERE date >= DATE '1995-10-01'),
f AS (SELECT entity, quantile_cont(o.close / n.close, 0.5) AS factor FROM o JOIN n USING (entity, date) GROUP BY 1 HAVING (max(o.close / n.close) - min(o.close / n.close)) / quantile_cont(o.close / n.close, 0.5) <= 0.001)
SELECT entity, date, round(close, 6) AS close, 'old' AS origin FROM o UNION ALL SELECT n.entity, n.date, round(n.close * factor, 6), 'new' FROM n JOIN f USING (entity) WHERE (n.entity, n.date) NOT IN (SELECT (entity, date) FROM o)"""
)
def hfq_stitch(spark, d):
    p = panel_week(spark, d).select("entity", "date", "close")
    old, new = p.where("date < date '1996-01-01'"), p.where("date >= date '1995-10-01'").withColumn("close", F.col("close") * (1 + F.col("entity") % 3))
    return joins.stitch(old, new, "entity", "date", "close", 0.001).select("entity", "date", *r6("close"), "origin")


# Features


@query(
    f"""WITH {RETURNS} SELECT entity, date, {s6('ret_1', 'ret_4', 'ret_12')},
 round(CASE WHEN count(close) OVER r >= 8 THEN avg(close) OVER r END, 6) AS ma, round(CASE WHEN count(close) OVER r >= 8 THEN stddev_samp(close) OVER r END, 6) AS sd,
 round(CASE WHEN count(close) OVER r >= 4 THEN min(close) OVER r END, 6) AS lo, round(CASE WHEN count(close) OVER r >= 4 THEN max(close) OVER r END, 6) AS hi,
 round(CASE WHEN count(close) OVER r >= 8 THEN quantile_cont(close, 0.5) OVER r END, 6) AS med, sum(volume) OVER r AS vol_sum,
 round(close / (CASE WHEN count(close) OVER r >= 8 THEN avg(close) OVER r END) - 1, 6) AS gap
FROM rets WINDOW r AS (PARTITION BY entity ORDER BY date ROWS 7 PRECEDING)"""
)
def rolling_features(spark, d):
    out = features.rolling_set(returns(spark, d))
    return out.select("entity", "date", *r6("ret_1", "ret_4", "ret_12", "ma", "sd", "lo", "hi", "med"), "vol_sum", *r6("gap"))


@query(
    f"""WITH {PANEL}, c AS (SELECT entity, date, close - lag(close) OVER (PARTITION BY entity ORDER BY date) AS x FROM panel),
g AS (SELECT *, CASE WHEN count(x) OVER r >= 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(x, 0) END) OVER r END AS g, CASE WHEN count(x) OVER r >= 14 THEN avg(CASE WHEN x IS NOT NULL THEN -least(x, 0) END) OVER r END AS l
 FROM c WINDOW r AS (PARTITION BY entity ORDER BY date ROWS 13 PRECEDING))
SELECT entity, date, round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS rsi FROM g"""
)
def rsi(spark, d):
    return features.rsi(panel_week(spark, d)).select("entity", "date", *r6("rsi"))


@query(
    f"""WITH {RETURNS} SELECT entity, date, round(CASE WHEN count(ret_1) OVER r >= 12 THEN product(1 + ret_1) OVER r END - 1, 6) AS mom FROM rets WINDOW r AS (PARTITION BY entity ORDER BY date ROWS 11 PRECEDING)"""
)
def rolling_product(spark, d):
    return features.rolling_product(returns(spark, d), "ret_1", 12, "mom").select("entity", "date", *r6("mom"))


@query(
    f"""WITH {RETURNS}, m AS (SELECT *, avg(ret_1) OVER (PARTITION BY date) AS market FROM rets), r AS (SELECT *, count(ret_1 * market) OVER w AS n, avg(ret_1 * market) OVER w AS xy, avg(ret_1) OVER w AS y, avg(market) OVER w AS x, avg(market * market) OVER w AS xx
 FROM m WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING))
SELECT entity, date, round(CASE WHEN n >= 20 THEN (xy - x * y) / nullif(round(xx - x * x, 12), 0) END, 4) AS beta FROM r"""
)
def rolling_beta(spark, d):
    m = returns(spark, d).withColumn("market", F.avg("ret_1").over(Window.partitionBy("date")))
    return features.rolling_beta(m, "ret_1", "market", 20, "beta").select("entity", "date", F.round("beta", 4).alias("beta"))


@query(
    f"""WITH {RETURNS}, l AS (SELECT *, lag(ret_1) OVER (PARTITION BY entity ORDER BY date) AS was FROM rets),
m AS (SELECT entity, date, CASE WHEN count(ret_1 * was) OVER w >= 20 THEN avg(ret_1 * was) OVER w END AS xy, CASE WHEN count(ret_1) OVER w >= 20 THEN avg(ret_1) OVER w END AS x, CASE WHEN count(was) OVER w >= 20 THEN avg(was) OVER w END AS y,
 stddev_samp(ret_1) OVER w * stddev_samp(was) OVER w AS spread, CASE WHEN count(ret_1) OVER w >= 20 THEN abs(sum(ret_1) OVER w) / nullif(sum(abs(ret_1)) OVER w, 0) END AS efficiency FROM l WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING))
SELECT entity, date, round(CASE WHEN spread > 1e-15 THEN (xy - x * y) / spread END, 6) AS autocorrelation, round(efficiency, 6) AS efficiency FROM m"""
)
def autocorrelation_efficiency(spark, d):
    out = features.efficiency(features.autocorrelation(returns(spark, d), "ret_1", 20, "autocorrelation"), "ret_1", 20, "efficiency")
    return out.select("entity", "date", *r6("autocorrelation", "efficiency"))


@query(
    f"""WITH {RETURNS}, e AS (SELECT entity, date, product(1 + coalesce(ret_1, 0)) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM rets)
SELECT entity, date, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM e"""
)
def drawdown(spark, d):
    return features.drawdown(returns(spark, d)).select("entity", "date", *r6("equity", "drawdown"))


@query(
    f"""WITH {PANEL} SELECT entity, date, round(CASE WHEN count(close) OVER w >= 5 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS z
FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)"""
)
def expanding_zscore(spark, d):
    return features.expanding_z(panel_week(spark, d), "close").select("entity", "date", *r6("z"))


@query(
    """WITH p AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL)
SELECT a.entity, a.date, round((count(CASE WHEN b.n < a.n THEN 1 END) + (count(CASE WHEN b.n = a.n THEN 1 END) + 1) / 2.0) / count(*), 6) AS own_rank
FROM p a JOIN p b ON a.entity = b.entity AND b.date <= a.date GROUP BY a.entity, a.date"""
)
def expanding_rank_pct(spark, d):
    p = read(spark, d, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return features.expanding_rank(p, "n").select("entity", "date", *r6("own_rank"))


@query(
    f"""WITH {FILINGS} SELECT entity, report, round((total - lag(total) OVER (PARTITION BY entity ORDER BY report)) / (abs(lag(total) OVER (PARTITION BY entity ORDER BY report)) + 1), 6) AS change FROM filings"""
)
def change_vs_previous_filing(spark, d):
    before = F.lag("total").over(Window.partitionBy("entity").orderBy("report"))
    return filings(spark, d).select("entity", "report", F.round((F.col("total") - before) / (F.abs(before) + 1), 6).alias("change"))


@query(
    f"""WITH {RETURNS}, m AS (SELECT date, avg(ret_1) AS r FROM rets WHERE ret_1 IS NOT NULL GROUP BY date)
SELECT date, round(r, 6) AS r, round(CASE WHEN count(r) OVER w >= 10 THEN quantile_cont(r, 0.5) OVER w END, 6) AS med,
 coalesce(r > CASE WHEN count(r) OVER w >= 10 THEN quantile_cont(r, 0.5) OVER w END, false) AS risk_on FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)"""
)
def lagged_median_regime(spark, d):
    m = returns(spark, d).where("ret_1 is not null").groupBy("date").agg(F.avg("ret_1").alias("r")).withColumn("med", features.lagged_median("r", 52, 10, "date"))
    return m.select("date", *r6("r", "med"), F.coalesce(F.col("r") > F.col("med"), F.lit(False)).alias("risk_on"))


@query(
    """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS date, max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS bought FROM events GROUP BY ALL)
SELECT user_id, date, date_diff('day', last_value(bought IGNORE NULLS) OVER w, date) AS days_since, sum(CAST(bought IS NOT NULL AS BIGINT)) OVER (PARTITION BY user_id ORDER BY date ROWS 4 PRECEDING)::BIGINT AS bought_5
FROM p WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)"""
)
def ffill_last_event(spark, d):
    p = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max(F.when(F.col("event_type") == "purchase", F.to_date("ts"))).alias("bought"))
    w = Window.partitionBy("user_id").orderBy("date")
    days = F.datediff("date", F.last("bought", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    return p.select("user_id", "date", days.alias("days_since"), F.sum(F.col("bought").isNotNull().cast("long")).over(w.rowsBetween(-4, 0)).alias("bought_5"))


@query(f"WITH {RETURNS}, {SECTORS} SELECT entity, date, round({rank_sql('ret_4', 'date, sector')} - 0.5, 6) AS g_rank FROM rets JOIN sectors USING (entity)")
def group_rank(spark, d):
    r = returns(spark, d).join(sectors(spark, d), "entity")
    return r.select("entity", "date", F.round(rank_pct("ret_4", ["date", "sector"]) - 0.5, 6).alias("g_rank"))


@query(f"WITH {RETURNS} SELECT entity, date, round(coalesce({rank_sql('ret_12', 'date')} - 0.5, 0), 6) AS c_rank FROM rets")
def cross_section_rank_pct(spark, d):
    return by_date(returns(spark, d), spark, d).select("entity", "date", F.round(F.coalesce(rank_pct("ret_12", ["date"]) - 0.5, F.lit(0.0)), 6).alias("c_rank"))


@query(
    f"""WITH {RETURNS}, q AS (SELECT *, quantile_cont(ret_1, 0.01) OVER d AS lo, quantile_cont(ret_1, 0.99) OVER d AS hi, count(ret_1) OVER d AS n FROM rets WINDOW d AS (PARTITION BY date)),
c AS (SELECT entity, date, n, CASE WHEN ret_1 IS NOT NULL THEN greatest(lo, least(hi, ret_1)) END AS x FROM q) SELECT entity, date, round(coalesce(CASE WHEN n >= 5 THEN {rank_sql('x', 'date')} - 0.5 END, 0), 6) AS w_rank FROM c"""
)
def winsor_rank(spark, d):
    return features.winsor_rank(returns(spark, d), "ret_1", ["date"], "w_rank").select("entity", "date", *r6("w_rank"))


# Labels


@query(f"WITH {LABELS} SELECT entity, date, label_end, {s6('entry_open', 'exit_open', 'label')} FROM labeled")
def label_open_to_open(spark, d):
    return labeled(spark, d).select("entity", "date", "label_end", *r6("entry_open", "exit_open", "label"))


@query(
    f"""WITH {PANEL}, {CALENDAR}, p AS (SELECT entity, date, session, open FROM panel JOIN calendar USING (date)),
l AS (SELECT p.entity, p.date, e.date AS entry_date, c.date AS label_end, b.open / a.open - 1 AS label FROM p LEFT JOIN p a ON a.entity = p.entity AND a.session = p.session + 1
LEFT JOIN p b ON b.entity = p.entity AND b.session = p.session + 3 LEFT JOIN calendar c ON c.session = p.session + 3 LEFT JOIN calendar e ON e.session = p.session + 1)
SELECT entity, date, entry_date, label_end, round(label, 6) AS label, label > 0 AS raw_up, label > 0.01 AS tradable_up FROM l"""
)
def label_calendar(spark, d):
    return labels.by_session(panel_week(spark, d), 2, 0.01).select("entity", "date", "entry_date", "label_end", *r6("label"), "raw_up", "tradable_up")


@query(
    f"""WITH {LABELS}, {SECTORS}, v AS (SELECT entity, date, sector, label AS y, {rank_sql('amount', 'date')} - 0.5 AS x, count(*) OVER (PARTITION BY date) AS n FROM labeled JOIN sectors USING (entity) WHERE label IS NOT NULL),
m AS (SELECT *, y - avg(y) OVER g AS yd, x - avg(x) OVER g AS xd FROM v WINDOW g AS (PARTITION BY date, sector)),
s AS (SELECT *, sum(xd * xd) OVER d AS sxx, sum(xd * yd) OVER d AS sxy FROM m WINDOW d AS (PARTITION BY date))
SELECT entity, date, round(CASE WHEN n >= 5 THEN yd - CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * xd END, 6) AS neutral FROM s"""
)
def neutral_label(spark, d):
    v = labeled(spark, d).join(sectors(spark, d), "entity")
    return labels.neutral(v, "label", "amount", "sector").where("label is not null").select("entity", "date", *r6("neutral"))


@query(f"WITH {LABELS} SELECT entity, date, round(label - avg(label) OVER (PARTITION BY date), 6) AS raw_label, coalesce(label > 0.01, false) AS up FROM labeled WHERE label IS NOT NULL")
def raw_label(spark, d):
    rows = labeled(spark, d).where("label is not null")
    return rows.select("entity", "date", F.round(F.col("label") - F.avg("label").over(Window.partitionBy("date")), 6).alias("raw_label"), F.coalesce(F.col("label") > 0.01, F.lit(False)).alias("up"))


@query(f"WITH {LABELS} SELECT CASE WHEN label_end IS NULL THEN 'PENDING' WHEN label_end < DATE '1997-06-01' THEN 'MATURE' ELSE 'PENDING' END AS status, count(*) AS n FROM labeled GROUP BY 1")
def label_maturity(spark, d):
    status = labels.maturity(F.col("label_end"), F.lit("1997-06-01").cast("date"))
    return labeled(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))
