"""Quality classifier: an interpolated modified Kneser-Ney model of character 4-grams.

Trusted documents (all their labels good, none toxic) are parted into a training and a held-out share.
Counts of the training share's n-grams, per language, are grouped over the whole share; lower orders
count the distinct n-grams that end in theirs. The probability of every distinct 4-gram of the corpus
comes from joins of the query grams with the counts and context sums of each order, all dealt by gram.
A document's log-probability sums those of its grams: while the resolved table has at most MODEL_ROWS
rows (counted first) it is broadcast and a document is scored where it is read; a larger one is cut into
shards by gram, and each shard in turn is joined with the documents' counts of its grams, whose sums are
added up by document. Both ways give the same figures. A document is kept if its perplexity is at most a
quantile of that of held-out trusted documents of its language and length class; classes hold an equal
share of the held-out documents each, since short texts vary more.

A gram is a 64-bit number of four UTF-16 units. Three start signs precede a text and an end sign follows
it; both are noncharacters, and where a text itself has one of them it counts as U+FFFD.

Edge cases: an empty or null text has no perplexity and isn't kept; a null language is the language '';
a language without held-out trusted documents has no threshold and keeps all its texts; rows with null
doc_id are scored but never trusted; equal texts of one language score alike; repeated rows are rows of
their own; columns of the input may have any names but those of the result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small, text_or_empty

ORDER = 4
#: Noncharacters of Unicode.
START, END, REPLACEMENT = 0xFFFE, 0xFFFF, 0xFFFD
FOLDS = 5
QUANTILE = 0.995
#: A language with so many held-out documents has two length classes, with twice as many four, and so on.
CLASS_ROWS, CLASSES = 400, 16
#: Rows of the resolved table (18 bytes each) that may be broadcast, and of a shard of a larger one.
MODEL_ROWS = 4_000_000
#: Languages, and rows per language and length class, that may be broadcast.
LANGUAGES = 20_000
#: Grams that one batch of counting holds.
PIECE = 1 << 19

_PAD = np.full(ORDER - 1, START, np.uint64)


def characters(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    return np.where(c >= START, np.uint64(REPLACEMENT), c)


def grams(text: str) -> np.ndarray:
    """The 4-grams that end at each character of a text and at its end sign."""
    c = np.concatenate([_PAD, characters(text), [np.uint64(END)]]).astype(np.uint64)
    return c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Counter:
    """Counts of grams by language, in bounded memory: what grows beyond it is handed on as it is."""

    def __init__(self) -> None:
        self.pending: dict[str, list[np.ndarray]] = {}
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting = self.rows = 0

    def add(self, lang: str, own: np.ndarray) -> bool:
        """Whether so much is held that it should be taken."""
        self.pending.setdefault(lang, []).append(own)
        self.waiting += len(own)
        if self.waiting >= PIECE:
            self.settle()
        return self.rows > 4 * PIECE

    def settle(self) -> None:
        for lang, own in self.pending.items():
            self.held.setdefault(lang, []).append(np.unique(np.concatenate(own), return_counts=True))
        self.pending, self.waiting = {}, 0
        if sum(len(k) for parts in self.held.values() for k, _ in parts) > 2 * PIECE + 2 * self.rows:
            self.held = {lang: [_merged(parts)] for lang, parts in self.held.items()}
            self.rows = sum(len(k) for parts in self.held.values() for k, _ in parts)

    def take(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for lang, parts in self.held.items():
            keys, counts = _merged(parts)
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(counts[i : i + 100_000].astype(np.int64))], ["lang", "gram", "n"])
        self.held, self.rows = {}, 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: counts of each partition's 4-grams, for texts that aren't empty. Columns read: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (t := text.as_py()):
                    continue
                for g in [grams(t)] if len(t) < PIECE else np.array_split(grams(t), len(t) // PIECE + 1):
                    if counter.add(lang, g):
                        yield from counter.take()
        yield from counter.take()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long")


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def count_tables(counts: DataFrame) -> dict[int, DataFrame]:
    """For each order lang, gram, a: raw counts of the highest, numbers of distinct predecessors of the lower ones."""
    tables = {ORDER: materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("a")), "quality-counts")}
    for order in range(ORDER - 1, 0, -1):
        above = tables[order + 1].select("lang", _suffix(F.col("gram"), order + 1).alias("gram"))
        tables[order] = materialize(above.groupBy("lang", "gram").agg(F.count("*").alias("a")), "quality-counts")
    return tables


def discounts(table: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: modified Kneser-Ney discounts from the counts of counts; one row per language."""
    n = table.groupBy("lang").agg(*(F.sum((F.col("a") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def d(i: int) -> Column:
        raw = F.lit(float(i)) - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}")
        return F.greatest(F.lit(0.1 * i), F.least(F.lit(0.95 * i), F.coalesce(raw, F.lit(0.5 * i))))

    return n.select("lang", *(d(i).alias(f"d{i}") for i in (1, 2, 3)))


def _discount() -> Column:
    return F.when(F.col("a") >= 3, F.col("d3")).when(F.col("a") == 2, F.col("d2")).when(F.col("a") == 1, F.col("d1")).otherwise(0.0)


def probabilities(tables: dict[int, DataFrame], queries: DataFrame) -> DataFrame:
    """lang, gram, p for distinct query 4-grams of languages that have a model. queries: lang, gram."""
    wanted = {ORDER: queries}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = materialize(wanted[order + 1].select("lang", _suffix(F.col("gram"), order + 1).alias("gram")).distinct(), "quality-wanted")
    symbols = tables[1].groupBy("lang").agg((F.count("*") + 1).alias("symbols"))
    lower = None
    for order in range(1, ORDER + 1):
        rates = small(materialize(discounts(tables[order]).join(symbols, "lang"), "quality-rates"), LANGUAGES)
        own = tables[order].join(rates, "lang").withColumn("left", F.col("a") - _discount())
        contexts = own.groupBy("lang", _context(F.col("gram")).alias("context")).agg(F.sum("a").alias("total"), (F.sum("a") - F.sum("left")).alias("freed"))
        found = wanted[order].join(own.select("lang", "gram", "left"), ["lang", "gram"], "left").withColumn("context", _context(F.col("gram")))
        found = found.join(contexts, ["lang", "context"], "left")
        if lower is None:
            found = found.join(rates.select("lang", "symbols"), "lang").withColumn("below", F.lit(1.0) / F.col("symbols"))
        else:
            found = found.withColumn("suffix", _suffix(F.col("gram"), order)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("below")) / F.col("total"))
        lower = materialize(found.select("lang", "gram", p.alias("p")), "quality-model")
    return lower


def scorer(model: DataFrame) -> Callable[[DataFrame, list[str]], DataFrame]:
    """What gives columns of documents with n_grams and perplexity. model: lang, gram, p (materialized)."""
    rows, languages = model.count(), model.select("lang").distinct().count()
    few = rows <= MODEL_ROWS and languages <= LANGUAGES
    held = _broadcast(model) if few else None
    shards = max(1, -(-rows // max(MODEL_ROWS, 1)))

    def score(docs: DataFrame, columns: list[str]) -> DataFrame:
        out = _score_in_place(docs, held, columns) if few else _score_by_joins(docs, model, columns, shards)
        return out.withColumn("perplexity", F.when(F.col("lm_n") > 0, F.exp(-F.col("lm_sum") / F.col("lm_n")))).drop("lm_sum").withColumnRenamed("lm_n", "n_grams")

    return score


def _broadcast(model: DataFrame) -> Broadcast:
    """Each language's place in the sorted grams, and their logarithms."""
    spark = model.sparkSession
    names = sorted(r["lang"] for r in model.select("lang").distinct().collect())  # at most LANGUAGES
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "number int, lang string"))
    table = model.join(numbers, "lang").select(F.col("number").cast("short").alias("number"), "gram", F.log("p").alias("w")).toArrow()  # at most MODEL_ROWS
    which, keys, logs = (table.column(c).to_numpy() for c in ("number", "gram", "w"))
    del table
    order = np.lexsort((keys.view(np.uint64), which))
    edges = np.searchsorted(which[order], np.arange(len(names) + 1))
    return spark.sparkContext.broadcast(({n: (int(a), int(b)) for n, a, b in zip(names, edges[:-1], edges[1:], strict=True)}, keys.view(np.uint64)[order], logs[order]))


def _score_in_place(docs: DataFrame, held: Broadcast, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, keys, logs = held.value
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True)):
                lo, hi = places.get(lang or "", (0, 0))
                if lo == hi or not (t := text.as_py()):
                    continue
                g, n = np.unique(grams(t), return_counts=True)
                at = lo + np.minimum(np.searchsorted(keys[lo:hi], g), hi - lo - 1)
                hit = keys[at] == g
                sums[i], counts[i] = np.dot(logs[at[hit]], n[hit]), n[hit].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(counts)], [*batch.schema.names, "lm_sum", "lm_n"])

    chosen = docs.select(*columns)
    return chosen.mapInArrow(run, chosen.select("*", F.lit(0.0).alias("lm_sum"), F.lit(0).cast("long").alias("lm_n")).schema)


def _score_by_joins(docs: DataFrame, model: DataFrame, columns: list[str], shards: int) -> DataFrame:
    """The same by joins of counts, a shard of grams at a time."""
    rows = materialize(docs.select(*columns, F.monotonically_increasing_id().alias("lm_row")), "quality-rows")
    texts = rows.select("lm_row", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))
    parts = None
    for s in range(shards):

        def run(batches: Iterator[pa.RecordBatch], s: int = s) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if not text:
                        continue
                    g, n = np.unique(grams(text), return_counts=True)
                    own = (g ^ (g >> np.uint64(32))).view(np.int64) % shards == s
                    k = int(own.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row, np.int64)), pa.array([lang] * k, pa.string()), pa.array(g[own].view(np.int64)), pa.array(n[own].astype(np.int64))], ["lm_row", "lang", "gram", "n"])

        here = F.pmod(F.col("gram").bitwiseXOR(F.shiftrightunsigned("gram", 32)), F.lit(shards)) == s
        counted = texts.mapInArrow(run, "lm_row long, lang string, gram long, n long")
        met = counted.join(model.where(here).select("lang", "gram", F.log("p").alias("w")), ["lang", "gram"])
        part = materialize(met.groupBy("lm_row").agg(F.sum(F.col("w") * F.col("n")).alias("s"), F.sum("n").alias("k")), "quality-sums")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("lm_row").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    joined = rows.join(sums, "lm_row", "left")
    return joined.select(*columns, F.coalesce("s", F.lit(0.0)).alias("lm_sum"), F.coalesce("k", F.lit(0)).cast("long").alias("lm_n"))


def length_limits(held_out: DataFrame, quantile: float) -> DataFrame:
    """limit_lang, edges (array) and thresholds (array): the quantile of perplexity in each length class of a language; a text's class is the number of edges that its length exceeds."""
    known = held_out.where(F.col("perplexity").isNotNull()).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    cuts = known.groupBy("lang").agg(F.percentile_approx("n_grams", [i / CLASSES for i in range(1, CLASSES)], 10_000).alias("cuts"), F.count("*").alias("rows"))
    # A power of two of classes, so that each takes whole sixteenths.
    classes = F.lit(1)
    for k in (2, 4, 8, CLASSES):
        classes = F.when(F.col("rows") >= k // 2 * CLASS_ROWS, k).otherwise(classes)
    edges = F.transform(F.sequence(F.lit(1), F.col("classes") - 1), lambda i: F.element_at("cuts", (i * CLASSES / F.col("classes")).cast("int")))
    cuts = cuts.withColumn("classes", classes).select("lang", F.when(F.col("classes") > 1, edges).otherwise(F.array().cast("array<bigint>")).alias("edges"))
    placed = known.join(small(materialize(cuts, "quality-cuts"), LANGUAGES), "lang").withColumn("class", _class())
    limits = placed.groupBy("lang", "edges", "class").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    return limits.groupBy(F.col("lang").alias("limit_lang"), "edges").agg(F.map_from_entries(F.collect_list(F.struct("class", "threshold"))).alias("thresholds"))


def _class() -> Column:
    return F.size(F.filter("edges", lambda e: F.col("n_grams") > e))


def trusted_ids(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("bad")).where("good = 1 and bad = 0").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], quantile: float = QUANTILE) -> DataFrame:
    """``columns`` of docs (doc_id, text and lang among them) with n_grams, perplexity, threshold and keep."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))
    # Labels grow with the documents: a merge join at every size, never a broadcast of ids.
    trusted = materialize(texts.join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi"), "quality-trusted")
    tables = count_tables(gram_counts(trusted.where(fold != 0)))
    asked = materialize(gram_counts(texts).groupBy("lang", "gram").agg(F.lit(1).alias("one")).select("lang", "gram"), "quality-asked")
    model = probabilities(tables, asked)
    score = scorer(model)
    limits = materialize(length_limits(materialize(score(trusted.where(fold == 0), ["lang", "text"]).drop("text"), "quality-held-out"), quantile), "quality-limits")
    scored = score(docs, columns)
    joined = scored.join(small(limits, LANGUAGES), F.coalesce(F.col("lang"), F.lit("")) == F.col("limit_lang"), "left")
    # The last class has no held-out document where many are of the greatest length: the one before it counts then.
    nearest = F.coalesce(*(F.try_element_at("thresholds", _class() - k) for k in range(CLASSES)))
    joined = joined.withColumn("threshold", F.when(F.col("n_grams") > 0, nearest)).drop("limit_lang", "edges", "thresholds")
    empty = F.length(text_or_empty()) == 0
    return joined.withColumn("keep", ~empty & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
