"""Streams give what a batch over the same rows gives."""

import datetime as dt
import random

import pytest

from tidemark.streaming import intake, revisions
from tidemark.streaming import observations as obs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return add


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def batches(spark, folder, schema, each):
    """A function that adds rows as files of their own and calls ``each`` with a stream of the folder: one micro-batch."""
    count = iter(range(99))

    def add(rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{next(count)}")
        each(spark.readStream.schema(schema).parquet(f"{folder}/*"))

    return add


def test_revisions(spark, tmp_path):
    """New, repeated, revised; an identity that was away for longer than the expiry is new, by its timer or before it fires."""
    schema, out = "id string, observed timestamp, content_hash string", str(tmp_path / "out")
    own = revisions.session(spark)

    def each(stream):
        told = revisions.classify(own.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), 5 * 86_400)
        told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(out).awaitTermination()

    add = batches(spark, tmp_path / "in", schema, each)
    day = lambda n: T0 + dt.timedelta(n)
    add([("a", day(0), "1"), ("b", day(0), "1"), ("c", day(0), "9")])
    add([("a", day(2), "1"), ("b", day(2), "2"), ("d", day(2), "1")])
    add([("b", day(4), "2"), ("b", day(4), "2"), ("a", day(4), "3")])
    add([("b", day(9), "1"), ("c", day(9), "9")])  # c was away for nine days
    add([("a", day(20), "7"), ("b", day(30), "4")])  # timers have fired by then
    got = sorted((r.id, (r.observed - T0).days, r.status, (r.first_seen - T0).days, r.revisions) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", 0, "new", 0, 0), ("a", 2, "repeat_same", 0, 0), ("a", 4, "identity_hash_changed", 0, 1), ("a", 20, "new", 20, 0),
        ("b", 0, "new", 0, 0), ("b", 2, "identity_hash_changed", 0, 1), ("b", 4, "repeat_same", 0, 1), ("b", 4, "repeat_same", 0, 1), ("b", 9, "repeat_same", 0, 1), ("b", 30, "new", 30, 0),
        ("c", 0, "new", 0, 0), ("c", 9, "new", 9, 0), ("d", 2, "new", 2, 0),
    ]


def test_ledger_of_revisions(spark, tmp_path):
    """Whole batches give what rows taken one by one give; a batch that comes again changes nothing; no Python state is asked row by row; who is gone is forgotten."""
    schema, r, most = "id string, observed timestamp, content_hash string", random.Random(3), 5 * 86_400
    ledger = revisions.Ledger(str(tmp_path / "ledger"), most)
    add = batches(spark, tmp_path / "in", schema, lambda s: ledger.run(s, str(tmp_path / "mark")))
    state, want, alive, top = {}, [], [], T0
    for number in range(5):
        got = [(r.choice([None, *"abcdefgh"]), T0 + dt.timedelta(4 * number + r.randrange(16 if number == 3 else 4)), r.choice("12345")) for _ in range(40)]
        got += [("z", T0 + dt.timedelta(4 * number), None)] if number < 2 else []
        for i, t, c in sorted(got, key=lambda x: (x[1], x[2] or "")):
            if i not in state or (t - state[i][2]).total_seconds() > most:
                state[i], status = (c, t, t, set()), "new"
            elif c == state[i][0] or c in state[i][3]:
                status = "repeat_same"
            else:
                status = "identity_hash_changed"
                state[i][3].add(c)
            state[i] = (*state[i][:2], max(t, state[i][2]), state[i][3])
            want.append((i, t, c, status, state[i][1], len(state[i][3])))
        top = max(top, *(t for _, t, _ in got))
        state = {i: x for i, x in state.items() if (top - x[2]).total_seconds() <= most}
        alive.append(len(state))
        add(got)
    key = lambda x: str([(v is None, v) for v in x])
    told = lambda: sorted(map(tuple, ledger.told(spark).collect()), key=key)
    assert told() == sorted(want, key=key) and {x[3] for x in want} == {"new", "repeat_same", "identity_hash_changed"}
    assert [spark.read.parquet(f"{tmp_path}/ledger/known/number={k}").count() for k in range(5)] == alive and max(alive) == 10
    ledger.take(spark.read.schema(schema).parquet(f"{tmp_path}/in/4"), 4)
    assert told() == sorted(want, key=key)


SEEN = "id int, ts timestamp, observed timestamp"


def test_dead_letters(spark, tmp_path):
    hours = lambda n: T0 + dt.timedelta(hours=n)
    taken = intake.Intake(str(tmp_path / "root"), "ts", intake.in_time("ts", "observed", 3600))
    with pytest.raises(ValueError, match="no batch"):
        taken.accepted(spark)
    add = batches(spark, tmp_path / "in", SEEN, lambda s: taken.run(s, str(tmp_path / "mark")))
    add([(1, hours(1), hours(5)), (2, hours(6), hours(5)), (3, None, hours(5)), (4, hours(2), None)])
    add([(5, hours(0), hours(9)), (6, hours(0.5), hours(9)), (7, hours(8), hours(9)), (8, hours(8), hours(9)), (8, hours(8), hours(9))])
    add([(9, hours(6), hours(9)), (10, hours(7), hours(9))])
    assert sorted(r.id for r in taken.accepted(spark).collect()) == [1, 5, 6, 7, 8, 8, 10]
    reasons = {r.id: (r.batch, r.reason) for r in taken.rejected(spark).collect()}
    assert reasons == {2: (0, "future"), 3: (0, "no_time"), 4: (0, "no_time"), 9: (2, "late")}
    receipts = taken.receipts(spark).orderBy("batch").collect()
    assert [(r.n_read, r.n_accepted, r.n_rejected) for r in receipts] == [(4, 1, 3), (5, 5, 0), (2, 1, 1)]
    assert sum(r.n_read for r in receipts) == taken.accepted(spark).count() + taken.rejected(spark).count() == 11


def test_batches_are_taken_once(spark, tmp_path, monkeypatch):
    """A crash between rows and receipt leaves nothing half taken; equal retries do nothing, changed ones fail."""
    taken = intake.Intake(str(tmp_path / "root"), "ts", intake.in_time("ts", "observed", 3600))
    add = batches(spark, tmp_path / "in", SEEN, lambda s: taken.run(s, str(tmp_path / "mark")))
    add([(1, T0, T0)])
    commit = intake.Intake.commit
    monkeypatch.setattr(intake.Intake, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        add([(2, T0, T0), (3, T0, T0)])
    assert [r.id for r in taken.accepted(spark).collect()] == [1]  # rows without a receipt aren't there
    assert spark.read.parquet(f"{tmp_path}/root/accepted/number=1").count() == 2
    monkeypatch.setattr(intake.Intake, "commit", commit)
    taken.run(spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in/*"), str(tmp_path / "mark"))  # the replayed batch
    assert sorted(r.id for r in taken.accepted(spark).collect()) == [1, 2, 3]
    rows = [(3, T0, T0), (2, T0, T0)]
    assert taken.take(spark.createDataFrame(rows, SEEN), 1) == "identical"
    with pytest.raises(ValueError, match="other rows"):
        taken.take(spark.createDataFrame(rows[:1], SEEN), 1)
    assert sorted(r.id for r in taken.accepted(spark).collect()) == [1, 2, 3]
    assert taken.take(spark.createDataFrame([], SEEN), 2) == "taken" and taken.receipts(spark).count() == 3


def test_repeats_are_dropped(feed):
    schema = "id string, ts timestamp"
    feed([("a", T0), ("a", T0), ("b", T0)], schema)
    stream = feed([("a", T0 + dt.timedelta(minutes=5)), ("c", T0)], schema)
    assert sorted(r.id for r in run(obs.drop_repeats(stream, "ts", "1 hour", ["id"]), "unrepeated")) == ["a", "b", "c"]


def test_windowed_counts(feed):
    stream = feed([("a", T0 + dt.timedelta(minutes=i)) for i in range(10)], "id string, ts timestamp")
    assert sum(r.n for r in run(obs.windowed_counts(stream, "ts", "1 minute", "5 minutes", "id"), "counted", "complete")) == 10


def test_days_are_appended_once(spark, tmp_path):
    days = intake.daily(str(tmp_path / "root"), "day")
    add = batches(spark, tmp_path / "in", "day date, x int", lambda s: days.run(s, str(tmp_path / "mark")))
    day = T0.date()
    add([(day, 1), (None, 9)])
    add([(day, 2), (day + dt.timedelta(1), 3)])
    assert sorted(r.x for r in days.accepted(spark).collect()) == [1, 3]
    assert sorted((r.x, r.reason) for r in days.rejected(spark).collect()) == [(2, "known_day"), (9, "no_day")]


def test_settlement(spark):
    predictions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 1), ("g", 1)], "entity string, session int")
    made = [("a", s, 10.0 + s, None, None) for s in range(1, 5)] + [("b", 4, 1.0, None, None), ("c", 2, 1.0, None, None)]
    made += [("d", 2, 1.0, None, None), ("d", 4, 2.0, None, True), ("e", 2, 1.0, True, None), ("e", 4, 2.0, None, None), ("f", 2, float("nan"), None, None), ("f", 4, 2.0, None, None), ("g", 2, 1.0, None, None), ("g", 4, 2.0, True, True)]
    prices = spark.createDataFrame(made, "entity string, session int, open double, suspended boolean, delisted boolean")
    index = spark.createDataFrame([(2, 5.0), (4, 6.0)], "session int, open double")
    got = {(r.entity, r.session): (r.status, r.actual) for r in obs.settle(predictions, prices, index, 2).collect()}
    assert got == {
        ("a", 1): ("SETTLED", 14 / 12 - 1), ("a", 2): ("PENDING", None), ("b", 1): ("MISSING_ENTRY_PRICE", None), ("c", 1): ("MISSING_EXIT_PRICE", None), ("d", 1): ("DELISTED_AT_EXIT", None),
        ("e", 1): ("SUSPENDED_PRICE_UNAVAILABLE", None), ("f", 1): ("MISSING_ENTRY_PRICE", None), ("g", 1): ("DELISTED_AT_EXIT", None),
    }
    assert {r.status for r in obs.settle(predictions, prices, index.where("session < 4"), 2).where("entity = 'a' and session = 1").collect()} == {"MISSING_BENCHMARK_PRICE"}
