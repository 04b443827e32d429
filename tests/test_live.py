"""State with time to live and capacity: entries against plain Python, restarts, late events; two parties that meet."""

import random
from collections import OrderedDict

import pandas as pd
from pyspark.sql import functions as F

from casemill.streaming import folds, live

DAY = 86_400_000_000
SCHEMA = "store string, entry string, at double"


def replay(rows, ttl, capacity, last):
    """What goes, by the rules: expired entries first, then the oldest beyond the capacity."""
    gone, stores = [], {}

    def expire(store, now):
        held = stores[store]
        for entry, at in sorted(held.items(), key=lambda x: (x[1], x[0])):
            if at + ttl <= now:
                gone.append((store, entry, at, at + ttl, "expired"))
                del held[entry]

    for at, store, entry in sorted(rows):
        held = stores.setdefault(store, OrderedDict())
        expire(store, at)
        held.pop(entry, None)
        held[entry] = at
        if len(held) > capacity:
            oldest, put = held.popitem(last=False)
            gone.append((store, oldest, put, at, "evicted"))
    for store in stores:
        expire(store, last)
    return gone


def test_entries_go_as_plain_python_says_in_any_batches_and_after_a_restart(spark, tmp_path):
    rand = random.Random(7)
    rows = sorted({(rand.randrange(0, 20 * DAY) // 1000 * 1000, rand.choice("ab"), f"e{rand.randrange(9)}") for _ in range(300)})
    rows.append((20 * DAY, "z", "clock"))
    at, path = str(tmp_path / "in"), str(tmp_path / "run")
    make = lambda part: spark.createDataFrame([(s, e, float(t)) for t, s, e in part], SCHEMA)
    live.replay_files(make(rows[:150]), "at", at, 3)
    schema = make(rows[:1]).schema

    def run():
        stream = folds.event_stream(spark, at, schema).withColumn("ts", F.timestamp_micros(F.col("at").cast("long")))
        return live.kept_stream(live.gone_entries(stream, "store", "entry", "ts", ttl_seconds=2 * 86_400, capacity=4), path)

    run()
    live.replay_files(make(rows[150:]), "at", at, 2)
    got = sorted(tuple(r) for r in run().collect())
    assert got == sorted(replay(rows, 2 * DAY, 4, 20 * DAY))
    late = make([(DAY, "a", "late")])
    late.coalesce(1).write.mode("append").parquet(at)
    assert sorted(tuple(r) for r in run().collect()) == got


def test_parties_meet_in_both_directions(spark, tmp_path):
    rand = random.Random(2)
    hour = 3_600_000_000
    rows = [(f"{rand.choice('lr')}", f"t{rand.randrange(6)}", float(rand.randrange(0, 200) * hour / 4)) for _ in range(160)]
    at, path = str(tmp_path / "in"), str(tmp_path / "run")
    df = spark.createDataFrame(rows, "side string, token string, at double")
    live.replay_files(df, "at", at, 4)
    stream = folds.event_stream(spark, at, df.schema).withColumn("ts", F.timestamp_micros(F.col("at").cast("long")))
    met = live.met(stream.where("side = 'l'"), stream.where("side = 'r'"), "token", "ts", ttl="2 hours")
    got = sorted(tuple(r) for r in live.kept_stream(met.select("token", F.unix_micros("left_at"), F.unix_micros("right_at")), path).collect())
    left, right = ([(t, int(x)) for s, t, x in rows if s == side] for side in "lr")
    assert got == sorted((t, a, b) for t, a in left for u, b in right if t == u and abs(a - b) <= 2 * hour)


class Counted:
    """Stands for a state store: counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 5 * DAY // 1000

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1


def test_calls_of_the_state_store_do_not_grow_with_stores_and_entries():
    rows = [(i * 1000, f"e{i}", f"s{i % 40}") for i in range(400)]
    told = Counted()
    stores = live.LiveStores(2 * DAY, 3)
    stores.init(told)
    batch = pd.DataFrame(rows, columns=["put_at", "entry", "store"])
    got = [tuple(r) for part in stores.handleInputRows((0,), iter([batch]), told) for r in part.itertuples(index=False)]
    assert told.calls <= 3
    got += [tuple(r) for part in stores.handleExpiredTimer((0,), told, None) for r in part.itertuples(index=False)]
    assert told.calls <= 5
    assert sorted(got) == sorted(replay([(at, s, e) for at, e, s in rows], 2 * DAY, 3, 5 * DAY))
    assert told.value is None


def test_stores_of_one_shelf_keep_apart(spark, tmp_path):
    rand = random.Random(3)
    rows = sorted({(rand.randrange(0, 9 * DAY) // 1000 * 1000, rand.choice("abcde"), f"e{rand.randrange(6)}") for _ in range(120)})
    df = spark.createDataFrame([(s, e, float(t)) for t, s, e in rows], SCHEMA)
    live.replay_files(df, "at", str(tmp_path / "in"), 3)
    stream = folds.event_stream(spark, str(tmp_path / "in"), df.schema).withColumn("ts", F.timestamp_micros(F.col("at").cast("long")))
    gone = live.gone_entries(stream, "store", "entry", "ts", ttl_seconds=86_400, capacity=2, shelves=2)
    assert sorted(tuple(r) for r in live.kept_stream(gone, str(tmp_path / "run")).collect()) == sorted(replay(rows, DAY, 2, rows[-1][0]))
