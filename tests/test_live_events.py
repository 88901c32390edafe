"""Events of arriving rows against one pass over all of them, and dummies of new values."""

import datetime as dt
import random

from pyspark.sql import functions as F

from inversia.operators import dummies, live_events, windows
from inversia.plans.series import SeriesSpec
from tests.helpers import START, same

SPEC = SeriesSpec(("site",), "ts", ("id",), rows_per_chunk=60)
SCHEMA = "site string, ts timestamp_ntz, id bigint, s double"


def rows_of(rng, n=240):
    """Three sites (one without a name) with long runs, ties in time and unknown strengths."""
    out, level = [], {}
    for i in range(n):
        site = rng.choice(["a", "a", "b", None])
        level[site] = -level.get(site, 1.0) if rng.random() < 0.15 else level.get(site, 1.0)
        strength = None if rng.random() < 0.05 else level[site] * rng.uniform(0.5, 3)
        out.append((site, START + dt.timedelta(minutes=10 * (i // 2)), i, strength))
    return out


def whole(spark, rows):
    return windows.inversion_events(spark.createDataFrame(rows, SCHEMA), SPEC, F.col("s"))


def test_arrivals_in_order_and_late_within_the_bound(spark):
    rng = random.Random(5)
    rows = rows_of(rng)
    seen = sorted(rows, key=lambda r: (r[1] + dt.timedelta(minutes=rng.uniform(0, 50)), r[2]))
    parts = [spark.createDataFrame(seen[i : i + 80], SCHEMA) for i in range(0, len(seen), 80)]
    got = live_events.events_of_arrivals(spark, parts, SPEC, F.col("s"), lateness_s=3600)
    want = whole(spark, rows)
    assert got.columns == want.columns and same(got, want)


def test_open_events_wait_and_too_late_rows_are_told(spark):
    at = lambda h, site, i, s: (site, START + dt.timedelta(hours=h), i, s)
    days = [[at(0, "a", 1, 1.0), at(1, "a", 2, 2.0)], [at(2, "b", 3, -1.0)], [at(3, "a", 4, 3.0), at(0.5, "a", 5, -9.0)], [at(4, "a", 6, -1.0)]]
    df = [spark.createDataFrame(d, SCHEMA) for d in days]
    state = live_events.start(df[0], SPEC, F.col("s"))
    closed, late = [], []
    for d in df:
        done, old, state = live_events.advance(state, d, SPEC, F.col("s"))
        closed.append([(r.site, r.n_steps, r.max_inversion_strength) for r in done.collect()])
        late.append([r.id for r in old.collect()])
    # the event of the first day goes on over the second, which has no row of its site
    assert closed == [[], [], [], [("a", 3, 3.0)]] and late == [[], [], [5], []]
    assert state.open.collect() == [] and state.tail.collect() == []
    done, _, state = live_events.advance(state, df[0].limit(0), SPEC, F.col("s"), last=True)
    assert done.collect() == []


def test_vocabulary_and_dummies(spark):
    train = spark.createDataFrame([("x",)] * 3 + [("y z",)] * 2 + [("b",), ("a",), (None,)], "v string")
    words = dummies.vocabulary(train, ["v"], 3)
    assert sorted((r.place, r.value, r.n) for r in words.collect()) == [(1, "x", 3), (2, "y z", 2), (3, "a", 1), (4, None, 1)]
    new = spark.createDataFrame([(1, "x"), (2, "unseen"), (3, None), (4, "y z"), (5, "b")], "id int, v string")
    out = dummies.add_dummies(new, words)
    assert out.columns == ["id", "v", "v_x", "v_y_z", "v_a", "v_other"]
    assert [tuple(r)[2:] for r in out.orderBy("id").collect()] == [(1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1)]
    assert dummies.add_dummies(new.drop("v"), words).columns == ["id"]
    assert dummies.vocabulary(train.limit(0), ["v"]).collect() == []
