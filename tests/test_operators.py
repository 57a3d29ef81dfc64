"""Operators against brute force on small random input, and their edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.functions.clinical import race_class
from stayline.functions.numbers import whole, whole_even
from stayline.functions.timing import days_between, minutes_between
from stayline.operators.grid import (
    block_grid,
    hour_grid,
    intervals_into_blocks,
    points_into_blocks,
)
from stayline.operators.intervals import overlapped_buckets, stabbed_minutes
from stayline.operators.shape import first_value, ordered_pivot
from stayline.operators.timeline import episode_flags, with_neighbours

T0 = datetime(2024, 1, 1)
random.seed(7)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def bounds(block):
    return block * 240 - 240, 60 if block == 0 else block * 240


def test_offsets_cut_toward_zero_in_any_zone(spark):
    pairs = [
        (T0, T0 - timedelta(seconds=30), 0, 0),
        (T0, T0 - timedelta(seconds=90), -1, 0),
        (T0, T0 + timedelta(hours=47, minutes=59, seconds=59), 2879, 1),
        # across the change to summer time in New York
        (datetime(2024, 3, 10, 1, 59), datetime(2024, 3, 10, 2, 30), 31, 0),
    ]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz, m long, d long")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(minutes_between(F.col("a"), F.col("b")), days_between(F.col("a"), F.col("b"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in got] == [(m, d) for *_, m, d in pairs]


def test_roundings(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (3.5,), (0.1 + 0.7 + 0.7,), (None,)], "x double")
    got = df.select(whole(F.col("x")), whole_even(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(3, 2), (-3, -2), (4, 4), (2, 2), (None, None)]


def test_grids_of_short_reversed_and_open_stays(spark):
    los = {1: 0, 2: 59, 3: 90, 4: 149, 5: None, 6: -10, 7: -600, 8: 8000}
    df = spark.createDataFrame(list(los.items()), "stay_id long, los_min long")
    hours = {}
    for stay, _ in rows(hour_grid(df), "stay_id", "hr"):
        hours[stay] = hours.get(stay, 0) + 1
    assert {s: hours.get(s, 0) for s in los} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 0, 6: 1, 7: 0, 8: 134}
    blocks = rows(block_grid(df), "stay_id", "block", "minute_start", "minute_end")
    assert [b for b in blocks if b[0] == 8][-1] == (8, 30, 6960, 7200)
    assert [b for b in blocks if b[0] == 1] == [(1, 0, -240, 60)]
    assert not [b for b in blocks if b[0] in (5, 7)]


def intervals(n=400):
    made = []
    for i in range(n):
        start = random.randint(-300, 1500)
        length = random.choice([0, 0, -30, random.randint(1, 500)])
        made.append((i, start, start + length))
    # on the boundaries, and open ends
    made += [(n, 60, 60), (n + 1, 60, 120), (n + 2, 61, 61), (n + 3, None, 100), (n + 4, 5, None)]
    return made


def test_overlapped_hours_equal_range_join(spark):
    data = intervals()
    df = spark.createDataFrame(data, "i long, s long, e long")
    got = rows(overlapped_buckets(df, "s", "e", 60, F.lit(20), "hr"), "i", "hr")
    want = sorted(
        (i, h)
        for i, s, e in data
        if s is not None and e is not None
        for h in range(21)
        if s < h * 60 + 60 and e > h * 60
    )
    assert got == want


def test_blocks_equal_range_join(spark):
    data = intervals()
    df = spark.createDataFrame(data, "i long, s long, e long")
    points = rows(points_into_blocks(df, F.col("s")), "i", "block")
    assert points == sorted(
        (i, b)
        for i, s, _ in data
        if s is not None
        for b in range(31)
        if bounds(b)[0] <= s < bounds(b)[1]
    )
    touched = rows(intervals_into_blocks(df, F.col("s"), F.col("e")), "i", "block")
    want = sorted(
        (i, b)
        for i, s, e in data
        if s is not None and e is not None
        for b in range(31)
        if e >= bounds(b)[0] and s < bounds(b)[1]
    )
    assert touched == want


def test_highest_rate_per_minute_equals_minute_loop(spark):
    data = []
    for _ in range(300):
        first = random.randint(0, 400)
        data.append((random.randint(1, 3), first, first + random.randint(0, 200), random.choice([1.0, 2.5, 4.0])))
    df = spark.createDataFrame(data + data[:40], "stay_id long, a long, b long, rate double")
    got = {(s, h): v for s, h, v in rows(stabbed_minutes(df, ["stay_id"], "a", "b", "rate"), "stay_id", "hr", "rate_minutes")}
    want = {}
    for stay in (1, 2, 3):
        for minute in range(0, 660):
            running = [r for s, a, b, r in data if s == stay and a <= minute <= b]
            if running:
                key = (stay, minute // 60)
                want[key] = want.get(key, 0) + max(running)
    assert got == pytest.approx(want)


def test_neighbours_equal_plain_order(spark):
    data = sorted({(random.randint(1, 3), random.randint(0, 3000)) for _ in range(500)})
    df = spark.createDataFrame([(k, o, o * 2) for k, o in data], "k long, o long, x long")
    got = rows(
        with_neighbours(df, "k", "o", F.floor(F.col("o") / 100), {"before": "x"}, {"after": "x"}),
        "k", "o", F.coalesce("before", F.lit(-1)), F.coalesce("after", F.lit(-1)),
    )
    want = []
    for key in (1, 2, 3):
        line = [o for k, o in data if k == key]
        for i, o in enumerate(line):
            before = line[i - 1] * 2 if i else -1
            after = line[i + 1] * 2 if i + 1 < len(line) else -1
            want.append((key, o, before, after))
    assert got == sorted(want)


def test_episodes_open_after_more_than_an_hour(spark):
    spans = [(0, 30), (90, 100), (161, 200), (262, 300)]
    data = [(1, T0 + timedelta(minutes=b), b, e) for b, e in spans] + [(2, T0, 5, 9)]
    df = spark.createDataFrame(data, "stay_id long, starttime timestamp_ntz, b long, e long")
    flags = rows(episode_flags(df, "stay_id", "starttime", "b", "e"), "stay_id", "b", F.coalesce("change", F.lit("")), "is_end")
    assert flags == [
        (1, 0, "start", 0),
        (1, 90, "", 1),
        (1, 161, "start", 1),
        (1, 262, "start", 1),
        (2, 5, "start", 1),
    ]


def test_pivot_keeps_order_and_pads(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 3, "a"), (2, 1, "z")], "k long, o long, v string")
    got = rows(ordered_pivot(df, "k", [F.col("o")], ["o", "v"], 3), "k", "o1", "v1", "o2", F.isnull("v2"), F.isnull("o3"))
    assert [r for r in got if r[0] == 1] == [(1, 3, "a", 5, True, True)]


def test_first_value_puts_null_keys_last(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 4, "y"), (2, None, "z")], "k long, o long, v string")
    assert rows(df.groupBy("k").agg(first_value("v", ["o", "v"], "f")), "k", "f") == [(1, "y"), (2, "z")]


def test_race_first_match_wins(spark):
    df = spark.createDataFrame([("WHITE - x",), ("UNKNOWN",), (None,), ("Black and White",)], "r string")
    assert [r[0] for r in df.select(race_class(F.col("r"))).collect()] == ["White", "other", "other", "Black"]
