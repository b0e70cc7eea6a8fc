"""As-of join: brute force on hot keys, ties across ranges, copies, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.llm import asof

ASKS, OFFERS = "ask_id long, key long, ts_us long", "key long, ts_us long, rank long, offer_id long, amount long"


def brute(asks, offers, tolerance):
    last = lambda x: (x is None, x or 0)  # noqa: E731  nulls last
    out = []
    for ask, key, ts in asks:
        seen = [o for o in offers if key is not None and ts is not None and o[0] == key and o[1] is not None and ts - tolerance <= o[1] <= ts]
        at = max((o[1] for o in seen), default=None)
        tied = [o for o in seen if o[1] == at]
        best = min(tied, key=lambda o: (last(o[2]), o[3] is None, -(o[3] or 0)), default=None)
        out.append((ask, key, ts, best[3] if best else None, ts - at if best else None, best[4] if best else None, len(tied)))
    return out


def answers(spark, asks, offers, tolerance):
    got = asof.as_of(spark.createDataFrame(asks, ASKS), spark.createDataFrame(offers, OFFERS), tolerance)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    """A key with two thirds of the rows, few times, so that tie groups and copies lie on both sides of the ranges' bounds."""
    chance = random.Random(seed)
    key = lambda: 7 if chance.random() < 0.66 else chance.choice([None, -3, 0, 5, 2**62])
    time = lambda: None if chance.random() < 0.03 else chance.choice([-50, 0, 1, 2, 3]) * 10 + chance.choice([0, 0, 0, 1])
    asks = [(k, key(), time()) for k in range(-150, 150)]
    offers = [(key(), time(), chance.choice([None, 1, 2]), chance.choice([None, -1, 4, 9, k]), chance.choice([None, -7, 100])) for k in range(300)]
    offers += offers[:40] * 3
    # With one amount for each (rank, id), as equal best offers could differ in it otherwise.
    offers = [(*o[:4], None if o[3] is None else o[3] % 5 * 11 + (o[2] or 0)) for o in offers]
    assert answers(spark, asks, offers, 25) == sorted(brute(asks, offers, 25), key=str)


def test_empty_sides(spark):
    asks, offers = [(1, 2, 3), (2, None, 3), (3, 2, None)], [(2, 1, 1, 1, 1)]
    assert answers(spark, asks, [], 10) == sorted(brute(asks, [], 10), key=str)
    assert answers(spark, [], offers, 10) == []
    assert answers(spark, [], [], 10) == []


def test_one_time_of_one_key_holds_all(spark):
    """One tie group over all ranges: it is counted whole."""
    asks, offers = [(k, 1, 10) for k in range(200)], [(1, 10, 2, k, k) for k in range(500)]
    assert {r[3:] for r in answers(spark, asks, offers, 0)} == {(499, 0, 499, 500)}


def test_tolerance_is_inclusive(spark):
    assert [r[6] for r in answers(spark, [(1, 1, 10), (2, 1, 11)], [(1, 0, None, None, None)], 10)] == [1, 0]


def test_copies_meet_as_one_record():
    records = asof._records((b"k" * asof.KEY.itemsize + b"v" * asof.AMOUNT.itemsize) * 3, asof.OFFER)
    assert len(records) == 1 and asof._times(records[0][1]) == 3


def test_carried_groups():
    group = lambda at, rank, n: (at, at + rank, b"", n)
    a, b = group(b"1", b"b", 2), group(b"1", b"a", 1)
    assert asof._carried([None, a, None, b, group(b"2", b"c", 1)]) == [None, None, a, a, (b"1", b"1a", b"", 3)]


def test_tables(spark):
    """Broken rows of the tables: no id, no total, no zone, copies that differ, columns of clashing names."""
    clicks = spark.createDataFrame([(1, "2024-01-02 00:30:00", 5), (1, "2024-01-02 00:30:00", 5), (2, None, 5), (None, "2024-01-02 00:30:00", 5), (3, "2024-01-02 01:00:00", None), (4, "2024-01-01 00:00:01", 5), (4, None, 6)], "click_id long, t string, client_id long").selectExpr("click_id", "cast(t as timestamp_ntz) ts", "client_id", "'x' as key", "'y' as rank")
    asks = {r.ask_id: (r.key, r.ts_us) for r in asof.asks_of(clicks).collect()}
    assert set(asks) == {1, 2, 3, 4} and asks[2] == (5, None) and asks[3][0] is None and asks[4][0] == 5
    sales = spark.createDataFrame([(1, 5, "2024-01-01 12:34:56", 2, 10.005), (None, 5, "2024-01-01 12:34:56", 3, float("nan")), (8, None, None, None, None)], "sale_id long, client_id long, t string, priority int, total double").selectExpr("sale_id", "client_id", "cast(t as timestamp_ntz) sold_at", "priority", "total")
    offers = [tuple(r) for r in asof.offers_of(sales.withColumn("amount", F.lit("z"))).collect()]
    assert (5, 1704112496000000, 3, None, None) in offers
    assert {o[2:4] for o in offers if o[4] == 1001 or o[4] == 1000} in ({(2, 1)}, {(2, 1), (4, -2)})


def test_micros_do_not_depend_on_the_zone(spark):
    rows = spark.range(1).selectExpr("timestamp_ntz'2024-03-31 02:30:00.000001' as a", "timestamp_ntz'1969-12-31 23:59:59.999999' as b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert tuple(rows.select(asof.micros(rows, "a"), asof.micros(rows, "b")).first()) == (1711852200000001, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
