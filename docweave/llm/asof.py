"""Tolerant as-of join on sorted streams (operator 13).

Each ask (ask_id, key, ts_us) gets the last offer (key, ts_us, rank, offer_id, amount) of its key at or before its
time and within a tolerance; of offers at one time the smaller rank wins, then the larger offer_id, and null loses.

Both sides become records whose bytes order like (key, time, side, rank, offer), offers before asks.
RDD.repartitionAndSortWithinPartitions deals them out by ranges of the whole composite key and sorts each range, so a key
that holds a third of all rows, or even one time of it, is spread over many ranges. A generator then walks the sorted
records of a range and holds the current tie group only: its time, its best offer and its size. The tie group that
a range has to begin with is the last one of the ranges before it; each range reports its last group (one small
record a range, whatever the number of rows), and these are carried forward.

The bounds of the ranges come from a sample of a fixed number of records for each range. Copies of an offer that are read
together travel as one record with their number. Records go to and from the RDD in packed batches.

Defined results: an ask without key or time never matches (n_tied 0; offer_id, lag_us, amount null) and does not enter
the sort; offers without key or time match nothing; offers count row by row, copies too; a null rank or a
null offer_id loses against any other, and an offer without an id can match; a null amount stays null. Empty tables on
either side, and other columns of any name, are fine. Asks are taken row by row: make them distinct before.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.workers import prepare
from docweave.llm._frames import read

HOUR_US = 3_600_000_000
#: Sampled records for each range.
SAMPLE = 100
#: Answers in one packed batch.
ANSWERS = 4_096
#: Big-endian with the sign bit flipped, so that bytes order like numbers; an offer's id is inverted (the larger is first), nulls are last.
KEY = np.dtype([("key", ">u8"), ("time", ">u8"), ("side", "u1"), ("no_rank", "u1"), ("rank", ">u8"), ("no_id", "u1"), ("id", ">u8")])
AMOUNT = np.dtype([("no_amount", "u1"), ("amount", ">i8")])
FLIP = np.uint64(1 << 63)
OFFER, ASK = 0, 1
SIDE, GROUP = 16, slice(0, 16)
ANSWER = np.dtype([("ask_id", "<i8"), ("key", "<i8"), ("ts_us", "<i8"), ("n_tied", "<i8"), ("no_offer", "u1"), ("offer_id", "<i8"), ("lag_us", "<i8"), ("no_amount", "u1"), ("amount", "<i8")])
RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("ask_id", "key", "ts_us", "offer_id", "lag_us", "amount", "n_tied")])


def _ordered(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ FLIP


def _packed(rows: DataFrame, side: int) -> RDD:
    """Batches of records, each batch the bytes of its records one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record = np.zeros(batch.num_rows, KEY.descr + AMOUNT.descr if side == OFFER else KEY)
            record["key"], record["time"], record["side"] = _ordered(batch.column("key")), _ordered(batch.column("ts_us")), side
            if side == ASK:
                record["id"] = _ordered(batch.column("ask_id"))
            else:
                rank, no, amount = batch.column("rank"), batch.column("offer_id"), batch.column("amount")
                record["no_rank"], record["rank"] = rank.is_null().to_numpy(zero_copy_only=False), _ordered(rank)
                record["no_id"], record["id"] = no.is_null().to_numpy(zero_copy_only=False), ~_ordered(no)
                record["no_amount"], record["amount"] = amount.is_null().to_numpy(zero_copy_only=False), amount.fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([record.tobytes()], pa.binary())], names=["packed"])

    return rows.mapInArrow(pack, "packed binary").rdd.map(lambda row: bytes(row[0]))


def _records(packed: bytes, side: int) -> list[tuple[bytes, bytes]]:
    """(composite key, amount); of copies one, with their number behind the amount."""
    width = KEY.itemsize
    if side == ASK:
        return [(packed[a : a + width], b"") for a in range(0, len(packed), width)]
    whole = width + AMOUNT.itemsize
    counted = Counter(packed[a : a + whole] for a in range(0, len(packed), whole))
    return [(r[:width], r[width:] if n == 1 else r[width:] + n.to_bytes(8, "big")) for r, n in counted.items()]


def _times(value: bytes) -> int:
    return 1 if len(value) == AMOUNT.itemsize else int.from_bytes(value[AMOUNT.itemsize :], "big")


def _bounds(sides: list[tuple[RDD, int]], ranges: int) -> list[bytes]:
    """The first keys of the second and later ranges: quantiles of SAMPLE * ranges records or so, drawn from all partitions."""
    parts = sum(rdd.getNumPartitions() for rdd, _ in sides)
    each = -(-SAMPLE * ranges // max(1, parts))

    def sketch(number: int, batches: Iterable[bytes], side: int) -> Iterator[tuple[int, list[bytes]]]:
        chance, total, some, weights = random.Random(number), 0, [], []
        for packed in batches:
            width = KEY.itemsize + (AMOUNT.itemsize if side == OFFER else 0)
            n = len(packed) // width
            total += n
            for k in chance.sample(range(n), min(n, each)):
                some.append(packed[k * width : k * width + KEY.itemsize])
                weights.append(n / min(n, each))
        yield total, chance.choices(some, weights, k=min(total, each)) if some else []

    found = [x for rdd, side in sides for x in rdd.mapPartitionsWithIndex(partial(sketch, side=side)).collect()]
    drawn = sorted((key, total / len(keys)) for total, keys in found for key in keys)
    share = sum(w for _, w in drawn) / ranges
    bounds, passed = [], 0.0
    for key, weight in drawn:
        passed += weight
        if passed >= share * (len(bounds) + 1) and (not bounds or key > bounds[-1]):
            bounds.append(key)
    return bounds[: ranges - 1]


Group = tuple[bytes, bytes, bytes, int]  # key and time, the best offer's record and amount, how many


def _last_group(records: Iterable[tuple[bytes, bytes]]) -> Iterator[Group | None]:
    """The last tie group of offers of a range, which need not be sorted yet."""
    at, best, amount, n = b"", b"", b"", 0
    for key, value in records:
        if key[SIDE] == OFFER and (here := key[GROUP]) >= at:
            if here > at:
                at, best, amount, n = here, key, value, 0
            n += _times(value)
            if key < best:
                best, amount = key, value
    yield (at, best, amount, n) if n else None


def _carried(groups: list[Group | None]) -> list[Group | None]:
    """The group that each range begins with."""
    out, now = [], None
    for group in groups:
        out.append(now)
        if group and now and group[0] == now[0]:
            now = (*min(now[:3], group[:3]), now[3] + group[3])
        else:
            now = group or now
    return out


def _merged(number: int, records: Iterable[tuple[bytes, bytes]], begin: list[Group | None], tolerance: int) -> Iterator[bytes]:
    """One answer for each ask of a sorted range. What is held: the tie group of the last time that had offers."""
    flip, of_key = 1 << 63, Struct(">QQ")
    answer = Struct("<qqqqBqqBq")
    at, best, amount, n = begin[number] or (b"", b"", b"", 0)
    key_of, time_of = of_key.unpack(at) if at else (-1, 0)
    stale, offer = True, ()
    for key, value in records:
        if key[SIDE] == OFFER:
            if key[GROUP] != at:
                at, best, amount, n, stale = key[GROUP], key, value, 0, True
                key_of, time_of = of_key.unpack(at)
            n += _times(value)
            continue
        own, time = of_key.unpack_from(key)
        ask = int.from_bytes(key[-8:], "big") - flip
        if own != key_of or time - time_of > tolerance:
            yield answer.pack(ask, own - flip, time - flip, 0, 1, 0, 0, 1, 0)
            continue
        if stale:
            no_id, inverted = best[-9], int.from_bytes(best[-8:], "big")
            offer, stale = (no_id, 0 if no_id else flip - 1 - inverted, amount[0], int.from_bytes(amount[1:9], "big", signed=True)), False
        yield answer.pack(ask, own - flip, time - flip, n, offer[0], offer[1], time - time_of, offer[2], offer[3])


def _batched(number: int, records: Iterable[tuple[bytes, bytes]], begin: list[Group | None], tolerance: int) -> Iterator[tuple[bytes]]:
    answers = _merged(number, records, begin, tolerance)
    while some := b"".join(islice(answers, ANSWERS)):
        yield (some,)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("packed"):
            rows = np.frombuffer(packed.as_buffer(), ANSWER)
            nulls = {"offer_id": rows["no_offer"] == 1, "lag_us": rows["n_tied"] == 0, "amount": rows["no_amount"] == 1}
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c]), pa.int64(), mask=nulls.get(c)) for c in RESULT.names], names=RESULT.names)


def as_of(asks: DataFrame, offers: DataFrame, tolerance_us: int) -> DataFrame:
    """ask_id, key, ts_us, offer_id, lag_us, amount, n_tied for each row of asks (all long)."""
    spark = asks.sparkSession
    prepare(spark)
    asks = asks.select(*[F.col(c).cast("long") for c in ("ask_id", "key", "ts_us")])
    offers = offers.select(*[F.col(c).cast("long") for c in ("key", "ts_us", "rank", "offer_id", "amount")])
    whole = F.col("key").isNotNull() & F.col("ts_us").isNotNull()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = [(_packed(offers.filter(whole), OFFER), OFFER), (_packed(asks.filter(whole & F.col("ask_id").isNotNull()), ASK), ASK)]
    bounds = _bounds(sides, ranges)
    place = partial(bisect_right, bounds)  # the range of a composite key
    records = spark.sparkContext.union([rdd.flatMap(partial(_records, side=side)) for rdd, side in sides]).partitionBy(ranges, place)
    begin = _carried(records.mapPartitions(_last_group).collect())
    ordered = records.repartitionAndSortWithinPartitions(ranges, place)  # of the same ranges: sorts them where they are
    answers = ordered.mapPartitionsWithIndex(partial(_batched, begin=begin, tolerance=tolerance_us))
    matched = spark.createDataFrame(answers, T.StructType([T.StructField("packed", T.BinaryType())]), verifySchema=False).mapInArrow(_unpacked, RESULT)
    null = F.lit(None).cast("long")
    never = asks.filter(~(whole & F.col("ask_id").isNotNull())).select("ask_id", "key", "ts_us", null.alias("offer_id"), null.alias("lag_us"), null.alias("amount"), F.lit(0).cast("long").alias("n_tied"))
    return matched.unionByName(never)


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    if isinstance(rows.schema[name].dataType, T.TimestampNTZType):
        since = F.col(name) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(20, 6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp"))


def crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def floored(time: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), time - F.pmod(time, F.lit(HOUR_US))).otherwise(time)


def asks_of(clicks: DataFrame) -> DataFrame:
    """One ask for each click_id; rows without one name no click. Copies that differ: the earliest time, then the smallest client counts."""
    time = micros(clicks, "ts")
    rows = clicks.filter("click_id is not null").select(F.col("click_id").cast("long").alias("ask_id"), F.col("client_id").cast("long").alias("key"), time.alias("ts_us"))
    first = F.min(F.struct(F.col("ts_us").isNull().alias("a"), "ts_us", F.col("key").isNull().alias("b"), "key")).alias("x")
    one = rows.groupBy("ask_id").agg(first).select("ask_id", "x.key", "x.ts_us")
    return one.withColumn("ts_us", floored(F.col("ts_us"), crc(F.col("ask_id")) % 2 == 1))


def offers_of(sales: DataFrame) -> DataFrame:
    """An order for each row, and a second one where the checksum of its id is not divisible by 3."""
    cents = F.when(~F.isnan("total") & (F.abs("total") < 1e16), F.floor(F.col("total") * 100 + 0.5).cast("long"))
    rows = sales.select(F.col("client_id").alias("key"), floored(micros(sales, "sold_at"), crc(F.col("sale_id")) % 2 == 1).alias("ts_us"), F.col("priority").cast("long").alias("rank"), F.col("sale_id").cast("long").alias("offer_id"), cents.alias("amount"))
    second = F.struct((6 - F.col("rank")).alias("rank"), (-1 - F.col("offer_id")).alias("offer_id"))
    first = F.struct("rank", "offer_id")
    both = F.when(crc(F.col("offer_id")) % 3 != 0, F.array(first, second)).otherwise(F.array(first))
    return rows.select("key", "ts_us", "amount", F.explode(both).alias("x")).select("key", "ts_us", "x.rank", "x.offer_id", "amount")


def op13_tolerant_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = read(spark, sf_dir, "clicks").select("click_id", "client_id", "ts")
    sales = read(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at", "priority", "total")
    found = as_of(asks_of(clicks), offers_of(sales), 240 * HOUR_US)
    return found.select(F.col("ask_id").alias("click_id"), F.col("key").alias("client_id"), "ts_us", F.col("offer_id").alias("sale_id"), "lag_us", F.col("amount").alias("total_cents"), "n_tied")


OP13_SQL = """
WITH crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
ids AS (SELECT DISTINCT click_id AS id FROM clicks UNION SELECT DISTINCT sale_id FROM sales),
crcs AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h FROM ids, crc_table WHERE id IS NOT NULL),
asks AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - (us % 3600000000) ELSE us END AS ts_us
         FROM (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us FROM clicks) JOIN crcs ON id = click_id),
plain AS (SELECT sale_id, client_id, priority, h, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents, CASE WHEN h % 2 = 1 THEN us - (us % 3600000000) ELSE us END AS t
          FROM (SELECT *, epoch_us(sold_at) AS us FROM sales) JOIN crcs ON id = sale_id),
orders AS (SELECT sale_id, client_id, priority, cents, t FROM plain UNION ALL SELECT -1 - sale_id, client_id, 6 - priority, cents, t FROM plain WHERE h % 3 <> 0),
tied AS (SELECT client_id, t, count(*) AS n, first(sale_id ORDER BY priority ASC NULLS LAST, sale_id DESC NULLS LAST) AS sale_id,
                first(cents ORDER BY priority ASC NULLS LAST, sale_id DESC NULLS LAST) AS cents
         FROM orders WHERE client_id IS NOT NULL AND t IS NOT NULL GROUP BY client_id, t),
met AS (SELECT a.click_id, a.client_id, a.ts_us, o.sale_id, a.ts_us - o.t AS lag_us, o.cents, o.n
        FROM asks a ASOF LEFT JOIN tied o ON a.client_id = o.client_id AND a.ts_us >= o.t)
SELECT click_id, client_id, ts_us, CASE WHEN lag_us <= 864000000000 THEN sale_id END AS sale_id, CASE WHEN lag_us <= 864000000000 THEN lag_us END AS lag_us,
       CASE WHEN lag_us <= 864000000000 THEN cents END AS total_cents, CASE WHEN lag_us <= 864000000000 THEN n ELSE 0 END AS n_tied
FROM met
"""
