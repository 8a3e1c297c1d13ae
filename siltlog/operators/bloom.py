"""Key filters of runs as tables of bitmaps: no false negatives, and a rate of false positives that follows from the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least bits of a filter, hundredths of the bits a key that a key sets, and most hashes.
LEAST_BITS, SHARE, MOST_HASHES = 64, 69, 30
#: Bits of a row's bitmap: what bitmap_construct_agg fills.
ROW_BITS = 4096 * 8


def filter_bits(keys: Column, bits_per_key: int) -> Column:
    """Bits of a filter of so many keys: LEAST_BITS at least."""
    return F.greatest(F.lit(LEAST_BITS).cast("long"), keys * max(1, bits_per_key))


def filter_hashes(bits_per_key: int) -> int:
    """Bits that a key sets: SHARE hundredths of the bits a key, from 1 to MOST_HASHES."""
    return max(1, min(MOST_HASHES, bits_per_key * SHARE // 100))


def positions(key: Column, bits: Column, hashes: int) -> Column:
    """Bits of a key: a walk from one hash in steps of another."""
    start, step = (F.pmod(F.xxhash64(key, F.lit(seed)), bits) for seed in (1, 2))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(start + i * step, bits))


def build_filters(ops: DataFrame, run: str = "run", key: str = "k", bits_per_key: int = 10) -> DataFrame:
    """(run, bits, hashes, part, bitmap): the filter of each run's keys, a row for each ROW_BITS bits that has any set.

    Bits are set in partial bitmaps ahead of the shuffle, so that a run of any size is never
    in one task; keys are counted first, as the filter's size follows from them.
    """
    counts = ops.groupBy(run).agg(F.count_distinct(key).alias("keys")).select(run, filter_bits(F.col("keys"), bits_per_key).alias("bits"))
    bit = ops.join(counts, run).select(run, "bits", F.explode(positions(F.col(key), F.col("bits"), filter_hashes(bits_per_key))).alias("bit"))
    part, place = F.floor(F.col("bit") / ROW_BITS).cast("long"), F.pmod(F.col("bit"), F.lit(ROW_BITS)).cast("long")
    maps = bit.groupBy(run, "bits", part.alias("part")).agg(F.bitmap_construct_agg(place).alias("bitmap"))
    return maps.select(run, "bits", F.lit(filter_hashes(bits_per_key)).alias("hashes"), "part", "bitmap")


def may_contain(probes: DataFrame, filters: DataFrame, run: str = "run", key: str = "k") -> DataFrame:
    """probes (run, key and others) with `maybe`: false if the run's filter rules the key out. Runs without a filter rule out nothing."""
    sizes = filters.select(run, "bits", "hashes").distinct()
    known = probes.withColumn("_row", F.monotonically_increasing_id()).join(sizes, run, "left")
    hashes = F.sequence(F.lit(0), F.col("hashes") - 1)
    start, step = (F.pmod(F.xxhash64(key, F.lit(seed)), F.col("bits")) for seed in (1, 2))
    bit = known.select("*", F.explode_outer(F.transform(hashes, lambda i: F.pmod(start + i * step, F.col("bits")))).alias("_bit"))
    bit = bit.withColumn("part", F.floor(F.col("_bit") / ROW_BITS).cast("long")).join(filters.select(run, "part", "bitmap"), [run, "part"], "left")
    place = F.pmod(F.col("_bit"), F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.when(F.col("_bit").isNull(), F.lit(True)).otherwise(F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)))
    answers = bit.groupBy("_row").agg(*[F.first(c).alias(c) for c in probes.columns], F.bool_and(is_set).alias("maybe"))
    return answers.drop("_row")


def sound(filters: DataFrame) -> DataFrame:
    """filters with `ok`: whether a row's sizes can be those of a filter and its bitmap is whole."""
    ok = (F.col("bits") >= LEAST_BITS) & F.col("hashes").between(1, MOST_HASHES) & (F.octet_length("bitmap") == ROW_BITS // 8) & (F.col("part") * ROW_BITS < F.col("bits")) & (F.col("part") >= 0)
    return filters.withColumn("ok", F.coalesce(ok, F.lit(False)))
