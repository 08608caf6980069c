"""A Bloom filter in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multipliers of the hash, 32-bit arithmetic.
STEP, FINAL, MASK = 103264, 2654435761, 4294967295


def shape(n: int, bits_per_key: int) -> tuple[int, int]:
    """Bits and number of hashes for ``n`` keys."""
    bits = max(64, n * bits_per_key)
    return (bits + 7) // 8 * 8, min(30, max(1, round(bits_per_key * math.log(2))))


def key_hash(key: str) -> Column:
    """32-bit hash of an ASCII text key; the last product is taken by halves, as it exceeds a signed long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.ascii(F.substring(F.col(key), i, F.lit(1))).cast("long"))
    h0 = F.aggregate(codes, F.length(key).cast("long"), lambda h, c: (h * STEP).bitwiseAND(F.lit(MASK)).bitwiseXOR(c))
    h0 = F.when(F.length(key) > 0, h0).otherwise(F.lit(0).cast("long"))
    low, high = h0.bitwiseAND(F.lit(65535)), F.shiftright(h0, 16)
    return (low * FINAL + F.shiftleft((high * FINAL).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(MASK))


def positions(h: Column, bits: int, k: int) -> Column:
    delta = F.greatest(F.lit(1).cast("long"), F.shiftright(h, 17))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h + i.cast("long") * delta).bitwiseAND(F.lit(MASK)) % bits)


def build(keys: DataFrame, bits: int, k: int, key: str = "user_key") -> DataFrame:
    """bit: the positions that are set. At most ``bits`` rows, whatever the number of keys."""
    return keys.select(F.explode(positions(key_hash(key), bits, k)).alias("bit")).distinct()


def probe(filter_bits: DataFrame, keys: DataFrame, bits: int, k: int, key: str = "user_key") -> DataFrame:
    """key, maybe: false means that the key was never added. An empty filter denies all."""
    asked = keys.select(key).distinct().withColumn("bit", F.explode(F.array_distinct(positions(key_hash(key), bits, k))))
    got = asked.join(filter_bits.withColumn("on", F.lit(1)), "bit", "left").groupBy(key).agg(F.min(F.coalesce("on", F.lit(0))).alias("m"))
    return got.select(key, (F.col("m") == 1).alias("maybe"))
