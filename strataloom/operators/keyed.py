"""Joins by keys of which a few may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot where it holds more than one row in so many; so there are fewer hot keys than that.
HOT_KEYS = 200


def split_join(rows: DataFrame, values: DataFrame, key: str, times: str, total: int, how: str = "inner", spread: tuple[str, ...] = ()) -> DataFrame:
    """rows with the columns of values, which has one row per key and, in `times`, how many of the rows have it.

    Hot keys (over total / HOT_KEYS of the rows, so fewer than HOT_KEYS keys) are parted: a broadcast list of these
    keys alone tells each row its key's number of parts, a hash of its columns `spread` (all, if none are named)
    chooses one, and the key's value goes to all of its parts, 2 * HOT_KEYS values more at most. No key then holds much of the shuffle. `how` is inner or
    left; the key's null is joined with nothing, and its rows are spread.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    parts = F.ceil(F.col(times) * HOT_KEYS / max(1, total))
    hot = F.broadcast(values.where(F.col(times) * HOT_KEYS > total).select(F.col(key).alias("_hot"), parts.alias("_parts")))
    chosen = F.xxhash64(*(spread or rows.columns))
    salt = F.when(F.col(key).isNull(), F.pmod(chosen, F.lit(HOT_KEYS))).otherwise(F.coalesce(F.pmod(chosen, F.col("_parts")), F.lit(0).cast("long")))
    salted = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_parts")
    each = values.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1).cast("long")) - 1)))
    other = each.drop(times).withColumnRenamed(key, "_key")
    return salted.join(other, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")), how).drop("_key", "_salt", "_part")
