"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot if it holds at least this part of the rows, so there are at most
# 1 / HOT_SHARE hot keys; that bounds the broadcast of them.
HOT_SHARE = 1e-3

# Names of the helper columns; no table has them.
KEY, SALTS, SALT = "join detail key", "join detail salts", "join detail salt"


def holds_map(kind: T.DataType) -> bool:
    """Whether values of this type cannot be hashed because they hold a map."""
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(holds_map(field.dataType) for field in kind.fields)


def join_detail(many: DataFrame, one: DataFrame, on: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``many`` with ``one`` on column ``on``, hot keys of ``many`` spread.

    Rows of a hot key get a salt from their content, maps left out, and the partition they
    come from; a key has as many salts as it holds shares of ``hot_share``. The rows of
    ``one`` with that key are repeated once a salt; all other keys join as they are. Only
    hot keys, not rows, are broadcast.
    """
    counts = many.where(F.col(on).isNotNull()).groupBy(F.col(on).alias(KEY)).agg(F.count(F.lit(1)).alias(SALTS))
    limit = F.greatest(F.lit(1.0), F.lit(hot_share) * counts.agg(F.sum(SALTS)).scalar())
    salts = F.ceil(F.col(SALTS) / limit).cast("int")
    hot = F.broadcast(counts.where(F.col(SALTS) >= limit).select(KEY, salts.alias(SALTS)))
    content = [F.col(f"`{f.name}`") for f in many.schema.fields if not holds_map(f.dataType)]
    spread = F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.col(SALTS)).cast("int")
    marked = many.join(hot, many[on] == hot[KEY], "left").drop(KEY)
    salted = marked.withColumn(SALT, F.when(F.col(SALTS).isNotNull(), spread).otherwise(0)).drop(SALTS)
    copies = F.when(F.col(SALTS).isNotNull(), F.sequence(F.lit(0), F.col(SALTS) - 1)).otherwise(F.array(F.lit(0)))
    repeated = one.join(hot, one[on] == hot[KEY], "left").drop(KEY).withColumn(SALT, F.explode(copies)).drop(SALTS)
    return salted.join(repeated, [on, SALT]).drop(SALT)
