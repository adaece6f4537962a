"""After-images of UPDATE and DELETE, as joins; nothing is collected.

Keys are checked by semi and anti joins, so they hold for any number of rows at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def referenced(children: list[DataFrame]) -> DataFrame | None:
    """All values in the foreign keys of other tables, given as one-column frames."""
    frames = [c.toDF("__key") for c in children]
    return reduce(DataFrame.unionByName, frames).distinct() if frames else None


def delete_rows(target: DataFrame, where: Column | None, pk: str | None, children: list[DataFrame]) -> DataFrame:
    """What is left of the target: rows that don't match, and rows that are referred to."""
    if where is None:
        where = F.lit(True)
    keys = referenced(children)
    if keys is None or pk is None:
        return target.filter(~where)
    held = keys.withColumn("__held", F.lit(True))
    return target.join(held, target[pk] == held["__key"], "left").filter(~where | F.col("__held")).select(*target.columns)


def update_rows(target: DataFrame, where: Column | None, sets: dict[str, Column], parents: dict[str, DataFrame]) -> DataFrame:
    """All rows after the change, and ``__changed``.  Expressions see the row as it was; a row whose new
    foreign key doesn't exist stays as it was."""
    df = target.withColumns({f"__new_{c}": e.cast(target.schema[c].dataType) for c, e in sets.items()}).withColumn("__hit", F.lit(True) if where is None else where)
    ok = F.col("__hit")
    for c, keys in parents.items():
        k = keys.toDF(f"__key_{c}").distinct().withColumn(f"__is_{c}", F.lit(True))
        df = df.join(k, F.col(f"__new_{c}") == F.col(f"__key_{c}"), "left")
        ok = ok & F.coalesce(F.col(f"__is_{c}"), F.lit(False))
    df = df.withColumn("__ok", ok)
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__new_{c}")) for c in sets])
    return df.select(*[F.when(F.col("__ok"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns], (F.col("__ok") & differs).alias("__changed"))


def droppable(pk: str | None, keys: DataFrame, children: list[DataFrame]) -> DataFrame:
    """One row: whether no other table refers to any of the keys."""
    refs = referenced(children)
    if pk is None or refs is None:
        return keys.sparkSession.range(1).select(F.lit(True).alias("droppable"))
    return keys.join(refs, keys[pk] == refs["__key"], "left_semi").agg((F.count(F.lit(1)) == 0).alias("droppable"))
