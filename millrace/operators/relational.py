"""Relational operators over DataFrames whose columns are named ``table.column``.

Joins of tables carry no hints: Catalyst broadcasts a side when its size is known to be small, and adaptive execution
splits skewed partitions of the others.  Both go by bytes read, so joins on columns that are a key of neither side,
whose rows multiply, are dealt out by the rows they give (``many_to_many``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BindError
from ..functions.expressions import Scope, column, condition, tables_of
from ..plans.nodes import Binary, ColumnRef, Expr

#: Rows of a join on non-keys that one pair of a key's pieces gives, about.
PIECE_ROWS = 1_000_000
#: Rows of the larger side that a piece has at least, about: the other side is sent once for each piece.
LEAST_PIECE = 16


def scan(table: str, df: DataFrame) -> DataFrame:
    """All columns, qualified; unused ones are pruned from the file scan by Catalyst."""
    return df.select(*[df[f"`{c}`"].alias(f"{table}.{c}") for c in df.columns])


def filter_rows(df: DataFrame, where: Expr | None, scope: Scope) -> DataFrame:
    return df if where is None else df.filter(condition(where, scope))


def cross_product(sides: list[DataFrame]) -> DataFrame:
    """Equalities in a filter above become join keys."""
    return reduce(lambda a, b: a.crossJoin(b), sides)


def pk_join(left: DataFrame, right: DataFrame, left_pk: str, right_pk: str) -> DataFrame:
    """Rows with equal primary keys, without the key of the right."""
    key = f"`{right_pk}`"
    return left.join(right, left[f"`{left_pk}`"] == right[key], "inner").drop(right[key])


def equi_joins(sides: dict[str, DataFrame], conditions: list[Expr], scope: Scope, pks: dict[str, str | None]) -> DataFrame:
    """Filters on one table go below the joins; equalities of two tables' columns join them in the order of
    the tables; whatever else the conditions ask for is a filter as soon as its tables are joined.

    pks: the tables' primary keys, by which it is known what a join can't multiply; the result doesn't depend on them."""
    keys: list[tuple[set[str], Column]] = []
    equal: list[dict[str, str]] = []  # of each of the keys: its columns by table
    rest: list[tuple[set[str], Column]] = []
    for c in conditions:
        tables, col = tables_of(c, scope), condition(c, scope)
        if len(tables) == 1:
            (t,) = tables
            sides = sides | {t: sides[t].filter(col)}
        elif len(tables) == 2 and isinstance(c, Binary) and c.op == "==" and isinstance(c.left, ColumnRef) and isinstance(c.right, ColumnRef):
            keys.append((tables, col))
            equal.append({t: f"{t}.{n}" for t, n in (scope.resolve(c.left), scope.resolve(c.right))})
        else:
            rest.append((tables, col))
    todo = list(sides)
    done = {first := todo.pop(0)}
    out = sides[first]
    pk = {t: f"{t}.{k}" for t, k in pks.items() if k is not None}
    unique = {pk[first]} if first in pk else set()  # columns without a value twice in out
    while todo:
        nxt = next((t for t in todo if any(t in k and k - {t} <= done for k, _ in keys)), None)
        if nxt is None:
            raise BindError("generate ast error, exist unjoined tables")
        todo.remove(nxt)
        done.add(nxt)
        on = reduce(lambda a, b: a & b, [col for k, col in [*keys, *rest] if nxt in k and k <= done])
        pairs = [(x[(set(x) - {nxt}).pop()], x[nxt]) for x in equal if nxt in x and set(x) <= done]
        one_left, one_right = any(a in unique for a, _ in pairs), any(b == pk.get(nxt) for _, b in pairs)
        if one_left or one_right:
            out = out.join(sides[nxt], on, "inner")
        else:
            ids = lambda ts: [pk[t] for t in sorted(ts)] if all(t in pk for t in ts) else []
            out = many_to_many(out, sides[nxt], on, pairs, ids(done - {nxt}), ids({nxt}))
        unique = (unique if one_right else set()) | ({pk[nxt]} if one_left and nxt in pk else set())
    never = [col for k, col in rest if not k]  # conditions without any column
    return reduce(lambda df, col: df.filter(col), never, out)


def many_to_many(left: DataFrame, right: DataFrame, on: Column, pairs: list[tuple[str, str]], left_ids: list[str], right_ids: list[str]) -> DataFrame:
    """An inner join whose keys (``pairs``, also in ``on``) may come often on both sides.

    A few MB can give billions of rows, which one task would make for each file or key.  If Catalyst will broadcast a
    side, the rows of the other are dealt out evenly, and those of a key together as far as that goes: they meet the
    same rows.  Else the rows of a key are cut into pieces on the larger side by a hash, as many as the rows that the key
    gives ask for, and those of the other side are sent to each piece; keys that give few rows are joined as ever.

    left_ids, right_ids: columns that tell a side's rows apart, if any do; without, equal rows share a piece.
    """
    spark = left.sparkSession
    small, large = sorted((left, right), key=_bytes)
    keys, others = [p[large is right] for p in pairs], [p[small is right] for p in pairs]
    ids = right_ids if large is right else left_ids
    if _bytes(small) <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        n = 4 * spark.sparkContext.defaultParallelism
        dealt = large.repartitionByRange(n, *[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *ids])]) if ids else large.repartition(n)
        return left.join(dealt, on, "inner") if large is right else dealt.join(right, on, "inner")

    def counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(name))

    pieces = F.ceil(F.least(F.col("__large") * F.col("__small").cast("double") / PIECE_ROWS, F.col("__large") / LEAST_PIECE)).cast("int")
    both = counts(large, keys, "__large").join(counts(small, others, "__small"), [f"__key{i}" for i in range(len(pairs))])
    often = both.withColumn("__pieces", pieces).filter("__pieces > 1").drop("__large", "__small")  # a row for about a million of the result

    def with_pieces(df: DataFrame, keys: list[str]) -> DataFrame:
        match = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__key{i}") for i, k in enumerate(keys)])
        return df.join(F.broadcast(often), match, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__pieces", F.lit(1)).alias("__pieces"))

    columns = [*left.columns, *right.columns]
    hashed = ids or [f.name for f in large.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.col("__pieces")).cast("int")
    large = with_pieces(large, keys).withColumn("__piece", piece).drop("__pieces")
    small = with_pieces(small, others).withColumn("__of", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces")
    return large.join(small, on & (F.col("__piece") == F.col("__of")), "inner").select(*[F.col(f"`{c}`") for c in columns])


def _bytes(df: DataFrame) -> int:
    """Catalyst's estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def project(df: DataFrame, items: list[tuple[Column, str]]) -> DataFrame:
    """Columns in the given order and under the given names; a name may come twice."""
    return df.select(*[c.alias(name) for c, name in items])


def order_rows(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    return df.orderBy(*[c.asc() if up else c.desc() for c, up in keys]) if keys else df


def key_lookup(df: DataFrame, key: str, value: int | str) -> DataFrame:
    """The row of a key; the filter reaches the file scan."""
    return df.filter(df[f"`{key}`"] == F.lit(value))


__all__ = ["column", "cross_product", "equi_joins", "filter_rows", "key_lookup", "many_to_many", "order_rows", "pk_join", "project", "scan"]
