"""SELECT statements to DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import BindError
from ..functions.expressions import Scope, column, to_column, type_of
from ..operators import relational as R
from .nodes import ColumnRef, Select, conjuncts


def plan_select(q: Select, table: Callable[[str], DataFrame], key_of: Callable[[str], str | None], analytical: bool) -> DataFrame:
    """table: a table by name (raises if there is none); key_of: its primary key.

    Names of the result: bare for one table in transactional mode, else ``table.column``; an expression is
    ``Column`` and its place in the list, from 0.
    """
    if len(set(q.tables)) < len(q.tables):
        raise BindError("a table may be named once in FROM")
    tables = {t: table(t) for t in q.tables}
    scope = Scope.of(tables)
    sides = {t: R.scan(t, df) for t, df in tables.items()}
    every = [(t, f.name) for t, df in tables.items() for f in df.schema.fields]
    if analytical:
        df = R.equi_joins(sides, conjuncts(q.where), scope, {t: key_of(t) for t in q.tables})
    else:
        if q.pk_join:
            (a, b), keys = q.tables, [key_of(t) for t in q.tables]
            for t, k in zip(q.tables, keys, strict=True):
                if k is None:
                    raise BindError(f'table "{t}" has no primary key')
            if scope.kinds[a, keys[0]] != scope.kinds[b, keys[1]]:
                raise BindError("expression types don't match")
            df = R.pk_join(sides[a], sides[b], f"{a}.{keys[0]}", f"{b}.{keys[1]}")
            every.remove((b, keys[1]))
            scope = Scope({k: v for k, v in scope.kinds.items() if k != (b, keys[1])}, scope.tables)
        else:
            df = R.cross_product(list(sides.values()))
        df = R.filter_rows(df, q.where, scope)
        df = R.order_rows(df, [(to_column(e, scope), up) for e, up in q.order])
    bare = not analytical and len(q.tables) == 1
    name = lambda t, c: c if bare else f"{t}.{c}"
    if q.items is None:
        return R.project(df, [(column(t, c), name(t, c)) for t, c in every])
    out = []
    for i, e in enumerate(q.items):
        type_of(e, scope)
        out.append((to_column(e, scope), name(*scope.resolve(e)) if isinstance(e, ColumnRef) else f"Column{i}"))
    return R.project(df, out)
