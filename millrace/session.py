"""The engine: statements in, DataFrames and messages out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BindError, ConstraintError, EngineError
from .functions.expressions import Scope, condition, constant, to_column, type_of
from .operators import dml
from .operators import relational as R
from .plans import nodes as N
from .plans.parser import parse, split_statements
from .plans.select import plan_select
from .sources.catalog import AUTO_PK, Catalog, Column, State, Table

FAILED = "SQL syntax error, please check query log: "


def stored(value: int | str | None, length: int | None) -> int | str | None:
    """A constant as a column keeps it: strings are cut to the column's length, numbers have 32 bits."""
    if isinstance(value, str):
        return value[:length]
    if value is not None and not -(1 << 31) <= value < 1 << 31:
        raise BindError(f"{value} is no INT of 32 bits")
    return value


@dataclass(frozen=True)
class Result:
    """message: what the statement reports; df: its rows, lazily; error: it failed and nothing changed; keys: the
    columns by which rows are shown, where the statement asks for no order (they are not sorted in ``df``)."""

    message: str = ""
    df: DataFrame | None = None
    error: bool = False
    keys: tuple[str, ...] = ()


class Engine:
    """A database below ``root`` in a store that Spark can write.

    It starts in transactional mode; SWITCH changes to analytical mode, which sees the tables as they were at
    the switch, and back.  ``cache`` keeps tables that analytical queries read in memory.
    """

    def __init__(self, spark: SparkSession, root: str, *, cache: bool = False):
        self.spark, self.catalog, self.cache = spark, Catalog(spark, root), cache
        self.closed, self.snapshot = False, None
        self._cached: dict[str, DataFrame] = {}

    @property
    def analytical(self) -> bool:
        return self.snapshot is not None

    def register(self, name: str, path: str, pk: str | None = None) -> None:
        """A Parquet table that statements may read, not change."""
        state = self.catalog.state()
        if name in state.tables:
            raise EngineError(f'The table "{name}" has already existed')
        self.catalog.commit(state, Table(name, (), external=path, external_pk=pk))
        if self.snapshot is not None:
            self.snapshot = self.catalog.state()

    def run(self, script: str) -> list[Result]:
        """All statements of a script, until EXIT."""
        out = []
        for text in split_statements(script):
            out.append(self.execute(text))
            if self.closed:
                break
        return out

    def execute(self, text: str) -> Result:
        """One statement.  Failures come back as results with ``error``."""
        if self.closed:
            raise EngineError("DB exit")
        try:
            return self._do(parse(text.strip().rstrip(";"), self.analytical))
        except ConstraintError as e:
            return Result(str(e))
        except EngineError as e:
            return Result(FAILED + str(e), error=True)
        except PySparkException as e:  # such as an overflow; nothing is committed before all rows are written
            return Result(FAILED + str(e).split("\n", 1)[0], error=True)

    def query(self, text: str) -> DataFrame:
        """The rows of a SELECT; raises where ``execute`` would report."""
        q = parse(text.strip().rstrip(";"), self.analytical)
        if not isinstance(q, N.Select):
            raise BindError("a SELECT is asked for")
        return self._select(q)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Spark's plan of a SELECT."""
        df = self.query(text)
        return self.spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def _state(self) -> State:
        return self.snapshot if self.snapshot is not None else self.catalog.state()

    def _do(self, s) -> Result:
        if isinstance(s, N.Select):
            df = self._select(s)
            return Result(df=df, keys=() if s.order else self._shown_by(s, df))
        if isinstance(s, N.Command):
            return getattr(self, f"_{s.name.lower()}")()
        by = {N.CreateTable: self._create, N.DropTable: self._drop, N.Insert: self._insert, N.Update: self._update, N.Delete: self._delete}
        return by[type(s)](s)

    def _select(self, q: N.Select) -> DataFrame:
        state = self._state()

        def table(name: str) -> DataFrame:
            t = state.get(name)
            if not (self.cache and self.analytical):
                return self.catalog.read(t)
            if name not in self._cached:
                self._cached[name] = self.catalog.read(t).cache()
            return self._cached[name]

        return plan_select(q, table, lambda n: state.get(n).pk, self.analytical)

    def _shown_by(self, q: N.Select, df: DataFrame) -> tuple[str, ...]:
        """The primary keys of a SELECT's tables, as far as the result has them."""
        state, bare = self._state(), not self.analytical and len(q.tables) == 1
        keys = [(t, state.get(t).pk) for t in q.tables]
        return tuple(n for n in (k if bare else f"{t}.{k}" for t, k in keys) if n in df.columns)

    # commands

    def _switch(self) -> Result:
        for df in self._cached.values():
            df.unpersist()
        self._cached = {}
        if self.snapshot is None:
            self.snapshot = self.catalog.state()
            return Result("SWITCH to OLAP")
        self.snapshot = None
        return Result("SWITCH to OLTP")

    def _exit(self) -> Result:
        self.closed = True
        return Result("DB exit")

    def tables(self) -> dict[str, DataFrame]:
        """Every table's rows, by name."""
        state = self._state()
        return {n: self.catalog.read(t) for n, t in sorted(state.tables.items())}

    def _show(self) -> Result:
        """(table, size, columns, row): for each table its rows as JSON in the order of its key, or one null if it has none."""
        out, state = None, self._state()
        for n, df in self.tables().items():
            key = state.get(n).pk
            number, text = F.lit(None), F.lit(None)
            if key is not None and dict(df.dtypes)[key] == "string":
                text = df[f"`{key}`"]
            elif key is not None:
                number = df[f"`{key}`"]
            rows = df.select(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns])).alias("row"), number.cast("bigint").alias("__number"), text.cast("string").alias("__text"))
            size = df.agg(F.count(F.lit(1)).alias("size")).select(F.lit(n).alias("table"), "size", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
            each = rows.crossJoin(F.broadcast(size)).unionByName(size.filter("size = 0"), allowMissingColumns=True)  # size: one row
            out = each if out is None else out.unionByName(each)
        if out is None:
            return Result(df=self.spark.createDataFrame([], "table string, size bigint, columns array<string>, row string"))
        return Result(df=out.orderBy("table", "__number", "__text").select("table", "size", "columns", "row"))

    def _schema(self) -> Result:
        """(table, size, column, position)."""
        out = self.spark.createDataFrame([], "table string, size bigint, column string, position int")
        for n, df in self.tables().items():
            sizes = df.agg(F.count(F.lit(1)).alias("size"))
            names = F.array(*[F.lit(c) for c in df.columns])
            out = out.unionByName(sizes.select(F.lit(n).alias("table"), "size", F.posexplode(names).alias("position", "column")).select("table", "size", "column", "position"))
        return Result(df=out, keys=("table", "position"))

    # definitions

    def _create(self, s: N.CreateTable) -> Result:
        state = self.catalog.state()
        if s.table in state.tables:
            raise ConstraintError(f'The table "{s.table}" has already existed')
        if len({c.name for c in s.columns}) < len(s.columns):
            raise BindError("a column is named twice")
        if sum(c.pk for c in s.columns) > 1:
            raise BindError("a table has one primary key column at most")
        columns = []
        for c in s.columns:
            if c.references and c.default is not None:
                raise BindError(f'column "{c.name}" can\'t have both REFERENCES and DEFAULT')
            if c.references:
                parent = state.get(c.references)
                if parent.pk is None or parent.external is None and parent.column(parent.pk).type != c.type:
                    raise BindError("expression types don't match")
            default = None if c.default is None else constant(c.default)
            if default is not None and isinstance(default, str) != (c.type == "STR"):
                raise BindError("expression types don't match")
            columns.append(Column(c.name, c.type, c.length, c.not_null, c.pk, c.references, stored(default, c.length)))
        auto = None
        if not any(c.pk for c in columns):
            if any(c.name == AUTO_PK for c in columns):
                raise BindError(f'"{AUTO_PK}" is the name of automatic keys')
            columns.insert(0, Column(AUTO_PK, "INT", pk=True))
            auto = 0
        self.catalog.commit(state, Table(s.table, tuple(columns), auto))
        return Result(f'create table "{s.table}"')

    def _drop(self, s: N.DropTable) -> Result:
        state = self.catalog.state()
        if s.table not in state.tables:
            raise ConstraintError(f'the table "{s.table}" does not exist')
        t = state.get(s.table)
        keys = self.catalog.read(t).select(t.pk) if t.pk else None
        if keys is not None and not dml.droppable(t.pk, keys, self._children(state, t)).first()[0]:
            raise ConstraintError(f'table "{s.table}" cannot be dropped due to FK constraint')
        self.catalog.commit(state, drop=s.table)
        return Result(f'table "{s.table}" has been dropped')

    # changes

    def _own(self, state: State, name: str) -> Table:
        t = state.get(name)
        if t.external:
            raise BindError(f'table "{name}" is read-only')
        return t

    def _children(self, state: State, t: Table) -> list[DataFrame]:
        return [self.catalog.read(c).select(f) for c, f in state.children(t.name) if c.name != t.name]

    def _parent_keys(self, state: State, t: Table, only: set[str]) -> dict[str, DataFrame]:
        out = {}
        for c in t.columns:
            if c.references and c.name in only:
                p = state.get(c.references)
                out[c.name] = self.catalog.read(p).select(p.pk)
        return out

    def _insert(self, s: N.Insert) -> Result:
        state = self.catalog.state()
        t = self._own(state, s.table)
        given = {}
        if len(set(s.columns)) < len(s.columns):
            raise BindError("a column is named twice")
        for name, e in zip(s.columns, s.values, strict=True):
            c, value = t.column(name), constant(e)
            if isinstance(value, str) != (c.type == "STR"):
                raise BindError("expression types don't match")
            given[name] = stored(value, c.length)
        auto = t.auto_id
        for c in t.columns:
            if c.name == AUTO_PK and auto is not None:
                given[c.name] = auto
            elif c.name not in given:
                if c.default is None:
                    raise BindError(f'column "{c.name}" has neither a value nor a default')
                given[c.name] = c.default
        for c in t.columns:
            if c.references:
                p = state.get(c.references)
                if R.key_lookup(self.catalog.read(p), p.pk, given[c.name]).isEmpty():
                    raise ConstraintError(f'FK constraint violate: "{given[c.name]}"')
        if auto is None and not R.key_lookup(self.catalog.read(t), t.pk, given[t.pk]).isEmpty():
            raise ConstraintError(f'PK exists: "{given[t.pk]}"')
        row = self.spark.createDataFrame([tuple(given[c.name] for c in t.columns)], t.schema)
        self.catalog.commit(state, replace(self.catalog.append(t, row), auto_id=None if auto is None else auto + 1))
        return Result("INSERT OK")

    def _hit(self, t: Table, where: N.Expr | None) -> tuple[list[str], DataFrame, Scope]:
        """The segments that hold a matching row, and the rows of these segments."""
        rows = self.catalog.read(t)
        scope = Scope.of({t.name: rows}, bare=True)
        hit = list(t.segments)
        if where is not None and hit:
            match = condition(where, scope)
            found = self.catalog.segments_of(rows.filter(match))
            hit = [x for x in hit if x in found]
        return hit, self.catalog.read(replace(t, segments=tuple(hit))), scope

    def _update(self, s: N.Update) -> Result:
        """The after-image is written once, with a mark on rows that differ; without any it is thrown away."""
        state = self.catalog.state()
        t = self._own(state, s.table)
        if len({name for name, _ in s.sets}) < len(s.sets):
            raise BindError("a column is named twice")
        hit, rows, scope = self._hit(t, s.where)
        sets = {}
        for name, e in s.sets:
            c = t.column(name)
            if c.pk:
                raise BindError("a primary key can't be updated")
            if type_of(e, scope) != c.type:
                raise BindError("expression types don't match")
            new = to_column(e, scope)
            sets[name] = F.substring(new, 1, c.length) if c.type == "STR" and c.length is not None else new
        n = 0
        if hit:
            where = None if s.where is None else condition(s.where, scope)
            after = dml.update_rows(rows, where, sets, self._parent_keys(state, t, set(sets)))
            segment = self.catalog.write(t, after, "__changed")
            n = self.spark.read.parquet(f"{self.catalog.root}/{segment}").filter("__changed").count()
            self._replace(state, t, hit, segment, n)
        return Result(f'update {n} rows in table "{s.table}"')

    def _delete(self, s: N.Delete) -> Result:
        """What is left is written once; both counts come from the footers of files."""
        state = self.catalog.state()
        t = self._own(state, s.table)
        hit, rows, scope = self._hit(t, s.where)
        n = 0
        if hit:
            where = None if s.where is None else condition(s.where, scope)
            segment = self.catalog.write(t, dml.delete_rows(rows, where, t.pk, self._children(state, t)))
            n = rows.count() - self.catalog.read(replace(t, segments=(segment,))).count()
            self._replace(state, t, hit, segment, n)
        return Result(f"delete {n} rows")

    def _replace(self, state: State, t: Table, hit: list[str], segment: str, n: int) -> None:
        if n:
            self.catalog.commit(state, replace(t, segments=(*(x for x in t.segments if x not in hit), segment)))
        else:
            self.catalog.remove(segment)
