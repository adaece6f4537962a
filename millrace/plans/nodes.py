"""What the parser makes of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: int | str


@dataclass(frozen=True)
class ColumnRef:
    table: str | None
    name: str


@dataclass(frozen=True)
class Binary:
    """op: + - * / %, a comparison, AND or OR."""

    op: str
    left: Expr
    right: Expr


Expr = Literal | ColumnRef | Binary

COMPARISONS = ("==", "!=", "<", ">", "<=", ">=")
ARITHMETIC = ("+", "-", "*", "/", "%")


def conjuncts(e: Expr | None) -> list[Expr]:
    """The parts of a left-deep chain of ANDs; a chain with an OR in it is one part."""
    if e is None:
        return []
    if isinstance(e, Binary) and e.op == "AND":
        return [*conjuncts(e.left), e.right]
    return [e]


@dataclass(frozen=True)
class Select:
    items: tuple[Expr, ...] | None  # None: all
    tables: tuple[str, ...]
    pk_join: bool = False
    where: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()  # ascending if true


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT or STR
    length: int | None = None
    not_null: bool = False
    pk: bool = False
    references: str | None = None
    default: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...] = field(default=())


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Command:
    name: str  # SHOW, SCHEMA, SWITCH or EXIT
