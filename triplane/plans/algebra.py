"""Logical query algebra of the graph: what both query languages are parsed into and what the planner turns into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


class Unsupported(ValueError):
    """A query that the languages or the planner don't take."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Ent:
    id: int


@dataclass(frozen=True)
class Lit:
    value: int | float | str | bool | datetime


Term = Var | Ent | Lit


@dataclass(frozen=True)
class Prop:
    pid: str


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    path: object
    zero: bool


@dataclass(frozen=True)
class Inv:
    path: object


@dataclass(frozen=True)
class Other:
    """Any one property that is none of these, forward and, if `back` is given, backward none of those."""

    pids: tuple
    back: tuple | None = None


@dataclass(frozen=True)
class Triple:
    s: Term
    path: object
    o: Term


@dataclass(frozen=True)
class Stmt:
    """A statement of subject and property: its value if that is used, qualifiers by property, and qualifiers that must be absent."""

    s: Term
    pid: str
    value: Term | None = None
    qualifiers: tuple = ()
    absent: tuple = ()


@dataclass(frozen=True)
class Label:
    of: Term
    text: Term


@dataclass(frozen=True)
class Call:
    """An expression: a comparison, a connective or a function, by name."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    expr: object


@dataclass(frozen=True)
class AnyOf:
    groups: tuple


@dataclass(frozen=True)
class Maybe:
    group: tuple


@dataclass(frozen=True)
class Absent:
    group: tuple


@dataclass(frozen=True)
class Bind:
    var: Var
    expr: object


@dataclass(frozen=True)
class Values:
    var: Var
    terms: tuple


@dataclass(frozen=True)
class Sub:
    query: Query


@dataclass(frozen=True)
class Agg:
    op: str
    var: Var | None
    distinct: bool
    alias: str


@dataclass
class Query:
    where: tuple = ()
    select: list = field(default_factory=list)
    ask: bool = False
    distinct: bool = True
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


def variables(x) -> set[str]:
    """The names of all variables in a pattern, group, path or expression."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Sub):
        return {i.alias if isinstance(i, Agg) else i.name for i in x.query.select}
    if isinstance(x, (tuple, list)):
        return set().union(*map(variables, x))
    if hasattr(x, "__dataclass_fields__"):
        return set().union(*(variables(getattr(x, f)) for f in x.__dataclass_fields__))
    return set()
