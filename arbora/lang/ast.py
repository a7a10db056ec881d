"""Syntax tree of the select language. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Str:
    text: str
    exact: bool = False  # single quotes: no wildcards
    bare: bool = False  # an unquoted word


@dataclass(frozen=True)
class DateLit:
    text: str  # canonical, see functions.dates


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Active:
    """The active set."""


@dataclass(frozen=True)
class Prev:
    """The variable declared before: `?` alone, or a statement that opens with an arrow."""


@dataclass(frozen=True)
class Obj:
    cls: str
    name: Any


@dataclass(frozen=True)
class ClassScan:
    cls: str


@dataclass(frozen=True)
class Path:
    base: Any
    op: str  # -> => >> #
    tag: str
    at: int = 1  # k-th column of the tag


@dataclass(frozen=True)
class Right:
    """Move right from a variable by k columns, on the same line of its tag."""

    base: Any
    k: int


@dataclass(frozen=True)
class Method:
    base: Any
    name: str


@dataclass(frozen=True)
class Un:
    op: str
    a: Any


@dataclass(frozen=True)
class Bin:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Cmp:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Isa:
    a: Any
    cls: str


@dataclass(frozen=True)
class Agg:
    fn: str
    of: Any  # an expression, or a Select


@dataclass(frozen=True)
class Call:
    fn: str
    args: tuple


@dataclass
class Decl:
    name: str
    source: Any
    anonymous: bool = False
    spread: bool = True  # `in` makes a row a value; `=` computes


@dataclass
class Where:
    cond: Any


@dataclass
class Select:
    exports: list[tuple[str, Any]] = field(default_factory=list)  # name, expression
    steps: list[Any] = field(default_factory=list)  # Decl and Where, in order
    order: list[tuple[str, bool]] | None = None  # column (number or name), descending
    titles: dict[str, str] = field(default_factory=dict)
    silent: bool = False
    options: dict[str, Any] = field(default_factory=dict)
