"""The syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Name:
    """A variable, or the name of a value from WITH or UNWIND."""

    name: str


@dataclass(frozen=True)
class Property:
    name: str
    key: str


@dataclass(frozen=True)
class Unary:
    op: str  # not, -, is null, is not null
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case:
    subject: object | None
    branches: tuple[tuple[object, object], ...]
    default: object | None


@dataclass(frozen=True)
class HasLabel:
    name: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class NodePattern:
    name: str
    labels: tuple[str, ...] = ()
    values: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class EdgePattern:
    name: str | None
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, any
    least: int = 1
    most: int | None = 1  # None: any length
    variable: bool = False


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]


@dataclass(frozen=True)
class Exists:
    path: Path
    where: object | None = None


@dataclass(frozen=True)
class Item:
    of: object
    alias: str | None

    @property
    def title(self) -> str:
        return self.alias or title(self.of)


@dataclass(frozen=True)
class Projection:
    """What RETURN and WITH share. star: all variables."""

    items: tuple[Item, ...]
    star: bool = False
    distinct: bool = False
    order: tuple[tuple[object, bool], ...] = ()
    skip: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: object | None = None
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    of: object
    name: str


@dataclass(frozen=True)
class With:
    projection: Projection
    where: object | None = None


@dataclass(frozen=True)
class Query:
    clauses: tuple
    returned: Projection | None
    union: tuple[str, "Query"] | None = field(default=None)  # ("all" or "distinct", the next branch)


def title(e: object) -> str:
    """The column name of an item without an alias."""
    if isinstance(e, Name):
        return e.name
    if isinstance(e, Property):
        return f"{e.name}.{e.key}"
    if isinstance(e, Call):
        inner = "*" if e.star else ", ".join(map(title, e.args))
        return f"{e.name.upper()}({'DISTINCT ' if e.distinct else ''}{inner})"
    if isinstance(e, Case):
        return "CASE"
    if isinstance(e, Literal):
        return str(e.value)
    return type(e).__name__.lower()


def walk(e: object):
    """The nodes of an expression, itself first."""
    yield e
    if isinstance(e, (list, tuple)):
        for x in e:
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            yield from walk(getattr(e, f))
