"""The filter language: predicates, their text form, and what they say about rows, partitions and files."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidFilter
from ..functions.transforms import PartitionField
from ..types import Schema, spark_type

OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


class Predicate:
    """Base of all predicates; they combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return or_(self, other)

    def __invert__(self) -> Predicate:
        return not_(self)


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool

    def __str__(self) -> str:
        return "TRUE" if self.value else "FALSE"


@dataclass(frozen=True)
class Compare(Predicate):
    column: str | int
    op: str
    value: object

    def __str__(self) -> str:
        return f"{_name(self.column)} {self.op} {literal_text(self.value)}"


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str | int
    negated: bool = False

    def __str__(self) -> str:
        return f"{_name(self.column)} IS {'NOT ' if self.negated else ''}NULL"


@dataclass(frozen=True)
class In(Predicate):
    column: str | int
    values: tuple

    def __str__(self) -> str:
        return f"{_name(self.column)} IN ({', '.join(map(literal_text, self.values))})"


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def __str__(self) -> str:
        return f"({' AND '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def __str__(self) -> str:
        return f"({' OR '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def __str__(self) -> str:
        return f"NOT {self.part}"


TRUE, FALSE = Constant(True), Constant(False)


def _name(column: str | int) -> str:
    return f"#{column}" if isinstance(column, int) else column


def literal_text(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (dt.date, dt.datetime)):
        return f"'{value.isoformat(*([' '] if isinstance(value, dt.datetime) else []))}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"X'{value.hex()}'" if isinstance(value, bytes) else repr(value)


def col(column: str | int) -> ColumnRef:
    """A column by name or field id, to compare: ``col("a") >= 3``."""
    return ColumnRef(column)


class ColumnRef:
    def __init__(self, column: str | int):
        if column == "" or isinstance(column, int) and column <= 0:
            raise InvalidFilter("a column needs a name or a positive field id")
        self.column = column

    __hash__ = None

    def __eq__(self, value) -> Predicate:  # type: ignore[override]
        return Compare(self.column, "=", value)

    def __ne__(self, value) -> Predicate:  # type: ignore[override]
        return Compare(self.column, "!=", value)

    def __lt__(self, value) -> Predicate:
        return Compare(self.column, "<", value)

    def __le__(self, value) -> Predicate:
        return Compare(self.column, "<=", value)

    def __gt__(self, value) -> Predicate:
        return Compare(self.column, ">", value)

    def __ge__(self, value) -> Predicate:
        return Compare(self.column, ">=", value)

    def is_null(self) -> Predicate:
        return IsNull(self.column)

    def is_not_null(self) -> Predicate:
        return IsNull(self.column, True)

    def is_in(self, *values) -> Predicate:
        return In(self.column, tuple(values))


def and_(*parts: Predicate) -> Predicate:
    kept = [p for p in parts if p != TRUE]
    if FALSE in kept:
        return FALSE
    return And(tuple(kept)) if len(kept) > 1 else kept[0] if kept else TRUE


def or_(*parts: Predicate) -> Predicate:
    kept = [p for p in parts if p != FALSE]
    if TRUE in kept:
        return TRUE
    return Or(tuple(kept)) if len(kept) > 1 else kept[0] if kept else FALSE


def not_(p: Predicate) -> Predicate:
    if isinstance(p, Constant):
        return Constant(not p.value)
    return p.part if isinstance(p, Not) else Not(p)


def columns_of(p: Predicate) -> list[str | int]:
    """Columns that p refers to, as often as it does."""
    if isinstance(p, (And, Or)):
        return [c for part in p.parts for c in columns_of(part)]
    if isinstance(p, Not):
        return columns_of(p.part)
    return [] if isinstance(p, Constant) else [p.column]


def positive(p: Predicate) -> Predicate:
    """p with every NOT moved into its leaves; for rows this changes nothing, nulls included."""
    if isinstance(p, And):
        return and_(*map(positive, p.parts))
    if isinstance(p, Or):
        return or_(*map(positive, p.parts))
    if not isinstance(p, Not):
        return p
    q = p.part
    if isinstance(q, And):
        return or_(*(positive(not_(x)) for x in q.parts))
    if isinstance(q, Or):
        return and_(*(positive(not_(x)) for x in q.parts))
    if isinstance(q, Compare):
        return Compare(q.column, OPPOSITE[q.op], q.value)
    if isinstance(q, IsNull):
        return IsNull(q.column, not q.negated)
    if isinstance(q, In):
        return and_(*(Compare(q.column, "!=", v) for v in q.values)) if q.values else TRUE
    return positive(q.part) if isinstance(q, Not) else not_(q)


# --- text

_TOKEN = re.compile(
    r"""\s*(?:(?P<hex>[xX]'(?:[0-9a-fA-F]{2})*')|(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])"""
    r"""|(?P<op><>|!=|<=|>=|=|<|>)|(?P<mark>[(),])|(?P<word>[^\W\d][\w.\-]*|`[^`]+`|\#\d+))"""
)


def parse(text: str) -> Predicate:
    """A predicate from text.

    Comparisons, ``[NOT] IN (...)``, ``IS [NOT] NULL``, AND, OR, NOT and
    parentheses; keywords in any case; strings, numbers, true, false, dates and
    times in quotes, and bytes as X'..'.  Empty text is true for every row.
    """
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidFilter(f"can't read {text[at:].strip()[:30]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        return TRUE
    found, rest = _either(tokens)
    if rest:
        raise InvalidFilter(f"unexpected {rest[0][1]!r}")
    return found


def _is(tokens: list, *words: str) -> bool:
    return len(tokens) >= len(words) and all(kind in ("word", "mark") and t.upper() == w for (kind, t), w in zip(tokens, words, strict=False))


def _either(tokens: list) -> tuple[Predicate, list]:
    first, tokens = _all(tokens)
    parts = [first]
    while _is(tokens, "OR"):
        nxt, tokens = _all(tokens[1:])
        parts.append(nxt)
    return or_(*parts), tokens


def _all(tokens: list) -> tuple[Predicate, list]:
    first, tokens = _one(tokens)
    parts = [first]
    while _is(tokens, "AND"):
        nxt, tokens = _one(tokens[1:])
        parts.append(nxt)
    return and_(*parts), tokens


def _one(tokens: list) -> tuple[Predicate, list]:
    if _is(tokens, "NOT"):
        inner, tokens = _one(tokens[1:])
        return not_(inner), tokens
    if _is(tokens, "("):
        inner, tokens = _either(tokens[1:])
        if not _is(tokens, ")"):
            raise InvalidFilter("a parenthesis isn't closed")
        return inner, tokens[1:]
    if not tokens or tokens[0][0] != "word":
        raise InvalidFilter("a column is missing" + (f" before {tokens[0][1]!r}" if tokens else " at the end"))
    if tokens[0][1].upper() in ("TRUE", "FALSE") and (len(tokens) < 2 or tokens[1][0] != "op"):
        return Constant(tokens[0][1].upper() == "TRUE"), tokens[1:]
    name: str | int = tokens[0][1].strip("`")
    if isinstance(name, str) and name.startswith("#"):
        name = int(name[1:])
    tokens = tokens[1:]
    if _is(tokens, "IS", "NOT", "NULL"):
        return IsNull(name, True), tokens[3:]
    if _is(tokens, "IS", "NULL"):
        return IsNull(name), tokens[2:]
    negated = _is(tokens, "NOT", "IN")
    if negated or _is(tokens, "IN"):
        tokens = tokens[1 + negated :]
        if not _is(tokens, "("):
            raise InvalidFilter("IN needs a list in parentheses")
        values, tokens = [], tokens[1:]
        while True:
            values.append(_value(tokens))
            tokens = tokens[1:]
            if _is(tokens, ","):
                tokens = tokens[1:]
            elif _is(tokens, ")"):
                return (not_(In(name, tuple(values))) if negated else In(name, tuple(values))), tokens[1:]
            else:
                raise InvalidFilter("a list isn't closed")
    if not tokens or tokens[0][0] != "op":
        raise InvalidFilter(f"no comparison after {name!r}")
    op = "!=" if tokens[0][1] == "<>" else tokens[0][1]
    return Compare(name, op, _value(tokens[1:])), tokens[2:]


def _value(tokens: list) -> object:
    if not tokens:
        raise InvalidFilter("a value is missing at the end")
    kind, text = tokens[0]
    if kind == "number":
        return float(text) if re.search(r"[.eE]", text) else int(text)
    if kind == "word" and text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    if kind == "hex":
        return bytes.fromhex(text[2:-1])
    if kind != "string":
        raise InvalidFilter(f"{text!r} is no value")
    bare = text[1:-1].replace(text[0] * 2, text[0])
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", bare):
        return _date(bare) or bare
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?", bare):
        try:
            return dt.datetime.fromisoformat(bare)
        except ValueError:
            return bare
    return bare


def _date(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


def as_predicate(p: Predicate | str | None) -> Predicate:
    return TRUE if p is None else parse(p) if isinstance(p, str) else p


# --- rows

COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def fit_value(value: object, kind: object) -> object:
    """A literal as its column's type has it: dates and times written as text stay text for text columns."""
    if kind == "string" and isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat(*([" "] if isinstance(value, dt.datetime) else []))
    if kind in ("timestamp", "timestamptz") and isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    return value


def _lit(value: object, kind: object) -> Column:
    value = fit_value(value, kind)
    if isinstance(value, dt.datetime) and kind != "timestamptz":
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    return F.lit(value)


def to_column(p: Predicate, schema: Schema) -> Column:
    """p over rows, as Spark's three-valued logic has it."""
    if isinstance(p, Constant):
        return F.lit(p.value)
    if isinstance(p, (And, Or)):
        return reduce((lambda a, b: a & b) if isinstance(p, And) else (lambda a, b: a | b), (to_column(x, schema) for x in p.parts))
    if isinstance(p, Not):
        return ~to_column(p.part, schema)
    field = schema.field(p.column)
    if field is None:
        raise InvalidFilter(f"no column {_name(p.column)}")
    c = F.col(f"`{field.name}`")
    if isinstance(p, IsNull):
        return c.isNotNull() if p.negated else c.isNull()
    if isinstance(p, In):
        return c.isin(*(_lit(v, field.type) for v in p.values)) if p.values else F.lit(False)
    return COMPARE[p.op](c, _lit(p.value, field.type))


# --- files

#: Types whose bounds are kept in an order that comparisons follow.
BOUNDED = ("boolean", "int", "long", "float", "double", "date", "time", "timestamp", "timestamptz", "string")


def _comparable(kind: object, value: object) -> bool:
    if isinstance(kind, str) and kind.startswith("decimal"):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind not in BOUNDED:
        return False
    if isinstance(value, bool) or kind == "boolean":
        return isinstance(value, bool) and kind == "boolean"
    if isinstance(value, (int, float)):
        return kind in ("int", "long", "float", "double", "time") and value == value
    if isinstance(value, dt.datetime):
        return kind in ("timestamp", "timestamptz", "string")
    if isinstance(value, dt.date):
        return kind in ("date", "timestamp", "timestamptz", "string")
    return isinstance(value, str) and kind == "string"


def may_match_bounds(p: Predicate, schema: Schema) -> Column:
    """Over rows of the file inventory: false only if no row of the file can satisfy p.

    Bounds and counts that are missing, columns that aren't there and literals
    of another kind than the column never exclude a file.
    """
    return _bounds(positive(p), schema)


def _bounds(p: Predicate, schema: Schema) -> Column:
    if isinstance(p, Constant):
        return F.lit(p.value)
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (_bounds(x, schema) for x in p.parts))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (_bounds(x, schema) for x in p.parts))
    field = None if isinstance(p, Not) else schema.field(p.column)
    if field is None:
        return F.lit(True)
    nulls, rows = F.col("null_value_counts")[field.id], F.col("record_count")
    maybe = lambda excluded: ~F.coalesce(excluded, F.lit(False))
    if isinstance(p, IsNull):
        return maybe(nulls == rows) if p.negated else maybe(nulls == 0)
    values = list(p.values) if isinstance(p, In) else [p.value]
    only_null = nulls == rows
    if not all(_comparable(field.type, v) for v in values):
        return maybe(only_null)
    kind = spark_type(field.type).simpleString()
    low, high = (F.col(c)[field.id].try_cast(kind) for c in ("lower_bounds", "upper_bounds"))
    if field.type in ("float", "double"):
        high = F.lit(None).cast(kind)  # NaN is above every number, and bounds don't show it
    tests = []
    for v in values:
        x = _lit(v, field.type)
        op = "=" if isinstance(p, In) else p.op
        out = F.lit(False)
        if op in ("=", "<", "<="):
            out = out | F.coalesce(low >= x if op == "<" else low > x, F.lit(False))
        if op in ("=", ">", ">="):
            out = out | F.coalesce(high <= x if op == ">" else high < x, F.lit(False))
        if op == "!=":
            out = F.coalesce((low == x) & (high == x), F.lit(False))
        tests.append(~out)
    possible = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return possible & maybe(only_null)


# --- partitions


def may_match_partition(p: Predicate, schema: Schema, spec: tuple[PartitionField, ...]) -> Column:
    """Over rows of the file inventory: false only if the partition values exclude every row."""
    return _partition(positive(p), schema, spec)


def _partition(p: Predicate, schema: Schema, spec: tuple[PartitionField, ...]) -> Column:
    if isinstance(p, Constant):
        return F.lit(p.value)
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (_partition(x, schema, spec) for x in p.parts))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (_partition(x, schema, spec) for x in p.parts))
    field = None if isinstance(p, Not) else schema.field(p.column)
    tests = [_project(p, f, field.type) for f in spec if field is not None and f.source == field.name and isinstance(field.type, str)]
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def _project(p: Predicate, field: PartitionField, source: str) -> Column | None:
    """What a leaf says about one partition field; None: nothing."""
    how = field.transform
    if how.kind == "void":
        return None
    has = F.array_contains(F.map_keys("partition"), field.name)
    stored = F.col("partition")[field.name]
    if isinstance(p, IsNull):
        # Transforms keep null as null and nothing else becomes null.
        return ~has | (stored.isNotNull() if p.negated else stored.isNull())
    values = p.values if isinstance(p, In) else (p.value,)
    if not all(_comparable(source, v) for v in values):
        return None
    results = [how.literal(fit_value(v, source), source) for v in values]
    if any(r is None for r in results):
        return None
    value = stored.try_cast(how.result(source))
    lits = [_lit(r, {"date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}.get(how.result(source), "")) for r in results]
    if isinstance(p, In):
        test = reduce(lambda a, b: a | b, (value == x for x in lits)) if lits else F.lit(False)
    elif p.op == "=":
        test = value == lits[0]
    elif p.op == "!=":
        if how.kind != "identity":
            return None
        test = value != lits[0]
    elif not how.ordered:
        return None
    elif how.kind == "identity":
        test = COMPARE[p.op](value, lits[0])
    else:
        test = value <= lits[0] if p.op in ("<", "<=") else value >= lits[0]
    return F.coalesce(test, F.lit(True))
