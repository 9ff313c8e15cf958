"""Partition transforms, for columns and for literals alike."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSpec

EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Transform:
    """identity, year, month, day, hour, bucket[n], truncate[w] or void."""

    kind: str
    width: int = 0

    @staticmethod
    def parse(text: str) -> Transform:
        name = text.strip().lower()
        if name in ("identity", "year", "month", "day", "hour", "void"):
            return Transform(name)
        if (m := re.fullmatch(r"(bucket|truncate)\[(\d+)\]", name)) and int(m[2]) > 0:
            return Transform(m[1], int(m[2]))
        raise InvalidSpec(f"unknown transform: {text}")

    def __str__(self) -> str:
        return f"{self.kind}[{self.width}]" if self.width else self.kind

    def column(self, c: Column, source: str) -> Column:
        """The partition value of a column of table type ``source``: time units count from 1970, days are dates."""
        if self.kind == "identity":
            return c
        if self.kind == "void":
            return F.lit(None).cast("string")
        if self.kind == "year":
            return F.year(c) - 1970
        if self.kind == "month":
            return (F.year(c) - 1970) * 12 + F.month(c) - 1
        if self.kind == "day":
            return F.to_date(c)
        if self.kind == "hour":
            day = F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date"))
            return (day * 24 + (F.lit(0) if source == "date" else F.hour(c))).cast("int")
        if self.kind == "bucket":
            return (F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % self.width).cast("int")
        return F.substring(c, 1, self.width) if source == "string" else c - F.pmod(c, F.lit(self.width))

    def literal(self, value: object, source: str) -> object | None:
        """The partition value of one literal; None where it can't be told."""
        if value is None or self.kind == "void":
            return None
        if self.kind == "identity":
            return value
        if self.kind in ("year", "month", "day", "hour"):
            when = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day) if isinstance(value, dt.date) else None
            if when is None:
                return None
            if when.tzinfo is not None:
                when = when.astimezone(dt.timezone.utc).replace(tzinfo=None)
            if self.kind == "year":
                return when.year - 1970
            if self.kind == "month":
                return (when.year - 1970) * 12 + when.month - 1
            return when.date() if self.kind == "day" else (when - EPOCH) // dt.timedelta(hours=1)
        if self.kind == "bucket":
            if source not in ("string", "int", "long") or isinstance(value, bool) or isinstance(value, str) != (source == "string") or isinstance(value, float):
                return None
            return int(hashlib.md5(str(value).encode()).hexdigest()[:8], 16) % self.width
        if source == "string":
            return value[: self.width] if isinstance(value, str) else None
        return value - value % self.width if isinstance(value, int) and not isinstance(value, bool) else None

    def result(self, source: str) -> str:
        """SQL type of the partition value."""
        if self.kind in ("year", "month", "hour", "bucket"):
            return "int"
        if self.kind == "day":
            return "date"
        return {"long": "bigint", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "uuid": "string"}.get(source, source)

    @property
    def ordered(self) -> bool:
        """Larger values never have smaller partition values."""
        return self.kind in ("identity", "year", "month", "day", "hour", "truncate")


@dataclass(frozen=True)
class PartitionField:
    source: str
    transform: Transform
    name: str
    field_id: int = 1000

    def json(self) -> dict:
        return {"source": self.source, "transform": str(self.transform), "name": self.name, "field-id": self.field_id}


def parse_spec(text: str) -> tuple[PartitionField, ...]:
    """``ts:day, id:bucket[8]=b``: source, transform (identity if left out) and name (by default made of both)."""
    fields = []
    for i, part in enumerate(p for p in text.split(",") if p.strip()):
        rule, _, name = part.partition("=")
        source, _, transform = (x.strip() for x in rule.partition(":"))
        if not source:
            raise InvalidSpec(f"no column in {part!r}")
        how = Transform.parse(transform or "identity")
        fields.append(PartitionField(source, how, name.strip() or (source if how.kind == "identity" else f"{source}_{how.kind}"), 1000 + i))
    return tuple(fields)
