"""Table types and schemas with field ids, and their Spark forms."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .errors import InvalidMetadata, Unsupported

#: Where Spark keeps a field's id; it writes it to Parquet as the field's id.
FIELD_ID = "parquet.field.id"

# Names of the primitive types with their Spark forms.
PRIMITIVES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "string": T.StringType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
}
_NAMES = {type(v): k for k, v in PRIMITIVES.items() if k not in ("time", "uuid")} | {T.ByteType: "int", T.ShortType: "int"}
#: Types without a Spark form of their own are told apart by this mark in a field's metadata.
TYPE_MARK = "tessera.type"


@dataclass(frozen=True)
class ListType:
    element_id: int
    element: object
    element_required: bool = False


@dataclass(frozen=True)
class MapType:
    key_id: int
    key: object
    value_id: int
    value: object
    value_required: bool = False


@dataclass(frozen=True)
class StructType:
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Field:
    """A column: primitive types are their names, nested ones the classes above."""

    id: int
    name: str
    type: object
    required: bool = False
    doc: str | None = None


def parse_type(text: str | dict) -> object:
    """A type from its JSON form; names are checked."""
    if isinstance(text, dict):
        kind = text.get("type")
        if kind == "list":
            return ListType(text["element-id"], parse_type(text["element"]), text.get("element-required", False))
        if kind == "map":
            return MapType(text["key-id"], parse_type(text["key"]), text["value-id"], parse_type(text["value"]), text.get("value-required", False))
        if kind == "struct":
            return StructType(tuple(Field(f["id"], f["name"], parse_type(f["type"]), f.get("required", False), f.get("doc")) for f in text["fields"]))
        if kind == "decimal":
            return f"decimal({text['precision']},{text['scale']})"
        if kind == "fixed":
            return f"fixed[{text['length']}]"
        return parse_type(str(kind))
    name = re.sub(r"\s+", "", text)
    if name in PRIMITIVES or re.fullmatch(r"fixed\[\d+\]", name):
        return name
    if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", name):
        if not 1 <= int(m[1]) <= 38 or int(m[2]) > int(m[1]):
            raise Unsupported(f"decimal precision or scale out of range: {text}")
        return name
    raise Unsupported(f"unknown type: {text}")


def type_json(kind: object) -> str | dict:
    if isinstance(kind, ListType):
        return {"type": "list", "element-id": kind.element_id, "element": type_json(kind.element), "element-required": kind.element_required}
    if isinstance(kind, MapType):
        return {"type": "map", "key-id": kind.key_id, "key": type_json(kind.key), "value-id": kind.value_id, "value": type_json(kind.value), "value-required": kind.value_required}
    if isinstance(kind, StructType):
        return {"type": "struct", "fields": [field_json(f) for f in kind.fields]}
    return kind


def field_json(f: Field) -> dict:
    return {"id": f.id, "name": f.name, "type": type_json(f.type), "required": f.required} | ({"doc": f.doc} if f.doc else {})


def spark_type(kind: object) -> T.DataType:
    if isinstance(kind, ListType):
        return T.ArrayType(spark_type(kind.element), not kind.element_required)
    if isinstance(kind, MapType):
        return T.MapType(spark_type(kind.key), spark_type(kind.value), not kind.value_required)
    if isinstance(kind, StructType):
        return T.StructType([spark_field(f) for f in kind.fields])
    if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    return T.BinaryType() if kind.startswith("fixed[") else PRIMITIVES[kind]


def spark_field(f: Field) -> T.StructField:
    marks = {FIELD_ID: f.id}
    if isinstance(f.type, str) and (f.type in ("time", "uuid") or f.type.startswith("fixed[")):
        marks[TYPE_MARK] = f.type
    return T.StructField(f.name, spark_type(f.type), not f.required, marks)


def max_id(fields: tuple[Field, ...]) -> int:
    """The largest id of fields, elements, keys and values at any depth."""

    def of(kind: object) -> int:
        if isinstance(kind, ListType):
            return max(kind.element_id, of(kind.element))
        if isinstance(kind, MapType):
            return max(kind.key_id, kind.value_id, of(kind.key), of(kind.value))
        return max_id(kind.fields) if isinstance(kind, StructType) else 0

    return max((max(f.id, of(f.type)) for f in fields), default=0)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    schema_id: int = 1
    identifiers: tuple[int, ...] = ()

    def spark(self) -> T.StructType:
        return T.StructType([spark_field(f) for f in self.fields])

    def field(self, name_or_id: str | int) -> Field | None:
        return next((f for f in self.fields if name_or_id in (f.name, f.id)), None)

    def json(self) -> dict:
        return {"type": "struct", "schema-id": self.schema_id, "identifier-field-ids": list(self.identifiers), "fields": [field_json(f) for f in self.fields]}

    @staticmethod
    def parse(data: dict) -> Schema:
        parsed = parse_type({"type": "struct", "fields": data["fields"]})
        return Schema(parsed.fields, data.get("schema-id", 1), tuple(data.get("identifier-field-ids", ())))

    @staticmethod
    def of(struct: T.StructType, need_ids: bool = False) -> Schema:
        """From a Spark schema; fields without ids get the next free ones by position."""
        taken = {f.metadata[FIELD_ID] for f in struct.fields if FIELD_ID in f.metadata}
        if len(taken) < sum(FIELD_ID in f.metadata for f in struct.fields):
            raise InvalidMetadata("two fields have one id")
        if need_ids and len(taken) < len(struct.fields):
            raise InvalidMetadata("fields without ids")
        last = max(taken, default=0)

        def fresh() -> int:
            nonlocal last
            last += 1
            return last

        def convert(kind: T.DataType, marks: dict) -> object:
            if isinstance(kind, T.ArrayType):
                own = fresh()
                return ListType(own, convert(kind.elementType, {}), not kind.containsNull)
            if isinstance(kind, T.MapType):
                key, value = fresh(), fresh()
                return MapType(key, convert(kind.keyType, {}), value, convert(kind.valueType, {}), not kind.valueContainsNull)
            if isinstance(kind, T.StructType):
                return StructType(tuple(one(f) for f in kind.fields))
            if isinstance(kind, T.DecimalType):
                return f"decimal({kind.precision},{kind.scale})"
            if TYPE_MARK in marks:
                return marks[TYPE_MARK]
            if type(kind) not in _NAMES:
                raise Unsupported(f"no table type for {kind.simpleString()}")
            return _NAMES[type(kind)]

        def one(f: T.StructField) -> Field:
            own = f.metadata.get(FIELD_ID) or fresh()
            return Field(own, f.name, convert(f.dataType, f.metadata), not f.nullable)

        top = [(f, f.metadata.get(FIELD_ID) or fresh()) for f in struct.fields]
        return Schema(tuple(Field(own, f.name, convert(f.dataType, f.metadata), not f.nullable) for f, own in top))


def same_type(a: object, b: object) -> bool:
    """Equal but for ids, docs and whether values may be missing; no widening."""
    if isinstance(a, ListType) and isinstance(b, ListType):
        return same_type(a.element, b.element)
    if isinstance(a, MapType) and isinstance(b, MapType):
        return same_type(a.key, b.key) and same_type(a.value, b.value)
    if isinstance(a, StructType) and isinstance(b, StructType):
        return len(a.fields) == len(b.fields) and all(x.name == y.name and same_type(x.type, y.type) for x, y in zip(a.fields, b.fields, strict=True))
    return a == b


def compatible(table: Schema, incoming: Schema) -> bool:
    """Fields that both have are of one type; either may lack some."""
    return all(same_type(f.type, g.type) for f in incoming.fields if (g := table.field(f.name)))


def new_fields(table: Schema, incoming: Schema) -> list[Field]:
    return [f for f in incoming.fields if table.field(f.name) is None]


def merge(table: Schema, incoming: Schema) -> Schema:
    """The table's schema with the incoming one's new fields, under new ids and a new schema id."""
    last = max_id(table.fields)

    def fresh(kind: object) -> object:
        nonlocal last
        if isinstance(kind, ListType):
            last += 1
            own = last
            return replace(kind, element_id=own, element=fresh(kind.element))
        if isinstance(kind, MapType):
            last += 2
            key, value = last - 1, last
            return replace(kind, key_id=key, key=fresh(kind.key), value_id=value, value=fresh(kind.value))
        if isinstance(kind, StructType):
            out = []
            for f in kind.fields:
                last += 1
                out.append(replace(f, id=last, type=fresh(f.type)))
            return StructType(tuple(out))
        return kind

    added = []
    for f in new_fields(table, incoming):
        last += 1
        own = last
        # Rows that are there already have no value, so the new field can't be required.
        added.append(replace(f, id=own, type=fresh(f.type), required=False))
    return Schema((*table.fields, *added), table.schema_id + 1, table.identifiers)
