"""Schemas inferred from JSON: distributed (path, type) collection, merging, and typed reading."""

from __future__ import annotations

import io
import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions import codec

# An array's items have no name; in a path they are the NULL step.
ITEM = None
PATH = "array<string>"

# The types a JSON value is given.
JSON_TYPES = ("NULL", "BOOLEAN", "INT", "LONG", "DOUBLE", "STRING", "ARRAY", "RECORD")


class Number(str):
    """The type of a number in a JSON text."""


def _whole(value: int) -> Number:
    return Number("INT" if -(2**31) <= value < 2**31 else "LONG" if -(2**63) <= value < 2**63 else "DOUBLE")


def number_type(text: str) -> Number:
    """INT if a number is integral and fits 32 bits, LONG if 64, else DOUBLE; ``1.0`` and ``1e3`` are integral."""
    if "e" in text or "E" in text or len(text) > 40:
        value = float(text)
        return _whole(int(value)) if value.is_integer() else Number("DOUBLE")
    whole, _, fraction = text.partition(".")
    return Number("DOUBLE") if fraction.strip("0") else _whole(int(whole))


def _refused(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


_DECODER = json.JSONDecoder(parse_float=number_type, parse_int=number_type, parse_constant=_refused)


def parsed(text: str | None) -> object:
    """A JSON text with numbers replaced by their types; a text that is no JSON is a string, NULL is null."""
    if text is None:
        return None
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return ""


def type_of(value: object) -> str:
    """Type of a JSON value whose numbers are types already."""
    if isinstance(value, dict):
        return "RECORD"
    if isinstance(value, list):
        return "ARRAY"
    if isinstance(value, Number):
        return str(value)
    if value is None:
        return "NULL"
    return "BOOLEAN" if isinstance(value, bool) else "STRING"


def _root(value: object) -> object:
    """The record form of a value: an array as ``{array: ..}``, a scalar as ``{value: ..}``."""
    return value if isinstance(value, dict) else {"array": value} if isinstance(value, list) else {"value": value}


def _partial(as_record: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch of texts one row for each (path, type), by an explicit stack."""
        for batch in batches:
            counts: dict[tuple, int] = defaultdict(int)
            for text in batch.column(0).to_pylist():
                value = parsed(text)
                stack = [((), _root(value) if as_record else value)]
                while stack:
                    path, value = stack.pop()
                    counts[path, type_of(value)] += 1
                    if isinstance(value, dict):
                        stack += [((*path, name), v) for name, v in value.items()]
                    elif isinstance(value, list):
                        stack += [((*path, ITEM), v) for v in value]
            yield pa.RecordBatch.from_arrays([
                pa.array([list(p) for p, _ in counts], pa.list_(pa.string())), pa.array([t for _, t in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64())], ["path", "type", "n"])

    return partial


def path_types(df: DataFrame, json_text: str, as_record: bool = False) -> DataFrame:
    """Distinct (path, type) of all values in JSON texts, with how often each occurs.

    ``path`` has field names, and NULL for array items. Each Arrow batch is folded to its own distinct
    pairs before the shuffle. ``as_record`` takes each text in its record form.
    """
    texts = df.select(F.col(json_text).cast("string").alias("text"))
    found = texts.mapInArrow(_partial(as_record), f"path {PATH}, type string, n bigint")
    return found.groupBy("path", "type").agg(F.sum("n").alias("n"))


def path_text(path: Column) -> Column:
    """``$.a.b[].c``"""
    steps = F.transform(path, lambda p: F.coalesce(F.concat(F.lit("."), p), F.lit("[]")))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


class Node:
    """One path of the merged schema: how often each type occurs there, and its children."""

    def __init__(self) -> None:
        self.types: dict[str, int] = defaultdict(int)
        self.fields: dict[str | None, Node] = {}

    def child(self, name: str | None) -> Node:
        return self.fields.setdefault(name, Node())

    def add(self, path: Sequence[str | None], kind: str, n: int) -> None:
        node = self
        for step in path:
            node = node.child(step)
        node.types[kind] += n

    @property
    def count(self) -> int:
        return sum(self.types.values())

    def text(self) -> str:
        """The whole schema as JSON text: per node its types and its fields."""
        return json.dumps(self._plain())

    def _plain(self) -> list:
        return [self.types, [[name, child._plain()] for name, child in self.fields.items()]]

    @classmethod
    def of(cls, text: str) -> Node:
        def build(plain: list) -> Node:
            node = cls()
            node.types.update(plain[0])
            node.fields = {name: build(child) for name, child in plain[1]}
            return node

        return build(json.loads(text))


def _folded(render: Callable[[Node], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node()
        for batch in batches:
            for path, kind, n in zip(*(c.to_pylist() for c in batch.columns)):
                root.add(path, kind, n)
        yield pa.RecordBatch.from_arrays([pa.array([render(root)], pa.string())], ["schema"])

    return folded


def merged(types: DataFrame, render: Callable[[Node], str] = Node.text) -> DataFrame:
    """One row with the merged schema of a ``path_types`` table as text; ``avro_json`` renders it for Avro.

    Nothing runs yet. A task reads the distinct pairs one Arrow batch after the other and holds the schema, which is what the row
    has anyway; objects with data for keys make it as large as their data, but it does not pass the driver.
    """
    return types.select("path", "type", "n").repartition(1).mapInArrow(_folded(render), "schema string")


def schema_text(df: DataFrame, json_text: str, render: Callable[[Node], str] | None = None) -> DataFrame:
    """One row with the schema of the record form of all JSON texts, as Avro text unless ``render`` says otherwise.

    Avro text is written along the sorted pairs, so its task holds the text and no tree of the schema.
    """
    types = path_types(df, json_text, as_record=True)
    return avro_texts(types) if render is None else merged(types, render)


def avro_texts(types: DataFrame, name: str = "object", namespace: str = "gen") -> DataFrame:
    """One row with what ``avro_json`` makes of the merged schema of a ``path_types`` table.

    In the order of paths a node's types stand together, in front of its items and these in front of its fields, which come by name:
    the order of the text.
    """
    in_order = types.select("path", "type", "n").repartition(1).sortWithinPartitions("path")
    return in_order.mapInArrow(_written(name, namespace), "schema string")


class _Open:
    """A node of which the text is being written: what has to be written behind its items and its fields."""

    def __init__(self, types: dict[str, int], label: str, behind: str, started: bool) -> None:
        # kinds that are left to write, last first
        self.left = [k for k in reversed(JSON_TYPES) if types.get(k)]
        self.records, self.label, self.behind = types.get("RECORD", 0), label, behind
        # the kind whose items or fields are being written, and whether there were kinds and items or fields before
        self.inside: str | None = None
        self.started, self.filled = started, False


class _Writer:
    """Avro text of nodes that come in the order of their paths, each with all of its types."""

    def __init__(self, name: str, namespace: str) -> None:
        self.out = io.BytesIO()
        self.root, self.namespace = name, json.dumps(namespace)
        self.names: dict[str, int] = {}
        self.open: list[_Open] = []

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def _record_name(self, wanted: str) -> str:
        wanted = _clean(wanted)
        self.names[wanted] = self.names.get(wanted, 0) + 1
        return wanted if self.names[wanted] == 1 else f"{wanted}{self.names[wanted]}"

    def add(self, path: list[str | None], types: dict[str, int]) -> None:
        while len(self.open) > len(path):
            self._close()
        if not path:
            self._begin(types, self.root, False, "")
            return
        parent, step = self.open[-1], path[-1]
        # items belong to the array, fields to the record
        self._until(parent, "ARRAY" if step is ITEM else "RECORD")
        if step is ITEM:
            parent.filled = True
            self._begin(types, parent.label, False, "")
        else:
            self._put(("" if not parent.filled else ", ") + f'{{"name": {json.dumps(_clean(step))}, "type": ')
            parent.filled = True
            self._begin(types, f"{step}Type", sum(types.values()) < parent.records, "}")

    def _begin(self, types: dict[str, int], label: str, optional: bool, behind: str) -> None:
        kinds = sum(1 for n in types.values() if n)
        null = optional and not types.get("NULL")
        union = kinds + null > 1
        node = _Open(types, label, ("]" if union else "") + behind, null)
        self._put(("[" if union else "") + ('"null"' if null else ""))
        self.open.append(node)
        while node.left and node.inside is None:
            self._next(node)

    def _until(self, node: _Open, kind: str) -> None:
        """Write a node's kinds up to the given one, which stays open."""
        while node.inside != kind:
            self._end(node)
            self._next(node)

    def _next(self, node: _Open) -> None:
        kind = node.left.pop()
        self._put(", " if node.started else "")
        node.started = True
        if kind == "RECORD":
            label = json.dumps(self._record_name(node.label))
            self._put(f'{{"type": "record", "name": {label}, "namespace": {self.namespace}, "fields": [')
        elif kind == "ARRAY":
            self._put('{"type": "array", "items": ')
        else:
            self._put(f'"{kind.lower()}"')
            return
        node.inside, node.filled = kind, False

    def _end(self, node: _Open) -> None:
        if node.inside == "ARRAY":
            self._put("}" if node.filled else '["string", "null"]}')
        elif node.inside == "RECORD":
            self._put("]}")
        node.inside = None

    def _close(self) -> None:
        node = self.open.pop()
        self._end(node)
        while node.left:
            self._next(node)
            self._end(node)
        self._put(node.behind)

    def text(self) -> memoryview:
        while self.open:
            self._close()
        return self.out.getbuffer()


def _written(name: str, namespace: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, types = _Writer(name, namespace), None, {}
        for batch in batches:
            for at, kind, n in zip(*(c.to_pylist() for c in batch.columns)):
                if at != path:
                    if path is not None:
                        writer.add(path, types)
                    path, types = at, {}
                types[kind] = types.get(kind, 0) + n
        if path is None:
            writer.out.write(avro_json(Node()).encode())
        else:
            writer.add(path, types)
        text = pa.py_buffer(writer.text())
        ends = pa.array([0, text.size], pa.int32()).buffers()[1]
        yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, ends, text)], ["schema"])

    return written


def fold(types: DataFrame) -> Node:
    """Merged schema of a ``path_types`` table; only its finished text comes to the driver."""
    return Node.of(merged(types).first()["schema"])


def _clean(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name)


def _fields(node: Node) -> list[tuple[str, Node, bool]]:
    """Fields of a record node, by name, with whether some record lacks the field."""
    records = node.types["RECORD"]
    return [(n, node.fields[n], node.fields[n].count < records) for n in sorted(set(node.fields) - {ITEM})]


def avro_schema(root: Node, name: str = "object", namespace: str = "gen") -> dict:
    """The merged schema in Avro's JSON form.

    Types that differ become a union, a field that some records lack becomes nullable, and names that
    Avro cannot hold are sanitised.
    """
    names: dict[str, int] = {}

    def record_name(wanted: str) -> str:
        wanted = _clean(wanted)
        names[wanted] = names.get(wanted, 0) + 1
        return wanted if names[wanted] == 1 else f"{wanted}{names[wanted]}"

    def build(node: Node, label: str, optional: bool):
        branches = []
        for kind in JSON_TYPES:
            if not node.types.get(kind):
                continue
            if kind == "RECORD":
                record = {"type": "record", "name": record_name(label), "namespace": namespace, "fields": []}
                record["fields"] = [
                    {"name": _clean(n), "type": build(c, f"{n}Type", missing)} for n, c, missing in _fields(node)
                ]
                branches.append(record)
            elif kind == "ARRAY":
                items = node.fields.get(ITEM)
                branches.append({"type": "array", "items": build(items, label, False) if items else ["string", "null"]})
            else:
                branches.append(kind.lower())
        if optional and "null" not in branches:
            branches.insert(0, "null")
        return branches[0] if len(branches) == 1 else branches

    return build(root, name, False)


def avro_json(root: Node, name: str = "object", namespace: str = "gen") -> str:
    return json.dumps(avro_schema(root, name, namespace))


_SPARK = {
    "NULL": T.VariantType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "LONG": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
}


def spark_schema(root: Node, sanitise: bool = False) -> T.DataType:
    """The merged schema as a Spark type; more than one non-null type at a path becomes VARIANT."""

    def build(node: Node) -> T.DataType:
        kinds = [k for k in JSON_TYPES if node.types.get(k) and k != "NULL"]
        if kinds == ["RECORD"]:
            return T.StructType(
                [
                    T.StructField(_clean(n) if sanitise else n, build(c), missing or bool(c.types.get("NULL")))
                    for n, c, missing in _fields(node)
                ]
            )
        if kinds == ["ARRAY"]:
            items = node.fields.get(ITEM)
            return T.ArrayType(build(items) if items else T.VariantType())
        return _SPARK[kinds[0]] if len(kinds) == 1 and kinds[0] in _SPARK else T.VariantType()

    return build(root)


def infer(df: DataFrame, json_text: str) -> Node:
    """Schema of the record form of all JSON texts: scalar and array roots are wrapped first.

    This runs a job, because reading with the schema needs it to build a plan. ``schema_text`` is the same as a table.
    """
    return fold(path_types(df, json_text, as_record=True))


def read_typed(df: DataFrame, json_text: str, schema: T.StructType, name: str = "record") -> DataFrame:
    """Add a strictly decoded STRUCT(value, error) of each JSON text under the given schema."""
    return codec.decode_record(df, codec.text_to_json(F.col(json_text)), schema, name)


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; all columns of both, absent ones NULL.

    Records merge field by field, also inside arrays, maps and other records; other types that differ
    become VARIANT.
    """
    both = _merged(left.schema, right.schema)

    def widen(df: DataFrame) -> DataFrame:
        return df.select(*[_as(F.col(f"`{f.name}`"), f.dataType, both[f.name].dataType).alias(f.name) for f in df.schema])

    return widen(left).unionByName(widen(right), allowMissingColumns=True)


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    if a.simpleString() == b.simpleString():
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        of_a, of_b = ({f.name: f.dataType for f in t.fields} for t in (a, b))
        names = [*of_a, *(n for n in of_b if n not in of_a)]
        return T.StructType([
            T.StructField(n, _merged(of_a[n], of_b[n]) if n in of_a and n in of_b else of_a.get(n) or of_b[n]) for n in names
        ])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, _merged(a.valueType, b.valueType))
    return T.VariantType()


def _as(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of one type as the type it was merged to."""
    if have.simpleString() == want.simpleString():
        return col
    if isinstance(want, T.VariantType):
        return F.when(col.isNotNull(), _variant(col, have))
    if isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        fields = [
            _as(col.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType) for f in want.fields
        ]
        return F.when(col.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(fields, want.fields)]))
    if isinstance(want, T.ArrayType):
        return F.transform(col, lambda x: _as(x, have.elementType, want.elementType))
    return F.transform_values(col, lambda _, v: _as(v, have.valueType, want.valueType))


def _variant(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return col
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(col)
    return col.cast(T.VariantType())
