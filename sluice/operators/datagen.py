"""Sample records generated from an Avro schema and a seed.

How many draws a schema takes does not depend on the seed: arrays always get two elements, maps two
entries, unions their first non-null branch. So leaf ``k`` of a record uses the seed after ``k`` draws,
``a_k * seed + c_k``, and a schema compiles to independent columns.
"""

from __future__ import annotations

import json
from collections.abc import Generator
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions import codec, seeds as S

PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")


class BadSchema(ValueError):
    """The text is not an Avro schema, or the schema has no finite sample."""


def _unwound(task: Generator) -> Any:
    """Run a generator that yields its inner calls and is sent their results, however deep they nest."""
    open_, result = [task], None
    while open_:
        try:
            open_.append(open_[-1].send(result))
            result = None
        except StopIteration as ended:
            open_.pop()
            result = ended.value
    return result


def parse_schema(text: str) -> Any:
    """Avro schema text as Python data."""
    try:
        schema = json.loads(text)
    except ValueError as error:
        raise BadSchema(f"not JSON: {error}") from error
    _unwound(_check(schema, {}))
    return schema


def _check(schema: Any, names: dict[str, Any]) -> Generator:
    if isinstance(schema, str):
        if schema not in PRIMITIVES and schema.rpartition(".")[2] not in names:
            raise BadSchema(f"unknown type {schema}")
    elif isinstance(schema, list):
        if not schema:
            raise BadSchema("an empty union")
        for branch in schema:
            yield _check(branch, names)
    elif isinstance(schema, dict) and "type" in schema:
        kind = schema["type"]
        needs = {"record": "fields", "enum": "symbols", "fixed": "size", "array": "items", "map": "values"}
        if isinstance(kind, str) and kind in needs:
            if needs[kind] not in schema:
                raise BadSchema(f"{kind} without {needs[kind]}")
            if kind in ("record", "enum", "fixed"):
                if not isinstance(schema.get("name"), str):
                    raise BadSchema(f"{kind} without a name")
                names[schema["name"].rpartition(".")[2]] = schema
            for inner in schema.get("fields", []) if kind == "record" else []:
                if not isinstance(inner, dict) or "type" not in inner or "name" not in inner:
                    raise BadSchema("a field without name or type")
                yield _check(inner["type"], names)
            if kind in ("array", "map"):
                yield _check(schema[needs[kind]], names)
        else:
            yield _check(kind, names)
    else:
        raise BadSchema(f"not a schema: {schema!r:.80}")


def _nullable(branch: Any) -> bool:
    open_ = [branch]
    while open_:
        found = open_.pop()
        if found == "null" or isinstance(found, dict) and found.get("type") == "null":
            return True
        if isinstance(found, list):
            open_.extend(found)
    return False


class _Columns:
    """Builds a sample out of columns."""

    def __init__(self, seed: Column) -> None:
        self.base = seed

    def leaf(self, kind: str, draw: int) -> Column:
        s = S.advance(self.base, draw)
        low_int = F.shiftright(F.shiftleft(s, 32), 32).cast("int")
        return {
            "long": lambda: s,
            "int": lambda: low_int,
            "fixed": lambda: low_int,
            "float": lambda: s.cast("float"),
            "double": lambda: s.cast("double"),
            "boolean": lambda: (s % 7) % 2 == 0,
            "bytes": lambda: F.array(low_int),
            "string": lambda: seed_text(s),
        }[kind]()

    def null(self) -> Column:
        return F.lit(None).cast("string")

    def enum(self, symbols: list[str], draw: int) -> Column:
        index = S.bounded_int(S.advance(self.base, draw), len(symbols) - 1)
        return F.element_at(F.array(*[F.lit(x) for x in symbols]), index + 1)

    def record(self, fields: list[tuple[str, Column]]) -> Column:
        return F.struct(*[v.alias(n) for n, v in fields])

    def array(self, items: list[Column]) -> Column:
        return F.array(*items)

    def map(self, entries: list[tuple[Column, Column]]) -> Column:
        return F.create_map(*[x for pair in entries for x in pair])


class _Values:
    """Builds a sample out of Python values."""

    def __init__(self, seed: int) -> None:
        self.base = seed

    def _at(self, draw: int) -> int:
        a, c = S.jump(draw)
        return _signed(a * self.base + c, 64)

    def leaf(self, kind: str, draw: int) -> Any:
        s = self._at(draw)
        low_int = _signed(s, 32)
        if kind == "float":
            # 32 bits, as the column has
            return float(np.int64(s).astype(np.float32))
        if kind == "double":
            return float(s)
        if kind == "boolean":
            return (abs(s) % 7) % 2 == 0
        return {"long": s, "int": low_int, "fixed": low_int, "bytes": [low_int], "string": f"{s & S.MASK64:x}"}[kind]

    def null(self) -> None:
        return None

    def enum(self, symbols: list[str], draw: int) -> str:
        return symbols[abs(self._at(draw)) % len(symbols)]

    def record(self, fields: list[tuple[str, Any]]) -> dict:
        return dict(fields)

    def array(self, items: list) -> list:
        return items

    def map(self, entries: list[tuple]) -> dict:
        return dict(entries)


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def seed_text(seed: Column) -> Column:
    """String leaf: the seed as hexadecimal digits."""
    return F.lower(F.hex(seed))


def _build(schema: Any, draw: int, out: Any, names: dict[str, Any], inside: set[int]) -> Generator:
    """Sample of a schema from draw number ``draw`` on: (next draw number, value).

    ``inside`` has the records being built: one that holds itself has no finite sample.
    """

    def inner(child: Any, at: int) -> Generator:
        return _build(child, at, out, names, inside)

    if isinstance(schema, list):
        first = next((b for b in schema if not _nullable(b)), None)
        return (draw, out.null()) if first is None else (yield inner(first, draw))
    if isinstance(schema, str):
        if schema == "null":
            return draw, out.null()
        if schema in PRIMITIVES:
            return draw + 1, out.leaf(schema, draw)
        return (yield inner(names[schema.rpartition(".")[2]], draw))
    kind = schema["type"]
    if kind in ("record", "enum", "fixed"):
        names[schema["name"].rpartition(".")[2]] = schema
    if kind == "record":
        if id(schema) in inside:
            raise BadSchema(f"{schema['name']} holds itself")
        inside.add(id(schema))
        fields = []
        for f in schema["fields"]:
            draw, value = yield inner(f["type"], draw)
            fields.append((f["name"], value))
        inside.remove(id(schema))
        return draw, out.record(fields)
    if kind == "enum":
        # no draw: the next field sees the same seed
        return draw, out.enum(schema["symbols"], draw)
    if kind == "fixed":
        return draw + 1, out.leaf("fixed", draw)
    if kind == "array":
        draw, a = yield inner(schema["items"], draw)
        draw, b = yield inner(schema["items"], draw)
        return draw, out.array([a, b])
    if kind == "map":
        first, second = out.leaf("string", draw), out.leaf("string", draw + 1)
        draw, a = yield inner(schema["values"], draw + 2)
        draw, b = yield inner(schema["values"], draw)
        return draw, out.map([(first, a), (second, b)])
    return (yield inner(kind, draw))


def sample(schema: str | Any, seed: Column) -> Column:
    """Sample record of one schema as a column: pure column logic, no per-row Python."""
    parsed = parse_schema(schema) if isinstance(schema, str) else schema
    return _unwound(_build(parsed, 0, _Columns(seed), {}, set()))[1]


def sample_text(schema: str, seed: int) -> str:
    """Sample record of one schema as compact JSON text."""
    return _parsed_sample_text(parse_schema(schema), seed)


def _parsed_sample_text(parsed: Any, seed: int) -> str:
    value = _unwound(_build(parsed, 0, _Values(seed), {}, set()))[1]
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def sample_json(schema_text: Column, seed: Column) -> Column:
    """Sample of each row's own schema as JSON text; NULL where the text is not a usable schema.

    Schemas differ from row to row here, so they are read in Arrow batches on the executors.
    """

    @F.pandas_udf(T.StringType())
    def generate(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        # many rows often share a schema
        parsed = cache(parse_schema)

        def one(text: str | None, s: int) -> str | None:
            try:
                return None if text is None else _parsed_sample_text(parsed(text), int(s))
            except BadSchema:
                return None

        return pd.Series([one(t, s) for t, s in zip(texts, seeds)], dtype=object)

    return generate(schema_text, seed)


def registry_samples(registry: DataFrame, seed: Column) -> DataFrame:
    """Sample data for every registry entry; entries whose schema does not parse are dropped."""
    made = registry.select("subject", "version", "schema", sample_json(F.col("schema"), seed).alias("sample"))
    return made.where(F.col("sample").isNotNull())


def parse_documents(df: DataFrame, text: str, seed: Column) -> DataFrame:
    """Uploaded texts: an Avro schema gives a sample record, other JSON itself, the rest ``parse_error``."""
    read = df.withColumn("_json", codec.parse_text(F.col(text)))
    parsed = F.col("_json").isNotNull()
    # only JSON objects and arrays can be schemas; the rest need not go through Python
    maybe_schema = F.schema_of_variant("_json").rlike(r"\A(?:OBJECT<.*type|ARRAY<)") | (
        F.try_variant_get("_json", "$", "string").isin(*PRIMITIVES)
    )
    candidate = F.when(parsed & maybe_schema, F.col(text))
    read = read.withColumn("_sample", sample_json(candidate, seed))
    error = F.concat(F.lit("Couldn't parse content as avro or json: >"), F.col(text), F.lit("<"))
    return read.select(
        *df.columns,
        F.when(F.col("_sample").isNotNull(), "avro").when(parsed, "json").alias("format"),
        F.coalesce("_sample", F.to_json("_json")).alias("document"),
        F.when(~parsed & F.col("_sample").isNull(), error).alias("parse_error"),
    )
