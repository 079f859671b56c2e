"""Wire formats: bytes and typed columns to JSON values and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions import dynamic as D, records
from sluice.functions.staging import once

# Configuration names of the wire types.
ALIASES = {
    "": "string",
    "string": "string",
    "strings": "string",
    "long": "long",
    "longs": "long",
    "bytes": "bytes",
    "byte array": "bytes",
    "json": "json",
    "avro": "avro",
}


def wire_type(name: str, namespace: str = "gen") -> str:
    """Normalise a configured type name: ``string``, ``long``, ``bytes``, ``json`` or ``avro:<namespace>``."""
    low = name.lower()
    if low.startswith("avro:"):
        return "avro:" + name[5:]
    if low not in ALIASES:
        raise ValueError(f"couldn't determine the supported type from serializer '{name}'")
    found = ALIASES[low]
    return f"avro:{namespace}" if found == "avro" else found


def _marked(text: Column) -> tuple[Column, Column]:
    """The text as the first of two array elements, and the second: the text's own hash."""
    mark = F.xxhash64(text)
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))), mark


def parse_text(text: Column) -> Column:
    """Parse a whole text as one JSON value; NULL when it is not one.

    ``try_parse_json`` stops after the first value and ignores what follows. With trailing content the
    second array element is not the hash, or the array ends early.
    """
    pair, mark = _marked(text)
    return F.when(F.try_variant_get(pair, "$[1]", "bigint") == mark, F.try_variant_get(pair, "$[0]", "variant"))


def parse_item(text: Column) -> Column:
    """``parse_text`` for use inside lambdas, where repeated parts are not shared."""
    pair, mark = _marked(text)
    whole = F.filter(F.array(pair), lambda p: F.try_variant_get(p, "$[1]", "bigint") == mark)
    return F.get(F.transform(whole, lambda p: F.try_variant_get(p, "$[0]", "variant")), 0)


def utf8(data: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def text_to_json(text: Column) -> Column:
    """JSON if the text parses, else the text as a JSON string; NULL becomes JSON null."""
    return F.coalesce(parse_text(text), text.cast(T.VariantType()), D.json_null())


def to_json_value(col: Column, dtype: T.DataType) -> Column:
    """Any column as a JSON value, chosen from its type when the plan is built."""
    null = D.json_null()
    if isinstance(dtype, T.VariantType):
        return F.coalesce(col, null)
    if isinstance(dtype, T.BinaryType):
        return text_to_json(utf8(col))
    if isinstance(dtype, T.StringType):
        return text_to_json(col)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        special = F.isnan(col) | (F.abs(col) == float("inf"))
        return F.coalesce(F.when(special, col.cast("string").cast("variant")).otherwise(col.cast("variant")), null)
    if isinstance(dtype, (T.BooleanType, T.IntegralType, T.DecimalType)):
        return F.coalesce(col.cast(T.VariantType()), null)
    if isinstance(dtype, T.StructType):
        return F.coalesce(F.to_variant_object(col), null)
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        values = F.transform_values(col, lambda _k, v: to_json_value(v, dtype.valueType))
        return F.coalesce(F.to_variant_object(values), null)
    if isinstance(dtype, T.ArrayType):
        values = F.transform(col, lambda v: to_json_value(v, dtype.elementType))
        return F.coalesce(F.to_variant_object(values), null)
    unsupported = F.struct(
        F.lit("no JSON form for this type").alias("error"),
        F.lit(dtype.simpleString()).alias("class"),
        col.cast("string").alias("object"),
    )
    return F.when(col.isNull(), null).otherwise(F.to_variant_object(unsupported))


def to_text(col: Column, dtype: T.DataType) -> Column:
    """Any column as text: bytes in base64, strings as they are, JSON compact, NULL as ``NULL``."""
    if isinstance(dtype, T.BinaryType):
        text = F.base64(col)
    elif isinstance(dtype, T.VariantType):
        text = F.when(col.isNotNull(), D.as_string(col))
    elif isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def long_from_bytes(data: Column) -> Column:
    """Eight big-endian bytes as BIGINT; NULL for any other length."""
    return F.when(F.length(data) == 8, F.conv(F.hex(data), 16, -10).cast("bigint"))


def long_to_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def deserialise(data: Column, wire: str, avro_schema: str | None = None) -> Column:
    """Bytes of a configured wire type as a JSON value; NULL where the bytes do not decode."""
    wire = wire_type(wire)
    if wire == "string":
        return F.coalesce(utf8(data).cast(T.VariantType()), D.json_null())
    if wire == "long":
        return long_from_bytes(data).cast(T.VariantType())
    if wire == "json":
        return parse_text(utf8(data))
    if wire == "bytes":
        return to_json_value(data, T.BinaryType())
    if avro_schema is None:
        raise ValueError("the avro wire type needs the writer schema")
    return F.parse_json(records.from_bytes(data, avro_schema))


def serialise(v: Column, wire: str, avro_schema: str | None = None) -> Column:
    """JSON value as the column written for a wire type; a non-integral ``long``, or what is no such record, fails the row."""
    wire = wire_type(wire)
    if wire == "json":
        return F.to_json(v)
    if wire == "string":
        return D.as_string(v)
    if wire == "bytes":
        return F.encode(D.as_string(v), "UTF-8")
    if wire == "long":
        value = D.as_long_opt(v)
        message = F.concat(F.lit("couldn't convert >"), D.as_string(v), F.lit("< to a long"))
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(message).cast("bigint"))
    if avro_schema is None:
        raise ValueError("the avro wire type needs the schema")
    return records.to_bytes(F.to_json(v), avro_schema)


def record_to_json(data: Column, wire: str, *, topic: Column, partition: Column, offset: Column, key: Column,
                   avro_schema: str | None = None) -> Column:
    """Decode, or describe the failure as an error object in place of the value."""
    value = deserialise(data, wire, avro_schema)
    failure = F.struct(
        F.lit("Error transforming record").alias("error"),
        F.concat(F.lit("bytes are not a valid "), F.lit(wire_type(wire))).alias("exception"),
        F.concat(F.lit("not a "), F.lit(wire_type(wire)), F.lit(" value")).alias("exceptionMsg"),
        F.coalesce(key.cast("string"), F.lit("null")).alias("key"),
        offset.alias("offset"),
        partition.alias("partition"),
        F.lit(wire_type(wire)).alias("supportedType"),
        topic.alias("topic"),
        F.coalesce(utf8(data), F.lit("null")).alias("valueString"),
        F.when(data.isNull(), F.lit("null")).otherwise(F.lit("binary")).alias("valueType"),
    )
    missing = F.when(data.isNull(), D.json_null())
    return F.coalesce(missing, value, F.to_variant_object(failure))


def header_map(headers: Column) -> Column:
    """Kafka headers ARRAY<STRUCT<key, value>> as MAP<STRING,STRING>; the last duplicate wins.

    Keeping only an entry that no later entry repeats makes the result independent of the session's
    duplicate-key policy.
    """
    keys = F.transform(headers, lambda h: h["key"])
    last = F.filter(headers, lambda h, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), h["key"]))
    return F.map_from_entries(F.transform(last, lambda h: F.struct(h["key"], utf8(h["value"]))))


def record_root(v: Column) -> Column:
    """Root of a typed record: an object as is, an array as ``{array: ..}``, a scalar as ``{value: ..}``."""
    return (
        F.when(D.is_object(v), v)
        .when(D.is_array(v), F.to_variant_object(F.struct(v.alias("array"))))
        .otherwise(F.to_variant_object(F.struct(F.coalesce(v, D.json_null()).alias("value"))))
    )


def decode_record(df: DataFrame, v: Column, schema: T.StructType, name: str = "record") -> DataFrame:
    """Add the strict decode of a record root with a supplied schema: STRUCT(value, error)."""
    return D.decode_as(once(df, _j=v), record_root(F.col("_j")), schema, name).drop("_j")
