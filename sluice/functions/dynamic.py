"""Null-safe navigation of dynamically typed JSON held in VARIANT columns.

Accessors never coerce: ``"12"`` is not an int and ``"true"`` is not a boolean. Spark's own variant
casts do coerce, so every accessor looks at the stored type first.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions.staging import once

Step = str | int


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def kind(v: Column) -> Column:
    """The stored type: ``BIGINT``, ``DECIMAL(..)``, ``STRING``, ``OBJECT<..>``; NULL for a missing value."""
    return F.schema_of_variant(v)


def _path(step: Step) -> str | None:
    """Path text of one step, or None when the path syntax cannot hold the name."""
    if isinstance(step, int):
        return f"[{step}]"
    if step and not set(step) & {"'", '"', "?", "\\"}:
        return f'["{step}"]'
    return None


def select(v: Column, *steps: Step) -> Column:
    """Navigate by field names and array indices; SQL NULL when a step does not apply."""
    path = "$"
    for step in steps:
        if isinstance(step, int) and step < 0:
            return F.lit(None).cast(T.VariantType())
        text = _path(step)
        if text is not None:
            path += text
            continue
        inner = v if path == "$" else F.try_variant_get(v, path, "variant")
        v, path = F.try_element_at(as_map(inner), F.lit(step)), "$"
    return v if path == "$" else F.try_variant_get(v, path, "variant")


def field(v: Column, *names: Step) -> Column:
    """``record.a.b``: a missing field, or a step into a non-object, is JSON null."""
    return F.coalesce(select(v, *names), json_null())


def item(v: Column, index: int) -> Column:
    """``v[i]``: out of range, negative or non-array is JSON null."""
    return field(v, index)


def as_map(v: Column) -> Column:
    """Object as MAP<STRING, VARIANT>; NULL for anything else."""
    return v.try_cast("map<string,variant>")


def as_array(v: Column) -> Column:
    """Array as ARRAY<VARIANT>; NULL for anything else."""
    return v.try_cast("array<variant>")


def is_null(v: Column) -> Column:
    return F.coalesce(kind(v) == "VOID", F.lit(True))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def is_number(v: Column) -> Column:
    k = kind(v)
    return F.coalesce(k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), F.lit(False))


def as_string(v: Column) -> Column:
    """The string itself, or compact JSON text of anything else."""
    return F.coalesce(v.cast("string"), F.lit("null"))


def _integral(v: Column, sql_type: str) -> Column:
    k = kind(v)
    real = F.try_variant_get(v, "$", "double")
    return (
        F.when(k == "BIGINT", F.try_variant_get(v, "$", sql_type))
        # to_json drops trailing zeros of a decimal, so a point means a real fraction
        .when(k.startswith("DECIMAL") & ~F.to_json(v).contains("."), F.try_variant_get(v, "$", sql_type))
        .when(k.isin("DOUBLE", "FLOAT") & (real == F.floor(real)), real.try_cast(sql_type))
    )


def as_int_opt(v: Column) -> Column:
    return _integral(v, "int")


def as_int(v: Column, default: int = 0) -> Column:
    return F.coalesce(as_int_opt(v), F.lit(default).cast("int"))


def as_long_opt(v: Column) -> Column:
    return _integral(v, "bigint")


def as_double_opt(v: Column) -> Column:
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def as_double(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(as_double_opt(v), F.lit(float(default)))


def as_bool(v: Column, default: bool = False) -> Column:
    return F.coalesce(F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), F.lit(default))


def each(v: Column) -> Column:
    """Elements of an array; an empty array for anything else."""
    return F.coalesce(as_array(v), F.array().cast("array<variant>"))


def as_vector(v: Column) -> Column:
    """Elements of an array; a one-element array holding the value itself for anything else."""
    return F.coalesce(as_array(v), F.array(F.coalesce(v, json_null())))


# strings are passed over whole; of what is between them, the marks
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]', re.S)


def _objects(text: str) -> dict[int, dict[str, tuple[int, int]]]:
    """All objects of a compact JSON text by where they start: where the value of each name lies, in one scan."""
    found, open_ = {}, []
    fields, name, start = None, "", 0
    for token in _TOKEN.finditer(text):
        mark, at = token.group(), token.start()
        if mark == "{" or mark == "[":
            open_.append((fields, name, start))
            fields, start = {} if mark == "{" else None, at + 1
            if fields is not None:
                found[at] = fields
        elif mark == "}" or mark == "]":
            if fields is not None and at > start:
                fields[name] = (start, at)
            fields, name, start = open_.pop()
        elif fields is not None and mark == ":":
            name, start = text[start:at], at + 1
        elif fields is not None and mark == ",":
            fields[name], start = (start, at), at + 1
    return found


def merged_text(left: str, right: str) -> str:
    """Two compact JSON objects merged at any depth, by an explicit stack; the right side wins, null included."""
    own, other = _objects(left), _objects(right)

    def both(l: int, r: int):
        a, b = own[l], other[r]
        return iter([(n, a.get(n), b.get(n)) for n in sorted({*a, *b})])

    out, stack, first = ["{"], [both(0, 0)], True
    while stack:
        name, l, r = next(stack[-1], (None, None, None))
        if name is None:
            stack.pop()
            out.append("}")
            first = False
            continue
        out.append(f"{name}:" if first else f",{name}:")
        first = l is not None and r is not None and left[l[0]] == right[r[0]] == "{"
        if first:
            stack.append(both(l[0], r[0]))
            out.append("{")
        else:
            out.append(left[l[0]:l[1]] if r is None else right[r[0]:r[1]])
    return "".join(out)


@F.pandas_udf(T.StringType())
def _merge_deep(left: pd.Series, right: pd.Series) -> pd.Series:
    """Merges the pairs that are there; most rows have none."""
    return pd.Series([None if l is None else merged_text(l, r) for l, r in zip(left.tolist(), right.tolist())], dtype=object)


def merge_levels(left: Column, right: Column, depth: int) -> Column:
    """``deep_merge`` for values whose objects are known to meet in so many levels at most, also inside lambdas.

    Below them the right side wins as a whole.
    """
    if depth == 0:
        return right

    def combine(_key: Column, a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge_levels(a, b, depth - 1))

    merged = F.to_variant_object(F.map_zip_with(as_map(left), as_map(right), combine))
    return F.when(is_object(left) & is_object(right), merged).otherwise(right)


# Levels that are merged by one expression; deeper pairs of values are merged as texts.
LEVELS = 4


def deep_merge(left: Column, right: Column) -> Column:
    """Merge objects recursively, however deep they nest; the right side wins, JSON null included.

    Pairs of which one has at most ``LEVELS`` objects, so that no deeper ones can meet, stay in the JVM. The others are
    merged as JSON texts, by a stack in Arrow batches, with the same result. Inside lambdas use ``merge_levels``.
    """
    def objects(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))

    sides = [F.to_json(left), F.to_json(right)]
    # an object's text begins with a brace, and no other value's
    deep = [F.coalesce(t.startswith("{") & (objects(t) > LEVELS), F.lit(False)) for t in sides]
    texts = _merge_deep(*[F.when(deep[0] & deep[1], t) for t in sides])
    return F.when(texts.isNotNull(), F.parse_json(texts)).otherwise(merge_levels(left, right, LEVELS))


def _field_conforms(value: Column, f: T.StructField) -> Column:
    ok = conforms(value, f.dataType)
    return F.when(is_null(value), F.lit(True)).otherwise(ok) if f.nullable else ok


def conforms(v: Column, dtype: T.DataType) -> Column:
    """True when the value decodes strictly as ``dtype`` (no coercion, non-nullable fields present)."""
    if isinstance(dtype, T.StructType):
        checks = [_field_conforms(select(v, f.name), f) for f in dtype.fields]
        return reduce(lambda a, b: a & b, checks, is_object(v))
    if isinstance(dtype, T.ArrayType):
        return is_array(v) & F.coalesce(F.forall(as_array(v), lambda x: conforms(x, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.MapType):
        values = F.map_values(as_map(v))
        return is_object(v) & F.coalesce(F.forall(values, lambda x: conforms(x, dtype.valueType)), F.lit(False))
    if isinstance(dtype, T.VariantType):
        return v.isNotNull()
    if isinstance(dtype, T.StringType):
        return F.coalesce(kind(v) == "STRING", F.lit(False))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(kind(v) == "BOOLEAN", F.lit(False))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _integral(v, dtype.simpleString()).isNotNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return is_number(v)
    raise TypeError(f"no JSON decoder for {dtype.simpleString()}")


def _value(v: Column, dtype: T.DataType) -> Column:
    return v if isinstance(dtype, T.VariantType) else F.try_variant_get(v, "$", dtype.simpleString())


def _result(value: Column, ok: Column, v: Column, schema: T.DataType) -> Column:
    error = F.concat(F.lit(f"cannot decode as {schema.simpleString()}: "), as_string(v))
    return F.struct(F.when(ok, value).alias("value"), F.when(~ok, error).alias("error"))


def decode(v: Column, schema: T.DataType) -> Column:
    """Typed decode as STRUCT(value, error): exactly one of the two is set."""
    return _result(_value(v, schema), conforms(v, schema), v, schema)


def decode_as(df: DataFrame, v: Column, schema: T.DataType, name: str) -> DataFrame:
    """``decode`` added as a column, in stages: the value, its fields and its check are computed once each."""
    staged = once(df, _v=F.coalesce(v, json_null()))
    if not isinstance(schema, T.StructType):
        staged = once(staged, _ok=conforms(F.col("_v"), schema))
        return staged.withColumn(name, _result(_value(F.col("_v"), schema), F.col("_ok"), F.col("_v"), schema)).drop("_v", "_ok")
    parts = {f"_f{i}": f for i, f in enumerate(schema.fields)}
    staged = once(staged, **{c: select(F.col("_v"), f.name) for c, f in parts.items()})
    checks = [_field_conforms(F.col(c), f) for c, f in parts.items()]
    staged = once(staged, _ok=reduce(lambda a, b: a & b, checks, is_object(F.col("_v"))))
    value = F.struct(*[_value(F.col(c), f.dataType).alias(f.name) for c, f in parts.items()])
    return staged.withColumn(name, _result(value, F.col("_ok"), F.col("_v"), schema)).drop("_v", "_ok", *parts)
