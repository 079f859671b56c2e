"""Text functions: placeholders, moustache templates, quoting, names and coordinates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

# Placeholder of the repeat index, and the moustache form.
INDEX_PLACEHOLDER = "{{i}}"
MOUSTACHE = re.compile(r"\{\{(.*?)\}\}", re.S)

_BLANKS = "".join(chr(c) for c in range(33))


def replace_index(json_text: Column, index: Column) -> Column:
    """Put an integer into every ``{{i}}`` of a compact JSON text, in string values and object keys.

    Plain text replacement is exact here: ``{{`` cannot occur outside a JSON string, and neither the
    placeholder nor the digits need escaping.
    """
    return F.replace(json_text, F.lit(INDEX_PLACEHOLDER), index.cast("string"))


# what stands for an escaped backslash and an escaped quote meanwhile; JSON has no bare control characters
_BACKSLASH, _QUOTE = "\x01", "\x02"


def replace_in_json(json_text: Column, old: str, new: str) -> Column:
    """Replace text in all string values and object keys of a JSON text; everything else keeps its spelling.

    If two keys become equal both are written, in order; parsing the result keeps the last. The text is split at
    its quotes: every second part is inside a string. Only parts with escapes are decoded and encoded again.
    """
    if old == "":
        return json_text

    def shown(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))

    def swapped(part: Column) -> Column:
        decoded = F.try_parse_json(F.concat(F.lit('"'), shown(part), F.lit('"'))).cast("string")
        encoded = F.to_json(F.replace(decoded, F.lit(old), F.lit(new)).cast("variant"))
        plain = F.replace(part, F.lit(old), F.lit(json.dumps(new, ensure_ascii=False)[1:-1]))
        escapes = part.contains("\\") | part.contains(_BACKSLASH) | part.contains(_QUOTE)
        return F.when(escapes, F.coalesce(F.substring(encoded, F.lit(2), F.length(encoded) - 2), shown(part))).otherwise(plain)

    def joined(parts: Column) -> Column:
        inside = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
        return F.array_join(F.transform(parts, lambda p, i: F.when(inside(i), swapped(p)).otherwise(shown(p))), '"')

    hidden = F.replace(F.replace(json_text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    # as the only element of an array the parts are made once, however often the lambda mentions them
    return F.get(F.transform(F.array(F.split(hidden, '"')), joined), 0)


def template_parts(template: str) -> list[tuple[bool, str]]:
    """Split ``text {{ expression }} text`` into (is_expression, text) parts."""
    parts: list[tuple[bool, str]] = []
    end = 0
    for match in MOUSTACHE.finditer(template):
        parts += [(False, template[end : match.start()]), (True, match.group(1).strip())]
        end = match.end()
    parts.append((False, template[end:]))
    return [p for p in parts if p[1] or p[0]]


def render(template: str) -> Column:
    """Template as a string column; placeholders are Spark SQL over the columns of the DataFrame.

    A NULL expression prints ``null``; a VARIANT prints as its string or its compact JSON.
    """
    parts = [
        F.coalesce(F.expr(text).cast("string"), F.lit("null")) if is_expr else F.lit(text)
        for is_expr, text in template_parts(template)
    ]
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def render_config(config: dict[str, str]) -> Column:
    """Each value with ``{{ }}`` evaluated, the others as they are, as MAP<STRING,STRING>."""
    entries: list[Column] = []
    for key, value in config.items():
        entries += [F.lit(key), render(value) if "{{" in value and "}}" in value else F.lit(value)]
    return F.create_map(*entries)


def environment(values: dict[str, str], overlay: dict[str, str] | None = None) -> Column:
    """Parameters as a MAP<STRING,STRING> literal column; overlay entries win."""
    merged = {**values, **(overlay or {})}
    entries = [F.lit(x) for pair in merged.items() for x in pair]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def env(values: Column, name: str) -> Column:
    """Parameter by name; a missing one is the empty text."""
    return F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(""))


def unquote(text: Column) -> Column:
    """Remove one layer of ``"..."`` or ``\\"...\\"``, with the spaces around it."""
    plain, escaped = r'\A *"(.*)" *\z', r'\A *\\"(.*)\\" *\z'
    return (
        F.when(text.rlike(plain), F.regexp_extract(text, plain, 1))
        .when(text.rlike(escaped), F.regexp_extract(text, escaped, 1))
        .otherwise(text)
    )


def unquote_all(text: Column) -> Column:
    """Trim and remove quote layers until none is left."""

    def trim(c: Column) -> Column:
        return F.btrim(c, F.lit(_BLANKS))

    def peel(current: Column, _i: Column) -> Column:
        quoted = current.startswith('"') & current.endswith('"') & (F.length(current) > 1)
        return F.when(quoted, trim(F.substring(current, F.lit(2), F.length(current) - 2))).otherwise(current)

    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    layers = F.sequence(F.lit(0), F.floor(quotes / 2).cast("int"))
    return F.aggregate(layers, trim(text), peel)


def field_name(name: Column) -> Column:
    """Every character that is not a letter or digit becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{Nd}]", "_")


def strip_suffix(subject: Column) -> Column:
    """Topic of a registry subject: without ``-key`` or ``-value`` at the end."""
    return F.regexp_replace(subject, r"-(?:key|value)\z", "")


def coordinates(topic: Column, partition: Column, offset: Column, key: Column) -> Column:
    """``{topic:partition/offset@key}``"""
    return F.concat(
        F.lit("{"), topic, F.lit(":"), partition.cast("string"), F.lit("/"), offset.cast("string"),
        F.lit("@"), F.coalesce(key.cast("string"), F.lit("null")), F.lit("}"),
    )


def position(partition: Column, offset: Column) -> Column:
    """``partition:offset``"""
    return F.concat_ws(":", partition.cast("string"), offset.cast("string"))
