"""Routing of topics to handlers: exact names first, then wildcard patterns in priority order."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions import text as X


@dataclass(frozen=True)
class Route:
    pattern: str
    handler: str
    priority: int = 0

    @property
    def is_wildcard(self) -> bool:
        return "*" in self.pattern

    @property
    def regex(self) -> str:
        """``*`` stands for any text; other characters keep their regular-expression meaning."""
        return rf"\A(?:{_unquote(self.pattern).replace('*', '.*')})\z"


def _unquote(text: str) -> str:
    text = text.strip()
    while len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1].strip()
    return text


def routes(*entries: tuple[str, str] | tuple[str, str, int]) -> list[Route]:
    """Routes from (pattern, handler[, priority]); without a priority the given order counts."""
    return [Route(_unquote(e[0]), _unquote(e[1]), e[2] if len(e) > 2 else i) for i, e in enumerate(entries)]


# characters that stand for themselves in a pattern
_PLAIN = re.compile(r"[A-Za-z0-9_/ -]*")


def literal_prefix(pattern: str) -> str:
    """The text that every name matching a wildcard pattern begins with."""
    if "|" in pattern:
        return ""
    found = _PLAIN.match(pattern).group()
    after = pattern[len(found):len(found) + 1]
    # these make the character before them optional or repeat it
    return found[:-1] if after in ("?", "+", "{") and found else found


def _slots(entries: dict[str, list[tuple]]) -> tuple[int, Column]:
    """A hash table as a literal: per slot its entries, each with its text first. Slots are as many as texts."""
    size = max(1, len(entries))
    table: list[list[list]] = [[] for _ in range(size)]
    for text, rows in entries.items():
        table[zlib.crc32(text.encode()) % size] += [{"text": text, "priority": p, "regex": r, "handler": h} for p, r, h in rows]
    return size, F.from_json(F.lit(json.dumps(table)), "array<array<struct<text:string,priority:int,regex:string,handler:string>>>")


def _found(text: Column, size: int, table: Column) -> Column:
    """The entries of a text."""
    slot = F.coalesce(F.get(table, (F.crc32(text) % size).cast("int")), F.array().cast(SLOT))
    return F.filter(slot, lambda e: e["text"] == text)


SLOT = "array<struct<text:string,priority:int,regex:string,handler:string>>"


def handler_for(topic: Column, table: list[Route]) -> Column:
    """Handler name of a topic, NULL when no route matches.

    The route table is configuration held by the job, so the lookup is a plain expression: no join, no shuffle.
    Exact names are one hash lookup. Wildcards are hashed by the literal text that they begin with, one lookup
    for each length that occurs; only those whose beginning fits are tried, and the first by priority counts.
    """
    name = X.unquote_all(topic)
    exact = {r.pattern: r.handler for r in table if not r.is_wildcard}
    if len(exact) != sum(not r.is_wildcard for r in table):
        raise ValueError("a topic has more than one exact route")
    found = [F.get(_found(name, *_slots({p: [(0, "", h)] for p, h in exact.items()})), 0)["handler"]] if exact else []
    lengths: dict[int, dict[str, list[tuple]]] = {}
    ordered = sorted((r for r in table if r.is_wildcard), key=lambda r: r.priority)
    for place, r in enumerate(ordered):
        prefix = literal_prefix(r.pattern)
        # a name that begins with the text in front of a last star matches, unless a line ends in it
        regex = "" if r.pattern == f"{prefix}*" else r.regex
        lengths.setdefault(len(prefix), {}).setdefault(prefix, []).append((place, regex, r.handler))
    if lengths:
        near = F.concat(*[_found(F.left(name, F.lit(n)), *_slots(entries)) for n, entries in sorted(lengths.items())])
        one_line = ~name.rlike(r"[\n\r\u0085\u2028\u2029]")
        fits = F.filter(near, lambda e: F.when(e["regex"] == "", one_line).otherwise(F.regexp(name, e["regex"])))
        best = F.array_min(F.transform(fits, lambda e: F.struct(e["priority"].alias("p"), e["handler"].alias("h"))))
        found.append(best["h"])
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def route(df: DataFrame, table: list[Route], topic: str = "topic") -> DataFrame:
    """Add ``handler`` and, for a topic without a route, ``route_error`` naming it."""
    routed = df.withColumn("handler", handler_for(F.col(topic), table))
    missing = F.concat(F.lit("No mapping found for '"), F.col(topic), F.lit("'"))
    return routed.withColumn("route_error", F.when(F.col("handler").isNull(), missing))


def route_by_topic(df: DataFrame, table: list[Route], topic: str = "topic") -> DataFrame:
    """The same as ``route``: matching is an expression, so no topic's messages are gathered in one place."""
    return route(df, table, topic)


def subscription(topic: str) -> tuple[str, str]:
    """Kafka source option for a configured topic: a pattern, a list, or one name."""
    if "*" in topic:
        return "subscribePattern", topic
    return "subscribe", topic


def subscribed(topic_column: Column, topic: str) -> Column:
    """The same subscription as a filter on a topic column. A pattern is used as written."""
    option, text = subscription(topic)
    if option == "subscribePattern":
        return topic_column.rlike(rf"\A(?:{text})\z")
    return topic_column.isin(text.split(","))
