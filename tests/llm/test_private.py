"""Persons keep one name throughout a text; addresses and tokens of further formats; formats without room end."""

import re

import pytest

from sluice.llm import private

SCHEMA = "doc_id long, text string"


def changed(spark, *texts, key="k"):
    rows = private.replaced(spark.createDataFrame(list(enumerate(texts)), SCHEMA), key, count_column="n").collect()
    return [(r["text"], r["n"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_bare_mentions_follow_the_person(spark):
    (first, n), (other, m), (same, _), (plain, _) = changed(
        spark, "Mr John Smith met Anna. John Smith left. Smith slept, Smith's dog too. Mr Smith woke. Smithers did not.",
        "Smith works. Dr. Jane Doe, Prof. Doe; Doe-Smith and DOE", "Mr Smith and Mrs Smith", "Smith and John")
    found = re.fullmatch(r"Mr (\w+) (\w+) met Anna\. \1 \2 left\. \2 slept, \2's dog too\. Mr \2 woke\. Smithers did not\.", first)
    assert found and found[1] in private.NAMES["m", "Latin"] and found[2] != "Smith" and n == 6
    # names in other texts are nobody's, and parts of words are no names
    doe = re.fullmatch(r"Smith works\. Dr\. \w+ (\w+), Prof\. \1; Doe-Smith and DOE", other)
    assert doe and doe[1] not in ("Doe", found[2]) and m == 2
    assert same == f"Mr {found[2]} and Mrs {found[2]}"
    assert plain == "Smith and John"


def test_given_names_of_two_genders_and_scripts(spark):
    (both, n), (russian, _), (long, k) = changed(
        spark, "Mr Alex Stone, Ms Alex Stone", "Г-н Иван Петров и Петров", "Herr Otto Braun. " + "Braun schrieb. " * 20000)
    male, female = re.fullmatch(r"Mr (\w+) (?:\w+), Ms (\w+) (?:\w+)", both).groups()
    assert male != female and n == 2
    assert re.fullmatch(r"Г-н [А-Яа-яё]+ ([А-Яа-яё]+) и \1", russian) and "Петров" not in russian
    assert "Braun" not in long and k == 20001


def test_six_group_addresses_and_tokens(spark):
    (text, n), (clean, none) = changed(
        spark, "2001:db8:0:1:1:1:1:1 or 2001:DB8:AA::1F, token xoxb-123456789012-abcdefGHIJKL.", "std::move a::b at 12:30:45 or 1:2")
    assert n == 3 and re.fullmatch(r"[0-9a-f:]+ or [0-9A-F]{4}:[0-9A-F]{3}:[0-9A-F]{2}::\w\w, token [a-z]{4}-[0-9]{12}-[a-z]{6}[A-Z]{6}\.", text)
    assert "2001" not in text and "xoxb" not in text and (clean, none) == ("std::move a::b at 12:30:45 or 1:2", 0)


def test_distinct_persons_get_distinct_names(spark):
    names = [f"{a}{b}{c}" for a in "BDFGKLMNPRST" for b in "aeiou" for c in ("rin", "lot", "mas", "del")]
    rows = changed(spark, *[f"Mrs {given} {last}" for given, last in zip(names, reversed(names), strict=True)])
    parts = [text.split(" ") for text, _ in rows]
    assert len({p[1] for p in parts}) == len({p[2] for p in parts}) == len(names)
    assert not {p[1] for p in parts} & set(names) and not {p[2] for p in parts} & set(names)


def test_a_format_without_room_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(private, "MOST_DRAWS", 1)
    monkeypatch.setattr(private, "candidate", lambda kind, normal, key, attempt: private.F.lit("taken"))
    with pytest.raises(ValueError, match="no surrogates"):
        changed(spark, "a@b.com and c@d.com")
