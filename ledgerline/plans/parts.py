"""Expressions over event_id that read the same in Spark and DuckDB: made-up fields of the credit panel."""

from __future__ import annotations

from typing import NamedTuple


class Part(NamedTuple):
    """One expression in both dialects."""

    spark: str
    sql: str


def lit(words: str) -> Part:
    return Part("'" + words.replace("'", "\\'").replace("\n", "\\n") + "'", "'" + words.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")


def pick(words, step: int = 1) -> Part:
    """The word at event_id // step, modulo their number."""
    listed = [lit(w) for w in words]
    return Part(f"element_at(array({', '.join(w.spark for w in listed)}), cast((event_id div {step}) % {len(words)} + 1 AS int))", f"([{', '.join(w.sql for w in listed)}])[(event_id // {step}) % {len(words)} + 1]")


def cat(*parts: Part | str) -> Part:
    parts = [lit(p) if isinstance(p, str) else p for p in parts]
    return Part("concat(" + ", ".join(p.spark for p in parts) + ")", "(" + " || ".join(p.sql for p in parts) + ")")


def either(modulus: int, yes: Part, no: Part) -> Part:
    return Part(*(f"(CASE WHEN event_id % {modulus} = 0 THEN {y} ELSE {n} END)" for y, n in zip(yes, no, strict=True)))


def number(modulus: int, add: int) -> Part:
    return Part(f"cast(event_id % {modulus} + {add} AS string)", f"(event_id % {modulus} + {add})::VARCHAR")
