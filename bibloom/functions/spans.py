"""Matches with their places; Spark has no find-all that tells them.

The pieces are SQL text: an expression of some hundred nested calls reaches Spark as one
string, where building it from Column calls takes seconds on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of long arrays go by blocks of so many
BLOCK = 256
PLACES = "array<struct<value:string,start:int,end:int>>"
SENTENCE_END = r"(?<=[.!?])\s+"
MATCHES = "array<struct<value:string,number:string,start:int,end:int,number_start:int>>"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, body: str) -> str:
    """body with value under a name, worked out once: Catalyst copies an expression into every lambda that uses it, a lambda's variable not."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running_sums(values: str) -> str:
    """Sums of an array of ints up to each place."""
    total = lambda part: f"aggregate({part}, 0, (a, x) -> a + x)"
    block = lambda i: f"cast(floor(({i}) / {BLOCK}) AS int)"
    sums = f"transform(sequence(0, {block('size(v) - 1')}), b -> {total(f'slice(v, b * {BLOCK} + 1, {BLOCK})')})"
    before = bound(sums, "s", f"transform(s, (y, b) -> {total('slice(s, 1, b)')})")
    rest = total(f"slice(v, {block('i')} * {BLOCK} + 1, i - {block('i')} * {BLOCK} + 1)")
    each = bound(before, "s", f"transform(v, (y, i) -> get(s, {block('i')}) + {rest})")
    return bound(values, "v", f"CASE WHEN size(v) > 0 THEN {each} ELSE cast(array() AS array<int>) END")


def places(text: str, pattern: str, when: str | None = None) -> str:
    """array of (value, start, end): the matches of a pattern (SQL that gives it), in time linear in their number.

    What lies between matches comes from a split by the same pattern, so a match begins
    after the gaps and matches before it. ``when`` spares the texts that cannot match.
    """
    none = f"cast(array() AS {PLACES})"
    lengths = f"zip_with(slice(split({text}, {pattern}, -1), 1, size(w)), w, (gap, m) -> length(gap) + length(m))"
    spans = f"zip_with(w, {running_sums(lengths)}, (m, e) -> struct(m AS value, e - length(m) AS start, e AS end))"
    some = bound(f"regexp_extract_all({text}, {pattern}, 0)", "w", f"CASE WHEN size(w) > 0 THEN {spans} ELSE {none} END")
    return some if when is None else f"CASE WHEN {when} THEN {some} ELSE {none} END"


def matches(text: str, pattern: str, group: int = 1) -> str:
    """array of (value, number, start, end, number_start): ``number`` is the group; it must be the match's first occurrence of its own text."""
    p = literal(pattern)
    one = "struct(m.value AS value, n AS number, m.start AS start, m.end AS end, m.start + locate(n, m.value) - 1 AS number_start)"
    both = f"zip_with(f, regexp_extract_all({text}, {p}, {group}), (m, n) -> {one})"
    return bound(places(text, p), "f", f"CASE WHEN size(f) > 0 THEN {both} ELSE cast(array() AS {MATCHES}) END")


def sentences(text: Column) -> Column:
    """Split after a full stop, question or exclamation mark that white space follows."""
    return F.split(text, SENTENCE_END)
