"""Small fixed vocabularies as literal arrays, and tests against them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LITERAL_ENTRIES = 2000


def checked(values: Iterable) -> list:
    """The values as a list, refused when too many to inline into a plan."""
    values = list(values)
    if len(values) > MAX_LITERAL_ENTRIES:
        raise ValueError(f"{len(values)} entries are too many for a literal; pass a DataFrame instead")
    return values


def _constant(value: list, ddl: str) -> Column:
    """A constant parsed once from JSON; the optimizer folds it into a literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def text_array(values: Iterable[str]) -> Column:
    """A constant array<string>."""
    values = checked(values)
    if not values:
        return F.expr("CAST(array() AS ARRAY<STRING>)")
    return _constant(values, "array<string>") if len(values) > 3 else F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value of a constant map, null when absent."""
    items = dict(checked(table.items()))
    kind = {str: "string", int: "int", float: "double"}[type(next(iter(items.values())))]
    return F.try_element_at(F.from_json(F.lit(json.dumps(items, ensure_ascii=False)), f"map<string,{kind}>"), key)


def alternation(values: Iterable[str]) -> str:
    """A regex matching any of the values literally (Java syntax)."""
    return "|".join(literal_pattern(v) for v in checked(values))


def literal_pattern(value: str) -> str:
    """One value as a regex that matches it literally."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-&~#" or ch == '"' else ch for ch in value)


def quoted_pattern(value: Column) -> Column:
    """A column's text as a literal inside a Java regex."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(value, r"\\E", ""), F.lit("\\E"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda re-evaluates whatever expressions it closes over for every array
    element; binding them first keeps that work to once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letter_tree(values: Iterable[str]) -> str:
    """A regex of literals that share their beginnings, the longest first at every place.

    Choices by letter stand in bunches behind one character class each, so a letter is compared with a few of them.
    """
    root: dict = {}
    for value in checked(values):
        node = root
        for ch in value:
            node = node.setdefault(ch, {})
        node[""] = {}

    def tail(node: dict) -> str:
        choices = [literal_pattern(ch) + tail(child) for ch, child in sorted(node.items()) if ch]
        if not choices:
            return ""
        return "(?:" + _bunched(choices, sorted(ch for ch in node if ch)) + ")?" if "" in node else (
            choices[0] if len(choices) == 1 else "(?:" + _bunched(choices, sorted(node)) + ")")

    heads = sorted(root)
    return _bunched([literal_pattern(ch) + tail(root[ch]) for ch in heads], heads)


def _bunched(choices: list[str], heads: list[str], size: int = 5) -> str:
    """Alternatives by first letter, in bunches that a place enters only where one of their letters stands."""
    if len(choices) <= size + 1:
        return "|".join(choices)
    plain = [i for i, head in enumerate(heads) if head < "\x80"]
    parts = [plain[i:i + size] for i in range(0, len(plain), size)] + [[i for i, head in enumerate(heads) if head >= "\x80"]]
    return "|".join(first_letters([heads[i] for i in part]) + "(?:" + "|".join(choices[i] for i in part) + ")" for part in parts if part)


def first_letters(values: Iterable[str]) -> str:
    """Lookahead that lets a scan skip places where no value can start; any letter beyond ASCII passes, which one range tells."""
    heads = dict.fromkeys(v[0] for v in values)
    beyond = "" if max(heads) < "\x80" else r"\x80-\uFFFF" if max(heads) <= "\uffff" else r"\x80-\x{10FFFF}"
    return "(?=[" + "".join(literal_pattern(ch) for ch in heads if ch < "\x80") + beyond + "])"


def contained_rows(text: Column, rows: Iterable[Mapping], key: str, schema: str) -> Column:
    """Records whose ``key`` is a substring of the text, in one scan.

    The scan yields the longest key at each place; the keys that are prefixes
    of it are attached to it beforehand, so every occurring key is found.
    """
    rows = checked(rows)
    keys = list(dict.fromkeys(row[key] for row in rows))
    names = [field.name for field in T.StructType.fromDDL(schema).fields]
    table = {k: [{n: row[n] for n in names} for row in rows if k.startswith(row[key])] for k in keys}
    fields = ", ".join(f"{field.name}: {field.dataType.simpleString()}" for field in T.StructType.fromDDL(schema).fields)
    by_key = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), f"map<string,array<struct<{fields}>>>")
    scan = first_letters(keys) + f"(?=({letter_tree(keys)}))"
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(scan), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(hits, lambda k: F.element_at(by_key, k))))


def contains_any(text: Column, values: Iterable[str]) -> Column:
    """Any value is a substring of the text (one regex pass)."""
    values = checked(values)
    return matches(text, literal_pattern(values[0]) if len(values) == 1 else f"{first_letters(values)}(?:{letter_tree(values)})")


def matches(text: Column, pattern: str) -> Column:
    """The pattern occurs in the text, like ``rlike``, which inside a lambda decodes its pattern again for every element."""
    return F.regexp_instr(text, F.lit(pattern)) > 0


def contained(text: Column, values: Iterable[str]) -> Column:
    """The values that are substrings of the text, in list order."""
    return let(text, lambda t: F.filter(text_array(values), lambda v: t.contains(v)))


def count_contained(text: Column, values: Iterable[str]) -> Column:
    """How many distinct values are substrings of the text."""
    return F.size(contained(text, values))


def ends_with_any(text: Column, values: Iterable[str]) -> Column:
    """The text ends with any of the values."""
    return text.rlike(f"(?:{alternation(values)})$")


def py_round(value: Column, digits: int) -> Column:
    """Round the binary value: scale, round to whole, scale back.

    ``round(x, d)`` rounds the printed decimal instead, so 0.5075 would become
    0.508 although the stored double lies below the tie.
    """
    scale = float(10 ** digits)
    return F.round(value * scale) / scale
