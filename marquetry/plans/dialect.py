"""One SQL text for two engines.

Queries that SQL expresses are written once, in SQL with a few neutral calls (``rx_get``, ``arr_map``
...) and ``@table`` for inputs. ``spark_text`` renders them for Spark, where each ``@table`` becomes a
DataFrame parameter, ``duck_text`` for DuckDB, which the tests and the driver hold the results against.
A pattern is written ``~'...'`` and reaches both engines' regular expressions unescaped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Render = Callable[[list[str]], str]

_GROUP = re.compile(r"\\(\d)")
_SPARK: dict[str, Render] = {
    "concat": lambda a: f"concat({', '.join(a)})",
    "trim": lambda a: f"trim({', '.join(a)})",
    "rx_sub": lambda a: f"regexp_replace({a[0]}, {a[1]}, {_GROUP.sub(r'$\1', a[2])})",
    "rx_get": lambda a: f"regexp_extract({', '.join(a)})",
    "rx_all": lambda a: f"regexp_extract_all({', '.join(a)})",
    "rx_is": lambda a: f"regexp_like({', '.join(a)})",
    "rx_split": lambda a: f"split({', '.join(a)})",
    "arr_filter": lambda a: f"filter({', '.join(a)})",
    "arr_map": lambda a: f"transform({', '.join(a)})",
    "arr_get": lambda a: f"try_element_at({a[0]}, {a[1]})",
    "arr_join": lambda a: f"array_join({', '.join(a)})",
    "arr_len": lambda a: f"size({a[0]})",
    "arr_has": lambda a: f"array_contains({', '.join(a)})",
    "arr_overlap": lambda a: f"arrays_overlap({', '.join(a)})",
    "arr_sort": lambda a: f"array_sort({a[0]})",
    "arr": lambda a: f"array({', '.join(a)})",
    "join_agg": lambda a: f"listagg({a[0]}, {a[1]}) WITHIN GROUP (ORDER BY {', '.join(a[2:])})",
    "js": lambda a: f"get_json_object({', '.join(a)})",
    "epoch_micros": lambda a: f"unix_micros(CAST({a[0]} AS TIMESTAMP))",
    "hash256": lambda a: f"sha2({a[0]}, 256)",
    "starts": lambda a: f"startswith({', '.join(a)})",
    "unnest_rows": lambda a: f"explode({a[0]})",
    "map_entry": lambda a: f"try_element_at({a[0]}, {a[1]})",
    "word_map": lambda a: f"map({', '.join(a)})",
    "range_rows": lambda a: f"explode(sequence({a[0]}, {a[1]}))",
    "half_even": lambda a: f"bround({', '.join(a)})",
    "pad2": lambda a: f"lpad(CAST({a[0]} AS STRING), greatest(2, length(CAST({a[0]} AS STRING))), '0')",
}
_DUCK: dict[str, Render] = {
    "concat": lambda a: f"({' || '.join(a)})",
    "trim": lambda a: f"trim({a[0]})" if len(a) > 1 or " FROM " in a[0] else f"trim({a[0]}, ' ')",
    "rx_sub": lambda a: f"regexp_replace({', '.join(a)}, 'g')",
    "rx_get": lambda a: f"regexp_extract({', '.join(a)})",
    "rx_all": lambda a: f"regexp_extract_all({', '.join(a)})",
    "rx_is": lambda a: f"regexp_matches({', '.join(a)})",
    "rx_split": lambda a: f"string_split_regex({', '.join(a)})",
    "arr_filter": lambda a: f"list_filter({', '.join(a)})",
    "arr_map": lambda a: f"list_transform({', '.join(a)})",
    "arr_get": lambda a: f"list_extract({a[0]}, {a[1]})",
    "arr_join": lambda a: f"array_to_string({', '.join(a)})",
    "arr_len": lambda a: f"len({a[0]})",
    "arr_has": lambda a: f"list_contains({', '.join(a)})",
    "arr_overlap": lambda a: f"list_has_any({', '.join(a)})",
    "arr_sort": lambda a: f"list_sort({a[0]})",
    "arr": lambda a: f"[{', '.join(a)}]",
    "join_agg": lambda a: f"string_agg({a[0]}, {a[1]} ORDER BY {', '.join(a[2:])})",
    "js": lambda a: f"json_extract_string({', '.join(a)})",
    "epoch_micros": lambda a: f"epoch_us({a[0]})",
    "hash256": lambda a: f"sha256({a[0]})",
    "starts": lambda a: f"starts_with({', '.join(a)})",
    "unnest_rows": lambda a: f"unnest({a[0]})",
    "map_entry": lambda a: f"{a[0]}[{a[1]}]",
    "word_map": lambda a: f"MAP([{', '.join(a[::2])}], [{', '.join(a[1::2])}])",
    "range_rows": lambda a: f"unnest(generate_series({a[0]}, {a[1]}))",
    "half_even": lambda a: f"round_even({', '.join(a)})",
    "pad2": lambda a: f"lpad(CAST({a[0]} AS VARCHAR), CAST(greatest(2, length(CAST({a[0]} AS VARCHAR))) AS INT), '0')",
}
_NAMES = re.compile(r"\b(" + "|".join(sorted(_SPARK, key=len, reverse=True)) + r")\(")
_TABLE = re.compile(r"@([a-z_]+)\b")


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens before ``start``, and where it closes."""
    depth, quoted, begin, found = 0, False, start, []
    for i in range(start, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
        elif c == ")":
            found.append(text[begin:i].strip())
            return found, i
        elif c == "," and not depth:
            found.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"unclosed call in {text[start - 20 : start + 40]!r}")


def _render(text: str, calls: dict[str, Render]) -> str:
    out, at = [], 0
    while m := _NAMES.search(text, at):
        arguments, close = _arguments(text, m.end())
        out += [text[at : m.start()], calls[m.group(1)]([_render(a, calls) for a in arguments])]
        at = close + 1
    return "".join([*out, text[at:]])


def tables_of(text: str) -> list[str]:
    """Names of the inputs of a query, in order of appearance."""
    return list(dict.fromkeys(_TABLE.findall(text)))


def spark_text(text: str) -> str:
    """SQL of an expression, or of a query whose tables are still named ``@table``."""
    return _render(text, _SPARK).replace("~'", "r'")


def spark_query(text: str) -> str:
    """SQL with ``{table}`` parameters, for ``spark.sql(text, table=df)``."""
    return _TABLE.sub(r"{\1}", spark_text(text).replace("{", "{{").replace("}", "}}"))


def duck_text(text: str) -> str:
    text = _render(text, _DUCK).replace("~'", "'")
    text = re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", text)
    text = re.sub(r"\b(\w+) -> ", r"lambda \1: ", text)
    return _TABLE.sub(r"\1", text)
