"""JSON of any shape as columns: its canonical text, its size, and the bounds of audit details.

A VARIANT keeps an object's fields by name, so its text is compact and sorted at all levels. What isn't JSON, or names
a field twice, has no canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of audit details.
MOST_DEPTH, MOST_TEXT, MOST_ITEMS, MOST_KEY, MOST_BYTES = 4, 256, 32, 64, 4096


def canonical(text: Column) -> Column:
    """The same JSON without blanks, fields in order of their names."""
    return F.to_json(F.try_parse_json(text))


def canonical_bytes(text: Column) -> Column:
    """The size of the canonical text in UTF-8."""
    return F.octet_length(canonical(text)).cast("long")


def escaped_bytes(text: Column) -> Column:
    """The size of a JSON text whose characters beyond ASCII are written as \\uXXXX, those beyond the first plane as two."""
    near, far = F.regexp_count(text, F.lit("[\\x{80}-\\x{FFFF}]")), F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return (F.length(text) + 5 * near + 11 * far).cast("long")


def _is(v: str, kind: str) -> str:
    return f"startswith(schema_of_variant({v}), '{kind}')"


def _map(v: str) -> str:
    return f"map_filter(try_variant_get({v}, '$', 'map<string,variant>'), (k, y) -> length(k) <= {MOST_KEY})"


def _children(column: str) -> Column:
    """What a level's objects and arrays hold, fields of long names left out."""
    return F.expr(f"flatten(transform({column}, x -> CASE WHEN {_is('x', 'OBJECT')} THEN map_values({_map('x')}) WHEN {_is('x', 'ARRAY')} THEN try_variant_get(x, '$', 'array<variant>') ELSE array() END))")


def _written(v: str, depth: int) -> str:
    """SQL of a value's canonical text without fields of long names."""
    if depth > MOST_DEPTH:
        return "''"
    k, m, x = f"k{depth}", f"m{depth}", f"x{depth}"
    own = _map(v)
    fields = f"transform(array_sort(map_entries(transform_values({own}, ({k}, {m}) -> {_written(m, depth + 1)}))), {x} -> concat(substring(to_json(array({x}.key)), 2, length(to_json(array({x}.key))) - 2), ':', {x}.value))"
    items = f"transform(try_variant_get({v}, '$', 'array<variant>'), {m} -> {_written(m, depth + 1)})"
    return f"CASE WHEN {_is(v, 'OBJECT')} THEN concat('{{', array_join({fields}, ','), '}}') WHEN {_is(v, 'ARRAY')} THEN concat('[', array_join({items}, ','), ']') ELSE to_json({v}) END"


def bounded(df: DataFrame, column: str) -> DataFrame:
    """df with details, the canonical text of a column's JSON object without fields of long names, and violations (sorted).

    An event whose details break a bound is rejected, not cut, so details is null then: object (no JSON object), depth (a
    value within more than four others), text (a string of more than 256 characters), list and fields (more than 32 items or
    fields, those of long names included), bytes (more than 4096 in ASCII). Fields whose name has more than 64 characters
    are left out with all they hold.
    """
    rows = df.withColumn("_v", F.try_parse_json(column)).withColumn("_0", F.expr(f"CASE WHEN {_is('_v', 'OBJECT')} THEN array(_v) ELSE array() END"))
    for depth in range(1, MOST_DEPTH + 2):
        rows = rows.withColumn(f"_{depth}", _children(f"_{depth - 1}"))
    levels = [f"_{d}" for d in range(MOST_DEPTH + 1)]
    some = lambda test: F.expr(" OR ".join(f"exists({level}, x -> {test})" for level in levels))
    # the text as it is, unless a name has to go
    long = some(f"{_is('x', 'OBJECT')} AND exists(map_keys(try_variant_get(x, '$', 'map<string,variant>')), k -> length(k) > {MOST_KEY})")
    rows = rows.withColumn("_text", F.when(F.size("_0") > 0, F.when(long, F.expr(_written("_v", 0))).otherwise(F.to_json("_v"))))
    rules = {
        "object": F.size("_0") == 0,
        "depth": F.size(f"_{MOST_DEPTH + 1}") > 0,
        "text": some(f"schema_of_variant(x) = 'STRING' AND length(variant_get(x, '$', 'string')) > {MOST_TEXT}"),
        "list": some(f"{_is('x', 'ARRAY')} AND size(try_variant_get(x, '$', 'array<variant>')) > {MOST_ITEMS}"),
        "fields": some(f"{_is('x', 'OBJECT')} AND size(try_variant_get(x, '$', 'map<string,variant>')) > {MOST_ITEMS}"),
        "bytes": F.coalesce(escaped_bytes(F.col("_text")) > MOST_BYTES, F.lit(False)),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()])))
    rows = rows.withColumn("violations", found).withColumn("details", F.when(F.size("violations") == 0, F.col("_text")))
    return rows.drop("_v", "_text", *levels, f"_{MOST_DEPTH + 1}")


def kept_keys(text: Column, names: tuple[str, ...]) -> Column:
    """A JSON object's canonical text with the named fields only; their values may be of any kind."""
    fields = F.map_filter(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), lambda k, _: k.isin(*names))
    written = F.transform(F.array_sort(F.map_entries(F.transform_values(fields, lambda _, v: F.to_json(v)))), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"]))
    return F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}"))
