"""JSON functions on text.  Scalars and flat objects stay in the JVM; deep edits run in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.strings import col

MAP = "map<string,string>"
MAP_VARIANT, LIST_VARIANT = "map<string,variant>", "array<variant>"


def extract(c: Column | str, path: str) -> Column:
    """$.k and $[i]; strings come unquoted, objects and arrays as JSON."""
    return F.get_json_object(col(c), path)


def valid(c: Column | str) -> Column:
    return F.coalesce(F.try_parse_json(col(c)).isNotNull(), F.lit(False))


def type_of(c: Column | str) -> Column:
    """NULL, BOOLEAN, NUMBER, STRING, ARRAY or OBJECT; SQL NULL for what isn't JSON."""
    s = F.schema_of_variant(F.try_parse_json(col(c)))
    return F.when(s == "VOID", "NULL").when(s == "BOOLEAN", "BOOLEAN").when(s == "STRING", "STRING").when(s.startswith("ARRAY"), "ARRAY").when(s.startswith("OBJECT"), "OBJECT").when(s.isNotNull(), "NUMBER")


def keys(c: Column | str) -> Column:
    return F.to_json(F.array_sort(F.json_object_keys(col(c))))


def length(c: Column | str) -> Column:
    return F.coalesce(F.json_array_length(col(c)), F.size(F.json_object_keys(col(c))), F.when(valid(c), 1))


def quote(c: Column | str) -> Column:
    whole = F.to_json(F.struct(col(c).cast("string").alias("q")))
    return F.regexp_extract(whole, r'^\{"q":([\s\S]*)\}$', 1)


def unquote(c: Column | str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(col(c)), "$", "string"), col(c))


def array(*values: Column) -> Column:
    return F.to_json(F.array(*values))


def object_(**values: Column) -> Column:
    """Keys in order of their names."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))))


def has(c: Column | str, path: str) -> Column:
    return extract(c, path).isNotNull()


def _deep(change, result: str = "string"):
    @F.pandas_udf(result)
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(change(*row))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out)

    return run


def _steps(path: str) -> list:
    import re

    return [int(i) if i else k for k, i in re.findall(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]", path) if k or i] if path != "$" else []


def _edit(document, path: str, value, create: bool, replace: bool, remove: bool = False):
    steps = _steps(path)
    if not steps:
        return value if replace and not remove else document
    at = document
    for k in steps[:-1]:
        inner = at.get(k) if isinstance(at, dict) and isinstance(k, str) else at[k] if isinstance(at, list) and isinstance(k, int) and k < len(at) else None
        if inner is None:
            if not create or not isinstance(at, dict):
                return document
            at[k] = inner = {}
        at = inner
    last = steps[-1]
    there = isinstance(at, dict) and last in at or isinstance(at, list) and isinstance(last, int) and last < len(at)
    if remove:
        if there:
            del at[last]
    elif there and replace or isinstance(at, dict) and isinstance(last, str) and not there and create:
        at[last] = value
    elif isinstance(at, list) and create and last == len(at):
        at.append(value)
    return document


def _dump(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def set_(c: Column | str, path: str, value) -> Column:
    """Sets, and creates what is missing."""
    return _deep(lambda text: _dump(_edit(json.loads(text), path, value, True, True)))(col(c))


def insert(c: Column | str, path: str, value) -> Column:
    return _deep(lambda text: _dump(_edit(json.loads(text), path, value, True, False)))(col(c))


def replace(c: Column | str, path: str, value) -> Column:
    return _deep(lambda text: _dump(_edit(json.loads(text), path, value, False, True)))(col(c))


def remove(c: Column | str, *paths: str) -> Column:
    def change(text: str) -> str:
        document = json.loads(text)
        for path in paths:
            document = _edit(document, path, None, False, False, True)
        return _dump(document)

    return _deep(change)(col(c))


def _patched(a, b):
    """RFC 7396."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v)
    return out


def merge_patch(a: Column | str, b: Column | str) -> Column:
    return _deep(lambda x, y: _dump(_patched(json.loads(x), json.loads(y))))(col(a), col(b))


def _holds(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_holds(x, y) for x in a) for y in b) if isinstance(b, list) else any(_holds(x, b) for x in a)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def contains(a: Column | str, b: Column | str) -> Column:
    return _deep(lambda x, y: _holds(json.loads(x), json.loads(y)), "boolean")(col(a), col(b))


def pick(c: Column | str, *names: str) -> Column:
    """Only those keys of a flat object, values as they stand; in the JVM."""
    return F.to_json(F.map_filter(F.from_json(col(c), MAP_VARIANT), lambda k, _: k.isin(*names)))


def omit(c: Column | str, *names: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(col(c), MAP_VARIANT), lambda k, _: ~k.isin(*names)))


def parse(c: Column | str) -> Column:
    """A variant; NULL for what isn't JSON."""
    return F.try_parse_json(col(c))


def values(c: Column | str) -> Column:
    """JSON array of an object's values, in order of the keys."""
    entries = F.array_sort(F.transform(F.map_keys(F.from_json(col(c), MAP_VARIANT)), lambda k: k))
    return F.to_json(F.transform(entries, lambda k: F.element_at(F.from_json(col(c), MAP_VARIANT), k)))


def merge(a: Column | str, b: Column | str) -> Column:
    """Keys of both objects, those of b first; the values of common keys come from b whole."""
    x, y = F.from_json(col(a), MAP_VARIANT), F.from_json(col(b), MAP_VARIANT)
    left = F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k))
    return F.to_json(F.map_concat(y, left))


def _merged(a, b):
    return {**a, **{k: _merged(a[k], v) if k in a else v for k, v in b.items()}} if isinstance(a, dict) and isinstance(b, dict) else b


def deep_merge(a: Column | str, b: Column | str) -> Column:
    return _deep(lambda x, y: _dump(_merged(json.loads(x), json.loads(y))))(col(a), col(b))


def array_append(c: Column | str, *values_: Column) -> Column:
    return F.to_json(F.concat(F.from_json(col(c), LIST_VARIANT), F.array(*map(_variant, values_))))


def _variant(v: Column) -> Column:
    """Any scalar as a variant, through its JSON text."""
    text = F.to_json(F.array(v))
    return F.parse_json(F.substring(text, 2, F.length(text) - 2))


def array_prepend(c: Column | str, *values_: Column) -> Column:
    return F.to_json(F.concat(F.array(*map(_variant, values_)), F.from_json(col(c), LIST_VARIANT)))


def array_flatten(c: Column | str) -> Column:
    """Arrays inside an array taken apart, at any depth."""

    def flat(x) -> list:
        return [z for y in x for z in (flat(y) if isinstance(y, list) else [y])]

    return _deep(lambda text: _dump(flat(json.loads(text))))(col(c))


def object_from_arrays(names: Column | str, values_: Column | str) -> Column:
    return F.to_json(F.map_from_arrays(col(names), col(values_)))


def minify(c: Column | str) -> Column:
    """Without white space between signs; NULL for what isn't JSON.  Keys in order."""
    return F.to_json(F.try_parse_json(col(c)))


def pretty(c: Column | str, indent: int = 2) -> Column:
    return _deep(lambda text: json.dumps(json.loads(text), indent=indent, ensure_ascii=False, sort_keys=True))(col(c))


def transform_keys(c: Column | str, change) -> Column:
    return F.to_json(F.transform_keys(F.from_json(col(c), MAP_VARIANT), lambda k, _: change(k)))


def transform_values(c: Column | str, change) -> Column:
    """change gets each value of a flat object as text."""
    return F.to_json(F.transform_values(F.from_json(col(c), MAP), lambda _, v: change(v)))
