"""Row-level CSV, XML, TOML, YAML, HTML, Markdown, feeds and addresses.

CSV, XML, HTML and addresses are built-in expressions; TOML and YAML documents run in Arrow batches and become JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.strings import col
from lodestar.functions.text import html_text


# CSV
def csv_line(*columns: Column | str, sep: str = ",") -> Column:
    return F.to_csv(F.struct(*map(col, columns)), {"sep": sep})


def csv_parse(c: Column | str, schema: str, sep: str = ",") -> Column:
    return F.from_csv(col(c), schema, {"sep": sep})


def csv_rows(c: Column | str, sep: str = ",") -> Column:
    """Array of maps from a text whose first line has the names; quoted fields may hold separators."""
    field = rf'("(?:[^"]|"")*"|[^{re.escape(sep)}]*)(?:{re.escape(sep)}|$)'
    clean = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, 2, F.greatest(F.length(x) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(x)
    count = lambda line: F.regexp_count(F.regexp_replace(line, r'"(?:[^"]|"")*"', ""), F.lit(re.escape(sep))) + 1
    cells = lambda line: F.transform(F.slice(F.regexp_extract_all(line, F.lit(field), F.lit(1)), F.lit(1), count(line)), clean)
    lines = F.filter(F.split(F.regexp_replace(col(c), "\r\n?", "\n"), "\n"), lambda x: x != "")
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda line: F.map_from_arrays(cells(F.get(lines, F.lit(0))), cells(line)))


# XML
def xml_parse(c: Column | str, schema: str) -> Column:
    return F.from_xml(col(c), schema)


def xml_get(c: Column | str, path: str) -> Column:
    """Text at an XPath; NULL if there is none."""
    found = F.xpath(col(c), F.lit(path if path.endswith("text()") or "@" in path else f"{path}/text()"))
    return F.get(found, F.lit(0))


def xml_stringify(root: str, **values: Column) -> Column:
    """An element with one child for each value, in order of the names; signs are escaped."""
    escape = lambda v: F.replace(F.replace(F.replace(v.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f"<{root}>"), *(F.concat(F.lit(f"<{k}>"), F.coalesce(escape(values[k]), F.lit("")), F.lit(f"</{k}>")) for k in sorted(values)), F.lit(f"</{root}>"))


# TOML and YAML
def _batched(change: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else change(v)
            except (ValueError, TypeError, KeyError, IndexError):
                return None

        return x.map(one)

    return run


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True, default=str)


def toml_parse(c: Column | str) -> Column:
    """JSON text of a TOML document; NULL for what is none."""
    import tomllib

    return _batched(lambda text: _json(tomllib.loads(text)))(col(c))


def _toml_lines(value: dict, path: tuple[str, ...] = ()) -> list[str]:
    def scalar(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(scalar, v)) + "]"
        return json.dumps(v, ensure_ascii=False)

    plain = {k: v for k, v in value.items() if not isinstance(v, dict)}
    out = ([f"[{'.'.join(path)}]"] if path and plain else []) + [f"{k} = {scalar(plain[k])}" for k in sorted(plain) if plain[k] is not None]
    for k in sorted(set(value) - set(plain)):
        out += _toml_lines(value[k], (*path, k))
    return out


def toml_stringify(c: Column | str) -> Column:
    """A TOML document of a JSON object."""
    return _batched(lambda text: "\n".join(_toml_lines(json.loads(text))) + "\n")(col(c))


def _yaml_scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text[:1] in "[{":
        inner, out, depth, start = text[1:-1], [], 0, 0
        for i, ch in enumerate(inner + ","):
            depth += (ch in "[{") - (ch in "]}")
            if ch == "," and not depth:
                out.append(inner[start:i].strip())
                start = i + 1
        out = [x for x in out if x]
        return [_yaml_scalar(x) for x in out] if text[0] == "[" else {k.strip(): _yaml_scalar(v) for k, v in (x.split(":", 1) for x in out)}
    plain = {"": None, "~": None, "null": None, "true": True, "false": False}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def yaml_value(text: str):
    """The block subset: nested mappings and lists by indentation, flow lists and mappings, scalars, comments."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in re.sub(r"(^|\s)#[^\n]*", r"\1", text).split("\n") if x.strip() and x.strip() != "---"]

    def block(i: int, depth: int):
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            items = []
            while i < len(rows) and rows[i][0] == depth and (rows[i][1].startswith("- ") or rows[i][1] == "-"):
                rest = rows[i][1][1:].strip()
                if not rest:
                    value, i = block(i + 1, rows[i + 1][0])
                elif re.match(r"[^\"'\[{][^:]*:(\s|$)", rest):
                    rows[i] = (depth + 2, rest)
                    value, i = block(i, depth + 2)
                else:
                    value, i = _yaml_scalar(rest), i + 1
                items.append(value)
            return items, i
        if not re.match(r"[^:]+:(\s|$)", rows[i][1]):
            return _yaml_scalar(rows[i][1]), i + 1
        out = {}
        while i < len(rows) and rows[i][0] == depth:
            key, _, rest = rows[i][1].partition(":")
            if rest.strip():
                out[str(_yaml_scalar(key))], i = _yaml_scalar(rest), i + 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > depth or rows[i + 1][0] == depth and rows[i + 1][1].startswith("-")):
                out[str(_yaml_scalar(key))], i = block(i + 1, rows[i + 1][0])
            else:
                out[str(_yaml_scalar(key))], i = None, i + 1
        return out, i

    if not rows:
        return None
    value, end = block(0, rows[0][0])
    if end != len(rows):
        raise ValueError("indentation")
    return value


def yaml_parse(c: Column | str) -> Column:
    """JSON text of a document of the block subset; NULL for what is none."""
    return _batched(lambda text: _json(yaml_value(text)))(col(c))


def _yaml_lines(value, depth: int = 0) -> list[str]:
    pad = "  " * depth

    def scalar(v) -> str:
        if isinstance(v, str):
            return v if re.fullmatch(r"[A-Za-z][\w .-]*", v) and v.lower() not in ("true", "false", "null") else json.dumps(v, ensure_ascii=False)
        return json.dumps(v)

    out = []
    for k, v in sorted(value.items()) if isinstance(value, dict) else ((None, x) for x in value):
        head = f"{pad}{k}:" if k is not None else f"{pad}-"
        if isinstance(v, (dict, list)) and v:
            out += [head, *_yaml_lines(v, depth + 1)]
        else:
            out.append(f"{head} {scalar(v)}")
    return out


def yaml_stringify(c: Column | str) -> Column:
    return _batched(lambda text: "\n".join(_yaml_lines(json.loads(text))) + "\n")(col(c))


# HTML, Markdown, feeds
def html_select(c: Column | str, selector: str) -> Column:
    """Elements by tag, .class or #id, as their source text (nested elements of one tag are not told apart)."""
    if selector.startswith("."):
        pattern = rf'(?is)<(\w+)[^>]*\sclass="(?:[^"]*\s)?{re.escape(selector[1:])}(?:\s[^"]*)?"[^>]*>.*?</\1>'
    elif selector.startswith("#"):
        pattern = rf'(?is)<(\w+)[^>]*\sid="{re.escape(selector[1:])}"[^>]*>.*?</\1>'
    else:
        pattern = rf"(?is)<{re.escape(selector)}(?:\s[^>]*)?>.*?</{re.escape(selector)}>"
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def html_attr(c: Column | str, name: str) -> Column:
    """Value of the first attribute of that name; empty if there is none."""
    return F.regexp_extract(col(c), rf"""(?is)\s{re.escape(name)}\s*=\s*["']([^"']*)["']""", 1)


def html_parse(c: Column | str) -> Column:
    return F.struct(html_text(c).alias("text"), F.length(col(c)).alias("length"))


def _rewritten(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    out = col(c)
    for pattern, new in rules:
        out = F.regexp_replace(out, pattern, new)
    return out


def html_to_markdown(c: Column | str) -> Column:
    rules = [(rf"<h{n}[^>]*>(.+?)</h{n}>", "#" * n + " $1\n") for n in (1, 2, 3)]
    rules += [(rf"<{tag}(?:\s[^>]*)?>(.+?)</{tag}>", f"{mark}$1{mark}") for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`"))]
    rules += [('<a[^>]*href="([^"]+)"[^>]*>(.+?)</a>', "[$2]($1)"), (r"<br\s*/?>", "\n"), (r"<p(?:\s[^>]*)?>(.+?)</p>", "$1\n\n"), ("<[^>]+>", "")]
    return _rewritten(c, rules)


def markdown_to_html(c: Column | str) -> Column:
    rules = [(rf"(?m)^{'#' * n} (.+)$", f"<h{n}>$1</h{n}>") for n in (3, 2, 1)]
    rules += [(r"\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), ("__(.+?)__", "<strong>$1</strong>"), ("_(.+?)_", "<em>$1</em>")]
    rules += [("```(.+?)```", "<pre><code>$1</code></pre>"), ("`(.+?)`", "<code>$1</code>"), (r"\[(.+?)\]\((.+?)\)", '<a href="$2">$1</a>'), ("\n\n", "</p><p>"), ("\n", "<br>")]
    return F.concat(F.lit("<p>"), _rewritten(c, rules), F.lit("</p>"))


def rss_items(c: Column | str) -> Column:
    """title, link and description of every item of a feed."""
    part = lambda item, tag: F.regexp_replace(F.regexp_extract(item, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    return F.transform(F.regexp_extract_all(col(c), F.lit("(?s)<item>(.*?)</item>"), F.lit(1)), lambda x: F.struct(*(part(x, t).alias(t) for t in ("title", "link", "description"))))


# Addresses
def url_join(base: Column | str, path: Column | str) -> Column:
    """A reference resolved against a base: absolute, by scheme, from the root, or beside the last part; dots are removed."""
    b, p = col(base), col(path)
    root = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(b, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*/|/)?", 1)
    plain = F.when(p.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), p).when(p.startswith("//"), F.concat(F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), p))
    plain = plain.when(p == "", F.regexp_replace(b, "#.*$", "")).when(p.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), p)).when(p.startswith("?"), F.concat(F.regexp_replace(b, "[?#].*$", ""), p))
    merged = F.when(p.startswith("/"), p).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), p))
    steps = F.split(F.regexp_extract(merged, "^[^?#]*", 0), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    tail = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    return plain.otherwise(F.concat(root, F.array_join(kept, "/"), tail, F.regexp_extract(merged, "[?#].*$", 0)))


def url_build(scheme: Column | str, host: Column | str, path: Column | None = None, query: dict[str, Column] | None = None, fragment: Column | None = None) -> Column:
    """An address of its parts; queries in order of their names."""
    out = [col(scheme), F.lit("://"), col(host)]
    if path is not None:
        out.append(F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path)))
    for i, k in enumerate(sorted(query or {})):
        out += [F.lit(("&" if i else "?") + k + "="), F.url_encode(query[k].cast("string"))]
    if fragment is not None:
        out += [F.lit("#"), fragment]
    return F.concat(*out)
