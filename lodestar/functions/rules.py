"""Rules, decision tables, expressions, state machines and schedules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "eq": lambda c, v: c.cast("string") == F.lit(str(v)),
    "neq": lambda c, v: c.cast("string") != F.lit(str(v)),
    "gt": lambda c, v: c.cast("double") > float(v),
    "gte": lambda c, v: c.cast("double") >= float(v),
    "lt": lambda c, v: c.cast("double") < float(v),
    "lte": lambda c, v: c.cast("double") <= float(v),
    "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))),
    "starts_with": lambda c, v: F.startswith(c.cast("string"), F.lit(str(v))),
    "ends_with": lambda c, v: F.endswith(c.cast("string"), F.lit(str(v))),
    "in": lambda c, v: c.cast("string").isin(*map(str, v)),
    "exists": lambda c, v: F.lit(True),
    "not_exists": lambda c, v: F.lit(False),
}
_SIGNS = {"==": "eq", "!=": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


def condition(name: str, operator: str, value=None) -> Column:
    """Whether a field meets a condition; a null field does not exist, which only not_exists accepts."""
    operator = _SIGNS.get(operator, operator)
    if operator not in _TESTS:
        raise ValueError(f"unknown operator {operator}")
    c = F.col(name)
    return F.when(c.isNull(), operator == "not_exists").otherwise(_TESTS[operator](c, value))


@dataclass
class Rule:
    """A name, conditions that all have to hold, and a priority."""

    name: str
    conditions: list[tuple] = field(default_factory=list)
    priority: int = 0

    def where(self, name: str, operator: str, value=None) -> Rule:
        self.conditions.append((name, operator, value))
        return self

    def matches(self) -> Column:
        return reduce(lambda a, b: a & b, (condition(*c) for c in self.conditions), F.lit(True))


def chain(*rules: Rule) -> Column:
    """Names of the rules that match, in the order given."""
    return F.filter(F.array(*(F.when(r.matches(), r.name) for r in rules)), lambda x: x.isNotNull())


def first_match(*rules: Rule) -> Column:
    """The matching rule of the highest priority; the first given among equals."""
    return F.get(chain(*sorted(rules, key=lambda r: -r.priority)), F.lit(0))


def decision_table(df: DataFrame, table: list[dict], result: str = "matched") -> DataFrame:
    """df with the outcomes of all rows of a table whose conditions ({field: value}) hold.  The table is a driver's list."""
    rules = [(Rule(str(i), [(k, "eq", v) for k, v in row["conditions"].items()]).matches(), row["outcome"]) for i, row in enumerate(table)]
    return df.withColumn(result, F.filter(F.array(*(F.when(m, F.lit(o)) for m, o in rules)), lambda x: x.isNotNull()))


def evaluate(df: DataFrame, expression: str, name: str = "value") -> DataFrame:
    """An expression over the columns."""
    return df.withColumn(name, F.expr(expression))


def state_machine(df: DataFrame, key: str, order: list[str], event: str, transitions: dict[tuple[str, str], str], initial: str) -> DataFrame:
    """key, order columns, event, before and after: each key's events through (state, event) -> state; others leave the
    state as it is.  Rows stream past in order, so a task holds one batch and one state, however long a key's history."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [key, *order, event]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), initial
        for rows in frames:
            before, after = [], []
            for k, e in zip(rows[key], rows[event], strict=True):
                if k != last:
                    last, state = k, initial
                before.append(state)
                state = transitions.get((state, e), state)
                after.append(state)
            yield rows.assign(before=before, after=after)

    sorted_ = df.select(*names).repartition(key).sortWithinPartitions(key, *order)
    return sorted_.mapInPandas(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "before string, after string"]))


# Schedules: minute, hour, day, month, weekday (0 or 7: Sunday)
_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def cron_fields(text: str) -> list[set[int]]:
    """The values of the five fields: *, lists, ranges and steps."""
    parts = text.split()
    if len(parts) != 5:
        raise ValueError("a schedule has five fields: minute hour day month weekday")
    out = []
    for part, (low, high) in zip(parts, _RANGES, strict=True):
        values: set[int] = set()
        for piece in part.split(","):
            span, _, step = piece.partition("/")
            a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span or not step else high)
            if not low <= a <= b <= high:
                raise ValueError(f"{piece} is out of {low}..{high}")
            values |= set(range(a, b + 1, int(step or 1)))
        out.append(values)
    out[4] = {v % 7 for v in out[4]}
    return out


def cron_next(text: str, after: dt.datetime, n: int = 1) -> list[dt.datetime]:
    """The next n times after a moment; fewer if none comes within ten years."""
    minutes, hours, days, months, weekdays = cron_fields(text)
    out, day, end = [], after.replace(hour=0, minute=0, second=0, microsecond=0), after.year + 10
    times = [dt.timedelta(hours=h, minutes=m) for h in sorted(hours) for m in sorted(minutes)]
    while len(out) < n and day.year <= end:
        if day.month in months and day.day in days and (day.weekday() + 1) % 7 in weekdays:
            out += [day + t for t in times if day + t > after][: n - len(out)]
        day += dt.timedelta(days=1)
    return out


def cron_matches(c: Column, text: str) -> Column:
    """Whether a timestamp's minute is one of a schedule's."""
    minutes, hours, days, months, weekdays = cron_fields(text)
    tests = ((F.minute(c), minutes), (F.hour(c), hours), (F.dayofmonth(c), days), (F.month(c), months), (F.dayofweek(c) - 1, weekdays))
    return reduce(lambda a, b: a & b, (x.isin(*sorted(v)) for x, v in tests))
