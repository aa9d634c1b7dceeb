"""Mutable tables as snapshots of Parquet files.

A table is a folder with numbered snapshot folders and a JSON side-car (schema, constraints, current snapshot).  Every
change writes new snapshots of all tables that it touches and moves the pointers only after that, so readers see whole
states, a failed or refused change leaves the old one, and a transaction can put the pointers back.  Unchanged rows are
copied by the same scan that computes the changed ones.  The side-car goes through Hadoop's file system, as the data does.
Conditions and values are SQL over the tables of the database, subqueries included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    pass


@dataclass
class Foreign:
    columns: list[str]
    table: str
    references: list[str]
    on_delete: str = "RESTRICT"  # or NO ACTION, CASCADE, SET NULL
    on_update: str = "RESTRICT"


@dataclass
class Meta:
    schema: str
    snapshot: int = 0
    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    sequence: str | None = None
    foreign: list[dict] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)  # name: columns, unique
    temporary: bool = False


class Database:
    """Tables under one folder, with triggers and transactions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.triggers: dict[tuple[str, str, str], list[Callable[[DataFrame], DataFrame | None]]] = {}
        self.last_insert_id: int | None = None
        self.row_count = 0
        self._saved: list[tuple[str, dict[str, str]]] = []  # open savepoints, the transaction's own first

    # Files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _write_meta(self, name: str, meta: Meta) -> None:
        fs, p = self._fs(f"{self.path}/{name}/meta.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(asdict(meta)).encode()))
        out.close()

    def meta(self, name: str) -> Meta:
        fs, p = self._fs(f"{self.path}/{name}/meta.json")
        stream = fs.open(p)
        try:
            return Meta(**json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}/meta.json")
        return fs.exists(p)

    def names(self) -> list[str]:
        fs, p = self._fs(self.path)
        found = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else ()
        return sorted(n for n in found if not n.startswith("_"))

    # Definition
    def create(self, name: str, schema: str, if_not_exists: bool = False, foreign: list[Foreign] | None = None, **constraints) -> None:
        if self.exists(name):
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        meta = Meta(schema, foreign=[asdict(f) for f in foreign or []], **constraints)
        self._write({name: (meta, self.spark.createDataFrame([], schema))})

    def drop(self, name: str, if_exists: bool = False) -> None:
        if not if_exists and not self.exists(name):
            raise ValueError(f"no table {name}")
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def close(self) -> None:
        """Drop the temporary tables."""
        for n in self.names():
            if self.meta(n).temporary:
                self.drop(n)

    def read(self, name: str) -> DataFrame:
        meta = self.meta(name)
        return self.spark.read.schema(meta.schema).parquet(f"{self.path}/{name}/s{meta.snapshot}")

    def views(self, **rows: DataFrame) -> None:
        """Make every table a temporary view of its name, with other rows where given."""
        for n in self.names():
            (rows.get(n) or self.read(n)).createOrReplaceTempView(n)

    def sql(self, text: str) -> DataFrame:
        self.views()
        return self.spark.sql(text)

    def _write(self, changes: dict[str, tuple[Meta, DataFrame]]) -> None:
        """All new snapshots, and then all pointers."""
        for name, (meta, rows) in changes.items():
            meta.snapshot += 1
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/s{meta.snapshot}")
        for name, (meta, _) in changes.items():
            self._write_meta(name, meta)

    def _stage(self, rows: DataFrame) -> DataFrame:
        """rows written beside the tables, so that later steps neither compute them again nor see changes."""
        path = f"{self.path}/_stage/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def alter(self, name: str, add: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, cast: dict[str, str] | None = None, default: dict[str, str] | None = None) -> None:
        meta, rows = self.meta(name), self.read(name)
        meta.defaults |= default or {}
        for c, kind in (add or {}).items():
            rows = rows.withColumn(c, F.expr(meta.defaults.get(c, "NULL")).cast(kind))
        for c, kind in (cast or {}).items():
            rows = rows.withColumn(c, F.col(c).try_cast(kind))
        for c in drop or []:
            if c in meta.primary or any(c in f["columns"] for f in meta.foreign):
                raise ConstraintError(f"{c} is part of a key")
            meta.not_null = [x for x in meta.not_null if x != c]
            meta.unique = [k for k in meta.unique if c not in k]
            meta.defaults.pop(c, None)
            meta.generated.pop(c, None)
        changed = rename or {}
        new = lambda c: changed.get(c, c)
        rows = rows.drop(*(drop or [])).withColumnsRenamed(changed)
        meta.primary, meta.not_null, meta.unique = [new(c) for c in meta.primary], [new(c) for c in meta.not_null], [[new(c) for c in k] for k in meta.unique]
        meta.defaults, meta.generated, meta.sequence = {new(c): e for c, e in meta.defaults.items()}, {new(c): e for c, e in meta.generated.items()}, meta.sequence and new(meta.sequence)
        for f in meta.foreign:
            f["columns"] = [new(c) for c in f["columns"]]
        meta.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self._write({name: (meta, rows)})

    def rename(self, name: str, to: str) -> None:
        if self.exists(to):
            raise ValueError(f"table {to} exists")
        fs, p = self._fs(f"{self.path}/{name}")
        fs.rename(p, self._fs(f"{self.path}/{to}")[1])
        for n in self.names():
            meta = self.meta(n)
            if any(f["table"] == name for f in meta.foreign):
                meta.foreign = [f | {"table": to if f["table"] == name else f["table"]} for f in meta.foreign]
                self._write_meta(n, meta)

    def constrain(self, name: str, constraint: str, check: str | None = None, unique: list[str] | None = None, foreign: Foreign | None = None, not_null: str | None = None) -> None:
        """Add a named constraint, which the rows that are there have to meet."""
        meta = self.meta(name)
        if check:
            meta.checks[constraint] = check
        if unique:
            meta.unique.append(unique)
            meta.indexes[constraint] = {"columns": unique, "unique": True}
        if foreign:
            meta.foreign.append(asdict(foreign) | {"name": constraint})
        if not_null:
            meta.not_null.append(not_null)
        self._check(name, self.read(name), meta=meta)
        self._write_meta(name, meta)

    def release_constraint(self, name: str, constraint: str) -> None:
        meta = self.meta(name)
        before = json.dumps(asdict(meta))
        meta.checks.pop(constraint, None)
        if (index := meta.indexes.pop(constraint, None)) and index["unique"]:
            meta.unique.remove(index["columns"])
        meta.foreign = [f for f in meta.foreign if f.get("name") != constraint]
        if json.dumps(asdict(meta)) == before:
            raise ValueError(f"no constraint {constraint}")
        self._write_meta(name, meta)

    def index(self, name: str, index: str, columns: list[str], unique: bool = False) -> None:
        """An index is a statement about the table: a unique one is a constraint, others only name columns to sort by."""
        if unique:
            self.constrain(name, index, unique=columns)
        else:
            meta = self.meta(name)
            meta.indexes[index] = {"columns": columns, "unique": False}
            self._write_meta(name, meta)

    # Constraints
    def violations(self, name: str, rows: DataFrame, against: DataFrame | None = None, meta: Meta | None = None) -> DataFrame:
        """kind, detail, n of every broken constraint among rows (unique keys also against other rows, of which only
        those with the same keys are looked at)."""
        meta = meta or self.meta(name)
        out = [rows.where(F.col(c).isNull()).agg(F.lit("NOT NULL").alias("kind"), F.lit(c).alias("detail"), F.count("*").alias("n")) for c in dict.fromkeys([*meta.not_null, *meta.primary])]
        out += [rows.where(~F.expr(e)).agg(F.lit("CHECK").alias("kind"), F.lit(k).alias("detail"), F.count("*").alias("n")) for k, e in meta.checks.items()]
        for key in [k for k in [meta.primary, *meta.unique] if k]:
            new = rows.dropna(subset=key).groupBy(*key).count()
            twice = new.where("count > 1").select(*key)
            if against is not None:
                twice = twice.unionByName(new.select(*key).join(against.select(*key), key, "left_semi")).distinct()
            out.append(twice.agg(F.lit("UNIQUE").alias("kind"), F.lit(", ".join(key)).alias("detail"), F.count("*").alias("n")))
        for f in meta.foreign:
            parent = self.read(f["table"])
            if f["table"] == name:
                parent = rows if against is None else against.unionByName(rows.select(*against.columns))
            parent = parent.select(*(F.col(r).alias(c) for c, r in zip(f["columns"], f["references"], strict=True)))
            lost = rows.dropna(subset=f["columns"]).join(parent, f["columns"], "left_anti")
            out.append(lost.agg(F.lit("FOREIGN KEY").alias("kind"), F.lit(", ".join(f["columns"])).alias("detail"), F.count("*").alias("n")))
        empty = self.spark.createDataFrame([], "kind string, detail string, n bigint")
        for o in out:
            empty = empty.unionByName(o)
        return empty.where("n > 0")

    def _check(self, name: str, rows: DataFrame, against: DataFrame | None = None, meta: Meta | None = None) -> None:
        broken = self.violations(name, rows, against, meta).collect()  # a row for each constraint at most
        if broken:
            raise ConstraintError("; ".join(f"{r['kind']} ({r['detail']}): {r['n']}" for r in broken))

    # Triggers: time BEFORE, AFTER or INSTEAD OF; event INSERT, UPDATE or DELETE; action gets the affected rows.
    def on(self, name: str, time: str, event: str, action: Callable[[DataFrame], DataFrame | None], when: str | None = None) -> None:
        run = (lambda rows: action(rows.where(when))) if when else action
        self.triggers.setdefault((name, time.upper(), event.upper()), []).append(run)

    def _fire(self, name: str, time: str, event: str, rows: DataFrame) -> DataFrame:
        for action in self.triggers.get((name, time, event), []):
            rows = action(rows) or rows
        return rows

    def _instead(self, name: str, event: str) -> bool:
        return (name, "INSTEAD OF", event) in self.triggers

    # Changes
    def _complete(self, name: str, rows: DataFrame, meta: Meta, old: DataFrame) -> DataFrame:
        schema = T._parse_datatype_string(meta.schema)
        if meta.sequence and meta.sequence not in rows.columns:
            start = old.agg(F.max(meta.sequence)).first()[0] or 0
            rows = self._numbered(rows, meta.sequence, start)
        for f in schema.fields:
            if f.name in meta.generated:
                rows = rows.withColumn(f.name, F.expr(meta.generated[f.name]))
            elif f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.expr(meta.defaults.get(f.name, "NULL")))
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))

    def _numbered(self, rows: DataFrame, name: str, start: int) -> DataFrame:
        """rows with the numbers after `start`, gapless: counted per partition, so no task holds all of them."""
        rows = self._stage(rows.withColumn("t_order", F.monotonically_increasing_id()))
        rows = rows.withColumn("t_part", F.shiftright("t_order", 33))
        before = Window.orderBy("t_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        offsets = rows.groupBy("t_part").count().select("t_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("t_before"))
        own = F.row_number().over(Window.partitionBy("t_part").orderBy("t_order"))
        return rows.join(offsets, "t_part").withColumn(name, own + F.col("t_before") + F.lit(start)).drop("t_order", "t_part", "t_before")

    def insert(self, name: str, rows: DataFrame, on_conflict: str | None = None, key: list[str] | None = None, update: dict[str, str] | None = None) -> DataFrame:
        """INSERT [ON CONFLICT DO NOTHING | DO UPDATE SET].  In `update` expressions new columns are called excluded.c.
        Returns the rows inserted or updated."""
        meta, old = self.meta(name), self.read(name)
        new = self._fire(name, "BEFORE", "INSERT", self._complete(name, rows, meta, old))
        if self._instead(name, "INSERT"):
            return self._fire(name, "INSTEAD OF", "INSERT", new)
        keep, changed = old, new
        if on_conflict:
            key = key or meta.primary
            # Of rows with one key the least by all columns counts, so that the result is defined.
            new = new.withColumn("t_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*old.columns))).where("t_rank = 1").drop("t_rank")
            if on_conflict.upper() == "NOTHING":
                changed = new.join(old.select(*key), key, "left_anti")
            else:
                pairs = old.alias("t").join(new.alias("excluded"), key, "inner")
                sets = update or {c: f"excluded.{c}" for c in old.columns if c not in key}
                updated = pairs.select(*((F.col(c) if c in key else F.expr(sets[c]) if c in sets else F.col(f"t.{c}")).alias(c) for c in old.columns))
                for c, e in meta.generated.items():
                    updated = updated.withColumn(c, F.expr(e).cast(old.schema[c].dataType))
                keep = old.join(new.select(*key), key, "left_anti")
                changed = updated.unionByName(new.join(old.select(*key), key, "left_anti"))
        changed = self._stage(changed.select(*old.columns))
        self._check(name, changed, keep)
        self._write({name: (meta, keep.unionByName(changed))})
        if meta.sequence:
            self.last_insert_id = self.read(name).agg(F.max(meta.sequence)).first()[0]
        return self._done(name, "INSERT", changed)

    def _done(self, name: str, event: str, rows: DataFrame) -> DataFrame:
        self.row_count = rows.count()
        self._fire(name, "AFTER", event, rows)
        return rows

    def _parted(self, name: str, where: str, cte: str) -> tuple[str, str]:
        """Queries of the rows that a condition hits and of the others."""
        self.views()
        return f"{cte} SELECT * FROM {name} WHERE {where}", f"{cte} SELECT * FROM {name} WHERE NOT coalesce({where}, false)"

    def update(self, name: str, sets: dict[str, str | Column], where: str = "true", cte: str = "") -> DataFrame:
        """UPDATE, with the actions of foreign keys; returns the rows as they are now.  cte: WITH clauses for the condition
        and the values."""
        meta, old = self.meta(name), self.read(name)
        _, rest = self._parted(name, where, cte)
        plain = {c: e for c, e in sets.items() if not isinstance(e, Column)}
        values = ", ".join(f"({plain[c]}) AS `t_{c}`" for c in plain)
        both = self.spark.sql(f"{cte} SELECT *{', ' + values if values else ''} FROM {name} WHERE {where}")
        both = both.withColumns({f"t_{c}": e for c, e in sets.items() if isinstance(e, Column)})
        new = lambda c: F.col(f"t_{c}").cast(old.schema[c].dataType) if c in sets else F.col(c)
        moved = self._stage(both.select(*(F.col(c).alias(f"o_{c}") for c in old.columns), *(new(c).alias(c) for c in old.columns)))
        after = moved.select(*old.columns)
        for c, e in meta.generated.items():
            after = after.withColumn(c, F.expr(e))
        if self._instead(name, "UPDATE"):
            return self._fire(name, "INSTEAD OF", "UPDATE", after)
        after = self._stage(self._fire(name, "BEFORE", "UPDATE", after).select(*old.columns))
        keep = self.spark.sql(rest)
        self._check(name, after, keep)
        changes = {name: keep.unionByName(after)}
        self._follow(name, moved, changes)
        self._write({n: (self.meta(n), rows) for n, rows in changes.items()})
        return self._done(name, "UPDATE", after)

    def _children(self, name: str) -> list[tuple[str, dict]]:
        return [(child, f) for child in self.names() for f in self.meta(child).foreign if f["table"] == name]

    def _follow(self, name: str, moved: DataFrame, changes: dict[str, DataFrame]) -> None:
        """ON UPDATE: moved has every changed row as it was (o_...) and as it is.  Children of children follow."""
        waiting = [(name, moved)]
        while waiting:
            table, moved = waiting.pop()
            for child, f in self._children(table):
                if not set(f["references"]) <= set(moved.columns):
                    continue
                differ = " OR ".join(f"NOT (o_{r} <=> {r})" for r in f["references"])
                keys = moved.where(differ).select(*(F.col(f"o_{r}").alias(c) for c, r in zip(f["columns"], f["references"], strict=True)), *(F.col(r).alias(f"n_{c}") for c, r in zip(f["columns"], f["references"], strict=True))).distinct()
                rows, action = changes.get(child, self.read(child)), f.get("on_update", "RESTRICT").upper()
                lost = self._stage(rows.join(keys, f["columns"]))
                if lost.isEmpty():
                    continue
                if action not in ("CASCADE", "SET NULL"):
                    raise ConstraintError(f"rows of {child} refer to {table}")
                new = {c: F.col(f"n_{c}") if action == "CASCADE" else F.lit(None).cast(rows.schema[c].dataType) for c in f["columns"]}
                both = lost.select(*(F.col(c).alias(f"o_{c}") for c in rows.columns), *(new.get(c, F.col(c)).alias(c) for c in rows.columns))
                changes[child] = rows.join(keys, f["columns"], "left_anti").unionByName(both.select(*rows.columns))
                if action == "SET NULL":
                    self._refuse_nulls(child, f["columns"])
                waiting.append((child, both))

    def _refuse_nulls(self, name: str, columns: list[str]) -> None:
        meta = self.meta(name)
        if held := set(columns) & {*meta.not_null, *meta.primary}:
            raise ConstraintError(f"NOT NULL ({', '.join(sorted(held))}) of {name}")

    def delete(self, name: str, where: str = "true", cte: str = "") -> DataFrame:
        """DELETE, with the actions of foreign keys through all levels; returns the rows as they were.  Nothing is
        written before every level is known to allow it."""
        hits, rest = self._parted(name, where, cte)
        gone = self._stage(self.spark.sql(hits))
        if self._instead(name, "DELETE"):
            return self._fire(name, "INSTEAD OF", "DELETE", gone)
        self._fire(name, "BEFORE", "DELETE", gone)
        changes, waiting = {name: self._stage(self.spark.sql(rest))}, [(name, gone)]
        while waiting:
            table, lost_rows = waiting.pop()
            for child, f in self._children(table):
                keys = lost_rows.select(*(F.col(r).alias(c) for c, r in zip(f["columns"], f["references"], strict=True))).dropna().distinct()
                rows, action = changes.get(child, self.read(child)), f["on_delete"].upper()
                lost = self._stage(rows.join(keys, f["columns"], "left_semi"))
                if lost.isEmpty():
                    continue
                if action not in ("CASCADE", "SET NULL"):
                    raise ConstraintError(f"rows of {child} refer to {table}")
                others = rows.join(keys, f["columns"], "left_anti").select(*rows.columns)
                if action == "CASCADE":
                    changes[child] = others
                    waiting.append((child, lost))
                else:
                    self._refuse_nulls(child, f["columns"])
                    changes[child] = others.unionByName(lost.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in f["columns"]}).select(*rows.columns))
        self._write({n: (self.meta(n), rows) for n, rows in changes.items()})
        return self._done(name, "DELETE", gone)

    def truncate(self, name: str) -> None:
        meta = self.meta(name)
        for child, _ in self._children(name):
            if child != name and not self.read(child).isEmpty():
                raise ConstraintError(f"rows of {child} refer to {name}")
        self._write({name: (meta, self.spark.createDataFrame([], meta.schema))})

    # Transactions: pointers are saved and put back.
    def begin(self) -> None:
        if self._saved:
            raise ValueError("a transaction is open")
        self.savepoint("")

    def savepoint(self, point: str) -> None:
        self._saved.append((point, {n: json.dumps(asdict(self.meta(n))) for n in self.names()}))

    def _place(self, point: str) -> int:
        places = [i for i, (p, _) in enumerate(self._saved) if p == point]
        if not places:
            raise ValueError(f"no savepoint {point}" if point else "no transaction is open")
        return places[-1]

    def release(self, point: str) -> None:
        """Forget a savepoint and those after it."""
        del self._saved[self._place(point) :]

    def commit(self) -> None:
        self._place("")
        self._saved = []

    def rollback(self, to: str = "") -> None:
        """Back to the beginning, or to a savepoint, which stays."""
        place = self._place(to)
        saved = self._saved[place][1]
        for n in self.names():
            if n in saved:
                self._write_meta(n, Meta(**json.loads(saved[n])))
            else:
                self.drop(n)
        self._saved = self._saved[: place + 1] if to else []

    # Care
    def vacuum(self, into: str | None = None) -> None:
        """Compact every table into a new snapshot and delete the others; or copy the tables into another folder.  Not
        inside a transaction, which needs the old ones."""
        if self._saved:
            raise ValueError("a transaction is open")
        if into:
            self._copy(Database(self.spark, into))
            return
        for n in self.names():
            meta = self.meta(n)
            self._write({n: (meta, self.read(n))})
            fs, p = self._fs(f"{self.path}/{n}")
            for s in fs.listStatus(p):
                if s.isDirectory() and s.getPath().getName() != f"s{meta.snapshot}":
                    fs.delete(s.getPath(), True)
        fs, p = self._fs(f"{self.path}/_stage")
        fs.delete(p, True)

    def _copy(self, to: Database) -> None:
        for n in self.names():
            meta = self.meta(n)
            to._write({n: (meta, self.read(n))})

    def summary(self, name: str) -> DataFrame:
        """ANALYZE: column, rows, nulls, distinct (approximate), least and greatest value as text."""
        rows = self.read(name)
        named = [(c, F.col(f"`{c}`")) for c in rows.columns]
        sums = rows.agg(*(F.struct(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")).alias(n) for n, c in named))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("v")) for n, _ in named))).alias("x")).select("x.column", "x.v.*")

    def checksum(self, name: str) -> tuple[int, int]:
        """Rows, and the sum of their hashes."""
        rows = self.read(name)
        r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
        return r["n"], int(r["h"] or 0)

    def backup(self, path: str) -> dict[str, tuple[int, int]]:
        """Copy all tables to a folder; returns each one's checksum, for verify()."""
        copy = Database(self.spark, path)
        self._copy(copy)
        return {n: copy.checksum(n) for n in copy.names()}

    def verify(self, path: str) -> DataFrame:
        """table, rows, same: whether a backup has the rows that are here."""
        copy, out = Database(self.spark, path), []
        for n in sorted({*self.names(), *copy.names()}):
            here, there = (d.checksum(n) if d.exists(n) else None for d in (self, copy))
            out.append((n, there[0] if there else None, here == there))
        return self.spark.createDataFrame(out, "table string, rows bigint, same boolean")

    def restore(self, path: str) -> None:
        """The tables of a backup in place of those here."""
        copy = Database(self.spark, path)
        for n in self.names():
            if not copy.exists(n):
                self.drop(n)
        for n in copy.names():
            meta = copy.meta(n)
            meta.snapshot = max(meta.snapshot, self.meta(n).snapshot if self.exists(n) else 0)
            self._write({n: (meta, copy.read(n))})


@dataclass
class View:
    """An updatable view: a table or another view, a condition, and whose conditions new rows have to meet: none, its own
    (LOCAL), or those of the views below too (CASCADED)."""

    database: Database
    source: str | View
    predicate: str = "true"
    option: str | None = None

    def table(self) -> str:
        return self.source if isinstance(self.source, str) else self.source.table()

    def where(self) -> str:
        """All conditions down to the table."""
        below = "true" if isinstance(self.source, str) else self.source.where()
        return f"({self.predicate}) AND ({below})"

    def required(self, forced: bool = False) -> list[str]:
        own = [self.predicate] if forced or self.option else []
        below = [] if isinstance(self.source, str) else self.source.required(forced or (self.option or "").upper() == "CASCADED")
        return [*own, *below]

    def read(self) -> DataFrame:
        return self.database.read(self.table()).where(self.where())

    def _check(self, rows: DataFrame) -> None:
        for predicate in self.required():
            if not rows.where(~F.coalesce(F.expr(predicate), F.lit(False))).isEmpty():
                raise ConstraintError(f"CHECK OPTION: {predicate}")

    def insert(self, rows: DataFrame) -> DataFrame:
        self._check(rows)
        return self.database.insert(self.table(), rows)

    def update(self, sets: dict[str, str], where: str = "true") -> DataFrame:
        table, names = self.table(), self.database.read(self.table()).columns
        self.database.views()
        hit = f"({where}) AND {self.where()}"
        after = self.database.spark.sql(f"SELECT {', '.join(f'({sets[c]}) AS `{c}`' if c in sets else f'`{c}`' for c in names)} FROM {table} WHERE {hit}")
        self._check(after)
        return self.database.update(table, sets, hit)

    def delete(self, where: str = "true") -> DataFrame:
        return self.database.delete(self.table(), f"({where}) AND {self.where()}")
