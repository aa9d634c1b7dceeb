"""Full-text search, events and streams, mutable tables, user-defined functions, files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import STOP_WORDS
from lodestar.operators.fulltext import Index
from lodestar.plans.catalogue.registry import query, same
from lodestar.plans.engine import Engine
from lodestar.sources import delimited
from lodestar.sources.tables import ConstraintError, Database, Foreign, View
from lodestar.session import Tables, shared_dir
from lodestar.streaming import events as ev


def scratch(t: Tables, name: str) -> str:
    """A folder of this run in the folder that the cluster shares."""
    return f"{shared_dir(t.spark)}/lodestar/{name}-{uuid.uuid4().hex}"


# Full text
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FTS = rf"""WITH tk AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY doc_id, term), d AS (SELECT doc_id, count(*) AS len FROM tk GROUP BY doc_id), t AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS mean)"""


@query("fts_and", _FTS + " SELECT doc_id AS doc, sum(tf)::BIGINT AS tf FROM p WHERE term IN ('anin', 'thor') GROUP BY doc_id HAVING count(*) = 2")
def fts_and(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text").search("anin thor")


@query("fts_or", _FTS + " SELECT doc_id AS doc, sum(tf)::BIGINT AS tf FROM p WHERE term IN ('anin', 'thor') GROUP BY doc_id")
def fts_or(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text").search("anin OR thor")


@query("fts_not", _FTS + " SELECT doc_id AS doc, tf FROM p WHERE term = 'thor' AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'anin')")
def fts_not(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text").search("thor NOT anin")


@query("fts_bm25", _FTS + """, f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('anin', 'thor') GROUP BY term)
SELECT doc_id AS doc, round(sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM p JOIN f USING (term) JOIN d USING (doc_id), t GROUP BY doc_id""")
def fts_bm25(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text").rank("anin OR thor").select("doc", F.round("score", 6).alias("score"))


@query("fts_tfidf", _FTS + """, f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('anin', 'thor') GROUP BY term)
SELECT doc_id AS doc, round(sum(ln(n / df) * tf / len), 6) AS score FROM p JOIN f USING (term) JOIN d USING (doc_id), t GROUP BY doc_id""")
def fts_tfidf(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text").rank("anin OR thor", "tfidf").select("doc", F.round("score", 6).alias("score"))


@query("fts_stats", _FTS + " SELECT (SELECT count(*) FROM documents) AS docs, round((SELECT mean FROM t), 6) AS mean_length, (SELECT count(DISTINCT term) FROM p) AS terms")
def fts_stats(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text").stats().select("docs", F.round("mean_length", 6).alias("mean_length"), "terms")


_STEM = "CASE WHEN strlen(term) <= 3 THEN term " + " ".join(f"WHEN ends_with(term, '{s}') AND strlen(term) >= {len(s) + 2} THEN left(term, length(term) - {len(s)})" for s in ("ation", "ition", "ness", "ment", "able", "ible", "ous", "ive", "ly", "ed", "ing", "es", "s")) + " ELSE term END"


@query("fts_porter", _FTS.split(",\np AS")[0] + f", st AS (SELECT doc_id, {_STEM} AS term FROM tk) SELECT doc_id AS doc, count(*)::DOUBLE AS score FROM st WHERE term IN ('word', 'thing') GROUP BY doc_id")
def fts_porter(t: Tables) -> DataFrame:
    return Index.build(t.documents, "doc_id", "text", stem=True).rank("wording OR things", "frequency")


# Events
@query("ev_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ev_tumbling(t: Tables) -> DataFrame:
    out = ev.windowed(ev.with_event_time(t.events, "ts"), "ts", "1 hour", None, ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("ev_sliding", """SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS w FROM events) GROUP BY w""")
def ev_sliding(t: Tables) -> DataFrame:
    out = ev.windowed(ev.with_event_time(t.events, "ts"), "ts", "1 hour", "15 minutes", [], F.count("*").alias("n"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("ev_session", """SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def ev_session(t: Tables) -> DataFrame:
    out = ev.sessions(ev.with_event_time(t.events, "ts"), "ts", "30 minutes", ["user_id"], F.count("*").alias("n"))
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("ev_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def ev_dedup(t: Tables) -> DataFrame:
    return ev.deduplicated(t.events.select("user_id", "event_type"), ["user_id", "event_type"])


@query("ev_rate_limit_fixed_window", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY ALL")
def ev_rate(t: Tables) -> DataFrame:
    out = ev.rate_limited(ev.with_event_time(t.events, "ts"), "ts", "user_id", "1 day", 3)
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "over")


@query("ev_token_bucket")
def ev_bucket(t: Tables) -> DataFrame:
    return ev.token_bucket(t.events, "user_id", "ts", "event_id", 3.0, 1 / 86400)


@query("ev_stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def ev_stream(t: Tables) -> DataFrame:
    stream = ev.with_event_time(ev.read_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema), "ts", "1 hour")
    out = ev.run_available(ev.windowed(stream, "ts", "1 hour", None, [], F.count("*").alias("n")), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("ev_stream_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def ev_stream_dedup(t: Tables) -> DataFrame:
    stream = ev.with_event_time(ev.read_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema), "ts", "60 days")
    return ev.run_available(ev.deduplicated(stream, ["event_id"]).select("event_id", "user_id"))


# Mutable tables
_CUST = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"


def _accounts(t: Tables) -> Database:
    db = Database(t.spark, scratch(t, "tables"))
    db.create("accounts", "id bigint, name string, balance double, tag string", primary=["id"], not_null=["name"], checks={"sane": "balance > -100000"}, defaults={"tag": "'new'"})
    db.insert("accounts", t.sql(_CUST, "customer"))
    return db


@query("dml_insert_upsert", f"SELECT id, name, CASE WHEN id <= 50 THEN balance + 10 ELSE balance END AS balance, CASE WHEN id <= 50 THEN 'seen' ELSE 'new' END AS tag FROM ({_CUST}) UNION ALL SELECT 1000000 + id, 'added', 1.5, 'new' FROM ({_CUST}) WHERE id <= 5")
def dml_upsert(t: Tables) -> DataFrame:
    db = _accounts(t)
    new = t.sql(f"SELECT id, name, 10.0D AS balance FROM ({_CUST}) WHERE id <= 50 UNION ALL SELECT 1000000 + id, 'added', 1.5D FROM ({_CUST}) WHERE id <= 5", "customer")
    db.insert("accounts", new, "UPDATE", update={"balance": "t.balance + excluded.balance", "tag": "'seen'"})
    return db.read("accounts")


@query("dml_insert_nothing", f"SELECT id, name, balance, 'new' AS tag FROM ({_CUST}) UNION ALL SELECT 2000000, 'x', 0.0, 'new'")
def dml_nothing(t: Tables) -> DataFrame:
    db = _accounts(t)
    db.insert("accounts", t.spark.sql("SELECT * FROM VALUES (5L, 'again', 0.0D), (2000000L, 'x', 0.0D) AS v(id, name, balance)"), "NOTHING")
    return db.read("accounts")


@query("dml_update", f"SELECT id, name, CASE WHEN balance < 1000 THEN balance * 2 ELSE balance END AS balance, CASE WHEN balance < 1000 THEN 'low' ELSE 'new' END AS tag FROM ({_CUST})")
def dml_update(t: Tables) -> DataFrame:
    db = _accounts(t)
    db.update("accounts", {"balance": "balance * 2", "tag": "'low'"}, "balance < 1000")
    return db.read("accounts")


@query("dml_returning", f"SELECT id, balance FROM ({_CUST}) WHERE id % 10 = 0")
def dml_returning(t: Tables) -> DataFrame:
    return _accounts(t).delete("accounts", "id % 10 = 0").select("id", "balance")


@query("dml_delete_cascade", "SELECT r_regionkey::BIGINT AS region, NULL::BIGINT AS nation FROM region WHERE r_regionkey <> 1 UNION ALL SELECT NULL, n_nationkey FROM nation WHERE n_regionkey <> 1")
def dml_cascade(t: Tables) -> DataFrame:
    db = Database(t.spark, scratch(t, "tables"))
    db.create("regions", "id bigint, name string", primary=["id"])
    db.create("nations", "id bigint, name string, region bigint", primary=["id"], foreign=[Foreign(["region"], "regions", ["id"], "CASCADE")])
    db.insert("regions", t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    db.insert("nations", t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    db.delete("regions", "id = 1")
    none = F.lit(None).cast("bigint")
    return db.read("regions").select(F.col("id").alias("region"), none.alias("nation")).unionByName(db.read("nations").select(none.alias("region"), F.col("id").alias("nation")))


@query("dml_rollback", f"SELECT id, name FROM ({_CUST})")
def dml_rollback(t: Tables) -> DataFrame:
    db = _accounts(t)
    db.begin()
    db.delete("accounts", "id > 10")
    db.rollback()
    return db.read("accounts").select("id", "name")


@query("check_violation_report", "SELECT 'CHECK' AS kind, 'size' AS detail, count(*) AS n FROM part WHERE NOT (p_size < 40) HAVING count(*) > 0")
def check_report(t: Tables) -> DataFrame:
    db = Database(t.spark, scratch(t, "tables"))
    db.create("parts", "p_partkey bigint, p_size int", primary=["p_partkey"], checks={"size": "p_size < 40"})
    return db.violations("parts", t.part.select("p_partkey", "p_size"))


@query("fk_violation_report", "SELECT 'FOREIGN KEY' AS kind, 'n_regionkey' AS detail, count(*) AS n FROM nation WHERE n_regionkey >= 3")
def fk_report(t: Tables) -> DataFrame:
    db = Database(t.spark, scratch(t, "tables"))
    db.create("regions", "id int", primary=["id"])
    db.insert("regions", t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("id")))
    db.create("nations", "n_nationkey int, n_regionkey int", foreign=[Foreign(["n_regionkey"], "regions", ["id"])])
    return db.violations("nations", t.nation.select("n_nationkey", "n_regionkey"))


# User-defined functions
@query("udf_sql", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN round(o_totalprice * 0.9, 4) ELSE o_totalprice END AS net FROM orders")
def udf_sql(t: Tables) -> DataFrame:
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rebate(price DOUBLE, rate DOUBLE DEFAULT 0.1) RETURNS DOUBLE RETURN CASE WHEN price > 100000 THEN round(price * (1 - rate), 4) ELSE price END")
    return t.sql("SELECT o_orderkey, rebate(o_totalprice) AS net FROM orders", "orders")


@query("udf_python", "SELECT p_partkey, length(p_name) % 7 + p_size AS v FROM part")
def udf_python(t: Tables) -> DataFrame:
    @F.pandas_udf("bigint")
    def mix(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str.len() % 7 + size

    return t.part.select("p_partkey", mix("p_name", "p_size").alias("v"))


@query("udaf_pandas", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wavg, round(exp(sum(ln(l_quantity)) / count(*)), 6) AS gmean FROM lineitem GROUP BY l_returnflag")
def udaf_pandas(t: Tables) -> DataFrame:
    """Aggregates of one's own, in two mergeable steps: each batch yields partial states, which a grouped function joins."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows = rows.assign(a=rows["l_extendedprice"] * rows["l_quantity"], b=rows["l_quantity"], c=np.log(rows["l_quantity"]), n=1.0)
            yield rows.groupby("l_returnflag", as_index=False)[["a", "b", "c", "n"]].sum()

    @F.pandas_udf("double")
    def wavg(a: pd.Series, b: pd.Series) -> float:
        return round(float(a.sum() / b.sum()), 4)

    @F.pandas_udf("double")
    def gmean(c: pd.Series, n: pd.Series) -> float:
        return round(float(np.exp(c.sum() / n.sum())), 6)

    states = t.lineitem.select("l_returnflag", "l_extendedprice", "l_quantity").mapInPandas(partial, "l_returnflag string, a double, b double, c double, n double")
    return states.groupBy("l_returnflag").agg(wavg("a", "b").alias("wavg"), gmean("c", "n").alias("gmean"))


@F.udtf(returnType="place int, word string")
class Words:
    """The words of a text with their places."""

    def eval(self, text: str):
        for i, word in enumerate((text or "").split(" ")):
            yield i, word


@query("udtf_split", "SELECT p_partkey, (i - 1)::INT AS place, w[i] AS word FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part))")
def udtf_split(t: Tables) -> DataFrame:
    t.spark.udtf.register("words_of", Words)
    return t.sql("SELECT p_partkey, x.place, x.word FROM part, LATERAL words_of(p_type) x", "part")


# Statements
def _engine(t: Tables, *setup: str) -> Engine:
    engine = Engine(t.spark, scratch(t, "engine"))
    for s in setup:
        engine.sql(s)
    return engine


_ACC = "CREATE TABLE accounts (id BIGINT PRIMARY KEY, name VARCHAR(50) NOT NULL, balance DOUBLE CHECK (balance > -100000), tag TEXT DEFAULT 'new')"


def _filled(t: Tables, *more: str) -> Engine:
    engine = _engine(t, _ACC, *more)
    engine.db.insert("accounts", t.sql(_CUST, "customer"))
    return engine


@query("sql_insert_duplicate_key", f"SELECT id, name, balance + CASE WHEN id < 3 THEN 5 ELSE 0 END AS balance, CASE WHEN id < 3 THEN 'dup' ELSE 'new' END AS tag FROM ({_CUST})")
def sql_duplicate(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.sql("INSERT INTO accounts (id, name, balance) SELECT id, 'x', 5 FROM accounts WHERE id < 3 ON DUPLICATE KEY UPDATE balance = balance + VALUES(balance), tag = 'dup'")
    return engine.sql("SELECT * FROM accounts")


@query("sql_update_returning", f"SELECT id, balance * 2 AS twice FROM ({_CUST}) WHERE balance < (SELECT avg(balance) FROM ({_CUST}))")
def sql_update(t: Tables) -> DataFrame:
    return _filled(t).sql("UPDATE accounts SET balance = balance * 2 WHERE balance < (SELECT avg(balance) FROM accounts) RETURNING id, balance AS twice")


@query("sql_insert_returning", "SELECT (1000000 + n_nationkey)::BIGINT AS id, upper(n_name) AS big FROM nation")
def sql_insert_returning(t: Tables) -> DataFrame:
    engine = _filled(t)
    rows = ", ".join(f"({1000000 + r['n_nationkey']}, '{r['n_name']}', 0)" for r in t.nation.collect())
    return engine.sql(f"INSERT INTO accounts (id, name, balance) VALUES {rows} RETURNING id, upper(name) AS big")


@query("sql_with_delete", f"WITH c AS ({_CUST}) SELECT id, name FROM c WHERE id NOT IN (SELECT id FROM c WHERE balance > 5000)")
def sql_with_delete(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.sql("WITH rich AS (SELECT id AS k FROM accounts WHERE balance > 5000) DELETE FROM accounts WHERE id IN (SELECT k FROM rich)")
    return engine.sql("SELECT id, name FROM accounts")


@query("sql_with_update", f"SELECT id, CASE WHEN balance > 5000 THEN 'rich' ELSE 'new' END AS tag FROM ({_CUST}) UNION ALL SELECT 1000000 + r_regionkey, 'added' FROM region")
def sql_with_update(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.sql("WITH rich AS (SELECT id AS k FROM accounts WHERE balance > 5000) UPDATE accounts SET tag = 'rich' WHERE id IN (SELECT k FROM rich)")
    engine.sql("WITH five AS (SELECT explode(sequence(0, 4)) AS i) INSERT INTO accounts (id, name, tag) SELECT 1000000 + i, 'r', 'added' FROM five")
    return engine.sql("SELECT id, tag FROM accounts")


@query("sql_truncate", "SELECT 0::BIGINT AS n")
def sql_truncate(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.sql("TRUNCATE TABLE accounts")
    return engine.sql("SELECT count(*) AS n FROM accounts")


_REG = ("CREATE TABLE regions (id BIGINT PRIMARY KEY, name TEXT)", "CREATE TABLE nations (id BIGINT PRIMARY KEY, name TEXT, region BIGINT REFERENCES regions(id) ON DELETE {d} ON UPDATE {u})",
        "CREATE TABLE shops (id BIGINT PRIMARY KEY, nation BIGINT, FOREIGN KEY (nation) REFERENCES nations(id) ON DELETE {d} ON UPDATE {u})")


def _geography(t: Tables, on_delete: str, on_update: str) -> Engine:
    engine = _engine(t, *(s.format(d=on_delete, u=on_update) for s in _REG))
    engine.db.insert("regions", t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    engine.db.insert("nations", t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    engine.db.insert("shops", t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))
    return engine


@query("fk_delete_levels", "SELECT s_suppkey::BIGINT AS id, s_nationkey::BIGINT AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1")
def fk_levels(t: Tables) -> DataFrame:
    engine = _geography(t, "CASCADE", "RESTRICT")
    engine.sql("DELETE FROM regions WHERE id = 1")
    return engine.sql("SELECT id, nation FROM shops")


@query("fk_delete_set_null", "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END::BIGINT AS region FROM nation")
def fk_set_null(t: Tables) -> DataFrame:
    engine = _geography(t, "SET NULL", "RESTRICT")
    engine.sql("DELETE FROM regions WHERE id = 1")
    return engine.sql("SELECT id, region FROM nations")


@query("fk_update_cascade", "SELECT s_suppkey::BIGINT AS id, (s_nationkey + 100)::BIGINT AS nation FROM supplier UNION ALL SELECT NULL, n_regionkey + 50 FROM nation")
def fk_update(t: Tables) -> DataFrame:
    engine = _geography(t, "CASCADE", "CASCADE")
    engine.sql("UPDATE nations SET id = id + 100")
    engine.sql("UPDATE regions SET id = id + 50")
    return engine.sql("SELECT id, nation FROM shops UNION ALL SELECT NULL, region FROM nations")


@query("fk_restrict", "SELECT 2::BIGINT AS refused, (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS nations")
def fk_restrict(t: Tables) -> DataFrame:
    engine, refused = _geography(t, "NO ACTION", "RESTRICT"), 0
    for s in ("DELETE FROM regions WHERE id = 2", "UPDATE regions SET id = 9 WHERE id = 2"):
        try:
            engine.sql(s)
        except ConstraintError:
            refused += 1
    return engine.sql(f"SELECT CAST({refused} AS BIGINT) AS refused, (SELECT count(*) FROM regions) AS regions, (SELECT count(*) FROM nations) AS nations")


@query("tx_savepoint", f"SELECT count(*) AS n, sum(CASE WHEN id < 10 THEN 1 ELSE 0 END)::BIGINT AS low FROM ({_CUST}) WHERE id <> 1")
def tx_savepoint(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.run("BEGIN; DELETE FROM accounts WHERE id = 1; SAVEPOINT a; DELETE FROM accounts WHERE id < 10; ROLLBACK TO SAVEPOINT a; SAVEPOINT b; RELEASE SAVEPOINT b; COMMIT")
    return engine.sql("SELECT count(*) AS n, sum(CASE WHEN id < 10 THEN 1 ELSE 0 END) AS low FROM accounts")


@query("vacuum_backup", f"SELECT 'accounts' AS \"table\", count(*) AS rows, TRUE AS same FROM ({_CUST})")
def vacuum_backup(t: Tables) -> DataFrame:
    engine, copy = _filled(t), scratch(t, "backup")
    engine.sql("UPDATE accounts SET balance = balance + 1")
    engine.db.backup(copy)
    engine.sql("VACUUM")
    engine.sql("DELETE FROM accounts WHERE id > 5")
    engine.db.restore(copy)
    engine.sql(f"VACUUM INTO '{scratch(t, 'vacuum')}'")
    return engine.db.verify(copy)


@query("analyze_table", f"SELECT 'id' AS \"column\", count(*) AS rows, 0::BIGINT AS nulls, min(id)::VARCHAR AS least, max(id)::VARCHAR AS greatest FROM ({_CUST})")
def analyze_table(t: Tables) -> DataFrame:
    return _filled(t).sql("ANALYZE accounts").where(F.col("column") == "id").select("column", "rows", "nulls", "least", "greatest")


@query("ddl_alter", f"SELECT id, name AS title, trunc(balance)::BIGINT AS balance, 'x' AS note, 7::BIGINT AS extra FROM ({_CUST}) WHERE id <> 1")
def ddl_alter(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.run("ALTER TABLE accounts ADD COLUMN note TEXT DEFAULT 'x'; ALTER TABLE accounts RENAME COLUMN name TO title; ALTER TABLE accounts MODIFY COLUMN balance BIGINT; ALTER TABLE accounts DROP COLUMN tag; ALTER TABLE accounts ADD extra BIGINT DEFAULT 7; ALTER TABLE accounts RENAME TO people")
    engine.run("ALTER TABLE people ADD CONSTRAINT short CHECK (length(note) < 9); DELETE FROM people WHERE id = 1; ALTER TABLE people DROP CONSTRAINT short; CREATE TEMP TABLE gone (a INT); DROP TABLE gone; DROP TABLE IF EXISTS gone")
    return engine.sql("SELECT * FROM people")


@query("ddl_constraints", "SELECT 'NOT NULL' AS kind UNION ALL SELECT 'UNIQUE' UNION ALL SELECT 'CHECK' UNION ALL SELECT 'UNIQUE'")
def ddl_constraints(t: Tables) -> DataFrame:
    engine, kinds = _filled(t, "CREATE UNIQUE INDEX by_name ON accounts(name)", "CREATE INDEX by_tag ON accounts(tag)"), []
    for values in ("(-1, NULL, 0)", "(5, 'other', 0)", "(-2, 'low', -200000)", f"(-3, '{t.customer.where('c_custkey = 7').first()['c_name']}', 0)"):
        try:
            engine.sql(f"INSERT INTO accounts (id, name, balance) VALUES {values}")
        except ConstraintError as broken:
            kinds.append((str(broken).split(" (")[0],))
    engine.run("DROP INDEX by_tag; DROP INDEX by_name; INSERT INTO accounts (id, name) SELECT -4, name FROM accounts WHERE id = 7")
    return t.spark.createDataFrame(kinds, "kind string")


@query("ddl_sequence", "SELECT n_name AS name, row_number() OVER () > 0 AS numbered, (SELECT count(*) FROM nation) AS last FROM nation")
def ddl_sequence(t: Tables) -> DataFrame:
    engine = _engine(t, "CREATE TABLE things (id INTEGER PRIMARY KEY AUTO_INCREMENT, name TEXT)")
    engine.db.insert("things", t.nation.select(F.col("n_name").alias("name")))
    return engine.sql("SELECT name, id BETWEEN 1 AND ROW_COUNT() AND CONNECTION_ID() = 1 AS numbered, LAST_INSERT_ID() AS last FROM things")


@query("view_check_option", f"SELECT id, balance FROM ({_CUST}) WHERE balance > 0 AND id < 50 UNION ALL SELECT -1, 7.0")
def view_check(t: Tables) -> DataFrame:
    engine = _filled(t)
    engine.run("CREATE VIEW plus AS SELECT * FROM accounts WHERE balance > 0; CREATE VIEW low AS SELECT * FROM plus WHERE id < 50 WITH CASCADED CHECK OPTION; CREATE OR REPLACE VIEW named (k, v) AS SELECT id, balance FROM accounts")
    for values in ("(60, 'far', 3)", "(-2, 'poor', -3)"):  # the first fails the view's own condition, the second the one below
        try:
            engine.sql(f"INSERT INTO low (id, name, balance) VALUES {values}")
        except ConstraintError:
            continue
        raise AssertionError(values)
    engine.sql("INSERT INTO low (id, name, balance) VALUES (-1, 'fits', 7)")
    engine.db.insert("accounts", t.spark.sql("SELECT -9L AS id, 'hidden' AS name, -1.0D AS balance"))
    local = View(engine.db, engine.views["plus"], "id < 50", "LOCAL")
    local.insert(t.spark.sql("SELECT -8L AS id, 'poor' AS name, -1.0D AS balance"))
    engine.sql("DELETE FROM low WHERE name = 'nobody'")
    return engine.sql("SELECT id, balance FROM low WHERE id IN (SELECT k FROM named)")


@query("trigger_audit", f"SELECT 'insert' AS event, count(*) AS n FROM ({_CUST}) UNION ALL SELECT 'delete', count(*) FROM ({_CUST}) WHERE id < 20")
def trigger_audit(t: Tables) -> DataFrame:
    engine = _engine(t, _ACC, "CREATE TABLE audit (event TEXT, n BIGINT)")
    engine.run("CREATE TRIGGER a AFTER INSERT ON accounts FOR EACH STATEMENT BEGIN INSERT INTO audit (event, n) SELECT 'insert', count(*) FROM inserted; END; CREATE TRIGGER b AFTER DELETE ON accounts WHEN (OLD.id < 20) BEGIN INSERT INTO audit (event, n) SELECT 'delete', count(*) FROM deleted; END")
    engine.db.insert("accounts", t.sql(_CUST, "customer"))
    engine.sql("DELETE FROM accounts WHERE id < 30")
    engine.sql("DROP TRIGGER b")
    engine.sql("DELETE FROM accounts WHERE id >= 30")
    return engine.sql("SELECT event, n FROM audit")


@query("sql_function_block", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN round(o_totalprice * 0.8, 2) WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice + 1 END AS v FROM orders")
def sql_function(t: Tables) -> DataFrame:
    engine = _engine(t, "CREATE OR REPLACE FUNCTION net(price DOUBLE, state TEXT, rate DOUBLE DEFAULT 0.2) RETURNS DOUBLE BEGIN LET off = price * rate; IF price > 200000 THEN RETURN round(price - off, 2); IF state = 'F' THEN RETURN 0; RETURN price + 1; END")
    t.views("orders")
    return engine.sql("SELECT o_orderkey, net(o_totalprice, o_orderstatus) AS v FROM orders")


@query("fts_match", _FTS.replace("FROM documents),", "FROM (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT -1, 'thor anin')),", 1).replace("(SELECT count(*) FROM documents)", "(SELECT count(DISTINCT doc_id) FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT -1))")
       + """, f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('anin', 'thor') GROUP BY term), b AS (SELECT doc_id FROM p WHERE term IN ('anin', 'thor') GROUP BY doc_id HAVING count(*) = 2)
SELECT doc_id AS id, round(sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM p JOIN f USING (term) JOIN d USING (doc_id) JOIN b USING (doc_id), t GROUP BY doc_id""")
def fts_match(t: Tables) -> DataFrame:
    """An index that rows leave and enter, searched by MATCH and scored by RANK."""
    engine = _engine(t, "CREATE TABLE texts (id BIGINT PRIMARY KEY, body TEXT)")
    engine.db.insert("texts", t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body")))
    engine.run("CREATE FTS INDEX words ON texts (body) TOKENIZER simple; DELETE FROM texts WHERE id % 3 = 0; INSERT INTO texts (id, body) VALUES (-1, 'thor x'); UPDATE texts SET body = 'thor anin' WHERE id = -1")
    return engine.sql("SELECT id, round(RANK, 5) AS score FROM texts WHERE texts MATCH 'anin thor'")


@query("catalog_sources", "SELECT 'accounts' AS name, 'table' AS kind UNION ALL SELECT 'rich', 'view' UNION ALL SELECT 'id', 'PRI' UNION ALL SELECT 'name', '' UNION ALL SELECT 'balance', '' UNION ALL SELECT 'tag', '' UNION ALL SELECT 'plan', 'ok'")
def catalog_sources(t: Tables) -> DataFrame:
    engine = _engine(t, _ACC, "CREATE VIEW rich AS SELECT * FROM accounts WHERE balance > 5000")
    plan = engine.sql("EXPLAIN QUERY PLAN SELECT count(*) FROM rich").where("id > parent")
    ok = plan.agg(F.lit("plan").alias("name"), F.when(F.count("*") > 1, "ok").otherwise("short").alias("kind"))
    return engine.sql("SHOW TABLES").unionByName(engine.sql("DESCRIBE accounts").select(F.col("field").alias("name"), F.col("key").alias("kind"))).unionByName(ok)


# Streams with late rows
@query("ev_stream_late", """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, ts, event_id % 10 AS turn FROM events)
SELECT w AS window_start, count(*) AS n FROM e, (SELECT max(ts) FILTER (WHERE turn > 1) - INTERVAL 1 HOUR AS first, max(ts) - INTERVAL 1 HOUR AS last FROM e)
WHERE (turn > 0 OR w + INTERVAL 1 HOUR > first) AND w + INTERVAL 1 HOUR <= last GROUP BY w""")
def ev_late(t: Tables) -> DataFrame:
    """Append mode over three files.  A batch drops rows whose window the watermark of the batch before the last had passed, so the
    third file loses its late rows; windows that are still open at the end don't come out."""
    path = scratch(t, "late")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in ("event_id % 10 > 1", "event_id % 10 = 1", "event_id % 10 = 0"):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = ev.with_event_time(t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", "1 hour")
    out = ev.run_available(ev.windowed(stream, "ts", "1 hour", None, [], F.count("*").alias("n")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


# Files
@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path, rows = scratch(t, "csv"), t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    delimited.write(rows, path, delimiter="|", null="\\N")
    return delimited.read(t.spark, path, rows.schema, delimiter="|", null="\\N")


@query("json_round_trip", "SELECT * FROM nation")
def json_round_trip(t: Tables) -> DataFrame:
    path = scratch(t, "json")
    t.nation.write.json(path)
    return t.spark.read.schema(t.nation.schema).json(path)


@query("orc_round_trip", "SELECT * FROM supplier")
def orc_round_trip(t: Tables) -> DataFrame:
    path = scratch(t, "orc")
    t.supplier.write.orc(path)
    return t.spark.read.orc(path)


@query("load_data", "SELECT r_regionkey, r_name FROM region")
def load_data(t: Tables) -> DataFrame:
    path = scratch(t, "lines")
    lines = t.spark.range(1).select(F.lit("key;name").alias("value")).unionByName(t.region.select(F.concat(F.col("r_regionkey").cast("string"), F.lit(";"), "r_name").alias("value"))).coalesce(1)
    lines.write.text(path)
    return delimited.load_data(t.spark, path, t.region.schema, "FIELDS TERMINATED BY ';' IGNORE 1 ROWS (r_regionkey, r_name)")


@query("conversation_turns", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def conversation_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(w.orderBy("turn")).alias("before"), F.count("*").over(w).alias("turns"))


same("labels_left", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "documents", "labels")
