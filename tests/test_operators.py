"""Operators on small relations, with the edge cases that the driver's tables lack."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrays, dates, jsons, maths, strings
from lodestar.operators import joins, relational
from lodestar.operators.fulltext import Index
from lodestar.plans.catalogue import QUERIES, SQL
from lodestar.plans.dialect import rewrite, run_script, run_sql, split_statements
from lodestar.plans.engine import Engine
from lodestar.sources import delimited
from lodestar.sources.tables import ConstraintError, Database, Foreign, View

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,), (None,)], "v int"), spark.createDataFrame([(2,), (2,), (3,), (3,), (4,), (4,), (None,)], "w int")
    values = lambda df: sorted([r[0] for r in df.collect()], key=lambda x: (x is None, x))
    assert values(relational.set_operation(a, b, "INTERSECT", True)) == [2, 2, 3, 3, None]
    assert values(relational.set_operation(a, b, "INTERSECT")) == [2, 3, None]
    assert values(relational.set_operation(a, b, "EXCEPT", True)) == [1, 3]
    assert values(relational.set_operation(a, b, "EXCEPT")) == [1]
    assert values(relational.set_operation(a, b, "UNION")) == [1, 2, 3, 4, None]
    with pytest.raises(ValueError):
        relational.set_operation(a, b.withColumn("x", F.lit(1)), "UNION")


@pytest.mark.parametrize("comparison", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
@pytest.mark.parametrize("values", [[], [2], [1, 3], [2, None], [None]])
def test_quantified(spark, comparison, quantifier, values):
    def holds(x):
        outcomes = [None if x is None or v is None else {"=": x == v, "<>": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[comparison] for v in values]
        return any(o is True for o in outcomes) if quantifier == "ANY" else all(o is True for o in outcomes)

    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    got = joins.quantified(left, F.col("x"), comparison, quantifier, spark.createDataFrame([(v,) for v in values], "v int"))
    assert {r[0] for r in got.collect()} == {x for x in (1, 2, 3, None) if holds(x)}


def test_asof_without_match_and_ties(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP '2024-01-01 10:00:00'), (2, 'a', TIMESTAMP '2024-01-03 00:00:00'), (3, 'b', TIMESTAMP '2024-01-01 00:00:00') AS t(id, k, ts)")
    right = spark.sql("SELECT * FROM VALUES (7, 'a', TIMESTAMP '2024-01-01 10:00:00'), (8, 'a', TIMESTAMP '2024-01-02 10:00:00') AS t(id, k, ts)")
    assert {r["id"]: r["r_id"] for r in joins.asof(left, right, "ts", "ts", ["k"]).collect()} == {1: 7, 2: 8, 3: None}
    assert {r["id"]: r["r_id"] for r in joins.asof(left, right, "ts", "ts").collect()} == {1: 7, 2: 8, 3: None}


def test_interval_and_salted(spark):
    points, ranges = spark.range(20).select(F.col("id").cast("double").alias("x")), spark.createDataFrame([("a", 0.0, 4.5), ("b", 4.0, 12.0)], "n string, lo double, hi double")
    got = joins.interval_join(points, ranges, "x", "lo", "hi", 3.0)
    assert got.count() == sum((0 <= x <= 4.5) + (4 <= x <= 12) for x in range(20))
    large, small = spark.createDataFrame([("h",)] * 50 + [("c",)], "k string"), spark.createDataFrame([("h", 1), ("z", 2)], "k string, v int")
    assert joins.salted(large, small, "k", 4).count() == 50
    assert joins.salted(large, small, "k", 4, "left").count() == 51


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_grouped_join_is_the_join(spark, how, null_safe):
    left = spark.createDataFrame([(1, "a")] * 3 + [(1, "b"), (2, "c"), (None, "d"), (None, "d"), (4, None)], "k int, v string")
    right = spark.range(5000).select(F.lit(1).cast("long").alias("k2"), F.col("id").alias("w")).union(spark.sql("VALUES (2L, -1L), (2L, -1L), (NULL, -2L), (9L, NULL)"))
    on = left.k.eqNullSafe(right.k2) if null_safe else left.k == right.k2
    got = joins.grouped(left, right, [("k", "k2")], how, null_safe)
    assert got.columns == ["k", "v", "k2", "w"]
    assert got.exceptAll(left.join(right, on, how)).count() == 0 and got.count() == left.join(right, on, how).count()


def test_join_full_holds_no_key_whole(spark):
    plan = _plan(QUERIES["join_full"](spark, SF))
    assert "FullOuter" not in plan and "REPARTITION_BY_NUM" in plan


def test_join_using_deals_each_key(spark):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES["join_using"](spark, SF))


def test_join_null_safe_deals_each_key(spark):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES["join_null_safe"](spark, SF))


def test_minmax_by_takes_the_first_of_equal_prices(spark, tmp_path):
    rows = [(1, 7, 5.0), (2, 7, 5.0), (3, 7, None), (4, 8, 2.0), (5, 8, 1.0), (6, 8, 1.0), (7, 8, 2.0), (8, 9, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in QUERIES["agg_minmax_by"](spark, str(tmp_path)).collect()}
    assert got == set(duckdb.sql(SQL["agg_minmax_by"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()) == {(7, 1, 1), (8, 4, 5), (9, None, None)}


def test_text_index_writes_only_what_changes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.sql("CREATE TABLE texts (id BIGINT PRIMARY KEY, body TEXT)")
    engine.db.insert("texts", spark.range(20).select("id", F.concat(F.lit("word number w"), "id").alias("body")))
    engine.run("CREATE FTS INDEX words ON texts (body) TOKENIZER simple; UPDATE texts SET body = 'other' WHERE id = 3; DELETE FROM texts WHERE id = 4")
    found = lambda word: sorted(r[0] for r in engine.sql(f"SELECT id FROM texts WHERE texts MATCH '{word}'").collect())
    stored = lambda: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema("term string").parquet(f"{tmp_path}/_fts").where("term IS NOT NULL").count()
    assert stored() == 61
    assert found("other") == [3] and found("number") == [i for i in range(20) if i not in (3, 4)]
    engine.run("DELETE FROM texts WHERE id > 9; INSERT INTO texts (id, body) VALUES (4, 'word again')")  # half has changed
    assert found("word") == [0, 1, 2, 4, 5, 6, 7, 8, 9] and found("again") == [4]
    assert engine.searches["words"]["index"].changes < 2


def test_percentiles_gather_no_group(spark):
    assert "percentile(" not in _plan(QUERIES["agg_percentile"](spark, SF))
    rows = [("a", float(i % 7) ** 3) for i in range(50)] + [("b", 4.0)] * 3 + [("c", None), (None, 1.0), (None, 2.0), ("d", float("inf")), ("d", 1.0), ("d", 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = relational.percentiles(df, ["g"], "v", lo=0.0, q=0.3, mid=0.5)
    want = df.groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in (("lo", 0.0), ("q", 0.3), ("mid", 0.5))))
    plain = lambda x: {r[0]: [y if y is None else round(y, 9) for y in r[1:]] for r in x.collect()}
    assert plain(got) == plain(want)


def test_fixpoint_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    to = edges.select(F.col("a").alias("m"), F.col("b").alias("c"))
    assert relational.fixpoint(edges, lambda new: new.join(to, new.b == to.m).select("a", "c")).count() == 9


def test_dialect(spark):
    assert "OFFSET 5" in rewrite("SELECT 1 LIMIT 5, 7")
    assert rewrite("SELECT 'LIMIT 1, 2', \"GLOB\" -- IIF(\n") == "SELECT 'LIMIT 1, 2', \"GLOB\" \n"
    assert split_statements("SELECT ';' ; -- a;b\nSELECT 2;") == ["SELECT ';'", "SELECT 2"]
    spark.createDataFrame([(1, "abc"), (2, "xbz"), (3, None)], "id int, s string").createOrReplaceTempView("dt")
    ids = lambda q: [r[0] for r in run_sql(spark, q).collect()]
    assert ids("SELECT id FROM dt WHERE s GLOB '[!x]b*'") == [1]
    assert ids("SELECT id FROM dt WHERE id <= ALL (SELECT id FROM dt)") == [1]
    assert ids("SELECT id FROM dt WHERE id > ANY (SELECT id FROM dt) ORDER BY id") == [2, 3]
    assert ids("SELECT id FROM dt WHERE id > ALL (SELECT id FROM dt WHERE id > 9) ORDER BY id") == [1, 2, 3]
    assert ids("SELECT IIF(id > 1, 'b', 'a') FROM dt ORDER BY id") == ["a", "b", "b"]
    assert ids("SELECT TRUNCATE(-2.57, 1)") == [-2.5]
    assert [r["name"] for r in run_sql(spark, "PRAGMA table_info(dt)").collect()] == ["id", "s"]
    assert len(run_script(spark, "SELECT 1; SELECT 2")) == 2


def test_strings(spark):
    assert one(spark, strings.glob(F.lit("a.c"), "a?c"), strings.glob(F.lit("abcd"), "a*[!x]"), strings.glob(F.lit("a]"), "a[]]")) == (True, True, True)
    assert one(spark, strings.soundex(F.lit("Robert")), strings.soundex(F.lit("Rupert")), strings.soundex(F.lit("")), strings.difference(F.lit("Robert"), F.lit("Rupert"))) == ("R163", "R163", "0000", 4)
    assert one(spark, strings.camel_case(F.lit("some text-here")), strings.pascal_case(F.lit("someText")), strings.snake_case(F.lit("someText v2"))) == ("someTextHere", "SomeText", "some_text_v2")
    assert one(spark, strings.roman(F.lit(1994)), strings.ordinal(F.lit(112)), strings.ordinal(F.lit(23))) == ("MCMXCIV", "112th", "23rd")
    assert one(spark, strings.last_index_of(F.lit("abcabc"), "bc"), strings.last_index_of(F.lit("x"), "y"), strings.center(F.lit("ab"), 5, "*")) == (4, -1, "*ab**")
    assert one(spark, strings.is_("credit_card", F.lit("4539 1488 0343 6467")), strings.is_("json", F.lit("{")), strings.is_("email", F.lit("a@b.co"))) == (True, False, True)
    assert one(spark, strings.unescape_html(strings.escape_html(F.lit("<a href='x'>&</a>"))), strings.char(72, 105)) == ("<a href='x'>&</a>", "Hi")
    assert one(spark, strings.format_bytes(F.lit(1536)), strings.is_palindrome(F.lit("A man, a plan, a canal: Panama")), strings.rot(F.lit("Hello"))) == ("1.50 KB", True, "Uryyb")


def test_maths(spark):
    assert one(spark, maths.truncate(F.lit(-2.567), 2), maths.truncate(F.lit(-2.9)), maths.round_(F.lit(-2.5)), maths.mod(F.lit(-7), F.lit(3))) == (-2.56, -2, -3, -1)
    assert one(spark, maths.gcd(F.lit(84), F.lit(-36)), maths.lcm(F.lit(4), F.lit(6)), maths.is_prime(F.lit(97)), maths.is_prime(F.lit(91)), maths.fibonacci(F.lit(10)), maths.binomial(F.lit(5), F.lit(2))) == (12, 12, True, False, 55, 10)
    assert one(spark, maths.acos(F.lit(2.0)), maths.asin(F.lit(2.0))) == (None, None)
    assert abs(one(spark, maths.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)))[0] - 343.6) < 1


def test_dates(spark):
    d = F.lit("2024-12-30 13:04:05").cast("timestamp")
    assert one(spark, dates.year_week(d), dates.weekday(d), dates.day_name(d), dates.strftime(d, "%Y-%m-%dT%H:%M:%S"), dates.julian_day(F.lit("2024-01-01 12:00:00")))[:4] == (202501, 1, "Monday", "2024-12-30T13:04:05")
    assert one(spark, dates.timestamp_diff("MONTH", F.lit("2024-01-31").cast("date"), F.lit("2024-02-01").cast("date")), dates.timestamp_diff("DAY", F.lit("2024-01-01"), F.lit("2024-01-02 23:00:00")), dates.time_to_seconds(dates.seconds_to_time(F.lit(3725)))) == (1, 1, 3725)
    assert str(one(spark, dates.modify(d, "start of month", "+1 month", "-1 day"))[0]) == "2024-12-31 00:00:00"
    assert str(one(spark, dates.str_to_date(F.lit("05/03/2024"), "%d/%m/%Y"))[0]) == "2024-03-05 00:00:00"
    with pytest.raises(ValueError):
        dates.modify(d, "sideways")


def test_json(spark):
    j = F.lit('{"a": {"b": [1, 2]}, "c": "x"}')
    assert one(spark, jsons.extract(j, "$.a.b[1]"), jsons.extract(j, "$.c"), jsons.type_of(F.lit("[1]")), jsons.type_of(F.lit("nope")), jsons.length(j), jsons.keys(j)) == ("2", "x", "ARRAY", None, 2, '["a","c"]')
    assert one(spark, jsons.set_(j, "$.a.z", 3), jsons.replace(j, "$.zz", 1), jsons.remove(j, "$.a.b[0]"), jsons.merge_patch(j, F.lit('{"c": null, "d": 1}'))) == (
        '{"a":{"b":[1,2],"z":3},"c":"x"}', '{"a":{"b":[1,2]},"c":"x"}', '{"a":{"b":[2]},"c":"x"}', '{"a":{"b":[1,2]},"d":1}',
    )
    assert one(spark, jsons.contains(j, F.lit('{"a": {"b": [2]}}')), jsons.contains(j, F.lit('{"a": 1}')), jsons.quote(F.lit('a"b')), jsons.unquote(F.lit('"q"'))) == (True, False, '"a\\"b"', "q")


def test_arrays(spark):
    a = F.array(*map(F.lit, [3, 1, 2, 5, 4]))
    got = one(spark, arrays.chunk(a, 2), arrays.windows(a, 3), arrays.rotate(a, 2), arrays.take_while(a, lambda x: x < 5), arrays.drop_while(a, lambda x: x < 5), arrays.median(a), arrays.variance(a), arrays.indices_of(a, F.lit(2)), arrays.reduce(a, "product"))
    assert got == ([[3, 1], [2, 5], [4]], [[3, 1, 2], [1, 2, 5], [2, 5, 4]], [2, 5, 4, 3, 1], [3, 1, 2], [5, 4], 3.0, 2.0, [2], 120.0)
    assert one(spark, arrays.intersperse(a, F.lit(0)), arrays.remove_at(a, 1), arrays.cosine(a, a)) == ([3, 0, 1, 0, 2, 0, 5, 0, 4], [3, 2, 5, 4], 1.0)


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "Go is a programming language"), (2, "apple banana cherry"), (3, "apple orange; the apple"), (4, None)], "id int, body string")
    index = Index.build(docs, "id", "body")
    ids = lambda q: sorted(r["doc"] for r in index.search(q).collect())
    assert ids("apple") == [2, 3] and ids("apple orange") == [3] and ids("apple NOT banana") == [3] and ids("go or cherry") == [1, 2] and ids("the") == []
    assert [r["doc"] for r in index.rank("apple", "frequency").orderBy(F.desc("score")).collect()] == [3, 2]
    assert Index.build(docs, "id", "body", stem=True).search("programmed").count() == 1


def test_tables(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create("parents", "id bigint, name string", primary=["id"], not_null=["name"], sequence="id")
    db.create("children", "id bigint, parent bigint, total double, twice double", primary=["id"], checks={"positive": "total > 0"}, generated={"twice": "total * 2"}, foreign=[Foreign(["parent"], "parents", ["id"], "SET NULL")])
    db.insert("parents", spark.createDataFrame([("a",), ("b",)], "name string"))
    assert db.last_insert_id == 2 and db.row_count == 2
    db.insert("children", spark.createDataFrame([(1, 1, 2.0), (2, 2, 3.0)], "id bigint, parent bigint, total double"))
    assert {r["twice"] for r in db.read("children").collect()} == {4.0, 6.0}
    for bad in ([(3, 9, 1.0)], [(1, 1, 1.0)], [(4, 1, -1.0)]):
        with pytest.raises(ConstraintError):
            db.insert("children", spark.createDataFrame(bad, "id bigint, parent bigint, total double"))
    with pytest.raises(ConstraintError):
        View(db, "children", "total < 10", "LOCAL").insert(spark.createDataFrame([(5, 1, 11.0)], "id bigint, parent bigint, total double"))
    seen = []
    db.on("parents", "AFTER", "DELETE", lambda rows: seen.append(rows.count()))
    db.begin()
    db.delete("parents", "id = 1")
    assert seen == [1] and db.read("children").where("parent is null").count() == 1
    db.rollback()
    assert db.read("parents").count() == 2 and db.read("children").where("parent is null").count() == 0
    db.update("children", {"total": "total + 1"}, "id = 1")
    assert db.read("children").where("id = 1").first()["twice"] == 6.0
    db.alter("parents", add={"note": "string"}, rename={"name": "title"})
    assert db.read("parents").columns == ["id", "title", "note"]
    db.truncate("children")
    assert db.read("children").isEmpty()


def test_files(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("id,name,active\n1,\"A, b\",yes\n2,,no\n3,\\N,maybe\n")
    schema = spark.createDataFrame([], "id bigint, name string, active boolean").schema
    got = [tuple(r) for r in delimited.read(spark, str(path), schema, null="\\N").orderBy("id").collect()]
    assert got == [(1, "A, b", True), (2, None, False), (3, None, False)]
    spark.createDataFrame([], schema).createOrReplaceTempView("copied")
    assert run_sql(spark, f"COPY copied FROM '{path}' WITH (FORMAT csv, HEADER true, NULL '\\N')").count() == 3


def test_digests_against_hashlib(spark):
    """What the oracle's engine has no function for."""
    import hashlib
    import hmac
    import zlib

    from lodestar.plans.catalogue import QUERIES

    for r in QUERIES["fn_hash_python"](spark, "/root/testdata/sf0.001").collect():
        name = r["gz"].encode()
        assert (r["s5"], r["s3"], r["hm"], r["crc"]) == (hashlib.sha512(name).hexdigest(), hashlib.sha3_256(name).hexdigest(), hmac.new(b"key", name, "sha256").hexdigest(), zlib.crc32(name))


def test_bad_packed_values_are_null(spark):
    from lodestar.functions import hashing

    assert one(spark, hashing.packed("gunzip", F.lit("no gzip")), hashing.text_code("unpunycode", F.lit("é")), hashing.decrypt(F.lit("AAAA"), "0123456789abcdef")) == (None, None, None)


def test_token_bucket_against_a_loop(spark):
    from lodestar.streaming import events as ev

    rows = [(i, i % 3, float(t)) for i, t in enumerate([0, 1, 2, 3, 3, 3, 4, 9, 9, 9, 9, 30, 30, 31, 31, 31, 31, 31, 31])]
    frame = spark.createDataFrame(rows, "id int, k int, at double").withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("bigint")))
    want, state = {}, {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        level, last = state.get(k, (2.0, None))
        level = 2.0 if last is None else min(2.0, level + (at - last) * 0.5)
        want[i] = level >= 1
        state[k] = (level - (level >= 1), at)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a key's history comes in several batches
    try:
        assert {r["id"]: r["allowed"] for r in ev.token_bucket(frame, "k", "at", "id", 2.0, 0.5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_engine_statements(spark, tmp_path):
    from lodestar.plans.engine import Engine

    e = Engine(spark, str(tmp_path / "engine"))
    e.run("""CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY, s VARCHAR(9) DEFAULT 'a;b', n INT CHECK (n >= 0), twice INT GENERATED ALWAYS AS (n * 2), UNIQUE (s, n));
    INSERT INTO t (id, n) VALUES (1, 1), (2, 2); -- two rows""")
    rows = lambda q: [tuple(r) for r in e.sql(q).collect()]
    assert rows("SELECT id, s, twice FROM t ORDER BY id") == [(1, "a;b", 2), (2, "a;b", 4)]
    assert rows("INSERT INTO t (id, s, n) VALUES (1, 'x', 7), (3, 'y', 3) ON CONFLICT (id) DO UPDATE SET n = t.n + excluded.n RETURNING id, n") in ([(1, 8), (3, 3)], [(3, 3), (1, 8)])
    assert rows("INSERT INTO t (id, s, n) VALUES (1, 'q', 0) ON CONFLICT DO NOTHING RETURNING id") == []
    assert rows("DELETE FROM t WHERE n IN (SELECT max(n) FROM t) RETURNING *") == [(1, "a;b", 8, 16)]
    for bad in ("INSERT INTO t (id, n) VALUES (2, 5)", "INSERT INTO t (id, n) VALUES (9, -1)", "INSERT INTO t (id, n) VALUES (9, 2)", "UPDATE t SET n = -5"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    for bad in ("DROP TABLE nothing", "SAVEPOINT a; RELEASE b", "SHOW weather", "ALTER TABLE t JUMP", "DROP INDEX nothing", "COMMIT"):
        with pytest.raises(ValueError):
            e.run(bad)
    e.db._saved = []
    e.run("BEGIN; CREATE TABLE u (a INT); UPDATE t SET s = 'z' WHERE id = 2; ROLLBACK")
    assert e.db.names() == ["t"] and rows("SELECT s FROM t WHERE id = 2") == [("a;b",)]
    e.run("CREATE TRIGGER g INSTEAD OF DELETE ON t BEGIN UPDATE t SET s = 'kept' WHERE id IN (SELECT id FROM deleted); END; DELETE FROM t WHERE id = 2")
    assert rows("SELECT id, s FROM t ORDER BY id") == [(2, "kept"), (3, "y")]
    e.run("CREATE TEMP TABLE w (a INT)")
    e.db.close()
    assert e.db.names() == ["t"]


def test_cascades_reach_a_table_that_refers_to_itself(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create("parts", "id bigint, whole bigint", primary=["id"], foreign=[Foreign(["whole"], "parts", ["id"], "CASCADE", "CASCADE")])
    db.insert("parts", spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "id bigint, whole bigint"))
    db.delete("parts", "id = 2")
    assert sorted(r["id"] for r in db.read("parts").collect()) == [1, 5]


def test_schedules_and_machines():
    import datetime as dt

    from lodestar.functions import rules

    start = dt.datetime(2024, 2, 28, 23, 50)
    assert rules.cron_next("*/15 0 29 2 *", start, 2) == [dt.datetime(2024, 2, 29, 0, 0), dt.datetime(2024, 2, 29, 0, 15)]
    assert rules.cron_next("0 9 * * 1-5", dt.datetime(2024, 3, 1, 9), 2) == [dt.datetime(2024, 3, 4, 9), dt.datetime(2024, 3, 5, 9)]
    for bad in ("* * *", "61 * * * *"):
        with pytest.raises(ValueError):
            rules.cron_fields(bad)


def test_documents_of_other_formats(spark):
    from lodestar.functions import formats

    assert one(spark, formats.yaml_parse(F.lit("a:\n  b: [1, 'x']\n  c: {d: true}\nl:\n- p: 1\n  q: null\n- two # note\n")), formats.yaml_parse(F.lit("a:\n    b: 1\n  c: 2")), formats.toml_parse(F.lit("= bad"))) == ('{"a":{"b":[1,"x"],"c":{"d":true}},"l":[{"p":1,"q":null},"two"]}', None, None)
    assert one(spark, formats.yaml_parse(formats.yaml_stringify(F.lit('{"a":{"b":[1,"x: y"]},"c":"true"}'))), formats.toml_parse(formats.toml_stringify(F.lit('{"a":{"b":[1,2]},"c":"q\\"t"}')))) == ('{"a":{"b":[1,"x: y"]},"c":"true"}', '{"a":{"b":[1,2]},"c":"q\\"t"}')
    joined = [formats.url_join(F.lit("http://h/a/b?q"), F.lit(p)) for p in ("c", "/c", "../c", "//g/x", "?z", "#f", "http://k/", ".")]
    assert one(spark, *joined) == ("http://h/a/c", "http://h/c", "http://h/c", "http://g/x", "http://h/a/b?z", "http://h/a/b?q#f", "http://k/", "http://h/a/")
