"""Scalar, collection, text, JSON and HTML functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import arrays, dates, hashing, jsons, maths, session, strings, text
from lodestar.plans.catalogue.registry import query, same
from lodestar.session import Tables

B = "bigint"


@query("fn_string_1", r"""SELECT p_partkey, length(p_name)::BIGINT AS len, octet_length(encode(p_name))::BIGINT AS bytes, upper(p_name) AS up, lower(p_brand) AS low, p_name || '/' || p_brand AS cat,
substr(p_name, 3, 4) AS sub, trim('  ' || p_brand || ' ') AS tr, ltrim('  ' || p_brand) AS lt, rtrim(p_brand || '  ') AS rt, instr(p_name, 'a')::BIGINT AS pos FROM part""")
def fn_string_1(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.length("p_name").cast(B).alias("len"), F.octet_length("p_name").cast(B).alias("bytes"), F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.concat("p_name", F.lit("/"), "p_brand").alias("cat"),
        strings.substring("p_name", 3, 4).alias("sub"), strings.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("tr"), strings.ltrim(F.concat(F.lit("  "), "p_brand")).alias("lt"), strings.rtrim(F.concat("p_brand", F.lit("  "))).alias("rt"), F.instr("p_name", "a").cast(B).alias("pos"),
    )


@query("fn_string_2", r"""SELECT p_partkey, lpad(p_brand, 14, '*') AS lp, rpad(p_brand, 4, '*') AS rp, reverse(p_name) AS rev, left(p_name, 5) AS le, right(p_name, 5) AS ri, replace(p_name, 'a', '__') AS rep,
chr(65 + p_size % 26) AS ch, ascii(p_name)::BIGINT AS code, repeat('ab', p_size % 4) AS rpt, concat_ws('-', p_brand, NULL, p_type) AS ws, printf('%.2f', p_retailprice) AS fmt FROM part""")
def fn_string_2(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.lpad("p_brand", 14, "*").alias("lp"), F.rpad("p_brand", 4, "*").alias("rp"), F.reverse("p_name").alias("rev"), strings.left("p_name", 5).alias("le"), strings.right("p_name", 5).alias("ri"), F.replace("p_name", F.lit("a"), F.lit("__")).alias("rep"),
        strings.char(65 + F.col("p_size") % 26).alias("ch"), strings.unicode("p_name").cast(B).alias("code"), F.repeat(F.lit("ab"), F.col("p_size") % 4).alias("rpt"), F.concat_ws("-", "p_brand", F.lit(None).cast("string"), "p_type").alias("ws"), strings.format_number("p_retailprice", 2).alias("fmt"),
    )


@query("fn_string_3", r"""SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '#', 'g') AS rx, regexp_extract(p_brand, '([0-9]+)', 1) AS num, len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT AS vowels,
split_part(p_type, ' ', 2) AS second, len(string_split(p_type, ' '))::BIGINT AS words, starts_with(p_type, 'PROMO') AS promo, ends_with(p_type, 'BRASS') AS brass, contains(p_name, 'ee') AS ee,
levenshtein(p_name, p_type)::BIGINT AS lev, translate(p_brand, 'Brand', 'bRAND') AS tl, p_brand = reverse(p_brand) AS pal FROM part""")
def fn_string_3(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.regexp_replace("p_name", "[aeiou]+", "#").alias("rx"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.regexp_count("p_name", F.lit("[aeiou]")).cast(B).alias("vowels"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("second"), F.size(F.split("p_type", " ")).cast(B).alias("words"),
        F.startswith("p_type", F.lit("PROMO")).alias("promo"), F.endswith("p_type", F.lit("BRASS")).alias("brass"), F.contains("p_name", F.lit("ee")).alias("ee"), F.levenshtein("p_name", "p_type").cast(B).alias("lev"), F.translate("p_brand", "Brand", "bRAND").alias("tl"), (F.col("p_brand") == F.reverse("p_brand")).alias("pal"),
    )


@query("fn_string_cases", r"""SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS snake, lower(replace(p_type, ' ', '-')) AS kebab, upper(replace(p_type, ' ', '_')) AS const, lower(replace(p_type, ' ', '.')) AS dot,
trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(p_name[1]) || substr(p_name, 2) AS cap, upper(p_type[1]) || lower(substr(p_type, 2)) AS sent FROM part""")
def fn_string_cases(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.snake_case("p_type").alias("snake"), strings.kebab_case("p_type").alias("kebab"), strings.constant_case("p_type").alias("const"), strings.dot_case("p_type").alias("dot"), strings.slugify("p_brand").alias("slug"), strings.capitalize("p_name").alias("cap"), strings.sentence_case("p_type").alias("sent"))


@query("fn_string_checks", r"""SELECT c_custkey, regexp_full_match(c_mktsegment, '[A-Za-z]+') AS alpha, regexp_full_match(c_custkey::VARCHAR, '[0-9]+') AS num, c_mktsegment = upper(c_mktsegment) AS up, regexp_full_match(c_name, '[\x00-\x7F]*') AS asc,
CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN c_custkey || 'th' WHEN c_custkey % 10 = 1 THEN c_custkey || 'st' WHEN c_custkey % 10 = 2 THEN c_custkey || 'nd' WHEN c_custkey % 10 = 3 THEN c_custkey || 'rd' ELSE c_custkey || 'th' END AS ord FROM customer""")
def fn_string_checks(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", strings.is_("alpha", "c_mktsegment").alias("alpha"), strings.is_("numeric", F.col("c_custkey").cast("string")).alias("num"), strings.is_("upper", "c_mktsegment").alias("up"), strings.is_("ascii", "c_name").alias("asc"), strings.ordinal("c_custkey").alias("ord"))


@query("fn_string_spans", r"""SELECT s_suppkey, lpad('', ((30 - length(s_name)) // 2)::INT, ' ') || s_name || lpad('', (30 - length(s_name) - (30 - length(s_name)) // 2)::INT, ' ') AS mid,
replace(s_name, 'Supplier#', '') AS bare, (length(s_name) - instr(reverse(s_name), '0'))::BIGINT AS last0, regexp_replace(s_name, '[[:punct:]]', '', 'g') AS plain FROM supplier""")
def fn_string_spans(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", strings.center("s_name", 30).alias("mid"), strings.trim_prefix("s_name", "Supplier#").alias("bare"), strings.last_index_of("s_name", "0").cast(B).alias("last0"), strings.strip_punctuation("s_name").alias("plain"))


@query("fn_math_1", r"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(l_discount - 0.05) AS ab, round(l_extendedprice)::BIGINT AS ro, round(l_extendedprice, 1) AS ro1, ceil(l_extendedprice)::BIGINT AS ce, floor(l_extendedprice)::BIGINT AS fl,
(l_orderkey % 7)::BIGINT AS mo, pow(l_linenumber, 2)::DOUBLE AS po, sqrt(l_quantity) AS sq, sign(l_discount - 0.05)::BIGINT AS si, round(ln(l_quantity), 10) AS ln, round(log10(l_quantity), 10) AS lg, round(exp(l_discount), 10) AS ex, trunc(l_extendedprice)::BIGINT AS tr FROM lineitem""")
def fn_math_1(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.abs(c("l_discount") - 0.05).alias("ab"), maths.round_("l_extendedprice").alias("ro"), maths.round_("l_extendedprice", 1).alias("ro1"), F.ceil("l_extendedprice").cast(B).alias("ce"), F.floor("l_extendedprice").cast(B).alias("fl"),
        maths.mod("l_orderkey", F.lit(7)).cast(B).alias("mo"), F.pow(c("l_linenumber"), 2).alias("po"), F.sqrt("l_quantity").alias("sq"), maths.sign(c("l_discount") - 0.05).cast(B).alias("si"), F.round(F.log("l_quantity"), 10).alias("ln"), F.round(F.log10("l_quantity"), 10).alias("lg"), F.round(F.exp("l_discount"), 10).alias("ex"), maths.truncate("l_extendedprice").alias("tr"),
    )


@query("fn_math_2", r"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(tan(l_discount), 9) AS t, round(asin(l_discount), 9) AS as_, CASE WHEN l_linenumber <= 1 THEN round(acos(CASE WHEN l_linenumber <= 1 THEN l_linenumber ELSE 0 END), 9) END AS ac,
round(atan(l_quantity), 9) AS at, round(atan2(l_quantity, l_tax), 9) AS at2, round(degrees(l_discount), 9) AS dg, round(radians(l_quantity), 9) AS rd, round(cot(l_quantity), 6) AS co, pi() AS pi,
gcd(l_orderkey, l_partkey)::BIGINT AS g, greatest(least(l_quantity, 40), 10) AS cl FROM lineitem""")
def fn_math_2(t: Tables) -> DataFrame:
    r = lambda x, n=9: F.round(x, n)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(F.sin("l_quantity")).alias("s"), r(F.cos("l_quantity")).alias("c"), r(F.tan("l_discount")).alias("t"), r(maths.asin("l_discount")).alias("as_"), r(maths.acos("l_linenumber")).alias("ac"), r(F.atan("l_quantity")).alias("at"), r(F.atan2("l_quantity", "l_tax")).alias("at2"),
        r(F.degrees("l_discount")).alias("dg"), r(F.radians("l_quantity")).alias("rd"), r(maths.cot("l_quantity"), 6).alias("co"), F.pi().alias("pi"), maths.gcd("l_orderkey", "l_partkey").alias("g"), maths.clamp("l_quantity", 10.0, 40.0).alias("cl"),
    )


@query("fn_math_integers", r"""SELECT p_partkey, lcm(p_partkey, p_size)::BIGINT AS l, factorial(p_size % 15)::BIGINT AS f FROM part""")
def fn_math_integers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", maths.lcm("p_partkey", "p_size").alias("l"), F.factorial(F.col("p_size") % 15).alias("f"))


@query("fn_math_primes", """WITH odd AS (SELECT range AS d FROM range(2, (SELECT ceil(sqrt(max(p_partkey)))::BIGINT + 2 FROM part)))
SELECT p_partkey, p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM odd WHERE d * d <= p_partkey AND p_partkey % d = 0) AS prime FROM part""")
def fn_primes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", maths.is_prime("p_partkey").alias("prime"))


@query("fn_date_1", r"""SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, hour(o_orderdate)::BIGINT AS h, quarter(o_orderdate)::BIGINT AS q, week(o_orderdate)::BIGINT AS w, dayofyear(o_orderdate)::BIGINT AS doy,
(dayofweek(o_orderdate) + 1)::BIGINT AS dow, dayofweek(o_orderdate)::BIGINT AS wd, last_day(o_orderdate) AS ld, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, yearweek(o_orderdate)::BIGINT AS yw FROM orders""")
def fn_date_1(t: Tables) -> DataFrame:
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey", F.year(d).cast(B).alias("y"), F.month(d).cast(B).alias("m"), F.dayofmonth(d).cast(B).alias("d"), F.hour(d).cast(B).alias("h"), F.quarter(d).cast(B).alias("q"), F.weekofyear(d).cast(B).alias("w"), F.dayofyear(d).cast(B).alias("doy"), F.dayofweek(d).cast(B).alias("dow"),
        dates.weekday(d).cast(B).alias("wd"), F.last_day(d).alias("ld"), dates.day_name(d).alias("dn"), dates.month_name(d).alias("mn"), dates.year_week(d).cast(B).alias("yw"),
    )


@query("fn_date_2", r"""SELECT o_orderkey, o_orderdate::DATE + 40 AS plus, o_orderdate::DATE - 7 AS minus, date_diff('day', DATE '1995-06-17', o_orderdate::DATE)::BIGINT AS dd, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS f, epoch(o_orderdate)::BIGINT AS u, epoch(o_orderdate) / 86400 + 2440587.5 AS jd,
((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 6)::BIGINT AS tm, (year(o_orderdate) - 1995)::BIGINT AS ty, floor(abs(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 3600)::BIGINT AS th, strftime(o_orderdate, '%H:%M:%S') AS ti FROM orders""")
def fn_date_2(t: Tables) -> DataFrame:
    d, base = F.col("o_orderdate"), F.lit("1995-06-17").cast("date")
    return t.orders.select(
        "o_orderkey", F.date_add(d, 40).alias("plus"), F.date_sub(d, 7).alias("minus"), F.datediff(d, base).cast(B).alias("dd"), dates.strftime(d, "%Y/%m/%d %H:%M:%S").alias("f"), F.unix_timestamp(d.cast("timestamp")).alias("u"), dates.julian_day(d).alias("jd"),
        dates.timestamp_diff("MONTH", base, d).alias("tm"), dates.timestamp_diff("YEAR", base, d).alias("ty"), dates.timestamp_diff("HOUR", F.lit("1995-01-01"), d).alias("th"), dates.time(d).alias("ti"),
    )


@query("fn_date_3", r"""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS som, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 3 DAY)::DATE AS mod, make_date(year(o_orderdate), 1, 1) + (dayofyear(o_orderdate) - 1)::INT AS md, strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y')::DATE AS st,
printf('%02d:%02d:%02d', o_orderkey % 86400 // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) AS s2t, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528)::BIGINT AS td, o_orderdate::DATE AS fd, dayofweek(o_orderdate) IN (0, 6) AS we, day(last_day(o_orderdate))::BIGINT AS dim FROM orders""")
def fn_date_3(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.to_date(dates.start_of("month", d)).alias("som"), F.to_date(dates.modify(d, "start of month", "+1 month", "+3 days")).alias("mod"), dates.make_date(F.year(d), F.dayofyear(d)).alias("md"), F.to_date(dates.str_to_date(dates.strftime(d, "%d-%m-%Y"), "%d-%m-%Y")).alias("st"),
        dates.seconds_to_time(F.col("o_orderkey") % 86400).alias("s2t"), dates.to_days(d).cast(B).alias("td"), dates.from_days(dates.to_days(d)).alias("fd"), dates.is_weekend(d).alias("we"), dates.days_in_month(d).cast(B).alias("dim"),
    )


same("fn_cond", """SELECT c_custkey, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, coalesce(NULLIF(c_nationkey, 4), -1) AS n, ifnull(NULLIF(c_mktsegment, 'BUILDING'), 'x') AS i,
CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS k FROM customer""", "customer")


@query("fn_hash_encode", r"""SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, lower(hex(encode(c_name))) AS hx, to_base64(encode(c_name)) AS b64, decode(unhex(hex(encode(c_name)))) AS back, lower(to_base(c_custkey, 2)) AS bin FROM customer""")
def fn_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.md5("c_name").alias("m"), hashing.sha("c_name", 1).alias("s1"), hashing.sha("c_name", 256).alias("s2"), hashing.hex_("c_name").alias("hx"), hashing.base64("c_name").alias("b64"), F.decode(hashing.unhex(F.hex("c_name")), "UTF-8").alias("back"), hashing.to_base("c_custkey", 2).alias("bin"))


@query("fn_hash_python")
def fn_hash_python(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.sha2("s_name", 512).alias("s5"), F.crc32("s_name").alias("crc"), hashing.digest("sha3_256", "s_name").alias("s3"), hashing.digest("hmac_sha256", "s_name", "key").alias("hm"), F.decode(hashing.packed("gunzip", hashing.packed("gzip", "s_name")), "UTF-8").alias("gz"), hashing.base64_url("s_name").alias("bu"))


@query("fn_json_read", r"""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, json_type(props::JSON) AS ty, json_array_length('[1,2,3]'::JSON)::BIGINT AS al, json_valid(props) AS ok, json_exists(props::JSON, '$.zzz') AS has, '["k"]' AS ks FROM events""")
def fn_json_read(t: Tables) -> DataFrame:
    return t.events.select("event_id", jsons.extract("props", "$.k").cast(B).alias("k"), jsons.type_of("props").alias("ty"), jsons.length(F.lit("[1,2,3]")).cast(B).alias("al"), jsons.valid("props").alias("ok"), jsons.has("props", "$.zzz").alias("has"), jsons.keys("props").alias("ks"))


@query("fn_json_write", r"""SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS o, '["' || event_type || '","x"]' AS a, '"' || event_type || '"' AS q, event_type AS u FROM events""")
def fn_json_write(t: Tables) -> DataFrame:
    return t.events.select("event_id", jsons.object_(id=F.col("event_id"), type=F.col("event_type")).alias("o"), jsons.array(F.col("event_type"), F.lit("x")).alias("a"), jsons.quote("event_type").alias("q"), jsons.unquote(jsons.quote("event_type")).alias("u"))


@query("fn_json_edit", r"""SELECT event_id, '{"a":{"b":1},"k":' || (props::JSON ->> '$.k') || '}' AS s, '{"k":0}' AS r, '{}' AS d, '{"k":' || (props::JSON ->> '$.k') || ',"z":2}' AS p, TRUE AS c FROM events""")
def fn_json_edit(t: Tables) -> DataFrame:
    return t.events.select("event_id", jsons.set_("props", "$.a.b", 1).alias("s"), jsons.replace("props", "$.k", 0).alias("r"), jsons.remove("props", "$.k").alias("d"), jsons.merge_patch("props", F.lit('{"z": 2, "y": null}')).alias("p"), jsons.contains("props", F.lit("{}")).alias("c"))


@query("fn_array", r"""SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS s, list_max(embedding) AS hi, list_min(embedding) AS lo, embedding[1] AS f, embedding[64] AS l, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS nn,
len(list_filter(embedding, lambda x: x > 0))::BIGINT AS pos, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 2)), 6) AS dbl, list_sort([label, 3, 1, 3]::INT[]) AS srt, list_distinct([1, 1])[1]::INT AS uq FROM embeddings""")
def fn_array(t: Tables) -> DataFrame:
    e = "embedding"
    return t.embeddings.select(
        "vec_id", F.size(e).cast(B).alias("n"), F.round(arrays.reduce(e, "sum"), 6).alias("s"), F.array_max(e).alias("hi"), F.array_min(e).alias("lo"), F.element_at(e, 1).alias("f"), F.element_at(e, -1).alias("l"), F.round(arrays.dot(e, e), 6).alias("nn"), F.size(F.filter(e, lambda x: x > 0)).cast(B).alias("pos"),
        F.round(arrays.reduce(F.transform(e, lambda x: x.cast("double") * 2), "sum"), 6).alias("dbl"), F.array_sort(F.array(F.col("label"), F.lit(3), F.lit(1), F.lit(3))).alias("srt"), F.element_at(F.array_distinct(F.array(F.lit(1), F.lit(1))), 1).alias("uq"),
    )


@query("fn_map", r"""SELECT event_id, map_keys(m) AS k, map_values(m) AS v, m['t'] AS t FROM (SELECT event_id, MAP {'t': event_type, 'u': user_id::VARCHAR} AS m FROM events)""")
def fn_map(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("t"), "event_type", F.lit("u"), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.map_keys(m).alias("k"), F.map_values(m).alias("v"), F.element_at(m, "t").alias("t"))


@query("fn_geo", r"""SELECT s_suppkey, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (SELECT s_suppkey, pow(sin(radians(50.0 - la) / 2), 2) + cos(radians(la)) * cos(radians(50.0)) * pow(sin(radians(8.0 - lo) / 2), 2) AS h FROM (SELECT s_suppkey, (s_suppkey % 90)::DOUBLE AS la, (s_suppkey * 7 % 180)::DOUBLE AS lo FROM supplier))""")
def fn_geo(t: Tables) -> DataFrame:
    at = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 90).cast("double").alias("la"), (F.col("s_suppkey") * 7 % 180).cast("double").alias("lo"))
    return at.select("s_suppkey", F.round(maths.haversine_km("la", "lo", F.lit(50.0), F.lit(8.0)), 4).alias("km"))


@query("fn_typeof", """SELECT c_custkey, 'integer' AS a, 'real' AS b, 'text' AS c FROM customer""")
def fn_typeof(t: Tables) -> DataFrame:
    kind = lambda c: session.type_name(c, t.customer)
    return t.customer.select("c_custkey", kind("c_custkey").alias("a"), kind("c_acctbal").alias("b"), kind("c_name").alias("c"))


# Text
_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"


@query("txt_word_freq", f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOK}) AS word FROM documents) GROUP BY word")
def txt_freq(t: Tables) -> DataFrame:
    return text.word_frequency(t.documents, "text")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("txt_keywords", f"""SELECT doc_id, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(word)) AS place FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS word FROM documents)
WHERE word NOT IN ({_STOP}) AND length(word) > 2 GROUP BY doc_id, word)) WHERE place <= 3""")
def txt_keywords(t: Tables) -> DataFrame:
    return text.keywords(t.documents, "doc_id", "text", 3)


@query("txt_ngrams", f"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT {_TOK} AS w FROM documents)) GROUP BY gram HAVING count(*) > 3""")
def txt_ngrams(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(text.ngrams("text", 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 3")


@query("txt_jaccard", f"""SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS j FROM (SELECT a.conv_id AS a, b.conv_id AS b, list_distinct({_TOK.replace('text', 'a.text')}) AS x, list_distinct({_TOK.replace('text', 'b.text')}) AS y
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)""")
def txt_jaccard(t: Tables) -> DataFrame:
    c = t.conversations
    pairs = c.where("turn = 0").select(F.col("conv_id").alias("a"), F.col("text").alias("x")).join(c.where("turn = 1").select(F.col("conv_id").alias("b"), F.col("text").alias("y")), F.col("a") == F.col("b"))
    return pairs.select("a", "b", F.round(text.jaccard("x", "y"), 6).alias("j"))


_BARE = r"regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
_ENT = f"regexp_replace({_BARE}, '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&#34;", '"'), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _ENT = f"replace({_ENT}, '{_e}', '{_c}')"


@query("html_text", rf"SELECT page_id, trim(regexp_replace({_ENT}, '\s+', ' ', 'g')) AS body, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_text("html").alias("body"), text.html_title("html").alias("title"))


@query("html_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*\shref="([^"]*)"', 1)) AS link FROM pages""")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(text.html_links("html")).alias("link"))


@query("url_parts", r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    p = text.url_parts("url")
    return t.pages.select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"))
