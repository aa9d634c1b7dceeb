"""Collections, texts, numbers, dates, documents, rules: the function library, row by row over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import arrays, dates, formats, hashing, jsons, maths, rules, strings, text
from lodestar.plans.catalogue.registry import query
from lodestar.session import Tables

B = "bigint"
_A = "[p_size, (p_partkey % 7)::INT, p_size % 5, 3, (p_partkey % 11)::INT]"
_PART = f"(SELECT p_partkey, p_size, p_name, p_type, p_brand, {_A} AS a, [p_size % 4, 3, 1] AS b, string_split(p_type, ' ') AS w FROM part)"


def _part(t: Tables) -> DataFrame:
    a = F.expr("array(p_size, cast(p_partkey % 7 as int), p_size % 5, 3, cast(p_partkey % 11 as int))")
    return t.part.select("p_partkey", "p_size", "p_name", "p_type", "p_brand", a.alias("a"), F.expr("array(p_size % 4, 3, 1)").alias("b"), F.split("p_type", " ").alias("w"))


def _json(**columns):
    """Collections as JSON text, which both engines write alike."""
    return [F.to_json(c).alias(k) for k, c in columns.items()]


@query("fn_array_build", f"""SELECT p_partkey, to_json(range(0, p_size % 5))::VARCHAR AS ra, to_json(range(10, p_size % 5, -3))::VARCHAR AS rs, to_json(list_append(a, 9))::VARCHAR AS pu, to_json(a[1:1] || [9] || a[2:])::VARCHAR AS ins,
to_json(list_filter(a, lambda x: x <> 3))::VARCHAR AS rem, to_json([7, 7, 7])::VARCHAR AS fi, to_json(a || a)::VARCHAR AS cy, to_json([0] || a)::VARCHAR AS pre, to_json(a || [0, 1])::VARCHAR AS app,
to_json([p_size, p_size * 2, p_size * 4])::VARCHAR AS it, to_json([a[4], a[2], a[3], a[1], a[5]])::VARCHAR AS sw, to_json([a[2], a[3], a[1], a[4], a[5]])::VARCHAR AS mo, to_json([a[1], 8, a[3], a[4], a[5]])::VARCHAR AS rep FROM {_PART}""")
def array_build(t: Tables) -> DataFrame:
    one = F.lit
    return _part(t).select("p_partkey", *_json(
        ra=arrays.range_(0, F.col("p_size") % 5), rs=arrays.range_(F.lit(10), F.col("p_size") % 5, -3), pu=F.array_append("a", one(9)), ins=arrays.insert_at("a", 1, one(9)), rem=arrays.remove_all("a", one(3)), fi=arrays.fill(one(7), 3), cy=arrays.cycle("a", 2),
        pre=arrays.prepend_all("a", one(0)), app=arrays.append_all("a", one(0), one(1)), it=arrays.iterate(F.col("p_size"), lambda x: x * 2, 3), sw=arrays.swap("a", 0, 3), mo=arrays.move("a", 0, 2), rep=arrays.replace_at("a", 1, one(8)),
    ))


@query("fn_array_search", f"""SELECT p_partkey, list_filter(a, lambda x: x > 10)[1] AS fi, (coalesce(list_position(list_transform(a, lambda x: x > 4), true), 0) - 1)::BIGINT AS ix,
(CASE WHEN list_bool_or(list_transform(a, lambda x: x > 4)) THEN list_max(list_filter([0, 1, 2, 3, 4], lambda i: a[i + 1] > 4)) ELSE -1 END)::BIGINT AS li, to_json(list_filter([0, 1, 2, 3, 4], lambda i: a[i + 1] = 3))::VARCHAR AS oc,
list_bool_and(list_transform(a, lambda x: x < 40)) AS ev, list_bool_or(list_transform(a, lambda x: x > 20)) AS so, to_json(a[:k - 1])::VARCHAR AS tw, to_json(a[k:])::VARCHAR AS dw, to_json(a[:2])::VARCHAR AS s1, to_json(a[3:])::VARCHAR AS s2,
a[1] AS f, a[5] AS l, a[2] AS n, to_json(a[2:])::VARCHAR AS rf, to_json(a[:4])::VARCHAR AS rl, to_json(a[:1] || a[3:])::VARCHAR AS ra, to_json(a[:g - 1])::VARCHAR AS br
FROM (SELECT *, coalesce(nullif(list_position(list_transform(a, lambda x: x >= 2), false), 0), 6) AS k, coalesce(nullif(list_position(list_transform(a, lambda x: x < 2), true), 0), 6) AS g FROM {_PART})""")
def array_search(t: Tables) -> DataFrame:
    big = lambda x: x > 4
    least = lambda x: x >= 2
    cut = arrays.split_at("a", 2)
    return _part(t).select(
        "p_partkey", arrays.find("a", lambda x: x > 10).alias("fi"), arrays.find_index("a", big).cast(B).alias("ix"), arrays.find_last_index("a", big).cast(B).alias("li"), arrays.every("a", lambda x: x < 40).alias("ev"), arrays.some("a", lambda x: x > 20).alias("so"),
        F.get("a", F.lit(0)).alias("f"), F.element_at("a", -1).alias("l"), F.get("a", F.lit(1)).alias("n"),
        *_json(oc=arrays.indices_of("a", F.lit(3)), tw=arrays.span("a", least)["yes"], dw=arrays.drop_while("a", least), s1=cut["yes"], s2=cut["no"], rf=arrays.drop("a", 1), rl=arrays.pop("a"), ra=arrays.remove_at("a", 1), br=arrays.break_list("a", lambda x: x < 2)["yes"]),
    )


@query("fn_array_sets", f"""SELECT p_partkey, to_json(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))))::VARCHAR AS di, to_json(list_sort(list_distinct(list_intersect(a, b))))::VARCHAR AS ii, to_json(list_sort(list_distinct(a || b)))::VARCHAR AS un,
to_json(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: y % 3), x % 3) = i))::VARCHAR AS ub, to_json(list_filter(a, lambda x: NOT list_contains(list_transform(b, lambda y: y % 3), x % 3)))::VARCHAR AS db,
to_json(list_filter(ib, lambda x, i: list_position(list_transform(ib, lambda y: y % 3), x % 3) = i))::VARCHAR AS ib, to_json(list_filter(a || b, lambda x, i: list_position(list_transform(a || b, lambda y: y % 3), x % 3) = i))::VARCHAR AS uu, to_json(list_filter(a, lambda x: x IS NOT NULL))::VARCHAR AS co
FROM (SELECT *, list_filter(a, lambda x: list_contains(list_transform(b, lambda y: y % 3), x % 3)) AS ib FROM {_PART})""")
def array_sets(t: Tables) -> DataFrame:
    third = lambda x: x % 3
    return _part(t).select("p_partkey", *_json(
        di=F.array_sort(arrays.difference("a", "b")), ii=F.array_sort(F.array_intersect("a", "b")), un=F.array_sort(F.array_union("a", "b")), ub=arrays.unique_by("a", third), db=arrays.difference_by("a", "b", third), ib=arrays.intersection_by("a", "b", third),
        uu=arrays.union_by("a", "b", third), co=arrays.compact_flat(F.array(F.slice("a", 1, 2), F.lit(None).cast("array<int>"), F.concat(F.array(F.lit(None).cast("int")), F.slice("a", 3, 3)))),
    ))


@query("fn_array_order", f"""SELECT p_partkey, to_json(list_sort(a))::VARCHAR AS so, to_json(list_reverse_sort(a))::VARCHAR AS sd, to_json(list_reverse_sort(a)[:2])::VARCHAR AS tn, to_json(list_sort(a)[:2])::VARCHAR AS bn, to_json(list_reverse(a))::VARCHAR AS rv,
to_json([[a[1], b[1]], [a[2], b[2]], [a[3], b[3]]])::VARCHAR AS tr, to_json([{{'a': a[1], 'b': b[1]}}, {{'a': a[2], 'b': b[2]}}, {{'a': a[3], 'b': b[3]}}])::VARCHAR AS zi, to_json(b)::VARCHAR AS uz, to_json(a || b)::VARCHAR AS fl,
to_json(list_sort(w))::VARCHAR AS sw, to_json([[], [b[1]], [b[2]], [b[1], b[2]], [b[3]], [b[1], b[3]], [b[2], b[3]], [b[1], b[2], b[3]]])::VARCHAR AS su, to_json(list_sort([[b[1], b[2], b[3]], [b[1], b[3], b[2]], [b[2], b[1], b[3]], [b[2], b[3], b[1]], [b[3], b[1], b[2]], [b[3], b[2], b[1]]]))::VARCHAR AS pe,
to_json(list_sort(a))::VARCHAR AS sh, 3::BIGINT AS sa FROM {_PART}""")
def array_order(t: Tables) -> DataFrame:
    return _part(t).select(
        "p_partkey", F.size(arrays.sample("a", 3)).cast(B).alias("sa"),
        *_json(so=arrays.sort("a"), sd=arrays.sort("a", True), tn=arrays.top_n("a", 2), bn=arrays.bottom_n("a", 2), rv=arrays.reverse("a"), tr=arrays.transpose(F.array("a", "b"))),
        *_json(zi=arrays.zip_("a", "b"), uz=arrays.unzip(arrays.zip_("a", "b"), "a", "b")["b"], fl=arrays.flatten(F.array("a", "b")), sw=arrays.sort("w"), su=arrays.subsequences("b"), pe=F.array_sort(arrays.permutations("b")), sh=F.array_sort(arrays.shuffled("a"))),
    )


@query("fn_array_shapes", f"""SELECT p_partkey, to_json([a[1:2], a[3:4], a[5:5]])::VARCHAR AS chunk, to_json([a[1:3], a[2:4], a[3:5]])::VARCHAR AS win, to_json([a[1:2], a[2:3], a[3:4], a[4:5]])::VARCHAR AS pairs, to_json(a[3:] || a[1:2])::VARCHAR AS rot,
to_json([a[1], 0, a[2], 0, a[3], 0, a[4], 0, a[5]])::VARCHAR AS mix, to_json(a || [0] || b)::VARCHAR AS cal, to_json(list_filter(a, lambda x: x > 4))::VARCHAR AS yes, to_json(list_filter(a, lambda x: x <= 4))::VARCHAR AS no, median(x.u)::DOUBLE AS med, round(var_pop(x.u), 8) AS var, round(stddev_pop(x.u), 8) AS sd,
max(len(list_filter(a, lambda y: y = 3)))::BIGINT AS threes, max(len(list_filter(a, lambda y: y % 2 = 0)))::BIGINT AS even, to_json([a[1:1], a[2:]])::VARCHAR AS cut, sum(x.u)::DOUBLE AS total, product(x.u)::DOUBLE AS prod, to_json([x.c for x in [{{'c': {{'x': p, 'y': q}}}} for p in b[:2] for q in [1]]])::VARCHAR AS xp
FROM {_PART}, LATERAL (SELECT unnest(a) AS u) x GROUP BY p_partkey, a, b""".replace("to_json([x.c for x in [{'c': {'x': p, 'y': q}} for p in b[:2] for q in [1]]])::VARCHAR AS xp", "to_json([{'x': b[1], 'y': 1}, {'x': b[2], 'y': 1}])::VARCHAR AS xp"))
def array_shapes(t: Tables) -> DataFrame:
    big = lambda x: x > 4
    first = lambda before, x: F.lit(True)
    runs = arrays.split_when("a", first)
    return _part(t).select(
        "p_partkey", arrays.median("a").alias("med"), F.round(arrays.variance("a"), 8).alias("var"), F.round(F.sqrt(arrays.variance("a")), 8).alias("sd"), F.element_at(arrays.count_by("a"), 3).cast(B).alias("threes"), F.coalesce(F.size(F.try_element_at(arrays.group_by("a", lambda x: x % 2), F.lit(0))), F.lit(0)).cast(B).alias("even"),
        arrays.reduce("a", "sum").alias("total"), arrays.reduce("a", "product").alias("prod"),
        *_json(chunk=arrays.chunk("a", 2), win=arrays.windows("a", 3), pairs=arrays.windows("a", 2), rot=arrays.rotate("a", 2), mix=arrays.intersperse("a", F.lit(0)), cal=arrays.intercalate(F.array("a", "b"), F.array(F.lit(0))), yes=arrays.partition("a", big)["yes"], no=arrays.partition("a", big)["no"]),
        *_json(cut=F.array(F.get(runs, F.lit(0)), F.flatten(F.slice(runs, 2, 9))), xp=arrays.product(F.slice("b", 1, 2), F.array(F.lit(1)))),
    )


@query("fn_map_pairs", """SELECT p_partkey, to_json(MAP {'brand': p_brand, 'type': p_type})::VARCHAR AS m, to_json([{'key': 'brand', 'value': p_brand}, {'key': 'type', 'value': p_type}])::VARCHAR AS pairs FROM part""")
def map_pairs(t: Tables) -> DataFrame:
    pairs = F.array(F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v")))
    m = arrays.from_pairs(pairs, "k", "v")
    return t.part.select("p_partkey", *_json(m=m, pairs=arrays.to_pairs(m)))


# Strings
@query("fn_string_cut", r"""SELECT p_partkey, to_json(CASE WHEN len(w) > 2 THEN [w[1], array_to_string(w[2:], ' ')] ELSE w END)::VARCHAR AS sn, to_json(CASE WHEN len(w) <= 2 THEN list_reverse(w) ELSE [array_to_string(w[:len(w) - 1], ' '), w[len(w)]] END)::VARCHAR AS rs, to_json(list_reverse(w))::VARCHAR AS rv, w[1] AS p1, array_to_string(w[2:], ' ') AS p3,
array_to_string(w[:len(w) - 1], ' ') AS r1, w[len(w)] AS r3, array_to_string(w, '+') AS jo, regexp_replace(p_name, 'a', 'A') AS r_first, regexp_replace(regexp_replace(p_name, 'a', 'A'), 'a', 'A') AS r_two, regexp_replace(p_type, 'brass', '*', 'gi') AS ric FROM (SELECT p_partkey, p_name, p_type, string_split(p_type, ' ') AS w FROM part)""")
def string_cut(t: Tables) -> DataFrame:
    one, last = strings.partition_at("p_type", " "), strings.rpartition_at("p_type", " ")
    return t.part.select(
        "p_partkey", *_json(sn=strings.split_n("p_type", " ", 2), rs=strings.rsplit("p_type", " ", 2), rv=strings.rsplit("p_type", " ")), F.get(one, F.lit(0)).alias("p1"), F.get(one, F.lit(2)).alias("p3"), F.get(last, F.lit(0)).alias("r1"), F.get(last, F.lit(2)).alias("r3"),
        strings.join(F.split("p_type", " "), "+").alias("jo"), strings.replace_first("p_name", "a", "A").alias("r_first"), strings.replace_n("p_name", "a", "A", 2).alias("r_two"), strings.replace_ignore_case("p_type", "brass", "*").alias("ric"),
    )


@query("fn_string_edit", r"""SELECT p_partkey, left(p_name, 2) || '++' || substr(p_name, 3) AS ins, left(p_name, 2) || substr(p_name, 6) AS del, left(p_name, 1) || 'XYZ' || substr(p_name, 5) AS ovr, '*' || p_name || '*' AS sur, '"' || p_brand || '"' AS quo, p_brand AS unq, p_brand AS unw,
left(repeat(p_brand, 3), 20) AS ru, p_brand || '~' || p_type AS pb, 'a' || chr(10) || 'b' || chr(10) || p_brand AS nl, length(p_name) = 0 AS em, url_encode(p_type) AS ue, p_type AS ud, '  ' || p_brand || chr(10) || '  x' AS ind, p_brand || chr(10) || ' x' AS ded,
rpad(p_brand, 12, '.') AS al, lpad(p_brand, 12, '.') AS ar, 'Brand ' || p_brand || ' no ' || p_partkey || ' {z}' AS te, p_name[1] AS ca, '&lt;' || p_brand || '&gt;' AS sa, 'Brand#' AS cp, 'x' AS cs, replace(p_type, ' ', chr(10)) AS ww, len(string_split(p_type, ' '))::BIGINT AS wc,
left(p_type, 3) || '...' AS tr, CASE WHEN contains(p_type, ' ') THEN string_split(p_type, ' ')[1] || '...' ELSE p_type END AS tw FROM part""")
def string_edit(t: Tables) -> DataFrame:
    c, s = F.col, strings
    crlf = F.concat(F.lit("a\r\nb\r"), "p_brand")
    return t.part.select(
        "p_partkey", s.insert("p_name", 2, "++").alias("ins"), s.delete("p_name", 2, 3).alias("del"), s.overwrite("p_name", 1, "XYZ").alias("ovr"), s.surround("p_name", "*").alias("sur"), s.quote("p_brand").alias("quo"), s.unquote(s.quote("p_brand")).alias("unq"), s.unwrap(F.concat(F.lit("("), "p_brand", F.lit(")")), "()").alias("unw"),
        s.repeat_until("p_brand", 20).alias("ru"), s.pad_between("p_brand", "p_type", "~").alias("pb"), s.normalize_newlines(crlf).alias("nl"), s.is_empty("p_name").alias("em"), s.escape_url("p_type").alias("ue"), s.unescape_url(s.escape_url("p_type")).alias("ud"), s.indent(F.concat("p_brand", F.lit("\nx"))).alias("ind"), s.dedent(F.concat(F.lit("  "), "p_brand", F.lit("\n   x"))).alias("ded"),
        s.align("p_brand", 12, "left", ".").alias("al"), s.align("p_brand", 12, "right", ".").alias("ar"), s.template("Brand {b} no {n} {z}", {"b": c("p_brand"), "n": c("p_partkey")}).alias("te"), F.substring("p_name", 1, 1).alias("ca"), s.sanitize(F.concat(F.lit("<\x01"), "p_brand", F.lit(">"))).alias("sa"),
        s.common_prefix("p_brand", F.lit("Brand#x")).alias("cp"), s.common_suffix(F.concat("p_brand", F.lit("-x")), F.concat(F.lit("q"), F.lit("x"))).alias("cs"), s.word_wrap("p_type", 1).alias("ww"), s.word_count("p_type").cast(B).alias("wc"), F.concat(F.left("p_type", F.lit(3)), F.lit("...")).alias("tr"), s.truncate_words("p_type", 1).alias("tw"),
    )


_WORDS = """list_transform(range(0, 1000), lambda n: trim((CASE WHEN n >= 100 THEN o[n // 100 + 1] || ' hundred ' ELSE '' END) || (CASE WHEN n % 100 < 20 THEN o[n % 100 + 1] ELSE te[n % 100 // 10 + 1] || (CASE WHEN n % 10 > 0 THEN '-' || o[n % 10 + 1] ELSE '' END) END)))"""


@query("fn_number_texts", f"""WITH words AS (SELECT {_WORDS} AS w FROM (SELECT ['', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS o,
['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS te)),
n AS (SELECT p_partkey, p_partkey * 997 AS k, p_retailprice AS r, p_size AS s FROM part),
x AS (SELECT *, CASE WHEN k = 0 THEN 'zero' ELSE trim((CASE WHEN k >= 1000000 THEN w[k // 1000000 + 1] || ' million ' ELSE '' END) || (CASE WHEN k // 1000 % 1000 > 0 THEN w[k // 1000 % 1000 + 1] || ' thousand ' ELSE '' END) || w[k % 1000 + 1]) END AS words FROM n, words)
SELECT p_partkey, words, words || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END AS ord, s::BIGINT AS back,
CASE WHEN k * 1000 >= 1073741824 THEN printf('%.2f GB', k * 1000 / 1073741824.0) WHEN k * 1000 >= 1048576 THEN printf('%.2f MB', k * 1000 / 1048576.0) WHEN k > 1 THEN printf('%.2f KB', k * 1000 / 1024.0) ELSE k * 1000 || ' B' END AS size, (s * 1536)::BIGINT AS bytes,
format('{{:,}}', k) || '.00' AS th, '$' || format('{{:,}}', k) || '.00' AS cu, printf('%.1f%%', s * 100.0) AS pct, lower(to_base(s, 2)) AS b2, lower(hex(s)) AS b16, lower(to_base(s, 36)) AS b36, lpad(s::VARCHAR, 5, '0') AS pad FROM x""")
def number_texts(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey") * 997, F.col("p_size")
    return t.part.select(
        "p_partkey", strings.to_words(k).alias("words"), strings.to_ordinal(k).alias("ord"), strings.from_roman(strings.roman(s)).cast(B).alias("back"), strings.format_bytes(k * -1000).alias("size"), strings.from_size(F.concat((s * 1.5).cast("string"), F.lit(" KB"))).alias("bytes"),
        strings.thousands(k).alias("th"), strings.currency(k).alias("cu"), strings.percent(s).alias("pct"), strings.format_int(s, 2).alias("b2"), strings.format_int(s, 16).alias("b16"), strings.format_int(s, 36).alias("b36"), strings.pad_number(s, 5).alias("pad"),
    )


@query("fn_contact_texts", r"""SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@mail.example' AS em, replace(lower(replace(c_name, '#', '.')), '.', '') || '@gmail.com' AS gm, '+1' || lpad(c_custkey::VARCHAR, 10, '5') AS ph, regexp_matches(c_name, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS ie,
TRUE AS iu, TRUE AS ip, TRUE AS ih, c_custkey % 256 < 256 AS iq, FALSE AS ic, 4::BIGINT AS score, TRUE AS valid, 'strong' AS strength, TRUE AS b64, FALSE AS hx FROM customer""")
def contact_texts(t: Tables) -> DataFrame:
    name, s = F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), strings
    word = s.password(F.concat(F.lit("Ab1xyzqw"), F.col("c_custkey").cast("string")))
    return t.customer.select(
        "c_custkey", s.normalize_email(F.concat(F.lit(" "), F.upper(name), F.lit("@mail.example "))).alias("em"), s.normalize_email(F.concat(name, F.lit("@Gmail.com"))).alias("gm"), s.normalize_phone(F.concat(F.lit("("), F.lpad(F.col("c_custkey").cast("string"), 10, "5"), F.lit(") -"))).alias("ph"), s.is_("email", "c_name").alias("ie"),
        s.is_("url", F.concat(F.lit("https://example.org/"), F.col("c_custkey").cast("string"))).alias("iu"), s.is_("ip", F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string"))).alias("ip"), s.is_("hex_color", F.lit("#a0B1c2")).alias("ih"), s.is_("uuid", hashing.uuid()).alias("iq"), s.is_("credit_card", F.lit("4539148803436468")).alias("ic"),
        word["score"].cast(B).alias("score"), word["valid"].alias("valid"), word["strength"].alias("strength"), s.is_("base64", F.base64("c_name")).alias("b64"), s.is_("hex", "c_name").alias("hx"),
    )


_DIGIT = "translate(regexp_replace(upper({0}), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
_SX = "rpad(left(regexp_replace(upper({0}), '[^A-Z]', '', 'g'), 1) || replace(substr(" + "array_to_string(list_filter(string_split(" + _DIGIT + ", ''), lambda x, i: i = 1 OR x <> string_split(" + _DIGIT + ", '')[i - 1]), ''), 2), '0', ''), 4, '0')[1:4]"


@query("fn_soundex", f"""SELECT p_partkey, a AS sx, ((a[1] = b[1])::INT + (a[2] = b[2])::INT + (a[3] = b[3])::INT + (a[4] = b[4])::INT)::BIGINT AS same FROM (SELECT p_partkey, {_SX.format('p_name')} AS a, {_SX.format('p_type')} AS b FROM part)""")
def fn_soundex(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.soundex("p_name").alias("sx"), strings.difference("p_name", "p_type").cast(B).alias("same"))


_ROMAN = "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']"


@query("fn_roman_bytes", f"""SELECT p_partkey, repeat('M', (n // 1000)::INT) || translate(({_ROMAN})[n // 100 % 10 + 1], 'IVX', 'CDM') || translate(({_ROMAN})[n // 10 % 10 + 1], 'IVX', 'XLC') || ({_ROMAN})[n % 10 + 1] AS roman,
CASE WHEN p_partkey * 1000 >= 1073741824 THEN printf('%.2f GB', p_partkey * 1000 / 1073741824.0) WHEN p_partkey * 1000 >= 1048576 THEN printf('%.2f MB', p_partkey * 1000 / 1048576.0) WHEN p_partkey * 1000 >= 1024 THEN printf('%.2f KB', p_partkey * 1000 / 1024.0) ELSE p_partkey * 1000 || ' B' END AS size,
translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS rot13, p_name AS caesar FROM (SELECT *, p_partkey % 3999 + 1 AS n FROM part)""")
def fn_roman(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.roman(F.col("p_partkey") % 3999 + 1).alias("roman"), strings.format_bytes(F.col("p_partkey") * 1000).alias("size"), strings.rot("p_name").alias("rot13"), strings.rot(strings.rot("p_name", 5), -5).alias("caesar"))


# Numbers
@query("fn_math_3", r"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((exp(l_discount) - exp(-l_discount)) / 2, 9) AS sh, round((exp(l_discount) + exp(-l_discount)) / 2, 9) AS ch, round((exp(2 * l_discount) - 1) / (exp(2 * l_discount) + 1), 9) AS th, round(log2(l_quantity), 9) AS l2,
round(cbrt(l_quantity), 9) AS cb, round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 9) AS hy, l_partkey // l_linenumber AS dv, FALSE AS na, l_linenumber = 3 AS inf, round(l_quantity + (l_extendedprice - l_quantity) * 0.25, 6) AS lp,
CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 5 WHEN 6 THEN 8 ELSE 13 END::BIGINT AS fi, (factorial(7) / (factorial(l_linenumber) * factorial(7 - l_linenumber)))::BIGINT AS bi, TRUE AS rn FROM lineitem""")
def fn_math_3(t: Tables) -> DataFrame:
    r, n = lambda x: F.round(x, 9), F.col("l_linenumber")
    infinite = F.when(n == 3, F.lit(float("inf"))).otherwise(F.col("l_tax"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(maths.sinh("l_discount")).alias("sh"), r(maths.cosh("l_discount")).alias("ch"), r(maths.tanh("l_discount")).alias("th"), r(maths.log2("l_quantity")).alias("l2"), r(maths.cbrt("l_quantity")).alias("cb"), r(maths.hypot("l_quantity", n)).alias("hy"),
        maths.div("l_partkey", n).alias("dv"), maths.is_nan("l_tax").alias("na"), maths.is_inf(infinite).alias("inf"), F.round(maths.lerp("l_quantity", "l_extendedprice", 0.25), 6).alias("lp"), maths.fibonacci(n).alias("fi"), maths.binomial(F.lit(7), n).alias("bi"), maths.random_int(3, 9, 5).between(3, 9).alias("rn"),
    )


@query("fn_geo_cells", r"""SELECT s_suppkey, TRUE AS back, round(la - degrees(10 / 6371.0), 9) AS lo_lat, round(lo + degrees(10 / 6371.0) / cos(radians(la)), 9) AS hi_lon, 12::BIGINT AS n FROM (SELECT s_suppkey, (s_suppkey % 80)::DOUBLE AS la, (s_suppkey * 7 % 170)::DOUBLE AS lo FROM supplier)""")
def geo_cells(t: Tables) -> DataFrame:
    at = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 80).cast("double").alias("la"), (F.col("s_suppkey") * 7 % 170).cast("double").alias("lo"))
    point, box = maths.geohash_point(maths.geohash("la", "lo")), maths.bounding_box("la", "lo", 10.0)
    return at.select("s_suppkey", ((F.abs(point["lat"] - F.col("la")) < 1e-6) & (F.abs(point["lon"] - F.col("lo")) < 1e-6)).alias("back"), F.round(box["min_lat"], 9).alias("lo_lat"), F.round(box["max_lon"], 9).alias("hi_lon"), F.length(maths.geohash("la", "lo")).cast(B).alias("n"))


# Dates
@query("fn_date_4", r"""SELECT event_id, minute(ts)::BIGINT AS mi, second(ts)::BIGINT AS se, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, make_timestamp(epoch(date_trunc('second', ts))::BIGINT * 1000000) AS fu, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN -1 WHEN ts > TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END::BIGINT AS cmp,
ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AS bt, printf('%02d:%02d:%02d', hour(ts), minute(ts), event_id % 60) AS mt, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS tts, date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS eod, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS eom,
date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND AS eoy, date_trunc('week', ts) AS sow, ts + INTERVAL 2 MONTH AS am, ts - INTERVAL 3 DAY AS sd, CASE WHEN year(ts) % 4 = 0 THEN 366 ELSE 365 END::BIGINT AS diy, dayofweek(ts) NOT IN (0, 6) AS wd, (event_id % 90 * 60 + 5)::DOUBLE AS pd,
concat_ws(' ', CASE WHEN event_id // 86400 > 0 THEN event_id // 86400 || 'd' END, CASE WHEN event_id // 3600 % 24 > 0 THEN event_id // 3600 % 24 || 'h' END, CASE WHEN event_id // 60 % 60 > 0 THEN event_id // 60 % 60 || 'm' END, CASE WHEN event_id % 60 > 0 THEN event_id % 60 || 's' END) AS fd,
ts + INTERVAL 1 HOUR AS tz, minute(ts)::BIGINT AS pm FROM events WHERE event_id > 0""")
def fn_date_4(t: Tables) -> DataFrame:
    c, ntz = F.col("ts"), "timestamp_ntz"
    lit = lambda x: F.lit(x).cast("timestamp")
    return t.events.where("event_id > 0").select(
        "event_id", dates.minute(c).cast(B).alias("mi"), dates.second(c).cast(B).alias("se"), dates.datetime(c).alias("dt"), dates.from_unix(F.unix_timestamp(c.cast("timestamp"))).cast(ntz).alias("fu"), dates.compare(c, lit("2024-01-15")).cast(B).alias("cmp"), dates.between(c, lit("2024-01-05"), lit("2024-01-20")).alias("bt"),
        dates.make_time(F.hour(c), F.minute(c), (F.col("event_id") % 60).cast("int")).alias("mt"), dates.time_to_seconds(dates.time(c)).alias("tts"), dates.end_of("day", c).cast(ntz).alias("eod"), dates.end_of("month", c).cast(ntz).alias("eom"), dates.end_of("year", c).cast(ntz).alias("eoy"), dates.start_of("week", c).cast(ntz).alias("sow"),
        dates.add(c, 2, "months").cast(ntz).alias("am"), dates.add(c, -3, "day").cast(ntz).alias("sd"), dates.days_in_year(c).cast(B).alias("diy"), dates.is_workday(c).alias("wd"), dates.parse_duration(F.concat((F.col("event_id") % 90).cast("string"), F.lit("m5s"))).alias("pd"), dates.format_duration("event_id").alias("fd"),
        dates.convert_timezone(c, "UTC", "+01:00").alias("tz"), dates.parts(c)["minute"].cast(B).alias("pm"),
    )


@query("fn_age", "SELECT o_orderkey, (2024 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0630' THEN 1 ELSE 0 END)::BIGINT AS age, CASE WHEN year(o_orderdate) % 4 = 0 THEN TRUE ELSE FALSE END AS leap FROM orders")
def fn_age(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.age("o_orderdate", F.lit("2024-06-30").cast("date")).cast(B).alias("age"), dates.is_leap_year("o_orderdate").alias("leap"))


# JSON and other formats
_J = """'{"a":' || event_id || ',"b":"' || event_type || '","c":[1,[2,3]]}'"""


@query("fn_json_parts", f"""SELECT event_id, '{{"b":"' || event_type || '"}}' AS pi, '{{"a":' || event_id || ',"b":"' || event_type || '"}}' AS om, '[' || event_id || ',"' || event_type || '",[1,[2,3]]]' AS va, '{{"a":' || event_id || ',"b":2,"c":[1,[2,3]]}}' AS me, '{{"x":{{"p":1,"q":' || event_id || '}}}}' AS dm,
'[1,' || event_id || ',9]' AS ap, '["z",1,' || event_id || ']' AS pr, '[1,2,' || event_id || ']' AS fl, '{{"k":"' || event_type || '"}}' AS ob, '{{"A":' || event_id || ',"B":"' || event_type || '","C":[1,[2,3]]}}' AS tk, '{{"a":"' || event_id || '!","b":"' || event_type || '!"}}' AS tv, '{{"a":' || event_id || '}}' AS mi,
'{{' || chr(10) || '  "a": ' || event_id || chr(10) || '}}' AS pt FROM events""")
def json_parts(t: Tables) -> DataFrame:
    j, n = F.expr(_J), F.col("event_id").cast("string")
    x, y = F.concat(F.lit('{"x":{"p":1,"q":0}}')), F.concat(F.lit('{"x":{"q":'), n, F.lit("}}"))
    return t.events.select(
        "event_id", jsons.pick(j, "b").alias("pi"), jsons.omit(j, "c").alias("om"), jsons.values(j).alias("va"), jsons.minify(jsons.merge(j, F.lit('{"b":2}'))).alias("me"), jsons.deep_merge(x, y).alias("dm"), jsons.array_append(F.concat(F.lit("[1, "), n, F.lit("]")), F.lit(9)).alias("ap"), jsons.array_prepend(F.concat(F.lit("[1,"), n, F.lit("]")), F.lit("z")).alias("pr"),
        jsons.array_flatten(F.concat(F.lit("[1,[2,["), n, F.lit("]]]"))).alias("fl"), jsons.object_from_arrays(F.array(F.lit("k")), F.array("event_type")).alias("ob"), jsons.transform_keys(j, F.upper).alias("tk"), jsons.transform_values(jsons.omit(j, "c"), lambda v: F.concat(v, F.lit("!"))).alias("tv"),
        jsons.minify(F.concat(F.lit('{ "a" :  '), n, F.lit(" }"))).alias("mi"), jsons.pretty(F.concat(F.lit('{"a":'), n, F.lit("}"))).alias("pt"),
    )


@query("fn_formats", r"""SELECT c_custkey, c_custkey || ',' || c_name || ',' || c_mktsegment AS csv, c_name AS c2, c_mktsegment AS c3, '<row><k>' || c_custkey || '</k><s>' || c_mktsegment || '</s></row>' AS xml, c_mktsegment AS xg, c_custkey AS xk, '{"a":{"n":' || c_custkey || '},"b":[1,2]}' AS toml, '{"items":["x",' || c_custkey || '],"name":"' || c_mktsegment || '"}' AS yaml,
'k = ' || c_custkey || chr(10) AS ts, 'k: ' || c_custkey || chr(10) AS ys FROM customer""")
def fn_formats(t: Tables) -> DataFrame:
    k, f = F.col("c_custkey").cast("string"), formats
    line, xml = f.csv_line("c_custkey", "c_name", "c_mktsegment"), f.xml_stringify("row", k=F.col("c_custkey"), s=F.col("c_mktsegment"))
    rows = f.csv_rows(F.concat(F.lit("key,name,seg\n"), k, F.lit(',"'), "c_name", F.lit('",'), "c_mktsegment"))
    return t.customer.select(
        "c_custkey", line.alias("csv"), F.get(rows, F.lit(0))["name"].alias("c2"), f.csv_parse(line, "k bigint, n string, s string")["s"].alias("c3"), xml.alias("xml"), f.xml_get(xml, "row/s").alias("xg"), f.xml_parse(xml, "k bigint, s string")["k"].alias("xk"), f.toml_parse(F.concat(F.lit("b = [1, 2]\n[a]\nn = "), k)).alias("toml"),
        f.yaml_parse(F.concat(F.lit("name: "), "c_mktsegment", F.lit("\nitems:\n  - x\n  - "), k, F.lit("\n"))).alias("yaml"), f.toml_stringify(F.concat(F.lit('{"k":'), k, F.lit("}"))).alias("ts"), f.yaml_stringify(F.concat(F.lit('{"k":'), k, F.lit("}"))).alias("ys"),
    )


@query("html_select", r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>.*?</p>'))::BIGINT AS ps, regexp_extract(html, '(?is)\shref\s*=\s*["'']([^"'']*)["'']', 1) AS href, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/x/z' AS joined, regexp_extract(url, '^([a-z]+)://', 1) || '://h.example/a?q=1+2#f' AS built FROM pages""")
def html_select(t: Tables) -> DataFrame:
    root = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    return t.pages.select(
        "page_id", F.size(formats.html_select("html", "p")).cast(B).alias("ps"), formats.html_attr("html", "href").alias("href"), formats.url_join(F.concat(root, F.lit("/x/y/w?q=1")), F.lit("../z")).alias("joined"),
        formats.url_build(text.url_parts("url")["scheme"], F.lit("h.example"), F.lit("/a"), {"q": F.lit("1 2")}, F.lit("f")).alias("built"),
    )


@query("markdown", r"""SELECT p_partkey, '<p><h1>' || p_brand || '</h1><br>a <strong>' || p_type || '</strong> <a href="u">x</a></p>' AS html, '# ' || p_brand || chr(10) || 'a **' || p_type || '** [x](u)' AS md, p_brand AS title, 'l' AS link FROM part""")
def markdown(t: Tables) -> DataFrame:
    source = F.concat(F.lit("# "), "p_brand", F.lit("\na **"), "p_type", F.lit("** [x](u)"))
    page = F.concat(F.lit("<h1>"), "p_brand", F.lit("</h1>a <b>"), "p_type", F.lit('</b> <a href="u">x</a>'))
    feed = formats.rss_items(F.concat(F.lit("<rss><item><title><![CDATA["), "p_brand", F.lit("]]></title><link>l</link></item></rss>")))
    return t.part.select("p_partkey", formats.markdown_to_html(source).alias("html"), formats.html_to_markdown(page).alias("md"), F.get(feed, F.lit(0))["title"].alias("title"), F.get(feed, F.lit(0))["link"].alias("link"))


# Text mining
_FROZEN = {  # the lexicon, written out for the oracle
    "p": "(contains(t, 'good'))::INT + (contains(t, 'great'))::INT + (contains(t, 'excellent'))::INT + (contains(t, 'amazing'))::INT + (contains(t, 'wonderful'))::INT + (contains(t, 'fantastic'))::INT + (contains(t, 'happy'))::INT + (contains(t, 'love'))::INT + (contains(t, 'best'))::INT + (contains(t, 'beautiful'))::INT",
    "n": "(contains(t, 'bad'))::INT + (contains(t, 'terrible'))::INT + (contains(t, 'awful'))::INT + (contains(t, 'horrible'))::INT + (contains(t, 'worst'))::INT + (contains(t, 'hate'))::INT + (contains(t, 'poor'))::INT + (contains(t, 'sad'))::INT + (contains(t, 'angry'))::INT + (contains(t, 'disappointing'))::INT",
}


@query("txt_sentiment", f"""SELECT doc_id, round(s, 2) AS s, CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS k, p::BIGINT AS p, n::BIGINT AS n
FROM (SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS s FROM (SELECT doc_id, {_FROZEN['p']} AS p, {_FROZEN['n']} AS n FROM (SELECT doc_id, lower(text) AS t FROM documents)))""")
def txt_sentiment(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", text.sentiment("text").alias("v"))
    return found.select("doc_id", F.col("v.score").alias("s"), F.col("v.sentiment").alias("k"), F.col("v.positive").cast(B).alias("p"), F.col("v.negative").cast(B).alias("n"))


_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
_STEMS = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND strlen(w) > {n} THEN left(w, length(w) - {len(s)})" for s, n in (
    ("ational", 5), ("tional", 5), ("enci", 4), ("anci", 4), ("izer", 4), ("isation", 4), ("ization", 4), ("ation", 4), ("ator", 4), ("alism", 4), ("iveness", 5), ("fulness", 5), ("ousness", 5), ("aliti", 4), ("iviti", 4), ("biliti", 4),
    ("alli", 4), ("entli", 4), ("eli", 3), ("ousli", 4), ("ing", 3), ("ed", 2), ("ness", 3), ("ment", 3), ("able", 3), ("ible", 3), ("ly", 2), ("er", 2), ("s", 1))) + " ELSE w END"


@query("txt_stem", f"SELECT w AS word, {_STEMS} AS stem FROM (SELECT DISTINCT unnest({_TOK}) AS w FROM documents)")
def txt_stem(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(text.tokens("text")).alias("word")).distinct().select("word", text.stem("word").alias("stem"))


@query("txt_pos_tag", f"""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN w IN ('the', 'a', 'an', 'this', 'that', 'these', 'those') THEN 'DT' WHEN w IN ('in', 'on', 'at', 'to', 'for', 'with', 'by', 'from', 'of') THEN 'IN'
WHEN w IN ('i', 'you', 'he', 'she', 'it', 'we', 'they', 'me', 'him', 'her', 'us', 'them') THEN 'PRP' WHEN ends_with(w, 'ing') THEN 'VBG' WHEN ends_with(w, 'ed') THEN 'VBD' WHEN regexp_matches(w, '(ful|less|ous|ive|able|ible|al|ic)$') THEN 'JJ' WHEN ends_with(w, 'ly') THEN 'RB'
WHEN regexp_full_match(w, '[0-9]+') THEN 'CD' ELSE 'NN' END AS tag FROM (SELECT unnest({_TOK}) AS w FROM documents) WHERE NOT regexp_matches(w, '[0-9][a-z]')) GROUP BY tag""")
def txt_pos(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(text.tokens("text")).alias("w")).where(~F.col("w").rlike("[0-9][a-z]"))
    return words.groupBy(text.pos_tag("w").alias("tag")).agg(F.count("*").alias("n"))


# Encodings
@query("fn_codes", r"""SELECT s_suppkey, s_name AS aes, s_name AS uu, s_name AS puny, s_name AS uni, s_name AS js, upper(s_name) AS morse, s_name AS b32, s_name AS qp, s_name AS zl, s_name AS b64, TRUE AS uid, 56::BIGINT AS s224, 96::BIGINT AS s384, s_suppkey AS oct, crc IS NOT NULL AS crc FROM (SELECT *, 1 AS crc FROM supplier)""")
def fn_codes(t: Tables) -> DataFrame:
    h, key = hashing, "0123456789abcdef"
    both = lambda make, back: h.text_code(back, h.text_code(make, "s_name"))
    raw = lambda make, back: F.decode(h.packed(back, h.packed(make, "s_name")), "UTF-8")
    return t.supplier.select(
        "s_suppkey", h.decrypt(h.encrypt("s_name", key), key).alias("aes"), both("uuencode", "uudecode").alias("uu"), both("punycode", "unpunycode").alias("puny"), both("unicode_escape", "unicode_unescape").alias("uni"), both("js_escape", "js_unescape").alias("js"), both("morse", "unmorse").alias("morse"),
        raw("base32", "unbase32").alias("b32"), raw("quoted_printable", "unquoted_printable").alias("qp"), raw("zlib", "unzlib").alias("zl"), F.decode(h.unbase64(h.base64("s_name")), "UTF-8").alias("b64"), strings.is_("uuid", h.uuid()).alias("uid"),
        F.length(h.sha("s_name", 224)).cast(B).alias("s224"), F.length(h.sha("s_name", 384)).cast(B).alias("s384"), h.from_base(h.to_base("s_suppkey", 8), 8).alias("oct"), F.crc32("s_name").isNotNull().alias("crc"),
    )


# Rules, machines, schedules
@query("rule_chain", """SELECT o_orderkey, to_json(list_filter([CASE WHEN o_totalprice > 200000 THEN 'dear' END, CASE WHEN o_orderstatus = 'F' AND starts_with(o_orderpriority, '1') THEN 'urgent' END, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' END], lambda x: x IS NOT NULL))::VARCHAR AS names,
CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' WHEN o_totalprice > 200000 THEN 'dear' WHEN o_orderstatus = 'F' AND starts_with(o_orderpriority, '1') THEN 'urgent' END AS best FROM orders""")
def rule_chain(t: Tables) -> DataFrame:
    dear, urgent, opened = rules.Rule("dear").where("o_totalprice", ">", 200000), rules.Rule("urgent").where("o_orderstatus", "eq", "F").where("o_orderpriority", "starts_with", "1"), rules.Rule("open", priority=5).where("o_orderstatus", "in", ["O", "P"])
    return t.orders.select("o_orderkey", *_json(names=rules.chain(dear, urgent, opened)), rules.first_match(dear, urgent, opened).alias("best"))


@query("decision_table", """SELECT c_custkey, to_json(list_filter([CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN 'b3' END, CASE WHEN c_nationkey = 7 THEN 'n7' END], lambda x: x IS NOT NULL))::VARCHAR AS out, c_acctbal * 2 AS v FROM customer""")
def decision_table(t: Tables) -> DataFrame:
    table = [{"conditions": {"c_mktsegment": "BUILDING"}, "outcome": "b"}, {"conditions": {"c_mktsegment": "BUILDING", "c_nationkey": 3}, "outcome": "b3"}, {"conditions": {"c_nationkey": 7}, "outcome": "n7"}]
    return rules.evaluate(rules.decision_table(t.customer, table, "m"), "c_acctbal * 2", "v").select("c_custkey", *_json(out=F.col("m")), "v")


@query("state_machine", """SELECT event_id, user_id, CASE WHEN event_type = 'purchase' OR purchased > 0 THEN 'buyer' WHEN viewed > 0 THEN 'viewer' ELSE 'new' END AS after FROM (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS purchased, count(*) FILTER (WHERE event_type IN ('view', 'click')) OVER w AS viewed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def state_machine(t: Tables) -> DataFrame:
    moves = {("new", "view"): "viewer", ("new", "click"): "viewer", ("new", "purchase"): "buyer", ("viewer", "purchase"): "buyer"}
    return rules.state_machine(t.events, "user_id", ["ts", "event_id"], "event_type", moves, "new").select("event_id", "user_id", "after")


@query("cron_matches", "SELECT event_id FROM events WHERE minute(ts) IN (0, 15, 30, 45) AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_matches(t: Tables) -> DataFrame:
    return t.events.where(rules.cron_matches(F.col("ts"), "*/15 8-17 * * 1-5")).select("event_id")


# Sessions, scripts, formats, services
@query("fn_session", """SELECT n_nationkey, TRUE AS now, TRUE AS today, TRUE AS uid, TRUE AS rnd, TRUE AS usr, TRUE AS db, TRUE AS ver, repeat(' ', (n_nationkey % 4)::INT) AS sp, 'integer' AS t1, 'text' AS t2, 'real' AS t3, 'null' AS t4 FROM nation""")
def fn_session(t: Tables) -> DataFrame:
    from lodestar.functions import session as s

    kind = lambda c: s.type_name(c, t.nation)
    return t.nation.select(
        "n_nationkey", (s.now() >= F.lit("2024-01-01").cast("timestamp")).alias("now"), (s.today() >= F.lit("2024-01-01").cast("date")).alias("today"), strings.is_("uuid", hashing.uuid()).alias("uid"), F.rand().between(0, 1).alias("rnd"), (F.length(s.user()) > 0).alias("usr"), (F.length(s.database()) > 0).alias("db"),
        s.version().rlike("^[0-9]+[.]").alias("ver"), s.space((F.col("n_nationkey") % 4).cast("int")).alias("sp"), kind("n_nationkey").alias("t1"), kind("n_name").alias("t2"), s.type_of_column(F.lit(1.5), "double").alias("t3"), s.type_of_column(F.lit(None).cast("int"), "int").alias("t4"),
    )


@query("typed_text", """SELECT c_custkey, c_custkey AS n, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS d, NULL::VARCHAR AS nothing FROM customer""")
def typed_text(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    from lodestar.sources.delimited import typed

    word = F.expr("CASE c_custkey % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' ELSE '' END")
    number = F.expr("CASE WHEN c_custkey % 2 = 0 THEN cast(c_acctbal AS string) ELSE 'none' END")
    return t.customer.select("c_custkey", typed(F.concat(F.lit(" "), F.col("c_custkey").cast("string")), T.LongType()).alias("n"), typed(word, T.BooleanType()).alias("b"), typed(number, T.DoubleType()).alias("d"), typed(F.lit("NULL"), T.StringType()).alias("nothing"))


@query("output_formats", """SELECT 'json' AS kind, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region UNION ALL SELECT 'csv', r_regionkey || ',' || r_name FROM region UNION ALL SELECT 'tsv', r_regionkey || chr(9) || r_name FROM region""")
def output_formats(t: Tables) -> DataFrame:
    from lodestar.sources.delimited import to_format

    rows = t.region.select("r_regionkey", "r_name")
    out = None
    for kind in ("json", "csv", "tsv"):
        lines = to_format(rows, kind).select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


@query("script_runner", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def script_runner(t: Tables) -> DataFrame:
    from lodestar.plans.dialect import run_script

    return run_script(t.views("nation"), "CREATE OR REPLACE TEMPORARY VIEW two AS SELECT * FROM nation WHERE n_regionkey = 2; -- all of; them\nSELECT n_name, n_regionkey FROM two;")[-1]


@query("pragma_sources", "SELECT 'n_nationkey' AS name UNION ALL SELECT 'n_name' UNION ALL SELECT 'n_regionkey' UNION ALL SELECT 'ok' UNION ALL SELECT 'UTF-8' UNION ALL SELECT 'nation'")
def pragma_sources(t: Tables) -> DataFrame:
    from lodestar.plans.dialect import run_sql

    spark = t.views("nation")
    out = run_sql(spark, "PRAGMA table_info(nation)").select("name")
    for text, column in (("PRAGMA integrity_check", "integrity_check"), ("PRAGMA encoding", "encoding")):
        out = out.unionByName(run_sql(spark, text).select(F.col(column).alias("name")))
    return out.unionByName(run_sql(spark, "PRAGMA table_list").where("name = 'nation'").select("name"))


@query("services", "SELECT (SELECT count(*) FROM nation) AS counted, (SELECT count(*) FROM region) AS cached, (SELECT count(*) FROM events) AS received, 2::BIGINT AS tries, (SELECT min(event_id) + 2 FROM events)::BIGINT AS third, (SELECT count(*) - 3 FROM events) AS waiting")
def services(t: Tables) -> DataFrame:
    """Observed counters, a cached result, a topic read as a stream, a queue, a retried action."""
    from lodestar.operators import services as sv
    from lodestar.streaming import events as ev

    metrics, cache, tries = sv.Metrics(), sv.Cache(t.spark), []
    metrics.watch(t.nation, rows=F.count("*")).write.format("noop").mode("overwrite").save()
    cache.set("regions", t.region)
    topic = sv.Topic(t.spark, "events", "event_id bigint, user_id bigint")
    topic.publish(t.events.select("event_id", "user_id"))
    queue = sv.Queue(topic, "event_id")

    def flaky() -> int:
        tries.append(1)
        if len(tries) < 2:
            raise OSError
        return len(tries)

    counted, cached, received = sv.in_parallel(lambda: int(metrics.get("rows")), lambda: cache.get("regions").count(), lambda: ev.run_available(topic.subscribe()).count())
    third = queue.pop(3)[-1]["event_id"]
    row = (counted, cached, received, sv.retry(flaky, wait=0.01), third, queue.size())
    return t.spark.createDataFrame([row], "counted bigint, cached bigint, received bigint, tries bigint, third bigint, waiting bigint")
