"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines of every length are normalised (lower case, runs of white space to one space, digit runs to 0) and hashed with
their host (`source`).  For each line the distinct documents of its host are counted; a document is a doc_id with a text, so
repeated rows are one.  A line is boilerplate when it stands in at least `min_docs` documents and in more than `share` of
the host's that have a content of their own: those of whose distinct lines' words at least `own` stand in lines that fewer
than `min_docs` documents of the host have.  So a group of copies or near copies does not condemn the text it shares.
Boilerplate lines are removed.  A document is rejected if it fails the base rules or is depleted: boilerplate makes up
more than `depleted` of its words.  Shares are compared exactly, as decimal fractions.

Null and empty texts have no words and no lines, and fail the base rules; a null host is a host of its own; a null doc_id
is an id like others.  Repeated rows yield repeated results; ties at a limit are not over it.  Any further columns of docs stay,
unless their names begin with lq_ or are those of results.  Hashes have 64 bits (two of them for a document).  Each text
is normalised once, into a table of line keys; joins on hot lines are plain shuffled joins of keys, which adaptive
execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, materialise, text_of

MIN_DOCS, SHARE, OWN, DEPLETED = 5, 0.002, 0.5, 0.6
MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 0.3, 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """Null stays null; a line without words is empty."""
    spaced = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def size_of(norm: Column) -> Column:
    """Words of a normalised line that has some."""
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def exceeds(part: Column, whole: Column, share: float) -> Column:
    """part > share * whole, in integers."""
    exact = Fraction(str(share))
    return part * F.lit(exact.denominator) > whole * F.lit(exact.numerator)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.  A column that a lambda uses may be copied into it by the optimizer, and
    then costs its whole computation for each element; a lambda's own variable may not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(array: Column, window: int = WINDOW) -> Column:
    """How many words of the array lie in windows that stand in it twice or more."""
    zero = F.lit(0).cast("long")

    def counted(windows: Column) -> Column:
        # Hash above, place below: after sorting, equal windows are neighbours.
        bits = F.length(F.bin(F.size(windows).cast("long"))).cast("int")
        high = lambda x, b: F.call_function("shiftright", x, b)
        low = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
        packed = let(bits, lambda b: F.transform(windows, lambda h, i: F.call_function("shiftleft", high(h, b), b).bitwiseOR(i.cast("long"))))

        def places(s: Column) -> Column:
            alike = lambda x, k, b: F.coalesce(high(x, b) == high(F.get(s, k - 1), b), F.lit(False)) | F.coalesce(high(x, b) == high(F.get(s, k + 1), b), F.lit(False))
            return let(bits, lambda b: F.sort_array(F.transform(F.filter(s, lambda x, k: alike(x, k, b)), lambda x: x.bitwiseAND(low(b) - F.lit(1)))))

        covered = lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(window).cast("long"), y - x))
        total = let(let(F.sort_array(packed), places), lambda p: F.aggregate(covered(p), zero, lambda acc, x: acc + x))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), zero).otherwise(total)

    def hashed(words_: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(words_) - (window - 1))
        return let(F.transform(words_, lambda x: F.xxhash64(x)), lambda h: F.transform(at, lambda i: F.xxhash64(F.slice(h, i, window))))

    return let(array, lambda w: F.when(F.size(w) <= window, zero).otherwise(let(hashed(w), counted)))


def line_quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, own: float = OWN, depleted: float = DEPLETED, min_words: int = MIN_WORDS, repeat_share: float = REPEAT_SHARE) -> DataFrame:
    """All columns of docs, and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
    removed_lines (long); base_failed, kept (boolean); clean_text (the text without its boilerplate lines)."""
    host = F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit(""))
    key = lambda norm: F.xxhash64(F.col("lq_host"), norm)
    base = docs.withColumn("lq_text", text_of()).withColumn("lq_host", host)
    identity = [F.col("lq_host"), F.col("doc_id").cast("string"), F.col("lq_text")]
    base = base.withColumn("lq_c1", F.xxhash64(F.col("doc_id").isNull(), *identity)).withColumn("lq_c2", F.xxhash64(F.lit(17), *reversed(identity)))
    doc = ["lq_c1", "lq_c2"]

    # The line keys of each row, and then of each document: how often each stands in it.
    listed = F.transform(F.transform(lines(F.col("lq_text")), normalised), lambda x: F.struct(key(x).alias("k"), size_of(x).alias("n")))
    rows = materialise(base.select("lq_host", *doc, listed.alias("lq_lines")), "lines")
    each = rows.groupBy("lq_host", *doc).agg(F.count("*").alias("lq_rows"))
    found = rows.select("lq_host", *doc, F.explode("lq_lines").alias("lq_line")).select("lq_host", *doc, F.col("lq_line.k").alias("lq_key"), F.col("lq_line.n").cast("long").alias("lq_size"))
    found = materialise(found.groupBy("lq_host", *doc, "lq_key").agg(F.max("lq_size").alias("lq_size"), F.count("*").alias("lq_times")), "found")

    shared = found.groupBy("lq_key").agg(F.count("*").alias("lq_n")).where(F.col("lq_n") >= min_docs)
    alike = found.join(shared, "lq_key", "left").groupBy(*doc).agg(F.sum("lq_size").alias("lq_all"), F.sum(F.when(F.col("lq_n").isNull(), F.col("lq_size")).otherwise(0)).alias("lq_own"))
    witnesses = alike.where(~exceeds(F.col("lq_all") - F.col("lq_own"), F.col("lq_all"), 1 - Fraction(str(own)))).select(*doc)
    counts = found.join(witnesses, doc, "left_semi").groupBy("lq_key", "lq_host").agg(F.count("*").alias("lq_n")).where(F.col("lq_n") >= min_docs)
    hosts = each.groupBy("lq_host").agg(F.count("*").alias("lq_docs"))
    common = counts.join(hosts, "lq_host").where(exceeds(F.col("lq_n"), F.col("lq_docs"), share)).select("lq_key")
    removed = found.join(common, "lq_key").groupBy(*doc).agg(F.collect_set("lq_key").alias("lq_removed"), F.sum(F.col("lq_size") * F.col("lq_times")).alias("lq_gone"), F.sum("lq_times").alias("lq_times"))
    removed = removed.join(each, doc).select(*doc, "lq_removed", (F.col("lq_gone") / F.col("lq_rows")).cast("long").alias("removed_words"), (F.col("lq_times") / F.col("lq_rows")).cast("long").alias("removed_lines"))

    out = base.withColumn("lq_words", words(F.col("lq_text"))).withColumn("lq_lines", lines(F.col("lq_text")))
    out = out.withColumn("n_words", F.size("lq_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("lq_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count("lq_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("lq_lines") - F.size(F.array_distinct("lq_lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", repeated_words(F.col("lq_words"))).drop("lq_words", "lq_lines")

    out = out.join(removed, doc, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("removed_words", "removed_lines")})
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | exceeds(F.col("n_repeat_words"), F.col("n_words"), repeat_share))
    out = out.withColumn("kept", ~F.col("base_failed") & ~exceeds(F.col("removed_words"), F.col("n_words"), depleted))
    stay = F.filter(F.split("lq_text", "\n"), lambda x: let(normalised(x), lambda norm: (norm == "") | ~F.array_contains("lq_removed", key(norm))))
    out = out.withColumn("clean_text", F.when(F.col("lq_removed").isNull(), F.col("lq_text")).otherwise(F.array_join(stay, "\n")))
    return out.drop("lq_text", "lq_host", "lq_c1", "lq_c2", "lq_removed")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('h' || source, '') AS host FROM documents),
c AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT host, doc_id, t FROM d)),
w AS (SELECT id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM c),
ln AS (SELECT id, host, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM c),
lk AS (SELECT id, host, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
       regexp_replace(lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')), '[0-9]+', '0', 'g') AS k FROM ln),
lf AS (SELECT id, host, k, n, count(*) AS times FROM lk GROUP BY id, host, k, n),
hosts AS (SELECT host, count(*) AS docs FROM c GROUP BY host),
shared AS (SELECT host, k FROM lf GROUP BY host, k HAVING count(*) >= 5),
own AS (SELECT id FROM lf LEFT JOIN shared s USING (host, k) GROUP BY id HAVING 2 * coalesce(sum(n) FILTER (WHERE s.k IS NULL), 0) >= sum(n)),
common AS (SELECT host, k FROM (SELECT host, k, count(*) AS n FROM lf JOIN own USING (id) GROUP BY host, k) JOIN hosts USING (host) WHERE n >= 5 AND n * 500 > docs),
rem AS (SELECT id, sum(n * times)::BIGINT AS removed_words, sum(times)::BIGINT AS removed_lines FROM lf JOIN common USING (host, k) GROUP BY id),
dup AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY id),
win AS (SELECT id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win FROM (SELECT id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS n FROM win) WHERE n > 1) GROUP BY id),
f AS (SELECT id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines
      FROM w LEFT JOIN dup USING (id) LEFT JOIN rep USING (id) LEFT JOIN rem USING (id))
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * removed_words <= 60 * n_words AS kept, removed_words, removed_lines
FROM d JOIN c ON d.host = c.host AND d.t = c.t AND d.doc_id IS NOT DISTINCT FROM c.doc_id JOIN f USING (id)
"""
