"""Text mining and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.strings import col, let, unescape_html

# The English stop words of the full-text tokenizer, and the sentiment lexicon.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")
POSITIVE = ("good", "great", "excellent", "amazing", "wonderful", "fantastic", "happy", "love", "best", "beautiful")
NEGATIVE = ("bad", "terrible", "awful", "horrible", "worst", "hate", "poor", "sad", "angry", "disappointing")
# Suffixes of the word stemmer in the order tried, each with the length that a word has to exceed.
_SUFFIXES = (
    ("ational", 5), ("tional", 5), ("enci", 4), ("anci", 4), ("izer", 4), ("isation", 4), ("ization", 4), ("ation", 4), ("ator", 4), ("alism", 4),
    ("iveness", 5), ("fulness", 5), ("ousness", 5), ("aliti", 4), ("iviti", 4), ("biliti", 4), ("alli", 4), ("entli", 4), ("eli", 3), ("ousli", 4),
    ("ing", 3), ("ed", 2), ("ness", 3), ("ment", 3), ("able", 3), ("ible", 3), ("ly", 2), ("er", 2), ("s", 1),
)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def word_frequency(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def keywords(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The k most frequent words of each document that are no stop words, ties by word."""
    counted = df.select(key, F.explode(tokens(text)).alias("word")).where(~F.col("word").isin(*STOP_WORDS) & (F.length("word") > 2)).groupBy(key, "word").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word")).cast("bigint")).where(F.col("place") <= k)


def ngrams(c: Column | str, n: int) -> Column:
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.slice(t, i, n))
    return F.transform(F.filter(let(tokens(c), runs), lambda x: F.size(x) == n), lambda x: F.array_join(x, " "))


def jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def sentiment(c: Column | str) -> Column:
    """Struct of sentiment (positive, negative, neutral), score (lexicon words for minus against, over their number, two
    decimals) and the numbers of both."""
    t = F.lower(col(c))
    hits = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words[1:]), F.contains(t, F.lit(words[0])).cast("int"))

    def judged(v: Column) -> Column:
        p, n = v["p"], v["n"]
        share = F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))
        name = F.when(share > 0.2, "positive").when(share < -0.2, "negative").otherwise("neutral")
        return F.struct(name.alias("sentiment"), F.round(share, 2).alias("score"), p.alias("positive"), n.alias("negative"))

    return let(F.struct(hits(POSITIVE).alias("p"), hits(NEGATIVE).alias("n")), judged)


def stem(c: Column | str) -> Column:
    """The lower-case word without the first suffix that it ends in and is long enough for (lengths in bytes)."""
    word = F.lower(col(c))
    out = word
    for suffix, least in reversed(_SUFFIXES):
        out = F.when(word.endswith(suffix) & (F.octet_length(word) > least), F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return out


# Word lists and endings of the rule-based tagger.
DETERMINERS = ("the", "a", "an", "this", "that", "these", "those")
PREPOSITIONS = ("in", "on", "at", "to", "for", "with", "by", "from", "of")
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them")
ADJECTIVE_ENDINGS = ("ful", "less", "ous", "ive", "able", "ible", "al", "ic")


def pos_tag(word: Column | str) -> Column:
    """Part of speech by word lists and endings; a noun if nothing tells."""
    w = F.lower(col(word))
    adjective = w.rlike("(?:" + "|".join(ADJECTIVE_ENDINGS) + ")$")
    tag = F.when(w.isin(*DETERMINERS), "DT").when(w.isin(*PREPOSITIONS), "IN").when(w.isin(*PRONOUNS), "PRP").when(w.endswith("ing"), "VBG").when(w.endswith("ed"), "VBD")
    return tag.when(adjective, "JJ").when(w.endswith("ly"), "RB").when(w.try_cast("double").isNotNull(), "CD").otherwise("NN")


def tagged(c: Column | str) -> Column:
    """word and tag of each white-space word, with signs stripped from its ends."""
    bare = F.transform(F.regexp_extract_all(col(c), F.lit(r"\S+"), F.lit(0)), lambda w: F.regexp_replace(w, "^[.,!?;:\"']+|[.,!?;:\"']+$", ""))
    return F.transform(bare, lambda w: F.struct(w.alias("word"), pos_tag(w).alias("tag")))


def html_text(c: Column | str) -> Column:
    """Visible text: without scripts, styles and tags, entities decoded, white space collapsed."""
    bare = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescape_html(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def html_links(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r'(?i)<a[^>]*\shref="([^"]*)"'), F.lit(1))


def html_title(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def url_parts(c: Column | str) -> Column:
    part = lambda p: F.parse_url(col(c), F.lit(p))
    return F.struct(part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("fragment"))
