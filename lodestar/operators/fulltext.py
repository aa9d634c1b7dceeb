"""Full-text search: postings as a DataFrame, boolean queries, and rankings.

A posting is (doc, term, tf); documents' lengths and document frequencies are aggregates.  Queries have a handful of terms,
so filtering postings by them is pushed into the scan, and scores are partial sums per document.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.strings import col
from lodestar.functions.text import STOP_WORDS

# The suffixes of the light stemmer, tried in this order.
SUFFIXES = ("ation", "ition", "ness", "ment", "able", "ible", "ous", "ive", "ly", "ed", "ing", "es", "s")


def stemmed(word: Column) -> Column:
    """The word without the first suffix that leaves two bytes, if it has over three."""
    out = word
    for suffix in reversed(SUFFIXES):
        out = F.when(word.endswith(suffix) & (F.octet_length(word) - len(suffix) >= 2), F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return F.when(F.octet_length(word) > 3, out).otherwise(word)


def terms(text: Column | str, stem: bool = False) -> Column:
    kept = F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{Nd}]+"), lambda w: ~w.isin("", *STOP_WORDS))
    return F.transform(kept, stemmed) if stem else kept


@dataclass
class Index:
    postings: DataFrame  # doc, term, tf, positions
    docs: DataFrame  # doc, length
    stem: bool
    listed: DataFrame | None = None  # doc, terms: an index that isn't stored; queries then keep only their own terms
    whole: int = 0  # documents when all was last written; then the changes since, and the documents they named
    changes: int = 0
    moved: int = 0

    @staticmethod
    def build(df: DataFrame, key: str, *texts: str, stem: bool = False) -> Index:
        listed = df.select(F.col(key).alias("doc"), terms(F.concat_ws(" ", *texts), stem).alias("terms"))
        # Documents are dealt while they are texts: a row for each word is never shuffled.
        at = df.select(F.col(key).alias("doc"), F.concat_ws(" ", *texts).alias("text")).repartition("doc").select("doc", F.posexplode(terms("text", stem)).alias("pos", "term"))
        postings = at.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        return Index(postings, listed.select("doc", F.size("terms").cast("bigint").alias("length")), stem, listed)

    def _chosen(self, words: list[str]) -> DataFrame:
        """doc, term, tf, length of the postings of a query's terms."""
        if self.listed is None:
            return self.postings.where(F.col("term").isin(*words)).select("doc", "term", "tf").join(self.docs, "doc")
        own = F.filter("terms", lambda x: x.isin(*words))
        hits = self.listed.select("doc", F.size("terms").cast("bigint").alias("length"), F.explode(own).alias("term"))
        return hits.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))

    def plus(self, rows: DataFrame, key: str, *texts: str) -> Index:
        """With the postings of further documents."""
        new = Index.build(rows, key, *texts, stem=self.stem)
        return Index(self.postings.unionByName(new.postings), self.docs.unionByName(new.docs), self.stem)

    def without(self, keys: DataFrame) -> Index:
        """Without the documents of a one-column table of keys."""
        gone = keys.toDF("doc").distinct()
        return Index(self.postings.join(gone, "doc", "left_anti"), self.docs.join(gone, "doc", "left_anti"), self.stem)

    def kept(self, path: str) -> Index:
        """Written to a new folder under path and read from there."""
        spark, at = self.docs.sparkSession, f"{path}/{uuid.uuid4().hex}"
        self.save(at)
        return Index.load(spark, at, self.stem)

    def changed(self, path: str, keys: DataFrame, rows: DataFrame | None, key: str, *texts: str) -> Index:
        """Without the documents of the keys and with the rows.  Only the change is written; all is written anew, without what
        has left, once the changed documents come to half of what was written whole, or with the 16th change."""
        spark, at = self.docs.sparkSession, f"{path}/{uuid.uuid4().hex}"
        keys.toDF("doc").distinct().write.parquet(f"{at}/gone")
        gone = spark.read.parquet(f"{at}/gone")
        out = self.without(gone)
        if rows is not None:
            new = Index.build(rows, key, *texts, stem=self.stem).kept(path)
            out = Index(out.postings.unionByName(new.postings), out.docs.unionByName(new.docs), self.stem)
        whole, changes = self.whole or self.docs.count(), self.changes + 1
        out.whole, out.changes, out.moved = whole, changes, self.moved + gone.count()
        return out.kept(path) if changes >= 16 or out.moved * 2 > whole else out

    def _query_terms(self, query: str) -> list[str]:
        words = [w for w in re.split(r"[^\w]+", query.lower()) if len(w) >= 2 and w not in (*STOP_WORDS, "and", "or", "not")]
        if self.stem:
            for i, w in enumerate(words):
                if len(w.encode()) > 3:
                    words[i] = next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w.encode()) - len(s) >= 2), w)
        return list(dict.fromkeys(words))

    def search(self, query: str) -> DataFrame:
        """doc, tf of the documents that match: `a b` or `a AND b` all terms, `a OR b` any, `a NOT b` without b."""
        wanted, _, refused = re.sub(r"\s+", " ", query).partition(" NOT ") if " NOT " in query else re.sub(r"\s+", " ", query).partition(" not ")
        words = self._query_terms(wanted)
        hits = self._chosen(words).groupBy("doc").agg(F.sum("tf").alias("tf"), F.count("*").alias("n"))
        if not re.search(r"\bor\b", wanted, re.I):
            hits = hits.where(F.col("n") == len(words))
        if refused:
            hits = hits.join(self._chosen(self._query_terms(refused)).select("doc").distinct(), "doc", "left_anti")
        return hits.select("doc", "tf")

    def rank(self, query: str, ranker: str = "bm25", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """doc, score of the matching documents."""
        words = self._query_terms(query.partition(" NOT ")[0])
        chosen = self._chosen(words)
        if ranker == "frequency":
            scored = chosen.select("doc", F.col("tf").cast("double").alias("part"))
        else:
            totals = self.docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
            df_ = chosen.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
            joined = chosen.join(F.broadcast(df_), "term").crossJoin(F.broadcast(totals))
            if ranker == "bm25":
                idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
                part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
            elif ranker == "tfidf":
                part = F.log(F.col("n") / F.col("df")) * F.col("tf") / F.col("length")
            else:
                raise ValueError(ranker)
            scored = joined.select("doc", part.alias("part"))
        scores = scored.groupBy("doc").agg(F.sum("part").alias("score"))
        if re.search(r"\bor\b", query, re.I) and not re.search(r"\bnot\b", query, re.I):
            return scores  # any term will do
        return scores.join(self.search(query).select("doc"), "doc", "left_semi")

    def stats(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")).crossJoin(self.postings.agg(F.count_distinct("term").alias("terms")))

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @staticmethod
    def load(spark, path: str, stem: bool = False) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), stem)
