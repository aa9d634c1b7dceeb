"""Quality classifier by co-training two views of a document.

Text-content view: presence of hashed words and of hashed word shapes (case and closing signs).  Page-metadata view:
language, source, and layout statistics (length, lines, shares of capitals, digits, signs, repeated words ...), each cut
into few bins.  Both views are naive Bayes models whose weights are kept only where their counts are significant.
They start from the labelled documents; in each round every unlabelled document on which one view is confident becomes a
pseudo-labelled one for the other.  Calibration (Platt) and the combination of both views are fitted on labelled
documents of a fold (crc32 of doc_id mod 5 = 0) that trains no weights.  The same machinery, run with the label `toxic`, gives
a toxicity score.  Counts cover all documents; what reaches the driver is bounded by the number of features and bins.

Null text counts as empty, null metadata as a value of its own.  Labels that disagree for a doc_id count by majority (ties:
1), null labels not at all; a label with one class only gives 0.5 plus no evidence.  Where only the calibration fold lacks a class, the
views stay uncalibrated and their mean margin decides.  Repeated rows repeat their results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, pieces, python_ready, text_of

WORDS, META, SHAPES = 1 << 16, 1024, 1 << 10
ROUNDS, CONFIDENT, SIGNIFICANT, FOLD, BINS, SPAN = 2, 0.98, 4.0, 5, 240, 60.0
TARGETS = ("quality", "toxic")
_CLASS = np.zeros(256, np.uint8)  # of bytes: 1 capital, 2 small, 3 digit, 4 space, 5 line feed, 6 . or , 7 other sign, 8 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".," else 7


def _word_features(word: str) -> tuple[int, int]:
    core = word.strip(".,;:!?\"'()[]")
    closing = word[len(word.rstrip(".,;:!?#*$%&|<>-_=+~/")) :][:4]
    shape = ("U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.isalpha() else "d" if core.isdigit() else "m") + closing
    return zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % (WORDS - SHAPES), WORDS - SHAPES + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES


def _bins(value: np.ndarray, top: int = 23) -> np.ndarray:
    return np.clip(value, 0, top).astype(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_view (16-bit feature numbers), meta_view (likewise)."""
    python_ready(docs.sparkSession)
    source = docs.select("doc_id", text_of().alias("ct_text"), text_of("lang").alias("ct_lang"), text_of("source").alias("ct_source"))
    id_type = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ct_text", 2 << 20):
                texts = part.column("ct_text").cast(pa.large_string())
                lists = pc.utf8_split_whitespace(texts)
                at = np.asarray(lists.offsets, dtype=np.int64)
                at = at - at[0]
                coded = lists.flatten().dictionary_encode()
                index = coded.indices.to_numpy().astype(np.int64)
                table = np.array([_word_features(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)
                raw = texts.cast(pa.large_binary()).to_pylist()
                size = np.array(list(map(len, raw)), np.int64)
                kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
                ends = np.cumsum(size)
                share = np.zeros((9, len(raw)))
                for k in range(1, 9):
                    total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
                    share[k] = total[ends] - total[ends - size]
                full, words = np.maximum(size, 1), np.diff(at)
                content, unique = [], np.zeros(len(raw))
                for i in range(len(raw)):
                    own = np.unique(index[at[i] : at[i + 1]])
                    unique[i] = len(own)
                    content.append(np.unique(table[own]).astype(np.uint16).tobytes())
                statistics = [np.log2(full) * 1.5, np.log2(share[5] + 1) * 2, *(np.sqrt(share[k] / full) * 30 for k in (1, 3, 7, 8)), share[6] / np.maximum(words, 1) * 20, (1 - unique / np.maximum(words, 1)) * 24, size / np.maximum(words, 1), np.sqrt(share[5] / np.maximum(words, 1)) * 24]
                meta = np.stack([24 * k + _bins(v) for k, v in enumerate(statistics)], axis=1)
                hashed = [[512 + zlib.crc32(x.encode()) % 64 for x in part.column("ct_lang").to_pylist()], [576 + zlib.crc32(x.encode()) % 448 for x in part.column("ct_source").to_pylist()]]
                meta = np.concatenate([meta, np.array(hashed).T], axis=1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(content, pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())], ["doc_id", "text_view", "meta_view"])

    return source.mapInArrow(run, f"doc_id {id_type}, text_view binary, meta_view binary")


class View:
    """Naive Bayes over one view, with Platt scaling."""

    def __init__(self, size: int):
        self.weights, self.bias, self.a, self.b, self.taught = np.zeros(size), 0.0, 1.0, 0.0, False

    def fit(self, counts: np.ndarray) -> None:
        """counts[class]: documents with each feature; the last entry is the number of documents."""
        n0, n1 = counts[0, -1], counts[1, -1]
        if not n0 or not n1:
            return
        self.taught = True
        c0, c1 = counts[0, :-1], counts[1, :-1]
        p0, p1 = (c0 + 1) / (n0 + 2), (c1 + 1) / (n1 + 2)
        both = (c0 + c1 + 1) / (n0 + n1 + 2)
        z = (p1 - p0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
        self.weights = np.where(np.abs(z) >= SIGNIFICANT, np.log(p1 / p0) - np.log((1 - p1) / (1 - p0)), 0.0)
        self.bias = float(np.log(n1 / n0) + np.where(self.weights != 0, np.log((1 - p1) / (1 - p0)), 0.0).sum())

    def margin(self, views: list[bytes]) -> np.ndarray:
        size = np.array([len(v) // 2 for v in views], np.int64)
        flat = np.append(self.weights[np.frombuffer(b"".join(views), np.uint16)], 0.0)
        total = np.concatenate([[0], np.cumsum(flat)])
        ends = np.cumsum(size)
        return np.clip(self.bias + total[ends] - total[ends - size], -SPAN, SPAN)

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (w * (p - y)) + 1e-2 * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """doc_id; quality, text_quality, meta_quality, toxicity (calibrated probabilities); kept (quality at least one
    half and toxicity under it)."""
    known = labels.groupBy("doc_id").agg(*(F.when(F.avg(t) >= 0.5, 1).when(F.avg(t).isNotNull(), 0).cast("int").alias(t) for t in TARGETS))
    # A sort-merge join at every size: the plan, and what it costs, doesn't turn on how few labels there are.
    table = materialise(features(docs).join(known.hint("merge"), "doc_id", "left"), "views")
    sizes = {"text_view": WORDS, "meta_view": META}
    views = {(t, v): View(n) for t in TARGETS for v, n in sizes.items()}
    joint = {t: np.array([0.0, 0.0, 0.0]) for t in TARGETS}

    def fold(ids: list) -> np.ndarray:
        return np.array([zlib.crc32(str(i).encode()) % FOLD == 0 for i in ids], bool)

    def taught(batch: pa.RecordBatch, target: str, turn: int) -> dict[str, np.ndarray]:
        """For each view, the class that each row teaches it: 0, 1, or -1 for none."""
        given = np.array([-1 if x is None else x for x in batch.column(target).to_pylist()])
        own = np.where(fold(batch.column("doc_id").to_pylist()) & (given >= 0), -2, given)
        out = {}
        for view, other in (("text_view", "meta_view"), ("meta_view", "text_view")):
            out[view] = np.where(own == -2, -1, own)
            if turn:
                p = views[target, other].chance(views[target, other].margin(batch.column(other).to_pylist()))
                sure = np.where(p >= confident, 1, np.where(p <= 1 - confident, 0, -1))
                out[view] = np.where(own == -1, sure, out[view])
        return out

    for turn in range(rounds + 1):

        def count(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            total = {(t, v): np.zeros((2, n + 1), np.int64) for t in TARGETS for v, n in sizes.items()}
            for batch in batches:
                if batch.num_rows:
                    for target in TARGETS:
                        for view, classes in taught(batch, target, turn).items():
                            raw = batch.column(view).to_pylist()
                            for c in (0, 1):
                                rows = np.flatnonzero(classes == c)
                                flat = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint16)
                                total[target, view][c] += np.append(np.bincount(flat, minlength=sizes[view]), len(rows))
            for (target, view), sums in total.items():
                for c in (0, 1):
                    use = np.flatnonzero(sums[c])
                    yield pa.RecordBatch.from_arrays([pa.array([target] * len(use), pa.string()), pa.array([view] * len(use), pa.string()), pa.array([c] * len(use), pa.int32()), pa.array(use), pa.array(sums[c][use])], ["target", "view", "class", "feature", "n"])

        sums = table.mapInArrow(count, "target string, view string, class int, feature bigint, n bigint").groupBy("target", "view", "class", "feature").agg(F.sum("n").alias("n")).toPandas()
        for (target, view), own in sums.groupby(["target", "view"]):
            counts = np.zeros((2, sizes[view] + 1))
            counts[own["class"].to_numpy(), own["feature"].to_numpy()] = own["n"].to_numpy()
            views[target, view].fit(counts)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = fold(batch.column("doc_id").to_pylist())
                for target in TARGETS:
                    given = np.array([-1 if x is None else x for x in batch.column(target).to_pylist()])
                    rows = np.flatnonzero(held & (given >= 0))
                    if len(rows):
                        x = [np.round((views[target, v].margin([batch.column(v)[i].as_py() for i in rows]) + SPAN) / (2 * SPAN) * BINS).astype(np.int64) for v in sizes]
                        yield pa.RecordBatch.from_arrays([pa.array([target] * len(rows)), pa.array(x[0]), pa.array(x[1]), pa.array(given[rows])], ["target", "x", "y", "given"])

        seen = table.mapInArrow(margins, "target string, x bigint, y bigint, given bigint").groupBy("target", "x", "y", "given").agg(F.count("*").alias("n")).toPandas()
        for target, own in seen.groupby("target"):
            if own["given"].nunique() == 2:
                x = np.stack([own["x"], own["y"]], axis=1) / BINS * 2 * SPAN - SPAN
                one = np.ones(len(x))
                for k, view in enumerate(sizes):
                    views[target, view].b, views[target, view].a = _logistic(np.stack([one, x[:, k]], axis=1), own["given"].to_numpy(), own["n"].to_numpy())
                joint[target] = _logistic(np.column_stack([one, x]), own["given"].to_numpy(), own["n"].to_numpy())

    for target in TARGETS:
        if not joint[target].any():  # no calibration: the taught views as they are
            used = [views[target, v].taught for v in sizes]
            joint[target][1:] = np.array(used, float) / max(1, sum(used))
    id_type = table.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin = {(t, v): views[t, v].margin(batch.column(v).to_pylist()) for t in TARGETS for v in sizes}
                both = {t: 1 / (1 + np.exp(-np.clip(joint[t][0] + joint[t][1] * margin[t, "text_view"] + joint[t][2] * margin[t, "meta_view"], -30, 30))) for t in TARGETS}
                text, meta = (views["quality", v].chance(margin["quality", v]) for v in sizes)
                kept = (both["quality"] >= 0.5) & ((both["toxic"] < 0.5) | ~joint["toxic"].any())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (both["quality"], text, meta, both["toxic"], kept))], ["doc_id", "quality", "text_quality", "meta_quality", "toxicity", "kept"])

    return table.mapInArrow(score, f"doc_id {id_type}, quality double, text_quality double, meta_quality double, toxicity double, kept boolean")
