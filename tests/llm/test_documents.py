"""Operators that judge, count, encode, search or pack single documents."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from lodestar.llm import bpe, op01_line_quality, op03_brown_classes, op04_token_counts, op05_byte_bpe, op06_pii, op07_curve_packing, op08_cotraining

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(row):
    return row["text"] or ""


def repeated(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)})


def test_line_quality(spark, odd, clashing, empty):
    for row in op01_line_quality.line_quality(clashing).collect():
        t = text_of(row)
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words)) and row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_repeat_words"] == repeated(words)
        assert row["base_failed"] == (len(words) < 20 or 100 * repeated(words) > 30 * len(words))
        assert row["node"] == "keep" and (not row["base_failed"] or not row["kept"])
    assert op01_line_quality.line_quality(clashing).count() == odd.count()
    assert op01_line_quality.line_quality(empty).count() == 0


def test_line_quality_long_lines(spark):
    """A notice of more than 20 words is boilerplate; a long passage that near copies share is not."""
    notice, passage = " ".join(f"notice{i}" for i in "abcdefghijklmnopqrstuvwxyz"), " ".join(f"passage{i}" for i in "abcdefghijklmnopqrstuvwxyz")
    own = lambda i, n: " ".join(f"own{chr(97 + i)}{chr(97 + k)}" for k in range(n))
    rows = [(i, f"{own(i, 26)}\n{notice}\n{own(i + 10, 8)}", "en", "h", 1) for i in range(8)]
    rows += [(20, f"{own(20, 3)}\n{notice}", "en", "h", 1)]
    rows += [(30 + i, f"{passage}\n{passage[::-1]}\nedit {own(i, 2)}", "en", "g", 1) for i in range(8)]
    got = {r["doc_id"]: r for r in op01_line_quality.line_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    for i, text, *_ in rows:
        removed = 26 if i < 30 else 0
        assert (got[i]["removed_words"], got[i]["removed_lines"], got[i]["kept"]) == (removed, removed // 26, i != 20)
        assert got[i]["clean_text"] == (text.replace(notice + "\n", "").replace("\n" + notice, "") if removed else text)


def test_line_quality_removes_boilerplate(spark):
    word = lambda *n: "".join(chr(97 + k % 26) + chr(97 + k // 26) for k in n)  # noqa: E731  digits would count as one
    body = lambda i: " ".join("w" + word(i, k) for k in range(30))
    rows = [(i, f"All  rights Reserved {2000 + i}\n{body(i)}", "en", "h", 1) for i in range(8)]
    rows += [(100 + i, "All rights reserved 1\n" * 12 + f"tail {word(i)} a b c d e f g h", "en", "h", 1) for i in range(2)]
    rows += [(200 + i, f"{body(99)}\nsame text", "en", "h", 1) for i in range(30)]  # copies have no content of their own
    rows += [(1, rows[1][1], "en", "h", 1)]  # a repeated row is no second document
    got = op01_line_quality.line_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    assert len(got) == len(rows)
    got = {r["doc_id"]: r for r in got}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 4 and got[i]["clean_text"] == body(i) for i in range(8))
    assert not got[100]["kept"] and got[100]["removed_words"] == 48 and got[100]["removed_lines"] == 12
    assert got[200]["kept"] and got[200]["removed_words"] == 0


def test_line_quality_limits_are_exact(spark):
    """A share such as 0.0004 is no 0, and a line at a limit is not over it."""
    word = lambda *n: "".join(chr(97 + k % 26) + chr(97 + k // 26) for k in n)
    rows = [(i, ("a notice of the host\n" if i < 6 else "") + " ".join("w" + word(i, k) for k in range(25)), "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    removed = lambda share: sum(r["removed_lines"] for r in op01_line_quality.line_quality(docs, share=share).collect())
    assert [removed(x) for x in (0.0004, 0.0999, 0.1, 0.5)] == [6, 6, 0, 0]


def test_line_quality_odd_rows(spark, odd):
    """The SQL states it for null ids, null hosts, repeated rows, empty and very long texts alike."""
    import duckdb

    con = duckdb.connect()
    con.register("documents", odd.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(op01_line_quality.SQL).df()
    got = op01_line_quality.line_quality(odd).select(*want.columns).toPandas()
    text = lambda frame: sorted(str(tuple(None if x is None or x != x else int(x) for x in r)) for r in frame.astype(object).where(frame.notna(), None).values.tolist())
    assert text(got) == text(want)


def test_brown_base_scores(spark, odd, empty):
    rows = odd.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*text_of(r).encode().lower().split(), None] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens, strict=True) if not held(r["doc_id"]) for w in t)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((held(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True))
    got = op03_brown_classes.score(odd, passes=1).collect()
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert op03_brown_classes.score(empty).count() == 0


def test_brown_classes_learn_order(spark):
    """Words of two alternating sets: the class before tells the class after, which single counts don't."""
    import random

    r = random.Random(3)
    texts = [(i, " ".join(f"{'ab'[k % 2]}{r.randint(0, 30)}" for k in range(60)), "en", "h", 1) for i in range(400)]
    got = op03_brown_classes.score(spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint"), width=5).where("held_out").toPandas()
    assert (got["score"].sum() - got["base_score"].sum()) / got["n_tokens"].sum() > 0.15  # log10 2 is 0.30


def test_brown_probabilities_sum_to_one():
    """Over all words of a model with classes: P(w | before) sums to one but for the share of unknown words."""
    import numpy as np

    r = np.random.default_rng(0)
    flow = np.concatenate([[0], r.integers(0, 40, 3000), [0]])
    classes = np.where(np.arange(40) > 0, 1 + np.arange(40) % 4, 0)
    n, bigram = np.bincount(flow[1:], minlength=40), np.zeros((5, 5))
    np.add.at(bigram, (classes[flow[:-1]], classes[flow[1:]]), 1)
    move, in_class = op03_brown_classes.transitions(bigram, op03_brown_classes.SMOOTH)
    total, weight = n.sum(), op03_brown_classes.WEIGHT
    p = weight * move[:, classes] * n / in_class[classes] + (1 - weight) * (n + 1) / (total + 41)
    assert np.allclose(move.sum(axis=1), 1) and np.allclose(p.sum(axis=1) + (1 - weight) / (total + 41), 1)


def test_brown_exchange_against_brute_force():
    """A word that best_classes moves raises the likelihood of a full recount; hidden classes come back."""
    import numpy as np

    r = np.random.default_rng(1)
    size, width, follow = 61, 5, {0: [1], 1: [2, 3], 2: [4], 3: [4], 4: [0]}
    hidden = np.where(np.arange(size) > 0, 1 + np.arange(size) % 4, 0)
    words, at = [0], 0
    for _ in range(20_000):
        at = int(r.choice(follow[at]))
        words.append(int(r.choice(np.flatnonzero(hidden == at))))
    words = np.array(words)

    def recount(c):
        bigram = np.zeros((width, width))
        np.add.at(bigram, (c[words[:-1]], c[words[1:]]), 1)
        return bigram

    classes, better = np.where(np.arange(size) > 0, r.integers(1, width, size), 0), []
    for turn in range(16):
        bigram = recount(classes)
        counts = np.zeros((size, 2 * width), np.int64)
        np.add.at(counts, (words[:-1], classes[words[1:]]), 1)
        np.add.at(counts, (words[1:], width + classes[words[:-1]]), 1)
        owner, codes = np.nonzero(counts)
        got = op03_brown_classes.best_classes(owner, codes, counts[owner, codes], classes, bigram)
        for w in np.flatnonzero(got != classes):
            if w:
                better.append(op03_brown_classes.information(recount(np.where(np.arange(size) == w, got[w], classes))) > op03_brown_classes.information(bigram))
        classes = np.where((np.arange(size) % 2 == turn % 2) & (np.arange(size) > 0), got, classes)
    assert len(better) > 20 and np.mean(better) > 0.95
    assert op03_brown_classes.information(recount(classes)) > 0.9 * op03_brown_classes.information(recount(hidden))


def test_brown_counts_in_bounded_memory():
    """What a task holds doesn't grow with words times classes: neither for a chunk's contexts nor for a shard's sums."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Rows:  # hands out the function that Spark would run over batches
        def __getattr__(self, name):
            return lambda *_, **__: self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    r, width, size = np.random.default_rng(2), 400, 40_000
    words = np.sort(r.choice(1 << 62, size, replace=False).astype(np.int64))
    flow, no = r.integers(0, size + 1, 200_000).astype(np.uint32), pa.array([[]], pa.list_(pa.struct([("shard", pa.int64()), ("values", pa.binary())])))
    chunk = pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()]) for x in (words, flow, np.zeros(1, bool), np.array([len(flow)], np.uint32))), no], ["words", "flow", "held", "lengths", "classes"])
    tracemalloc.start()
    sent = list(op03_brown_classes.contexts(Rows(), {}, width, 3, (0, 2))(iter([chunk])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # a table of all words and contexts would be 128 MB
    got = Counter()
    for row in (x for batch in sent for x in batch.to_pylist() if x["shard"] >= 0):
        n = np.frombuffer(row["n"], np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(row["large"], np.int64)
        cells = zip(np.repeat(np.frombuffer(row["words"], np.int64), np.frombuffer(row["entries"], np.uint16)).tolist(), np.frombuffer(row["codes"], np.uint16).tolist(), n.tolist(), strict=True)
        got.update({(w, c): k for w, c, k in cells})
    classes = lambda w: width - 1 if w else 0
    pairs, want = zip([0, *flow[:-1].tolist()], flow.tolist(), strict=True), Counter()
    moved = {1 + i: int(w) for i, w in enumerate(words) if (int(w) >> 60) % 2 == 0}
    for before, after in pairs:
        want.update([(moved[before], classes(after))] if before in moved else [])
        want.update([(moved[after], width + classes(before))] if after in moved else [])
    assert got == want
    assert all(size * 2 * width / 2 ** op03_brown_classes.part_bits(3, width, size) <= op03_brown_classes.CELLS for size, width in ((10, 4), (200_000, 70), (200_000, 112), (200_000, 400)))


def test_brown_parts_of_shards(spark, monkeypatch):
    """Shards counted part by part give the scores of shards counted at once."""
    import random

    r = random.Random(5)
    texts = [(i, " ".join(f"{'ab'[k % 2]}{int(r.paretovariate(0.6)) % 500}" for k in range(60)), "en", "h", 1) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    whole = sorted(op03_brown_classes.score(docs, passes=1).select("doc_id", "score").collect())
    monkeypatch.setattr(op03_brown_classes, "CELLS", 100)
    assert op03_brown_classes.part_bits(3, 10, 125) > 4
    assert sorted(op03_brown_classes.score(docs, passes=1).select("doc_id", "score").collect()) == whole


def test_brown_buckets_are_sparks(spark):
    from pyspark.sql import functions as F

    import numpy as np

    numbers = np.array([0, 1, -1, 7 << 40, 2**62, -(2**63)] + list(range(500)), np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(x),) for x in numbers], "x bigint").select(F.pmod(F.hash("x"), F.lit(11))).collect()]
    assert op03_brown_classes.bucket_of(numbers, 11).tolist() == want


def test_token_counts(spark, odd, empty, tmp_path):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds every digest
        for r in op04_token_counts.token_counts(odd, path, cache).collect():
            n = len(sp.encode(text_of(r)))
            assert r["n_tokens"] == n and r["n_bytes"] == len(text_of(r).encode()) and r["over_limit"] == (n > 4096)
    rows = spark.read.parquet(cache)
    assert rows.count() == rows.select("digest").distinct().count() == odd.select("text").na.fill("").distinct().count()
    assert op04_token_counts.token_counts(empty, path, cache).count() == 0
    extra = ["▁a ▁", "a\tb", "  lead", "trail  ", "\n", "\n\na", "a \n b", "</s> <s>"]
    import pyarrow as pa

    assert op04_token_counts.counter(path).counts(pa.array(extra)).tolist() == [len(sp.encode(x)) for x in extra]


def test_byte_bpe(spark, odd, empty):
    import base64

    import numpy as np
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = Counter()
    for r in op05_byte_bpe.encode_decode(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), path, P.PATTERN, outputs=("ids", "starts", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect():
        texts[r["doc_id"]] += 1
        t = text_of(next(x for x in odd.where(f"doc_id = {r['doc_id']}").collect()))
        want = library.encode_ordinary(t)
        assert r["ids"] == want and bytes(r["decoded"]) == t.encode() and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert all(0 <= a < b <= len(t) for a, b in zip(r["starts"], r["ends"], strict=True))
    assert op05_byte_bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    own = bpe.load(path, P.PATTERN)
    assert own.offsets("日 é", np.array(library.encode_ordinary("日 é")))[1][-1] == 3


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and op06_pii.luhn(re.sub(r"\D", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text) if ok(m[0]))


def test_pii_spans_against_regex():
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("a1@.+- (9)%é") for _ in range(80)) for _ in range(4000)] + ["a@b@c.d@e.f", "1.2.3.4.5.6.7.8", "4539 1488-0343 6467", "+1 (743) 555-3824", "@" * 2000, "1" * 20_000, "1." * 5000]
    assert all(op06_pii.base_spans(t) == brute_spans(t) for t in texts)


def test_pii(spark, odd, empty):
    extra = [(500 + i, f"call me: 030 1234 567{i} or x{i}(at)mail(dot)com; card 4539 1488 0343 6467, chapter 12 345 67{i}", "en", "h", 1) for i in range(20)]
    table = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    got = op06_pii.find(table).collect()
    assert len(got) == table.count()
    by_id = {r["doc_id"]: text_of(r) for r in table.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        base = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in brute_spans(by_id[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in op06_pii.redact(table).collect()}
    assert "[CARD]" in clean[500] and "4539" not in clean[500] and clean[0] is None and clean[5] == by_id[5]
    assert op06_pii.find(empty).count() == 0 and op06_pii.redact(empty).count() == 0


def test_label_model_trusts_agreement():
    patterns = {(3, 0, 1, 1, 1, 2, 2, 0): 50, (3, 0, 0, 0, 0, 2, 2, 0): 50, (3, 0, 1, 0, 1, 2, 2, 0): 5}
    belief = op06_pii.label_model(patterns)
    assert belief[3, 0, 1, 1, 1, 2, 2, 0] > 0.9 > 0.1 > belief[3, 0, 0, 0, 0, 2, 2, 0]


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    import numpy as np

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    ids = {}
    for r in odd.collect():
        own = [*library.encode(text_of(r), add_special_tokens=False).ids, 0]
        want[r["doc_id"]] += len(own)
        ids[r["doc_id"]] = own
    rows = op07_curve_packing.pack(odd, path).collect()
    have, sequences = Counter(), defaultdict(list)
    for r in rows:
        have[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert have == want
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(have.values())
    assert op07_curve_packing.pack(empty, path).count() == 0


def test_hilbert_neighbours():
    import itertools

    import numpy as np

    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
        key = op07_curve_packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("labels", [[], [(5, 1, 0)], [(5, 1, 0), (5, 0, None), (9, None, None), (None, 1, 1)]])
def test_co_training_edges(spark, odd, empty, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert op08_cotraining.co_train(odd, table).count() == odd.count()
    assert op08_cotraining.co_train(empty, table).count() == 0


def test_co_training_without_calibration(spark):
    """Toxic labels that all lie outside the calibration fold still count."""
    rows = [(i, ("vile nasty slur " if i % 4 == 0 else "calm plain prose ") * 15 + f"w{i}", "en", "h", 1) for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200) if zlib.crc32(str(i).encode()) % 5 or i % 4]
    got = op08_cotraining.co_train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert all((r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got)


def test_co_training_held_out(spark):
    SF = "/root/testdata/sf0.001"

    docs = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet")
    labels = spark.read.parquet(SF.replace("0.001", "0.1") + "/labels.parquet")
    got = op08_cotraining.co_train(docs, labels.where("doc_id % 4 <> 1")).join(labels.where("doc_id % 4 = 1").withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    assert ((got["quality"] >= 0.5) == (got["truth"] == 1)).mean() > 0.93
    assert ((got["toxicity"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.93


def test_words_with_signs_are_encoded_once(monkeypatch):
    """Runs of signs after letters are a match of their own: the letters are encoded once, as the library does it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, library = bpe.ByteBpe(Tokenizer.from_file(path), True), Tokenizer.from_file(path)
    tails = ["", ".", "?!", "$$", "%),", "'", "'s", "'!", "''s", "--", ".'s", "_", "…", "1.", "½.", "*&#@"]
    words = [w + t for w in ("word", "naïve", "日本語", "İx", "ǅ", "s", "") for t in tails]
    texts = [" ".join(words), "\n".join(words), *words, " ".join(reversed(words)), "x  " + " \t".join(words)]
    ids, at = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    slow, encode = [], own._encode
    monkeypatch.setattr(own, "_encode", lambda part: slow.append(part) or encode(part))
    own.encode(pa.array([" ".join(f"{a}{b}{t}" for a in "klmn" for b in ("ab", "éb") for t in ("%%", "$&", "!?"))]))
    assert not [x for x in slow if any(c.isalpha() for c in x)]


def test_idle_workers_forget_words(monkeypatch):
    """Python workers outlive their tasks, and other stages need the memory."""
    import gc
    import time

    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "IDLE", 0.2)
    own = bpe.ByteBpe(Tokenizer.from_file(P.path("byte_bpe_50k.json")), True)
    first = own.encode(pa.array(["some words here"]))[0].tolist()
    assert any(own.kept[True]) and gc.isenabled()
    time.sleep(1)
    assert not any(own.kept[True]) and not any(own.kept[False])
    assert own.encode(pa.array(["some words here"]))[0].tolist() == first
