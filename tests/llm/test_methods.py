"""Plain versions of the operators' methods, large batches, and tables with odd columns or none."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, op01_line_quality, op02_nn_descent, op03_brown_classes, op04_token_counts, op05_byte_bpe, op06_pii, op07_curve_packing, op08_cotraining, op09_gear_chunks, op10_setsketch
from lodestar.llm.common import pieces

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# Chunks
def plain_chunks(text):
    """(first word, words, bytes) of each chunk, byte by byte."""
    raw = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b or 1 for b in text.encode())
    words, start = [], None
    for i, b in enumerate(raw + b" "):
        if b != 32 and start is None:
            start = i
        elif b == 32 and start is not None:
            words.append((start, i))
            start = None
    if not words:
        return []
    heads, since = [], 0
    for n, (a, _) in enumerate(words):
        h = 0
        for b in raw[max(0, a - 32) : a]:
            h = (h << 1) + int(op09_gear_chunks._GEAR[b]) & 0xFFFFFFFF
        if n == 0 or h < (1 << 32) // op09_gear_chunks.MEAN:
            heads.append(n)
            since = 0
        elif since % op09_gear_chunks.LONGEST == 0:
            heads.append(n)
        since += 1
    ends = [*heads[1:], len(words)]
    return [(a, b - a, raw[words[a][0] : words[b - 1][1]]) for a, b in zip(heads, ends, strict=True)]


def plain_spans(rows):
    texts = defaultdict(list)
    for i, t in rows:
        if i is not None and t not in texts[i]:
            texts[i].append(t)
    holders = defaultdict(set)
    for i, own in texts.items():
        for t in own:
            for _, _, c in plain_chunks(t or ""):
                holders[c].add(i)
    out = set()
    for i, own in texts.items():
        hits = {}
        for t in own:
            seen = set()
            for a, n, c in plain_chunks(t or ""):
                if c in seen or min(holders[c]) != i:
                    hits[a] = (n, min(holders[c]))
                seen.add(c)
        run = []
        for a in [*sorted(hits), None]:
            if a is None or run and run[-1] + hits[run[-1]][0] != a:
                n = sum(hits[x][0] for x in run)
                if n >= op09_gear_chunks.LEAST:
                    out.add((i, run[0], n, len(run), hits[run[0]][1]))
                run = []
            run.append(a)
    return out


def test_repeated_spans_against_brute_force(spark, odd_rows):
    r = random.Random(3)
    fresh = lambda n: [f"Q{r.randint(0, 10**6)}é" for _ in range(n)]
    shared = [fresh(70) for _ in range(4)]
    rows = [(i, t) for i, t, *_ in odd_rows if t is None or len(t) < 20_000]
    for i in range(60):
        parts = [fresh(r.randint(5, 60)), r.choice(shared), fresh(r.randint(0, 30)), r.choice(shared)[10:50]]
        rows.append((1000 + i, " ".join(w + ("\n" if k % 9 == 8 else "") for p in parts for k, w in enumerate(p))))
    got = [tuple(x) for x in op09_gear_chunks.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_spans(rows) and len(got) > 60


# Personal data
def test_added_spans_against_brute_force(spark):
    r = random.Random(5)
    kinds = ["mail {0}(at)site{0}.com", "call 030 1234 567{0}", "ssn 123-45-678{0}", "account DE89370400440532013000", "card 4539 1488 0343 6467", "a{0}@b.org", "chapter 12 345 678{0}", "host 10.0.0.{0}", "+49 30 1234567{0}"]
    texts = [" words ".join(r.choice(kinds).format(r.randint(0, 9)) for _ in range(r.randint(0, 5))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    loose = [(3, op06_pii._NATIONAL), (4, op06_pii._SSN), (5, op06_pii._IBAN), (0, op06_pii._SPELLED)]

    def candidates(text):
        base = op06_pii.base_spans(text)
        out = []
        for a, _, k, b in sorted((m.start(), -m.end(), k, m.end()) for k, p in loose for m in p.finditer(text)):
            if all(b <= x or a >= y for x, _, y in base) and all(a >= y for _, _, y in out):
                out.append((a, k, b))
        return base, out

    rows = [op06_pii.pattern(t, s, own) for t in texts for own, spans in zip((True, False), candidates(t), strict=True) for s in spans]
    # Expectation maximisation row by row, as label_model() does it on counts of patterns.
    for kind in sorted({p[0] for p in rows}):
        own = [p for p in rows if p[0] == kind]
        belief = [min(0.95, max(0.05, sum(0.5 if v == 2 else v for v in p[2:5]) / 3)) for p in own]
        for _ in range(50):
            prior = (sum(belief) + 1) / (len(own) + 2)
            tables = []
            for k in range(3):
                voted = [(p[2 + k], b) for p, b in zip(own, belief, strict=True) if p[2 + k] < 2]
                yes, no = sum(b for _, b in voted), sum(1 - b for _, b in voted)
                tables.append({v: ((sum(b for w, b in voted if w == v) + 1 + v) / (yes + 3), (sum(1 - b for w, b in voted if w == v) + 2 - v) / (no + 3)) for v in (0, 1)})
            belief = [1 / (1 + math.exp(-max(-30, min(30, math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, p[2:5], strict=True) if v < 2))))) for p in own]
        model = op06_pii.label_model(Counter(rows))
        assert all(abs(model[p] - b) < 1e-6 for p, b in zip(own, belief, strict=True))
    theta = op06_pii.train(docs)
    added = 0
    for row in op06_pii.find(docs).collect():
        base, more = candidates(texts[row["doc_id"]])
        more = [s for s in more if op06_pii._features(op06_pii.pattern(texts[row["doc_id"]], s, False)) @ theta > 0]
        added += len(more)
        assert row["spans"] == ",".join(f"{op06_pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))
    assert added > 50


# Co-training
def test_co_training_against_brute_force(spark):
    """The rounds with plain loops over documents, from the same features."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("toxic", F.lit(None).cast("int"))
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], set(np.frombuffer(r["text_view"], np.uint16).tolist()), np.frombuffer(r["meta_view"], np.uint16).tolist()) for r in op08_cotraining.features(docs).collect()]
    import zlib

    fold = {i: zlib.crc32(str(i).encode()) % op08_cotraining.FOLD == 0 for i, _, _ in rows}
    weights, biases, platt = [defaultdict(float), defaultdict(float)], [0.0, 0.0], [(0.0, 1.0), (0.0, 1.0)]
    margin = lambda v, row: max(-op08_cotraining.SPAN, min(op08_cotraining.SPAN, biases[v] + sum(weights[v][f] for f in row[1 + v])))
    chance = lambda v, row: 1 / (1 + math.exp(-max(-30, min(30, platt[v][0] + platt[v][1] * margin(v, row)))))
    joint = None
    for turn in range(op08_cotraining.ROUNDS + 1):
        taught = []
        for v in (0, 1):
            own = {}
            for row in rows:
                mark = marks.get(row[0])
                if mark is not None:
                    own[row[0]] = None if fold[row[0]] else mark
                elif turn:
                    p = chance(1 - v, row)
                    own[row[0]] = 1 if p >= op08_cotraining.CONFIDENT else 0 if p <= 1 - op08_cotraining.CONFIDENT else None
            taught.append(own)
        for v in (0, 1):
            n, counts = [0, 0], [Counter(), Counter()]
            for row in rows:
                c = taught[v].get(row[0])
                if c is not None:
                    n[c] += 1
                    counts[c].update(row[1 + v])
            if not all(n):
                continue
            weights[v], biases[v] = defaultdict(float), math.log(n[1] / n[0])
            for f in set(counts[0]) | set(counts[1]):
                p0, p1 = ((counts[c][f] + 1) / (n[c] + 2) for c in (0, 1))
                both = (counts[0][f] + counts[1][f] + 1) / (sum(n) + 2)
                if abs((p1 - p0) / math.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))) >= op08_cotraining.SIGNIFICANT:
                    weights[v][f] = math.log(p1 / p0) - math.log((1 - p1) / (1 - p0))
                    biases[v] += math.log((1 - p1) / (1 - p0))
        held = [(row, marks[row[0]]) for row in rows if fold[row[0]] and marks.get(row[0]) is not None]
        if len({y for _, y in held}) == 2:
            rounded = lambda m: round((m + op08_cotraining.SPAN) / (2 * op08_cotraining.SPAN) * op08_cotraining.BINS) / op08_cotraining.BINS * 2 * op08_cotraining.SPAN - op08_cotraining.SPAN
            x, y = np.array([[1.0, *(rounded(margin(v, row)) for v in (0, 1))] for row, _ in held]), np.array([m for _, m in held])
            fit = lambda columns: op08_cotraining._logistic(x[:, columns], y, np.ones(len(y)))
            platt, joint = [tuple(fit([0, 1])), tuple(fit([0, 2]))], fit([0, 1, 2])
    got = {r["doc_id"]: r for r in op08_cotraining.co_train(docs, labels).collect()}
    for row in rows:
        r, m = got[row[0]], [margin(v, row) for v in (0, 1)]
        assert abs(r["text_quality"] - chance(0, row)) < 1e-6 and abs(r["meta_quality"] - chance(1, row)) < 1e-6
        if joint is not None:
            assert abs(r["quality"] - 1 / (1 + math.exp(-max(-30, min(30, joint[0] + joint[1] * m[0] + joint[2] * m[1]))))) < 1e-6


# Large batches
@pytest.fixture(scope="module")
def large():
    """One Arrow batch of over 20 MB of text, with null, empty and non-ASCII texts."""
    r = random.Random(8)
    words = [f"{r.choice(['Wort', 'été', 'mot', '日本', 'x'])}{r.randint(0, 5000)}" for _ in range(4000)]
    texts = [None if i % 97 == 5 else "" if i % 89 == 3 else " ".join(r.choice(words) + ("\n" if k % 50 == 49 else "") for k in range(r.randint(10, 2400))) for i in range(2600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(pieces(batch, "text"))
    assert batch.nbytes > 20 << 20 and len(parts) >= 3 and sum(p.num_rows for p in parts) == len(texts)
    return texts, parts


def test_large_batches(large):
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    texts, parts = large
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counter, library, own = op04_token_counts.counter(P.path("piece_bpe_32k.model")), Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.load(P.path("byte_bpe_50k.json"))
    multi = P.path("byte_bpe_multi_50k.tiktoken")
    import base64

    with open(multi, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tik, ranked = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.load(multi, P.PATTERN)
    for part in parts:
        column = part.column("text")
        first = part.column("doc_id")[0].as_py()
        index, words, at = op03_brown_classes._words(column)
        sets = op10_setsketch.shingle_sets(column, 4)
        counts, (ids, begin), (ranks_, begins) = counter.counts(column), own.encode(column), ranked.encode(column)
        owner, _, word, size = op09_gear_chunks.chunks([x or "" for x in column.to_pylist()])
        for i in range(part.num_rows):
            t = texts[first + i] or ""
            plain = t.encode().lower().split()
            assert [words[k] for k in index[at[i] : at[i + 1]]] == plain
            assert len(sets[i]) == (len({tuple(plain[k : k + 4]) for k in range(len(plain) - 3)}) if len(plain) > 3 else min(1, len(plain)))
            if i % 60 == 0:
                assert counts[i] == len(sp.encode(t))
                assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
                assert ranks_[begins[i] : begins[i + 1]].tolist() == tik.encode_ordinary(t)
                assert [(int(a), int(n)) for a, n in zip(word[owner == i], size[owner == i], strict=True)] == [(a, n) for a, n, _ in plain_chunks(t)]


def test_large_batches_in_spark(spark, large):
    texts, _ = large
    docs = spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}).to_pandas()).coalesce(1).select(F.col("doc_id").cast("long"), "text")
    tokens = sum(len((t or "").encode().split()) + 1 for t in texts)
    scored = op03_brown_classes.score(docs, passes=1).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).first()
    assert (scored["n"], scored["rows"]) == (tokens, len(texts))
    near = op10_setsketch.near_duplicates(docs).collect()
    assert all(r["kept"] for r in near) and len(near) == len(texts)


# Columns and rows
NAMES = ("node", "label", "digest", "n", "row", "items", "word", "host", "a", "b", "kept", "spans", "n_tokens", "sketch", "text_view", "chunk", "ids", "hits", "vec", "curve", "component", "shard")


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.lit("keep") for c in NAMES})


def judged(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def test_clashing_columns(spark, odd, clashing, tmp_path):
    """Further columns, whatever their names, change nothing."""
    for run in (
        lambda d: op03_brown_classes.score(d, passes=1).drop("score", "perplexity"),
        lambda d: op05_byte_bpe.encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, outputs=("n_tokens", "ids_sha256")),
        op06_pii.find,
        lambda d: op07_curve_packing.pack(d, P.path("byte_bpe_50k.json")).drop("sequence_id", "offset"),
        op09_gear_chunks.repeated_spans,
        op10_setsketch.near_duplicates,
    ):
        a, b = run(odd), run(clashing)
        assert a.columns == b.columns
        if "start" not in a.columns:  # pieces are cut where the ranges of a run end
            assert judged(a, *a.columns) == judged(b, *b.columns)
        else:
            assert a.groupBy("doc_id").sum("length").count() == b.groupBy("doc_id").sum("length").count()
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("keep"))
    assert judged(op08_cotraining.co_train(odd, labels.drop("text")), "doc_id", "kept") == judged(op08_cotraining.co_train(clashing, labels), "doc_id", "kept")
    kept = [c for c in clashing.columns if c != "n_tokens"]
    counted = op04_token_counts.token_counts(clashing.drop("n_tokens"), P.path("piece_bpe_32k.model"), str(tmp_path / "c"))
    assert counted.columns == [*kept, "n_bytes", "n_tokens", "over_limit"] and judged(counted, *kept) == judged(clashing, *kept)
    for whole in (op06_pii.redact(clashing), op09_gear_chunks.without_spans(clashing, op09_gear_chunks.repeated_spans(clashing))):
        assert whole.columns == clashing.columns and whole.count() == clashing.count()
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [1.0, 0.001], 3), (3, [0.0, 1.0], 3), (1, [1.0, 0.0], 3), (None, None, None)], "vec_id bigint, embedding array<double>, label int")
    assert judged(op02_nn_descent.near_duplicates(vectors), "vec_id", "n_links", "component_id", "kept") == judged(op02_nn_descent.near_duplicates(vectors.withColumns({c: F.lit("x") for c in ("node", "copies", "a", "s", "code", "component")})), "vec_id", "n_links", "component_id", "kept")


# The pipeline
def plain_pipeline(rows):
    """The first three stages with loops: verdicts by the SQL of operator 1, exact shingle sets, chunks byte by byte."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows).astype({"doc_id": "Int64"}))
    kept = {r[0] for r in con.sql(f"SELECT doc_id, kept FROM ({op01_line_quality.SQL}) WHERE kept").fetchall()}
    common = {tuple(r) for r in con.sql(op01_line_quality.SQL.split("rem AS (")[0].rstrip().rstrip(",") + " SELECT host, k FROM common").fetchall()}
    norm = lambda line: re.sub("[0-9]+", "0", " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).lower())
    texts = {}
    for r in rows:
        if r["doc_id"] in kept:
            host = "" if r["source"] is None else "h" + r["source"]
            texts[r["doc_id"]] = "\n".join(x for x in r["text"].split("\n") if not norm(x) or (host, norm(x)) not in common)
    yield dict(texts)
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    texts = {i: t for i, t in texts.items() if root(i) == i}
    yield dict(texts)
    spans = defaultdict(list)
    for i, first, n, _, _ in plain_spans(list(texts.items())):
        spans[i].append((first, n))
    for i, own in spans.items():
        starts, t = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i])], texts[i]
        starts.append(len(t))
        gone = {c for first, n in own for c in range(starts[first], starts[first + n])}
        texts[i] = "".join(ch for c, ch in enumerate(t) if c not in gone)
    yield texts


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    from lodestar.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = materialise(docs, "docs")
    rows = [r.asDict() for r in docs.collect()]
    step = docs
    for (name, stage), want in zip(pipeline.STAGES[:3], plain_pipeline(rows), strict=True):
        step = materialise(stage(spark, step, SF), "step")
        got = {r["doc_id"]: r["text"] for r in step.collect()}
        assert got == want, name
    hidden = materialise(pipeline.hide_personal_data(spark, step, SF), "step")
    theta, before = op06_pii.train(step), {r["doc_id"]: r["text"] for r in step.collect()}
    for r in hidden.collect():
        text, out, left = before[r["doc_id"]] or "", "", 0
        base = op06_pii.base_spans(text)
        for a, k, b in sorted(base + [s for s in op06_pii.loose_spans(text, base) if op06_pii.accepts(theta, op06_pii.pattern(text, s, False))]):
            if a >= left:
                out += text[left:a] + f"[{op06_pii.KINDS[k].upper()}]"
            left = max(left, b)
        assert (r["text"] or "") == out + text[left:]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in hidden.collect()}
    packed = pipeline.pack(spark, hidden, SF).collect()
    assert Counter({i: n for i, n in sizes.items()}) == Counter({i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in sizes})


def test_stages_on_odd_tables(spark, odd, empty, clashing):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        nothing = stage(spark, empty, SF)
        assert nothing.count() == 0
        got = stage(spark, clashing, SF)
        if name != "packing":
            assert nothing.columns == empty.columns and got.columns == clashing.columns, name
        rows = got.collect()
        assert name in ("quality rules", "near dedup", "packing") or len(rows) == clashing.count(), name
    blank = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "h", 0), (1, None, "en", "h", None)], SCHEMA)
    assert [stage(spark, blank, SF).count() for _, stage in pipeline.STAGES] == [0, 3, 3, 3, 3]


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
