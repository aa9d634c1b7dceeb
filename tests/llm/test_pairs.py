"""Operators on pairs of documents or vectors, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestar.llm import graph, op02_nn_descent, op09_gear_chunks, op10_setsketch

SF = "/root/testdata/sf0.001"


def classes(links, nodes):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    want = classes(links, {n for pair in links for n in pair if pair[0] != pair[1]})
    got = {row["node"]: row["label"] for row in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want


def near_texts():
    r = random.Random(4)
    base = [[f"w{r.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    out = []
    for b in base:
        for k in range(12):  # a star: every variant is near its original, variants often not near one another
            words = list(b)
            for _ in range(k % 5):
                words[r.randrange(len(words))] = f"v{r.randint(0, 10**6)}"
            out.append(" ".join(words))
    return out + [" ".join(base[0][:60] + [f"z{i}{k}" for k in range(60)]) for i in range(8)]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, odd_rows, width):
    rows = [*odd_rows, *((1000 + i, t, "en", "h", 1) for i, t in enumerate(near_texts()))]
    sets = {}
    for i, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets[i, t] = frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])
    nodes = [(i, t) for i, t in sets if i is not None]
    links = [(a[0], b[0]) for k, a in enumerate(nodes) for b in nodes[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(links, {i for i, _ in nodes})
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = op10_setsketch.near_duplicates(frame, width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert not r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] == len(next(v for (i, _), v in sets.items() if i == r["doc_id"]))
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {5, None}


def test_near_duplicates_empty(spark, empty):
    assert op10_setsketch.near_duplicates(empty).count() == 0
    assert op10_setsketch.near_duplicates(spark.createDataFrame([(1, None), (2, "a b c d e f")], "doc_id bigint, text string")).count() == 2


def test_sketch_estimates_and_merges():
    r = np.random.default_rng(1)
    items = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = items[:2000], items[500:2500]  # similarity 0.6
    assert (op10_setsketch.sketch(a, 512)[:128] == op10_setsketch.sketch(a, 128)).all()
    x, y = op10_setsketch.sketch(a, 512), op10_setsketch.sketch(b, 512)
    assert (op10_setsketch.merge(x, y) == op10_setsketch.sketch(np.union1d(a, b), 512)).all()
    assert abs(op10_setsketch.estimate(x[None], y[None], np.array([2000]), np.array([2000]))[0] - 0.6) < 0.08
    assert op10_setsketch.estimate(x[None], x[None], np.array([2000]), np.array([2000]))[0] == 1


def vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(16).tolist(), int(i % 3)) for i in range(300)]
    center = r.standard_normal(16)
    rows += [(1000 + i, (center + 0.05 * r.standard_normal(16)).tolist(), 1) for i in range(60)]  # a dense group
    rows += [(2000 + i, (np.array(rows[i][1]) * 3 + 0.01).tolist(), rows[i][2]) for i in range(40)]  # scaled, shifted copies
    rows += [(3000, rows[0][1], 0), (3001, rows[0][1], 1), (3002, rows[0][1], None), (3003, None, 0), (3004, [0.0] * 16, 0), (3005, [None] * 16, 0), (3006, [float("nan")] * 16, 0), (3007, [float("inf")] * 16, 0), (3008, [], 0), (3009, rows[0][1][:8], 0)]
    rows += [rows[1], (None, rows[1][1], 1)]
    return rows


def test_nn_descent(spark):
    rows = vectors(spark)
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (np.array(v), label)
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.98]
    ids = {i for i, _, _ in rows if i is not None}
    want, count = classes(links, ids), {i: sum(i in pair for pair in links) for i in ids}
    got = op02_nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert op02_nn_descent.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def brute_components(rows):
    """Links of (id, vector) rows of one label at 0.98, and the smallest id that they reach."""
    ids, unit = [i for i, _ in rows], np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    return classes([(ids[i], ids[j]) for i, j in zip(a, b, strict=True)], ids)


def test_nn_descent_audit_sees_lone_pairs(spark, monkeypatch):
    """With one short start, pairs are lost that a dense group's links outnumber: the search has to go on.  One id of four
    can be audited."""
    r = np.random.default_rng(3)
    center, plain = r.standard_normal(32), r.standard_normal((900, 32))
    near = plain[:60] + 0.17 * r.standard_normal((60, 32))
    vecs = [*plain, *near, *(center + 0.01 * r.standard_normal((150, 32)))]
    rows = [(50 * int(i) + (int(i) % 4 > 0), v.tolist()) for i, v in zip(r.permutation(len(vecs)), vecs, strict=True)]
    for name, value in {"ORDERS": 1, "WINDOW": 1, "MISS": 0.9}.items():
        monkeypatch.setattr(op02_nn_descent, name, value, raising=False)
    want = brute_components(rows)
    got = {x["vec_id"]: x["component_id"] for x in op02_nn_descent.near_duplicates(spark.createDataFrame([(*x, 0) for x in rows], "vec_id bigint, embedding array<double>, label int"), k=2).collect()}
    lone = [i for i in want if sum(want[i] == c for c in want.values()) == 2]
    assert len(lone) > 60 and np.mean([got[i] == want[i] for i in lone]) >= 0.95


def drifting(clumps=40, size=60, dims=24):
    """Dense clumps; each is linked with the next by one pair only, through a way out of its middle."""
    r = np.random.default_rng(9)
    out = []
    for _ in range(clumps // 2):
        u, v, w = np.linalg.qr(r.standard_normal((dims, 3)))[0].T
        at = lambda angle: np.cos(angle) * u + np.sin(angle) * v  # noqa: B023, E731
        out += [at(0) + 0.004 * r.standard_normal(dims) for _ in range(size)]
        out += [at(0.36) + 0.004 * r.standard_normal(dims) for _ in range(size)]
        out += [at(0.09) + 0.004 * w, at(0.27) + 0.004 * w]
    return out


def test_nn_descent_leaves_dense_groups(spark, monkeypatch):
    """Lists full of closer neighbours must not hide the link between two dense groups.  From one short start the
    search may still stop before a link: 12 splits at most are let pass, where joins within components leave 24."""
    vecs = drifting()
    ids = [50 * int(i) + 1 for i in np.random.default_rng(4).permutation(len(vecs))]  # none is audited
    rows = list(zip(ids, [v.tolist() for v in vecs], strict=True))
    for name, value in {"ORDERS": 1, "WINDOW": 4, "MISS": 0.9}.items():
        monkeypatch.setattr(op02_nn_descent, name, value, raising=False)
    want = brute_components(rows)
    got = {x["vec_id"]: x["component_id"] for x in op02_nn_descent.near_duplicates(spark.createDataFrame([(*x, 0) for x in rows], "vec_id bigint, embedding array<double>, label int")).collect()}
    assert len(set(want.values())) == 20 and len(set(got.values())) <= 32


def test_nn_descent_recall_counts_each_vector_once(spark):
    truth = spark.createDataFrame([(0, k) for k in range(1, 200)] + [(500, 501)], "a bigint, b bigint")
    labels = spark.createDataFrame([(k, 0) for k in range(200)], "node bigint, label bigint")
    assert op02_nn_descent._recall(truth, labels) == (2, 0.5, 0.0)


def test_gear_is_a_rolling_hash():
    data, h, want = np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 4, np.uint8), 0, []
    for byte in data:
        h = (h << 1) + int(op09_gear_chunks._GEAR[byte]) & 0xFFFFFFFF
        want.append(h)
    assert op09_gear_chunks.gear(data).tolist() == want


def test_chunks_resist_shifts():
    r = random.Random(7)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(2000)]
    owner, digest, first, size = op09_gear_chunks.chunks([" ".join(words), " ".join(["new", "words", *words[:1000], "in", *words[1000:]])])
    assert sum(size[owner == 0]) == 2000 and max(size) <= op09_gear_chunks.LONGEST
    one, two = set(digest[owner == 0].tolist()), set(digest[owner == 1].tolist())
    assert len(one & two) > 0.97 * len(one)


def test_repeated_passages(spark, odd, empty):
    r = random.Random(9)
    fresh = lambda n: [f"q{r.randint(0, 10**7)}" for _ in range(n)]
    passage = fresh(55)
    rows = [(i, " ".join(fresh(40) + passage + fresh(30 + i)), "en", "h", 1) for i in range(30)] + [(100 + i, " ".join(fresh(90)), "en", "h", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, odd.schema)
    spans = op09_gear_chunks.repeated_spans(docs).collect()
    assert {s["doc_id"] for s in spans} == set(range(1, 30)) and all(s["first_doc_id"] < s["doc_id"] for s in spans)
    assert all(40 <= s["first_word"] and s["first_word"] + s["n_words"] <= 95 for s in spans)
    cut = {x["doc_id"]: x["text"] for x in op09_gear_chunks.without_spans(docs, op09_gear_chunks.repeated_spans(docs)).collect()}
    texts = {i: t for i, t, *_ in rows}
    assert all(cut[i] == texts[i] for i in [0, *range(100, 110)])
    assert all(" ".join(passage) not in cut[i] and set(texts[i].split()) - set(cut[i].split()) <= set(passage) for i in range(1, 30))
    assert op09_gear_chunks.repeated_spans(empty).count() == 0
    assert op09_gear_chunks.without_spans(odd, op09_gear_chunks.repeated_spans(odd)).count() == odd.count()


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    from lodestar.llm import op06_pii

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "substring dedup", "personal data", "packing"]
    from lodestar.llm import op01_line_quality
    from lodestar.llm.common import materialise

    steps = [docs]
    for _, stage in pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], SF), "test"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] == {r["doc_id"] for r in op01_line_quality.line_quality(docs).where("kept").collect()}
    assert ids[2] == {r["doc_id"] for r in op10_setsketch.near_duplicates(steps[1]).where("kept").collect()} and ids[2] == ids[3] == ids[4] == ids[5]
    assert all(not op06_pii.base_spans(r["text"]) for r in steps[4].collect())
    assert steps[5].agg({"length": "sum"}).first()[0] == sum(r["doc_tokens"] for r in steps[5].select("doc_id", "doc_tokens").distinct().collect())


def test_near_dedup_judges_rows(spark):
    """Null ids don't shield copies, and a repeated id costs no text of its own."""
    import corpus_pipeline

    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two", "three"))
    rows = [(1, one), (None, one), (None, one), (2, one), (2, two), (2, two), (None, three), (None, three), (None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, one), (2, two), (None, three), (None, None)], "doc_id bigint, text string").collect()))


def test_arrow_batches_are_bounded(empty):
    """A batch of sets or texts is held by the executor and its worker, so near dedup and packing keep it under the 8 MB of a piece."""
    import public_tokenizers

    from lodestar.llm import op07_curve_packing, op10_setsketch

    spark = empty.sparkSession
    for run in (op10_setsketch.near_duplicates, lambda d: op07_curve_packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"))):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
        run(empty)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) < 8 << 20
