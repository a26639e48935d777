"""Operators that compare rows (5, 9), components and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from incidentflow.llm import ngram_join, suffix_dedup
from incidentflow.llm import queries as Q
from incidentflow.llm.common import Scratch
from incidentflow.llm.components import components
from incidentflow.llm.count_tree import GROUPS, CountTree, enough
from incidentflow.llm.suffix_sort import Suffixes
from pyspark.sql import functions as F

from . import brute
from .rows import SF, prose


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ---- 5 suffix arrays ----

def test_suffix_order():
    r = np.random.default_rng(1)
    for trial in range(120):
        t = r.integers(97, 97 + r.integers(1, 4), r.integers(1, 150)).astype(np.uint8)
        t = np.concatenate([t, t[:len(t) // 2], t]) if trial % 3 == 0 else t
        for depth in (5, 8, 20, 200):
            s, b = Suffixes(t, depth), t.tobytes()
            assert sorted(s.order.tolist()) == list(range(len(t)))
            head = [b[i:i + depth] for i in s.order]
            assert head == sorted(head)
            valid = np.arange(len(t)) + depth <= len(t)
            classes = {}
            for p, k in zip(*s.equal_runs(valid)):
                assert classes.setdefault(k, b[p:p + depth]) == b[p:p + depth]
            assert len(set(classes.values())) == len(classes)


def check_suffix(df, **how):
    d = suffix_dedup.suffix_dedup(df, **how)
    got = Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in d.select(
        "doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans"), "dedup.kept").collect())
    own = pairs(df)
    assert got == Counter((i, *x) for (i, _), x in zip(own, brute.suffix([t for _, t in own], 200)))
    assert d.columns == [*df.columns, "dedup"]


@pytest.mark.parametrize("how", [{}, {"hot": 2, "chunk": 500}])
def test_suffix_dedup_messy(messy, how):
    check_suffix(messy, **how)


def test_suffix_dedup_documents(docs, nothing):
    check_suffix(docs)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_dedup_hot_passage(spark, tmp_path):
    """Many documents share a passage between different texts; some share its ends as well."""
    passage = prose(50, 60)
    rows = [(i, prose(100 + i % 30, 25) + "ab"[i % 2] + passage + prose(200 + i % 17, 25)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    check_suffix(df)
    check_suffix(df, hot=3)


def test_suffix_dedup_hot_windows_in_batches(monkeypatch):
    """The windows of a salted anchor leave a task in small batches, whatever their number."""
    import pyarrow as pa
    runs = []

    class Frame:
        def repartition(self, *keys):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, schema):
            runs.append(run)

    monkeypatch.setattr(suffix_dedup, "ROWS", 50, raising=False)
    suffix_dedup._marked(Frame(), 20, 1 << 20)
    texts = [prose(i, 20).encode()[:60] for i in range(9)] + [b"x" * 30 + prose(0, 20).encode()[:30]]
    m = len(texts)
    rows = pa.RecordBatch.from_arrays(
        [pa.array([7] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array([len(t) - 19 for t in texts], pa.int32()),
         pa.array([1] * m, pa.int64()), pa.array([0] * m, pa.int32()), pa.array([True] * m), pa.array(texts, pa.binary())],
        names=["h", "c", "n", "copies", "salt", "hot", "bytes"])
    out = list(runs[0](iter([rows])))
    assert max(b.num_rows for b in out) <= 50
    got = [r for b in out for r in b.to_pylist() if r["digest"] is not None]
    seen = Counter(t[i:i + 20] for t in texts for i in range(len(t) - 19))
    assert len(got) == len(seen) == len({r["digest"] for r in got})
    assert sum(r["single"] for r in got) == sum(k == 1 for k in seen.values())
    for r in got:
        assert r["hi"] == r["lo"] + 1 and r["single"] == (seen[texts[r["c"]][r["lo"]:r["hi"] + 19]] == 1)


# ---- 9 Jaccard join ----

def check_join(df, **how):
    got = Counter((r.doc_id, r.n_shingles, r.component_id)
                  for r in ngram_join.similar_components(df, **how).collect())
    own = pairs(df)
    assert got == Counter((i, *x) for (i, _), x in zip(own, brute.groups(own)))


def test_join_messy(messy, nothing):
    check_join(messy)
    assert ngram_join.similar_components(nothing).count() == 0


def test_join_documents(docs):
    check_join(docs)


@pytest.mark.parametrize("how", [{}, {"hot": 2, "block": 3}])
def test_join_chains_and_hot_groups(spark, tmp_path, how):
    """Chains of documents just over and under the threshold, and a group of near copies."""
    r, rows = random.Random(4), []
    for chain in range(12):
        w = prose(300 + chain, 120).split()
        for step in range(8):
            rows.append((" ".join(w),))
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
    base = prose(400, 150).split()
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
        rows.append((" ".join(w),))
    r.shuffle(rows)
    spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string").repartition(6).write.parquet(
        str(tmp_path / "d"))
    check_join(spark.read.parquet(str(tmp_path / "d")), **how)


@pytest.mark.parametrize("most", [10000, 0])
def test_join_of_many_short_rows(spark, tmp_path, most):
    """A token has the same width in a slice of 70,000 rows as in a small one."""
    rows = [(i, f"w{i} one two three four five six" if i % 5000 == 0 else f"{i} {i % 7}") for i in range(70_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(100_000, "w5000 one two three four five six"), (100_001, "7 0")], "doc_id long, text string").write.mode(
        "append").parquet(str(tmp_path / "d"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.similar_components(spark.read.parquet(str(tmp_path / "d"))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got[100_000] == 5000 and got[100_001] == 7 and sum(i != c for i, c in got.items()) == 2


def test_count_tree_loses_nothing():
    r = np.random.default_rng(3)
    n = r.integers(5, 60, 400)
    x = np.array([np.bincount(r.integers(0, GROUPS, k), minlength=GROUPS) for k in n])
    x[200:300] = x[100:200] + (r.random((100, GROUPS)) < 0.05)
    n = x.sum(axis=1)
    tree = CountTree(x, n, 75)
    for i in range(len(n)):
        want = np.flatnonzero(enough(np.minimum(x, x[i]).sum(axis=1), n, n[i], 75)
                              & (100 * n >= 75 * n[i]) & (75 * n <= 100 * n[i]))
        assert set(want) <= set(tree.near(x[i], int(n[i])))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {x.v: x.c for x in got} == {v: find(v) for v in list(parent)}


# ---- pipeline ----

def whole_pipeline(rows, bench):
    """Kept (id, text) after each of the first four stages, by the definitions; the method's quality
    verdict is taken from the stage itself."""
    groups = brute.groups(rows)
    seen, near = set(), []
    for (i, t), (n, c) in sorted(zip(rows, groups), key=lambda x: x[0][0]):
        if n == 0 or c not in seen:
            near.append((i, t))
            seen.add(c)
    cut = [(i, x[3].decode("utf-8", "ignore")) for (i, _), x in zip(near, brute.suffix([t for _, t in near], 200))]
    clean = [(i, t) for (i, t), x in zip(cut, brute.leaks([t for _, t in cut], bench)) if not x[1]]
    return near, cut, clean


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    docs, got = spark.read.parquet(f"{SF}/documents.parquet"), []
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got.append(docs)
    kept = pairs(got[0])
    near, cut, clean = whole_pipeline(kept, bench)
    assert all(not brute.quality(t)[5] for _, t in kept) and len(kept) > 100
    assert sorted(pairs(got[1])) == sorted(near) and sorted(pairs(got[2])) == sorted(cut)
    assert sorted(pairs(got[3])) == sorted(clean)
    tokens = Counter()
    for r in got[4].collect():
        tokens[r.doc_id] += r.length
    assert tokens == Counter({i: len(brute.ids_of(t, 1)) for i, t in clean})
    whole = Q.QUERIES and C.run(spark, SF)
    assert whole.count() == got[4].count()


def test_pipeline_stages_on_messy_and_empty(spark, messy, nothing, tmp_path):
    import corpus_pipeline as C
    for label, docs in (("messy", messy), ("empty", nothing)):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / label / name))
            if label == "messy" and name == "quality_rules":
                continue                                        # the later stages get the messy rows as they are
            docs = spark.read.parquet(str(tmp_path / label / name))
