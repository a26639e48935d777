"""Operators 11 (alignment), 12 (vector codes) and 13 (repeated phrases) against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from incidentflow.llm import phrase_dedup, skew, token_alignment, vector_codes
from incidentflow.llm import queries as Q
from pyspark.sql import functions as F

from . import brute
from .rows import SF, prose


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# ---- 11 alignment ----

ODD = ["", None, " ", "  ", "a  b", "a \n b", "\n x", "日本語 é  b  c", "x\u2581y z", "<|endoftext|> </s> <0x41> <s>", "\x00 a\x00b",
       "tab\t  two", "é" * 50, "\U0001d4b3\U0001d4b4 \U0001f600\U0001f600 ok", "'s 't it's DON'T 12 345", "a\x85 b",
       "\u3000 \u3000x  ", " lead", "trail ", " <unk> \u2047 ", ".\n\n\n  x\r\n y", "\ufb01 \ufdfa", "e\u0301 \u00e9x", "\ufeff bom",
       "x\x7f y\x1f z", "嘛 嘛x", "a\u00a0 b", "a\u2003 b"]


@pytest.mark.parametrize("most", [64, 16 << 20])
def test_alignment_of_odd_texts(spark, most):
    rows = list(enumerate(ODD + ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert counted(token_alignment.align_tokens(df, most=most)) == Counter(brute.alignment(rows))


def test_alignment_of_tables(spark, messy, docs, nothing):
    for df in (messy, docs):
        assert counted(token_alignment.align_tokens(df)) == Counter(brute.alignment(pairs(df)))
    assert token_alignment.align_tokens(nothing).count() == 0


def test_alignment_of_a_very_long_text(spark):
    rows = [(1, prose(70, 60_000, 2000)), (2, "ab" * 200_000), (3, prose(71, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(token_alignment.align_tokens(df, most=1 << 18)) == Counter(brute.alignment(rows))


def test_alignment_without_chunks_is_the_same(spark, monkeypatch):
    """Files under which chunks would not be independent: whole texts, one by one."""
    rows = list(enumerate(ODD)) + [(100 + i, prose(80 + i, 50)) for i in range(10)]
    one = token_alignment.Aligner(token_alignment.A_FILE, token_alignment.B_FILE)
    assert one.chunked
    texts = [" " + t for _, t in rows if t]
    cut = one.align(texts)
    one.chunked = False
    whole = one.align(texts)
    assert (cut[0] == whole[0]).all() and cut[1] == whole[1] and (cut[2] == whole[2]).all()


# ---- 12 vector codes ----

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def check_codes(df, dim=None):
    got = counted(vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    assert got == Counter(brute.codes(rows))


def test_codes_of_documents(spark):
    check_codes(spark.read.parquet(f"{SF}/embeddings.parquet"))
    check_codes(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))


def test_codes_ties_nulls_repeats(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-3, 4)) / 512 for _ in range(8)], r.choice([None, 1, 2])) for i in range(700)]
    rows += [(5, rows[5][1], 1), (None, rows[6][1], None), (900, None, 1), (901, [1.0] * 7 + [None], 1),
             (902, [float("nan")] + [1.0] * 7, 1), (903, [float("inf")] + [1.0] * 7, 2), (904, [-100.5] * 8, 2)]
    rows += [(2000 + i, [0.25] * 8, 7) for i in range(800)]            # one label, one vector, most rows
    check_codes(vectors(spark, rows).repartition(5))


def test_codes_of_few_rows_and_odd_lengths(spark):
    check_codes(vectors(spark, [(i, [0.1 * i] * 4, i) for i in range(5)]))
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    out = vector_codes.vector_codes(vectors(spark, [(1, [0.5] * 6, 1), (2, [0.5] * 5, 1), (3, [], 2)])).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in out} == {
        1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, None)}
    empty = vector_codes.vector_codes(vectors(spark, [(1, [], 1), (2, [], 1)])).collect()
    assert [(r.code, r.error) for r in empty] == [("00000000", 0)] * 2


def test_codes_ignore_other_columns(spark):
    rows = [(i, [0.01 * i, 0.2, -0.3, 0.4 * (i % 7)], i % 3) for i in range(300)]
    df = vectors(spark, rows)
    clash = df.select("*", F.lit("x").alias("id"), F.lit(1).alias("error"), F.lit(2).alias("code"), F.lit(3).alias("copies"))
    assert counted(vector_codes.vector_codes(df)) == counted(vector_codes.vector_codes(clash))


@pytest.mark.parametrize("scale", [1, 1 << 10, 1 << 15])
def test_equal_average_search_is_exact(scale):
    r = np.random.default_rng(2)
    book = vector_codes.Codebook(r.integers(-40, 40, (256, 6)) * scale)
    x = np.concatenate([r.integers(-45, 45, (2000, 6)) * scale, book.entries, r.integers(-900, 900, (200, 6)) * scale])
    d = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    index, best = book.nearest(x)
    assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()


def test_too_large_a_component_is_an_error():
    with pytest.raises(OverflowError):
        vector_codes.integers(np.array([1e30]))


# ---- 13 repeated phrases ----

def check_phrases(df, **how):
    d = phrase_dedup.remove_repeated(df, **how)
    gone = F.aggregate("phrases.spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    got = counted(d.select("doc_id", "phrases.n_words", gone.alias("n"), "phrases.kept"))
    assert got == Counter(brute.phrases(pairs(df)))
    assert d.columns == [*df.columns, "phrases"]


def stored(spark, path, rows, parts=5):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("how", [{}, {"hot": 1, "chunk": 300, "shard": 200}])
def test_phrases_of_messy_rows(messy, how):
    check_phrases(messy, **how)


def test_phrases_of_documents(docs, nothing):
    check_phrases(docs)
    assert phrase_dedup.remove_repeated(nothing).count() == 0


@pytest.mark.parametrize("how", [{}, {"hot": 2, "chunk": 2000, "shard": 500}])
def test_phrases_shared_by_many(spark, tmp_path, how):
    """A passage of 13 words and one of 40 in different surroundings; repeated and null ids; a periodic text."""
    short, long, r = " ".join(prose(90, 30).split()[:13]), " ".join(prose(91, 60).split()[:40]), random.Random(5)
    rows = [(i, f"{prose(500 + i, 14)} {short} {prose(600 + i % 9, 20)} {long[r.randrange(9):]}") for i in range(120)]
    rows += [(i % 7, f"{prose(700 + i, 10)} {long} tail") for i in range(30)] + [(None, long), (None, f"x {short} y")]
    rows += [(300, "go " * 400), (301, "go " * 90 + "stop " + "go " * 20), (302, "a b c " * 100), (303, "b c a " * 50)]
    check_phrases(stored(spark, tmp_path / "d", rows), **how)


def test_phrases_across_blocks(spark, tmp_path):
    """More documents than a block holds, with copies far apart and the same id in several blocks."""
    rows = [(i, prose(i % 400, 30)) for i in range(1500)] + [(i % 50, prose(40 + i % 5, 30) + " " + prose(7, 20)) for i in range(900)]
    check_phrases(stored(spark, tmp_path / "d", rows, 1))


def test_phrases_of_a_very_long_text(spark, tmp_path):
    long = prose(95, 40_000, 3000)
    rows = [(1, prose(96, 30) + " " + long[:2000]), (2, long), (3, long[5000:90_000] + " end"), (4, None)]
    check_phrases(stored(spark, tmp_path / "d", rows, 2))


def test_join_counted_deals_out_frequent_keys(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 1, id) k", "id v")
    keys = rows.groupBy("k").agg(F.count("*").alias("m"), F.min("v").alias("least")).filter("k % 2 = 1")
    got = skew.join_counted(rows, keys, ["k"], "m", F.xxhash64("v"), share=10)
    assert counted(got.select("k", "v", "least")) == counted(rows.join(keys.drop("m"), "k").select("k", "v", "least"))


def test_queries_return_their_columns(spark):
    assert Q.op11_token_alignment(spark, SF).columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Q.op12_vector_codes(spark, SF).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Q.op13_phrase_dedup(spark, SF).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_chunk_cuts_take_little_memory():
    """Cuts at spaces after solid characters, in a few bytes of memory a byte of text."""
    import tracemalloc
    from incidentflow.llm.token_alignment import chunk_cuts
    texts = ["a b", " x", "é b\u00a0 c\u3000 d 字 e", "", "😀 f \t g", "\x7f h", "\u2581 i"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    first, start = chunk_cuts(np.frombuffer(b"".join(raw), np.uint8), off, True)
    want = []
    for t, o in zip(texts, off.tolist()):
        for i, c in enumerate(t):
            p = t[i - 1:i].encode()
            if i == 0 or c == " " and (0x20 < p[0] < 0x7F or p[0] >= 0x80 and p[0] not in (0xC2, 0xE1, 0xE2, 0xE3)):
                want.append(o + len(t[:i].encode()))
    assert start.tolist() == want
    assert first.tolist() == [sum(w < o for w in want) for o in off.tolist()]
    data = np.frombuffer(b"words of a text " * (1 << 16), np.uint8)
    tracemalloc.start()
    chunk_cuts(data, np.array([0, len(data)]), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data)


def test_tokenizers_are_kept_by_a_worker(tmp_path):
    from incidentflow.llm.common import kept
    made = []

    def make(path):
        made.append(path)
        return object()

    a = tmp_path / "a"
    a.write_text("1")
    one = kept(make, str(a))
    assert kept(make, str(a)) is one and len(made) == 1
    a.write_text("22")                                        # a changed file is loaded again
    assert kept(make, str(a)) is not one and len(made) == 2


def test_alignment_loads_its_tokenizers_once_a_worker(spark, monkeypatch):
    """Pass one keeps them for a worker's later tasks, pass two sets them free."""
    import pyarrow as pa
    from incidentflow.llm import token_alignment as TA
    runs, made = [], []

    class Frame:
        schema = spark.createDataFrame([], "id long, text string, row long").schema

        def mapInArrow(self, run, schema):
            runs.append(run)

    class Counted(TA.Aligner):
        def __init__(self, *files):
            made.append(files)
            super().__init__(*files)

    monkeypatch.setattr(TA, "Aligner", Counted)
    TA._slice_rows(Frame(), TA.A_FILE, TA.B_FILE, TA.SLICE)
    rows = pa.RecordBatch.from_pydict({"id": [1], "text": ["two words"], "row": [0]})
    first, second = (list(runs[0](iter([rows]))) for _ in range(2))
    assert len(made) == 1 and first == second
    TA.released(Counted)
    assert list(runs[0](iter([rows]))) == first and len(made) == 2
