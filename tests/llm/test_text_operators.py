"""Operators that look at one row at a time: 1, 2, 3, 4, 6, 7, 8, 10."""

import html as H
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from incidentflow.llm import (decontam, html_extract, langid, licenses, packing, quality, simple8b, token_counts,
                              token_files)
from incidentflow.llm import queries as Q
from incidentflow.llm.bpe import Encoder
from pyspark.sql import functions as F

from . import brute
from .rows import SF, messy_rows


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ---- 1 token counts ----

def unigram():
    """The public library's own unigram model over the same vocabulary."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, models
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    low = -1e9      # special pieces must not be matched: give them text that never occurs
    vocab = [(m.id_to_piece(i) if m.is_byte(i) or not (m.is_control(i) or m.is_unknown(i)) else f"\0{i}\0", m.get_score(i)
              if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) else low) for i in range(m.vocab_size())]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_token_counts_equal_the_library(spark, messy, docs, nothing):
    lib = unigram()
    for df in (messy, docs):
        got = rows(token_counts.token_counts(df), "doc_id", "n_chars", "n_tokens")
        want = Counter((i, len(t or ""), len(lib.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in pairs(df))
        assert got == want
    assert token_counts.token_counts(nothing).count() == 0


def test_viterbi_against_all_segmentations():
    c = token_counts.UnigramCounter([("a", -2.0), ("b", -3.0), ("ab", -5.0), ("aba", -7.0), ("ba", -5.0), ("▁", -1.0)], True)

    def best(w):
        if not w:
            return 0.0, ()
        options = []
        for k in range(1, len(w) + 1):
            p = w[-k:]
            if p in ("a", "b", "ab", "aba", "ba", "▁"):
                s = {"a": -2, "b": -3, "ab": -5, "aba": -7, "ba": -5, "▁": -1}[p]
            elif k == 1:
                s = c.unknown
            else:
                continue
            score, cut = best(w[:-k])
            options.append((score + s, k, cut + (len(p.encode()) if s == c.unknown else 1,)))
        top = max(o[0] for o in options)
        _, _, cut = max((o for o in options if o[0] == top), key=lambda o: o[1])     # earliest start wins
        return top, cut

    r = random.Random(5)
    for _ in range(200):
        w = "".join(r.choice("ab▁é") for _ in range(r.randint(1, 9)))
        score, cut = best(w)
        assert c.solve(w) == (sum(cut), score)


# ---- 2 HTML ----

def article_text(page):
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    return " ".join(H.unescape(re.sub(r"<[^>]*>", lambda t: " " if re.match(r"</?(p|br|h1)", t[0]) else "", m[1])).split())


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in Q.op2_html_extract(spark, SF).collect()}
    assert {k: v.text for k, v in got.items()} == want
    assert all(v.n_chars == len(v.text) and v.url for v in got.values())


PAGE = """<html><head><title>no</title><script>"<p>no</p>"</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div id="cookie-notice"><p>We use cookies.</p></div>
<main><h1>Title &amp; more</h1><p>First  paragraph<br>goes&nbsp;on, with a <a href=x>link</a>.<p>Second&#33; <!-- no --><div
class='sidebar widget'><p>Related</p></div><table><tr><td>cell one<td>cell two</table><form><label>Name</label></form></main>
<section class="comments"><p>Nice article, said a reader, and so on.</p></section><footer>&copy; me</footer>"""


def test_html_cases(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (2, "v", "", 3), (2, "v", "<p>", 4), (3, "w", "<!-- x", 5),
                                (4, "x", "<script>a", 6), (1, "u", PAGE, 1), (5, "y", "<article>" + "<p>word</p>" * 5000, 7)],
                               "page_id long, url string, html string, text long")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    text = "Title & more First paragraph goes on, with a link. Second! cell one cell two"
    assert got == Counter({(1, "u", text, len(text)): 2, (None, None, "", 0): 1, (2, "v", "", 0): 2, (3, "w", "", 0): 1,
                           (4, "x", "", 0): 1, (5, "y", " ".join(["word"] * 5000), 24999): 1})
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("inside, text", [
    ("<video-player src=x></video-player>", ""),                    # custom elements are not the raw ones
    ("<title-bar>own words</title-bar>", "own words"),
    ("<script-note>own words", "own words"),
    ("<svg-icon name='a'/>", ""),
    ('<svg viewBox="0 0 1 1" data-x="a=b/" />', ""),                # closed without an end tag
    ("<math/>", ""),
    ("<svg><style/><title>no</title><g><path d='M0'/></g><svg><text>no</text></svg>no</svg>", ""),
    ("<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg>", ""),
    ("<svg><path d='M0'>", ""),                                     # unclosed: the next paragraph ends it
    ("<div><video src=x></div>", ""),                               # unclosed: ends with what holds it
    ("<div><button>no</div>", ""),
    ("<select><option>no<option>no</select>", ""),
    ("<video><canvas>no</video>", ""),
    ("<object><p>no</p><button>no</object>", ""),
    ("<script>'<p>no</p>'</script >", ""),
    ("<textarea><p>no</textarea>", ""),
])
def test_html_elements_without_text(inside, text):
    got = [b.text for b in html_extract.blocks(f"<article><p>a</p>{inside}<p>rest</p></article><p>end</p>")]
    assert got == ["a", *([text] if text else []), "rest", "end"]


def test_html_raw_text_to_the_end():
    for tag in ("script", "style", "iframe", "textarea", "title", "noscript"):
        assert [b.text for b in html_extract.blocks(f"<p>a</p><{tag}>no</{tag}-x><p>no</p>")] == ["a"]


PROSE = ["The council met on Tuesday, spoke for three hours, and put off the vote on the new bridge to May.",
         "Two members asked for figures; the mayor, who had none at hand, promised a report within a week.",
         "Work on the old bridge goes on, with one lane closed at night and no change to the bus lines."]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in PROSE)


def content(page):
    own = html_extract.blocks(page)
    return [b.text for b, good in zip(own, html_extract.label(own, html_extract.DEFAULT)) if good]


@pytest.mark.parametrize("before, after", [
    ('<div id="page" class="site has-sidebar">', "</div>"),
    ('<main class="no-sidebar">', "</main>"),
    ('<article class="post with-comments hide-related">', "</article>"),
    ('<div class="sidebar-right"><article>', "</article></div>"),          # article below a weak word
    ('<div class="content-sidebar"><div>', "</div></div>"),                # strong text below a weak word
    ('<form id="page-form"><main><article>', "</article></main></form>"),
    ('<div class="siteHeader-share"><div class="a">', "</div></div>"),
])
def test_html_layout_words_do_not_drop_the_text(before, after):
    page = f"<body class='sidebar'><nav><a href=/>Home</a></nav>{before}{PARAGRAPHS}{after}<footer>&copy; us</footer>"
    assert content(page) == PROSE


@pytest.mark.parametrize("name", ["commentlist", "commentList", "comment-list", "reader-talk", "u17"])
def test_html_comments_below_content(name):
    items = "".join(f"<li><a href=/u/{i}>user {i}</a></li><li><a href=#r>Reply</a></li>" for i in range(3))
    assert content(f"<article><h1>Bridge vote</h1>{PARAGRAPHS}<div class='{name}'><ul>{items}</ul></div></article>") \
        == ["Bridge vote", *PROSE]


def test_html_teasers_of_related_pages():
    teasers = "".join(f"<article class='post'><div class='entry'><a href=/{i}>Other news {i}</a></div></article>" for i in range(4))
    assert content(f"<div class='text'>{PARAGRAPHS}</div><div class='related'>{teasers}</div>") == PROSE


def test_html_pages_without_article():
    links = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(5))
    page = f"<div class='top'><ul>{links}</ul></div><div class='x1'>{PARAGRAPHS}</div><div class='x2'><ul>{links}</ul></div>"
    assert content(page) == PROSE


def test_html_cut_can_outweigh_the_elements():
    sure = np.array([9.0, 0, 0, 0, 0, 0, 0])
    alone = html_extract.blocks("<nav><p>a b</p></nav>")
    assert html_extract.label(alone, sure) == [False] and html_extract.label(alone, -sure) == [False]
    own = html_extract.blocks("<p>a b</p>" * 3)
    own[1].evidence = alone[0].evidence
    assert html_extract.label(own, sure) == [True] * 3
    own[1].evidence = -alone[0].evidence
    assert html_extract.label(own, -sure) == [False] * 3


def test_minimum_cut_against_all_cuts():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 8)
        u = [r.randint(-8, 8) / 2 for _ in range(n)]
        e = [(a, b, r.randint(0, 6) / 4) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(side):
            return (sum(-x if s and x < 0 else x if not s and x > 0 else 0 for s, x in zip(side, u))
                    + sum(w for a, b, w in e if side[a] != side[b]))

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_extract.minimum_cut(u, e)) - best) < 1e-9


@pytest.mark.parametrize("page, texts", [
    ("<p don't>a</p><p>it's b</p>", ["a", "it's b"]),                # a quote opens a value only after =
    ("<p title=it's>a</p><p class = 'x > y'>b</p>", ["a", "b"]),
    ("<p>a</p><!--><p>b</p><!---><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><!-- x > --!><p>b</p><!-- y", ["a", "b"]),
    ("<p>a</ p> b</p></><p>c</p>", ["a b", "c"]),
    ("<p>a</p><p>b <a href='x", ["a", "b"]),                         # cut off by the end of the page
    ("<p>a</p><p>b <a title='x>c</p>", ["a", "b"]),
    ("<p>1 < 2 <3 </", ["1 < 2 <3 </"]),
    ("<p>a</p><script>no</script x='>' ><p>b</p>", ["a", "b"]),
    ("<svg a=b/><p>b</p>", ["b"]), ("<svg a=b/>no</svg>c", ["c"]), ("<svg a=b />c", ["c"]),
    ("<p/>a<br/>b<p a=/>c", ["a", "b", "c"]),
])
def test_html_reads_tags_as_a_browser(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


@pytest.mark.parametrize("unit, tail", [("<a ", ""), ("</script ", ""), ("<!-- ", ""), ("<script>", ""), ("<p x='", ""),
                                        ("<b>", "</i>" * 50000), ("<b>", "x<br>" * 50000), ("<i a=b/ ", ">"), ("= a=", "")])
def test_html_time_grows_with_the_page(unit, tail):
    page = "<p>a</p>" + unit * (200000 // len(unit)) + tail
    start = time.perf_counter()
    assert html_extract.blocks(page)[0].text == "a"
    assert time.perf_counter() - start < 10


def test_minimum_cut_of_many_open_blocks():
    r = random.Random(4)
    n = 10000
    u = [r.uniform(-1, 1) for _ in range(n)]
    e = [(i - 1, i, 0.6) for i in range(1, n)]
    start = time.perf_counter()
    side = html_extract.minimum_cut(u, e)
    assert time.perf_counter() - start < 10
    # on a path the best cut follows from one pass over the nodes
    keep, drop = max(-u[0], 0), max(u[0], 0)
    for x in u[1:]:
        keep, drop = min(keep, drop + 0.6) + max(-x, 0), min(drop, keep + 0.6) + max(x, 0)
    cost = sum(-x if s and x < 0 else x if not s and x > 0 else 0 for s, x in zip(side, u))
    assert abs(cost + 0.6 * sum(a != b for a, b in zip(side, side[1:])) - min(keep, drop)) < 1e-6


# ---- 3 quality ----

def test_quality_base(spark, messy, docs, nothing):
    for df in (messy, docs):
        q = quality.quality_rules(df)
        got = rows(q, "doc_id", *[f"quality.{c}" for c in (*quality.BASE, "base_failed")])
        assert got == Counter((i, *brute.quality(t)) for i, t in pairs(df))
        assert q.filter("quality.base_failed and quality.kept").count() == 0
        assert q.columns == [*df.columns, "quality"]
    assert quality.quality_rules(nothing).count() == 0


def test_quality_order_changes_no_verdict(messy):
    names = list(quality.rules())
    a, b = (rows(quality.quality_rules(messy, order=o), "doc_id", "quality.kept") for o in (names, names[::-1]))
    assert a == b
    assert sorted(quality.plan_cascade(messy)) == sorted(names)


def test_quality_filters_on_every_field(docs):
    """A filter on any field stays above the statistics: the plan does not copy them, and the rows are the same."""
    q = quality.quality_rules(docs, order=list(quality.rules()))
    whole = [r.quality for r in q.select("quality").collect()]
    for field, test in [*((c, lambda v: v > 5) for c in quality.BASE), ("base_failed", lambda v: not v), ("kept", bool),
                        ("rule", lambda v: v is None)]:
        at = F.col(f"quality.{field}")
        kept = q.filter(at > 5 if field in quality.BASE else ~at if field == "base_failed" else at if field == "kept" else at.isNull())
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_distinct") <= 8, field
        assert kept.count() == sum(bool(test(r[field])) for r in whole), field


def test_quality_order_is_the_same_in_every_run(docs):
    assert len({tuple(quality.plan_cascade(docs)) for _ in range(3)}) == 1


def test_quality_keeps_good_documents(spark):
    kept = Q.op3_quality_rules(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed")
    assert kept.filter("quality = 1 and not kept").count() == 0
    assert kept.filter("quality = 0 and kept").count() <= 0.1 * kept.filter("quality = 0").count() + 1


# ---- 4 language ----

def test_language(spark, nothing, messy):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, sample_rows=300).join(docs.select("doc_id", "lang"), "doc_id").collect()
    import zlib
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    m = {r.doc_id: r for r in langid.identify(messy).collect()}
    assert m[0].lang_pred == m[1].lang_pred == m[2].lang_pred == m[21].lang_pred == "und" and m[8].lang_pred == "en"
    assert langid.identify(nothing).count() == 0
    none = langid.identify(messy.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_language_rare_label(spark):
    """A rare language is learned in a large table as in a small one; a repeated row takes one place."""
    r = random.Random(4)

    def words(letters):
        return " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20))

    rare = [(i, words("wxyzk"), "rr") for i in range(30)]
    common = [(100 + i, words("abcde"), "cc") for i in range(4000)] + [(7, "abcde bcdea", "cc")] * 1000
    for more in (common[:60], common):
        got = langid.identify(spark.createDataFrame(rare + more, "doc_id long, text string, lang string"), sample_rows=100)
        assert {x.lang_pred for x in got.filter("doc_id < 30 and doc_id <> 7").collect()} == {"rr"}
        assert {x.lang_pred for x in got.filter("doc_id >= 100").collect()} == {"cc"}


def test_language_quotas():
    assert langid._quotas({"a": 9000, "b": 3000, "c": 10}, 100) == {"a": 33 + 18, "b": 33 + 5, "c": 10}
    assert langid._quotas({"a": 5, "b": 7}, 100) == {"a": 5, "b": 7}
    assert langid._quotas({"a": 5, "b": 7, "c": 1}, 2) == {"a": 1, "b": 1, "c": 1}


# ---- 6 licences ----

def test_licenses(messy, docs, nothing):
    for df in (messy, docs):
        got = licenses.license_scan(df)
        assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(
            (i, *brute.licenses(t)) for i, t in pairs(df))
        assert got.filter("score < 0 or score > 1").count() == 0
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r for r in licenses.license_scan(messy).collect()}
    assert by[19].labels == "bsd,bsd-3-clause,gpl,gpl-2.0-only,gpl-2.0-only with classpath-exception-2.0,mit" and by[19].score == 1
    assert {"apache-2.0", "gpl-3.0", "cc-by-nc"} <= set(by[18].labels.split(",")) and by[0].score == 0
    assert licenses.license_scan(nothing).count() == 0


@pytest.mark.parametrize("text,want", [("a or b and c", "a b c and or".split()), ("(a or b) and c", "a b or c and".split()),
                                       ("a and b with e or c", "a b e with and c or".split()), ("a or", None), ("(a", None),
                                       ("a)", None), ("a b", None), ("", None), ("and a", None)])
def test_shunting_yard(text, want):
    assert licenses.rpn(text) == want


@pytest.mark.parametrize("text, named, required", [
    ("MIT OR GPL-2.0", "mit gpl gpl-2.0", ""), ("MIT AND GPL-2.0", "mit gpl gpl-2.0", "mit gpl gpl-2.0"),
    ("MIT OR (MIT AND Zlib)", "mit zlib", "mit"), ("GPL-2.0-only OR GPL-3.0-only", "gpl gpl-2.0-only gpl-3.0-only", "gpl"),
    ("(MIT OR Zlib) AND X11", "mit zlib x11", "x11"), ("a OR b AND c", "a b c", ""), ("a AND b OR a AND c", "a b c", "a")])
def test_expressions(text, named, required):
    assert licenses.evaluate(text) == (set(named.split()), set(required.split()))


def test_expression_with_exception():
    own = {"gpl", "gpl-2.0", "gpl-2.0 with x"}
    assert licenses.evaluate("GPL-2.0 WITH x") == (own, own)
    assert licenses.evaluate("(a or b) with x") is None
    assert licenses.evaluate(" or ".join(f"a{i}" for i in range(50000)))[1] == set()


# ---- 7 decontamination ----

ITEMS = [(1, "one two"), (2, messy_rows()[7][1][100:400]), (3, None), (4, ""), (None, "go go go"), (5, "x"), (5, "cc BY"),
         (6, messy_rows()[13][1]), (2, messy_rows()[17][1][:3000])]


@pytest.mark.parametrize("block,piece", [(1 << 22, 20_000), (600, 12)])
def test_decontamination(spark, messy, nothing, block, piece):
    bench = spark.createDataFrame([(*x, 0) for x in ITEMS], "item_id long, text string, words int")
    got = decontam.find_benchmark(messy, bench, block_bytes=block, piece_windows=piece)
    c = F.col("contamination")
    have = Counter((r[0], r[1], r[2], tuple(r[3])) for r in got.select(
        "doc_id", c["n_words"], decontam.n_hit(c), c["items"]).collect())
    own = pairs(messy)
    assert have == Counter((i, n, h, tuple(x)) for (i, _), (n, h, x) in zip(own, brute.leaks([t for _, t in own], ITEMS)))
    assert got.columns == [*messy.columns, "contamination"]
    assert decontam.find_benchmark(nothing, bench, block_bytes=block).count() == 0
    empty = decontam.find_benchmark(messy, bench.limit(0))
    assert empty.filter(F.size("contamination.spans") > 0).count() == 0 and empty.count() == messy.count()


def test_decontamination_repeated_items(spark, messy, monkeypatch):
    once = spark.createDataFrame(ITEMS, "item_id long, text string")
    often = once.unionByName(once.limit(1).crossJoin(spark.range(5000)).drop("id"))
    sizes, init = [], decontam.Patterns.__init__

    def spy(self, items, k):
        sizes.append(sum(len(w) + 64 for _, w in items))
        init(self, items, k)

    monkeypatch.setattr(decontam.Patterns, "__init__", spy)
    cols = ("doc_id", "contamination")
    want = rows(decontam.find_benchmark(messy, once).withColumn("contamination", F.to_json("contamination")), *cols)
    top = max(sizes)
    sizes.clear()
    got = rows(decontam.find_benchmark(messy, often).withColumn("contamination", F.to_json("contamination")), *cols)
    assert got == want and max(sizes) == top


def test_decontamination_query(spark, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    own = pairs(docs)
    got = rows(Q.op7_decontaminate(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == Counter((i, n, h, len(x), brute.sha(x), h > 0) for (i, _), (n, h, x) in zip(
        own, brute.leaks([t for _, t in own], bench)))


# ---- 8 token files, 10 packing ----

def test_encoder_equals_library():
    texts = [t for _, t, *_ in messy_rows()] + ["a\x1cb", "'s't'll", "x's!'t", "Σ ΑΣ İ", "é́", "ﬁ ½ ²", "<|startoftext|>a <|"]
    ids, off = Encoder(most=50).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == brute.ids_of(t, 0)[:-1], t


def test_simple8b_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 59, 60, 61, 1024, 1025, 5000):
        for top in (1, 2, 300, 50_000, 1 << 33, (1 << 64) - 1):
            v = r.integers(0, top, n, dtype=np.uint64, endpoint=True)
            v[::7] = 0
            words, at, esc = simple8b.encode(v)
            assert (simple8b.decode(words, at, esc, n) == v).all()
    words, _, _ = simple8b.encode(np.zeros(1024, np.uint64), 1024)
    assert len(words) == 18                                     # 60 to a word


@pytest.mark.parametrize("chunk,shards", [(1 << 16, None), (100, 3)])
def test_token_files(spark, messy, nothing, tmp_path, chunk, shards):
    token_files.write_tokens(messy, str(tmp_path / "a"), chunk=chunk, shards=shards)
    got = token_files.read_tokens(spark, str(tmp_path / "a")).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    want = Counter((i, len(x), brute.crc(x)) for i, x in ((i, brute.ids_of(t, 2)) for i, t in pairs(messy)))
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    token_files.write_tokens(nothing, str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("capacity,least", [(2048, 128), (64, 8)])
def test_packing(messy, docs, nothing, capacity, least):
    for df in (messy, docs):
        got = packing.pack(df, capacity=capacity, least=least).collect()
        seq, doc = defaultdict(list), defaultdict(list)
        for r in got:
            seq[r.sequence_id].append((r.offset, r.length))
            doc[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
            assert len(r.ids) == 4 * r.length > 0
        for s in seq.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= capacity
        want = Counter((i, len(x)) for i, x in ((i, brute.ids_of(t, 1)) for i, t in pairs(df)))
        for (i, t) in set(pairs(df)):
            x = brute.ids_of(t, 1)
            if want[(i, len(x))] == 1:
                assert [v for _, p in sorted(doc[(i, len(x))]) for v in p] == x
        assert sum(r.length for r in got) == sum(k * n for (_, k), n in want.items())
        pad = packing.padding([sum(n for _, n in s) for s in seq.values()], capacity)
        assert pad <= 0.03 * sum(r.length for r in got)
    assert packing.pack(nothing).count() == 0
