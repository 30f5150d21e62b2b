"""HTML, top-k, simhash, BPE, language ID and the pipeline against brute-force versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import bpe, html_extract, langid, mixing, queries, simhash, vector_topk

from near_brute import kept_by_brute_force  # noqa: I001

SF = "/root/testdata/sf0.001"
RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, found string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (1, "the same words here again", "en", "a", 1, "x", "y"), (2, "the same words here again", "en", "a", 1, "x", "y"),
        (2, "the same words here again", "en", "a", 1, "x", "y"), (3, None, None, None, None, None, None), (4, "", "en", "b", 0, "", ""),
        (5, "la même chose ici encore " * 4000, "fr", "b", 9, "x", "y"), (None, "an unknown row of words", "en", "a", 1, "x", "y"),
        (7, "123 !!!", "en", "a", 1, "x", "y"), (8, "мир и слово", "ru", "a", 1, "x", "y"), (9, "the same words here again", None, "c", 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><header>Top</header>
<nav><ul><li>Menu</li></ul></nav><article><h1>Head&amp;Line</h1><p>One <b>bold</b>
 two&nbsp;x<br>three<p>Four &lt;ok&gt; &am</p><div class="ad-box ads">Buy</div><section id="comments"><p>Nice!</p></section>
<form><p>Send</p></form><div class="download">Keep me</div></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_html_article_only(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/x/1", PAGE, "k"), (2, None, None, "k"), (3, "http://a/x/2", "", "k"), (3, "http://a/x/2", "", "k"), (None, "http://b/", "plain <i>text</i>", "k")],
        "page_id long, url string, html string, key string",
    )
    got = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    assert got[1].text == "Head&Line\n\nOne bold two x three\n\nFour <ok> &am\n\nKeep me"
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[None].text == "plain text"
    assert html_extract.extract_text(pages).count() == 5 and html_extract.extract_text(pages.limit(0)).count() == 0


def test_html_copies_do_not_delete_each_other(spark):
    page = lambda n: f"<div>Site of things</div><p>Story {n} begins</p><p>And goes on {n}</p><div>All rights reserved</div>"
    rows = [(10 * n + k, f"http://h/s/{n}{'/copy' * (k == 2)}", page(n)) for n in range(10, 16) for k in range(3)]
    rows.append((500, "http://h/s/15", page(15).replace("begins", "began")))
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Story {i // 10} begins\n\nAnd goes on {i // 10}" for i, *_ in rows}
    assert got == want | {500: "Story 15 began\n\nAnd goes on 15"}


def test_html_differencing_without_markup(spark):
    page = lambda n: f"<div>Site of things</div><div>Menu A | B</div><p>Story {n} begins</p><p>And goes on {n}</p><div>All rights reserved</div>"
    rows = [(n, f"http://h{n % 2}/s/{n // 8}/{n}.html", page(n)) for n in range(60)] + [(99, "http://alone/", page(99))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_extract.extract_text(pages).collect():
        own = f"Story {r.page_id} begins\n\nAnd goes on {r.page_id}"
        assert r.text == own if r.page_id != 99 else own in r.text


def test_nearest_pages_cross_partitions(spark):
    random.seed(3)
    rows = sorted({(random.choice(["a", "b", "c"]), f"/{random.randint(1, 5)}/{random.randint(1, 400)}") for _ in range(500)})
    places = spark.createDataFrame([(h, p, f"{h}{p}") for h, p in rows], "host string, path string, key string")
    got = {r.key: r.partner for r in html_extract.nearest_pages(places).collect()}
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i, (host, path) in enumerate(rows):
        near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j][0] == host]
        best = max(near, key=lambda r: common(path.split("/"), r[1].split("/")), default=None)
        assert got.get(host + path) == (best and best[0] + best[1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    shared = html_extract.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
    own, rest = [x for x, s in zip(a, shared) if s], iter(b)
    assert len(own) == brute_lcs(a, b) and all(x in rest for x in own)


@pytest.mark.parametrize(("html", "lines"), [
    ('<div class="layout has-sidebar"><article><p>A text</article></div>', ["A text"]), ('<main class="search-page"><p>B</main>', ["B"]),
    ("<head><title>x</title><body><p>C", ["C"]), ("<head><title>x</title><p>C2", ["C2"]), ('<ul><li class="share">s<li>D item</ul>', ["D item"]),
    ("<article><header><h1>E head</h1></header><p>E</article>", ["E head", "E"]), ("<!-- c --!><p>F", ["F"]), ('<div class="sidebar"><article>G</article></div>', ["G"]),
    ('<section class="comments"><article>no</article></section><article>yes</article>', ["yes"]), ("<nav><article>no</article></nav>y", ["y"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]), ('<dl><dt class="ad">x<dd>ok</dl>', ["ok"]), ('<div class="site-footer">no</div>y', ["y"]),
])
def test_html_markup(html, lines):
    assert [t for r, t in html_extract.page_lines(html) if r != html_extract.CHROME] == lines


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_html_query_matches_brute_force(spark):
    """All pages: texts are the blocks of the article; counts of lines by what decided them."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: r for r in queries.op3_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    lines = {i: html_extract.page_lines(h) for i, _, h in pages}
    at = {i: re.match(r"\w+://([^/?#]*)([^?#]*)", u).groups() for i, u, _ in pages}
    content = {i: tuple(t for _, t in own) for i, own in lines.items()}
    stand = {}
    for i, (host, path) in at.items():
        stand[host, content[i]] = min(path, stand.get((host, content[i]), path))
    first = {}
    for i, url, h in pages:
        if stand[at[i][0], content[i]] == at[i][1]:
            key = hashlib.md5(f"{i}\n{url}\n{h}".encode()).hexdigest(), i
            first[at[i]] = min(first.get(at[i], key), key)
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    totals = defaultdict(int)
    for i, _, h in pages:
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|ul|li|div|table|tr)\b[^>]*>", article)]
        assert got[i].text == "\n\n".join(filter(None, blocks)) and got[i].n_chars == len(got[i].text)
        host = at[i][0]
        own, ranked = stand[host, content[i]], sorted(p for x, p in first if x == host)
        where = ranked.index(own)
        near = [ranked[n] for n in (where - 1, where + 1) if 0 <= n < len(ranked)]
        best = max(near, key=lambda p: common(own.split("/"), p.split("/")), default=None)
        shared = brute_lcs(content[i], content[first[host, best][1]]) if best is not None else 0
        assert got[i].shared == shared
        chrome = sum(r == html_extract.CHROME or (r == html_extract.OTHER and any(x == html_extract.MAIN for x, _ in lines[i])) for r, _ in lines[i])
        assert got[i].named == chrome - (shared - got[i].put_back)
        totals["deleted by differencing"] += shared - got[i].put_back
        totals["put back"] += got[i].put_back
    assert min(totals.values()) > 0


def test_long_alignments_are_halved(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, 300), rng.integers(0, 30, 280)
    monkeypatch.setattr(html_extract, "BITS_KEPT", 50)
    shared = html_extract.shared_lines(a, b)
    rest = iter(b.tolist())
    assert shared.sum() == brute_lcs(a.tolist(), b.tolist()) and all(x in rest for x in a[shared].tolist())
    monkeypatch.undo()
    long = rng.integers(0, 10**9, 30_000)
    assert html_extract.shared_lines(long, np.delete(long, slice(0, 30_000, 3))).sum() == 20_000


# ---- top-k


def brute_top(vectors, k):
    out = []
    for q, v in vectors:
        if q is not None and q % 50 == 0 and v is not None:
            own = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in vectors if w is not None and i is not None and i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    random.seed(5)
    rows = [(i, [random.gauss(0, 0.2) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(5000, None), (5050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5100, [float("nan")] * 6), (5150, [float("inf")] * 6), (None, [0.1] * 6), (6000, [0.5] * 3)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, vector int")
    whole = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for sizes in ({}, {"block_rows": 100, "block_queries": 4}):
        got = vector_topk.exact_top_k(table, F.col("vec_id") % 50 == 0, **sizes).collect()
        assert sorted(map(tuple, got)) == brute_top(whole, 5)
    assert vector_topk.exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_reads_few_exact_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.3, (4_000, 32)))] + [(10_001 + i, [0.5] * 32) for i in range(2_000)] + [(10_000, [0.5] * 32)] * 9
    table, reads = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), []
    got = sorted(map(tuple, vector_topk.exact_top_k(table, F.col("vec_id") % 1000 == 0, reads=reads).collect()))
    whole = np.floor(256 * np.array([v for _, v in rows]))
    ids = np.array([i for i, _ in rows])
    want = []
    for q in sorted({i for i in ids.tolist() if i % 1000 == 0}):
        scores = whole @ whole[np.flatnonzero(ids == q)[0]]
        own = sorted((-s, i) for s, i in zip(scores.astype(int).tolist(), ids.tolist()) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own)]
    assert got == want and sum(reads) < 0.1 * len(rows)


# ---- simhash


def brute_fingerprint(text, k):
    words = [w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or ""))]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limit):
    root = {p: p for p in prints}
    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    listed = sorted(prints)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for p, ids in prints.items():
        least[find(p)] += ids
    return {i: min(ids) for ids in least.values() for i in ids}


def test_simhash_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_simhash(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert prints == {i: brute_fingerprint(t, 3) for i, t in text.items()}
    groups = defaultdict(list)
    for i, p in prints.items():
        groups[p].append(i)
    assert {r.doc_id: r.component_id for r in rows} == brute_components(groups, 2)


@pytest.mark.parametrize("cap", [1, 64])
def test_links_and_components_lose_nothing(spark, cap, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", cap)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    random.seed(cap)
    prints = {random.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:15]:
        for _ in range(12):  # chains of small steps
            for _ in range(random.choice((1, 2, 3))):
                p ^= 1 << random.randrange(64)
            prints.add(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    rows = [(i, [signed(p)]) for i, p in enumerate(sorted(prints))] + [(1000 + i, [signed(p)]) for i, p in enumerate(sorted(prints)[:9])]
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, print array<bigint>"), simhash.EXACT_64).collect()
    got = {r["print"][0]: r.component_id for r in found}
    groups = {p: [i for i, (x,) in rows if x == signed(p)] for p in prints}
    want = brute_components(groups, 2)
    assert {p: got[signed(p)] for p in prints} == {p: want[ids[0]] for p, ids in groups.items()}


def test_simhash_odd_rows(odd_docs):
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(odd_docs).collect()}
    assert got[1] == got[2] == got[9] == 1 and got[3] == got[4] == 3


# ---- BPE

TEXTS = [
    "", None, " ", "   ", "a  b", " a b ", "a\n\nb \n c\t", "it's we'll  I'M", "x y 　z", "naïve Ünï 漢字 テスト 🙂👩‍👩‍👧", "a" * 5000,
    "1234567 89", "\x1c a \x1c\x1c b", "<|endoftext|>", "tail  ", "\u0085x \u0085 y", "ab" * 300 + " " * 40 + "!" * 77, "é́ combining", "foo. \nBar  \n\n baz",
]


def expect(text):
    ids = ENCODING.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_matches_tiktoken(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    for table, chars in ((docs, 1 << 25), (docs, 50), (real, 100_000)):
        got = bpe.encode_digest(table, RANKS, public_tokenizers.PATTERN, bundle_chars=chars).collect()
        want = [(r.doc_id, *expect(r.text)) for r in table.select("doc_id", "text").collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(bytes(r.content) for r in back) == sorted((r.text or "").encode() for r in docs.collect())
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abIé '\n\t.1! 漢ss  "), max_size=60))
def test_bundles_cut_and_merge_as_tiktoken(text):
    bundle = bpe.Bundle(__import__("regex").compile(public_tokenizers.PATTERN))
    bundle.add(1, text)
    words = list(bundle.words)
    assert [i for c in bundle.codes[0] for i in bpe.merge(words[c].encode(), RANKS)] == ENCODING.encode_ordinary(text)


# ---- language ID


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 150 and np.mean(judged) > 0.95


def test_language_id_odd_rows(spark, odd_docs):
    got = {r.doc_id: r for r in langid.identify_languages(odd_docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[3].score == 0
    assert langid.identify_languages(odd_docs).count() == odd_docs.count()
    kept = langid.drop_unidentified(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, None, 8, 9}
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_languages(nothing).collect()} == {"und"}
    assert langid.identify_languages(odd_docs.limit(0)).count() == 0


def test_language_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    some = {r.lang: r.text[:300].rsplit(" ", 1)[0] for r in docs.where("lang in ('en', 'de') and length(text) > 400 and doc_id > 300").collect()}
    assert [s[0] for s in langid.language_spans(f"{some['de']} {some['en']}", model)] == ["de", "en"]


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(0, 3, (9, 3))
    got = langid.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        paths = [[]]
        for _ in range(n):
            paths = [p + [x] for p in paths for x in range(3)]
        value = lambda p: sum(own[i][x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert list(got[at : at + n]) == max(paths, key=value)
        at += n


def brute_language(text, model):
    """Label words one by one in plain Python; language and share of the letters."""
    mask, low = (1 << 64) - 1, (text or "").lower()
    known = [ord(c) if c.isalpha() else 0 for c in low]
    here, words = [0, 0, *known, 0], []
    for i in range(len(low) + 1):
        inside, before = i < len(low) and known[i], i > 0 and known[i - 1]
        if inside or before:
            a, b, c = here[i], here[i + 1], here[i + 2]
            bucket = ((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) * 0x9E3779B97F4A7C15 & mask) >> 48
            if inside and not before:
                script = next(n for start, n in reversed(langid.SCRIPT_STARTS) if ord(low[i]) >= start)
                words.append([np.where(model["uses"][langid.SCRIPTS.index(script)], 0.0, -1e6), 0, 0])
            words[-1][0] = words[-1][0] + model["logs"][bucket]
            words[-1][1] += bool(inside)
    best, back = None, []
    for scores, *_ in words:
        if best is None:
            best = scores
        else:
            top = int(best.argmax())
            back.append([x if best[x] >= best[top] - langid.SWITCH_PENALTY else top for x in range(len(best))])
            best = np.array([best[came] - (langid.SWITCH_PENALTY if came != x else 0) for x, came in enumerate(back[-1])]) + scores
    if best is None:
        return "und", 0.0
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    letters = np.bincount(path[::-1], [n for _, n, _ in words], len(model["langs"]))
    return model["langs"][letters.argmax()], letters.max() / letters.sum()


def test_language_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    rows = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    for r in docs.where("length(text) < 4000 OR text IS NULL").collect():
        lang, score = brute_language(r.text, model)
        assert rows[r.doc_id].lang_pred == lang and abs(rows[r.doc_id].score - score) < 1e-6


def test_language_batches_are_cut(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    texts = [r.text for r in docs.select("text").collect()]
    whole = langid._in_parts(texts, model, 8.0)
    monkeypatch.setattr(langid, "PART", 500)
    assert langid._in_parts(texts, model, 8.0).equals(whole) and len(langid._in_parts([], model, 8.0)) == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {name: [r.doc_id for r in spark.read.parquet(f"{tmp_path}/{name}").select("doc_id").collect()] for name, _ in corpus_pipeline.STAGES[:-1]}
    letters = {i for i, r in kept.items() if any(c.isalpha() for c in r.text or "")}
    assert set(ids["language_id"]) == letters
    texts = defaultdict(list)
    for i in sorted(letters):
        texts["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in kept[i].text)].append(i)
    assert sorted(ids["exact_dedup"]) == sorted(v[0] for v in texts.values())
    assert set(ids["near_dedup"]) == kept_by_brute_force([(i, kept[i].text) for i in ids["exact_dedup"]])
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", kept[i].text)) for i in ids["near_dedup"]}
    targets = {(r.doc_id): r for r in mixing.mix_report(spark.read.parquet(f"{tmp_path}/near_dedup"), seed=17).collect()}
    assert {i: ids["mixing"].count(i) * n for i, n in sizes.items()} == {i: r.taken for i, r in targets.items()}
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(ids["mixing"])
    for r in last:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expect(kept[r.doc_id].text)


def test_pipeline_odd_tables(spark, tmp_path, odd_docs):
    """Nulls, repeated rows, long texts, clashing columns, and an empty table go through all stages."""
    for name, docs in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} <= {1, 5, 8, None} and bool(rows) == (name == "odd")
