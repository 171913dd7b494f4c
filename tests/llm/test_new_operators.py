"""Whitening, main text of pages, and the divergence of sources, against plain versions of their contracts."""

import math
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.llm import divergence, pages, queries, whitening

from .conftest import SMALL

# Whitening


def check_whitened(rows, vectors, components=4):
    """``vectors``: (id, entries) of the rows that stay."""
    x = [[math.floor(Fraction(float(c)) * 256) for c in v] for _, v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(x[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = [[Fraction(n * v[k] - sums[k], n) for k in range(d)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > 1e-12 * values.sum()).sum()))
    got = defaultdict(list)
    for r in rows:
        got[r.vec_id, r.component].append(r)
    want = defaultdict(list)
    for (i, _), v in zip(vectors, x):
        deviation = sum((n * v[k] - sums[k]) ** 2 for k in range(d))
        for c in range(count):
            want[i, c + 1].append((deviation, float(np.dot([float(Fraction(n * v[k] - sums[k], n)) for k in range(d)], axes[:, c]) / math.sqrt(values[c]))))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    sign = {}
    for key, found in got.items():
        for r, (deviation, whitened) in zip(sorted(found, key=lambda r: (r.deviation, abs(r.whitened))), sorted(want[key], key=lambda w: (w[0], abs(w[1])))):
            assert r.n == n and r.deviation == deviation and abs(abs(r.whitened) - abs(whitened)) < 1e-8
            assert abs(r.explained - values[key[1] - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-8
            if abs(whitened) > 1e-6:
                assert sign.setdefault(key[1], r.whitened * whitened > 0) == (r.whitened * whitened > 0)


def test_whitening_query_equals_an_eigen_decomposition(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(60).collect()]
    # Sixty vectors in exact fractions; the whole table in doubles below.
    check_whitened(whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect(), vectors)
    rows = queries.QUERIES["op11_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(np.stack(table.embedding).astype(float) * 256)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    want = (x - fit.mean(axis=0)) @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert np.abs(np.abs(rows.whitened.to_numpy().reshape(-1, 4)) - np.abs(want)).max() < 1e-8


def test_whitening_of_odd_vectors(spark):
    odd = [(1, [0.5, -0.25, 40.0]), (1, [0.5, -0.25, 40.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [float("inf"), 0.0, 0.0]),
           (6, []), (7, [1.0, 2.0]), (None, [-3.0, 0.125, 41.0]), (8, [7.0, 7.0, 7.0]), (9, [0.001, -0.001, -90.0]), (10, [4.0, 1.0, 5.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in odd], "vec_id long, embedding array<double>, _packed string, n int")
    stay = [(i, v) for i, v in odd if v and len(v) == 3 and None not in v and all(map(math.isfinite, v))]
    check_whitened(whitening.whiten(frame).where("component > 1 or vec_id is null or vec_id is not null").collect(), stay)
    assert whitening.whiten(frame.where("false")).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and any(r.deviation is None for r in found)


@pytest.mark.parametrize("kind", ["random", "pairs", "steep", "flat", "close"])
def test_spectral_division(kind):
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 60):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        values = {"random": rng.random(d) * 9, "pairs": np.repeat(np.arange(1, d // 2 + 2.0), 2)[:d], "steep": 10.0 ** -np.arange(d), "flat": np.full(d, 3.0),
                  "close": 2 + 1e-9 * np.arange(d)}[kind]
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, axes = whitening.leading(a, 4)
        assert np.abs(found - np.sort(values)[::-1][:4]).max() < 1e-12 * values.max()
        assert np.abs(a @ axes - axes * found).max() < 1e-11 * values.max() and np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-12


# Main text


def test_main_text_of_the_given_pages(spark):
    import html as references

    rows = queries.QUERIES["op12_main_text"](spark, SMALL).collect()
    source = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(source)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", source[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        want = [" ".join(references.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


LONG = "Sentence after sentence, long enough; and more of it. " * 6
CASES = [
    # No element marks the main part: ratios decide.
    (f'<body><div class="top-nav"><a href=/>Home</a></div><div id=c><h2>Title here</h2><p>{LONG}</p><p>Second &amp; last, <a href=x>a link</a> in it.</p></div>'
     '<div class="comments"><p>Nice, very nice. I agree, totally.</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></body>',
     f"Title here\n{LONG.strip()}\nSecond & last, a link in it."),
    (f"<div><div>Home | News | Contact</div><div><p>{LONG}</p><p>{LONG}</p></div><div><ul><li><a href=1>This, and that.</a></li></ul></div></div>",
     f"{LONG.strip()}\n{LONG.strip()}"),
    # A short article wins against long notices around it.
    (f'<nav>{LONG}</nav><article><header><h1>T</h1></header><p>x<p>y &nbsp; z</p><aside>{LONG}</aside><section class="reader-comments"><p>{LONG}</p>'
     f'</section></article><div class="cookie-notice">{LONG}</div><footer>{LONG}</footer>', "T\nx\ny z"),
    (f"<article class='post has-sidebar'><ul><li>a<li>b</ul><p>{LONG}</p><table><tr><td>1<td>2</table><p>t <button>Copy</button> u</p></article>",
     f"a\nb\n{LONG.strip()}\n1\n2\nt u"),
    ("<p title=it's>one</p><p a='x>y' b=\"<i>\">two<br>three</p><!-- no end <p>four</p>", "one\ntwo three"),
    ("a < b and c > d <p", "a < b and c > d"), ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"),
    ("<script>var t = '<p>no</p>';</script><style>p{}</style><form><p>Name, please.</p></form>", ""), ("", ""), (None, ""), ("<p>  \n </p>", ""),
    ("<article>&lt;b&gt; &#233;&eacute; &copy 2020 &unknown; <b>bold</b>er</article>", "<b> éé © 2020 &unknown; bolder"),
]


def test_main_text_of_hand_made_pages(spark):
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(CASES)] + [(0, "u0", CASES[0][0], "x"), (None, None, CASES[0][0], "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = pages.extract(frame).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter(
        (i, u, CASES[i or 0][1], len(CASES[i or 0][1])) for i, u, _, _ in rows)
    assert pages.extract(frame.where("false")).collect() == []


@pytest.mark.parametrize("piece", ["<", '<p a="', "<a ", "<p>", "<div>", "<b>", "&", "<!--", "<script>", "<p>a<b>", "<li>x"])
def test_main_text_of_long_broken_pages_takes_linear_time(piece):
    started = time.time()
    pages.blocks(piece * (400_000 // len(piece)))
    assert time.time() - started < 30


# Divergence


def divergence_brute(rows, top=200, least=3):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", word.findall((text or "").translate(lower))
        docs[lang].update(set(words))
        count[lang, source].update(words)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in names:
            whole.update({t: count[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(count[lang, s]) for s in names}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return Counter(out)


def test_divergence_equals_brute_force(spark, small, odd):
    rows = [(r.text, r.lang, r.source) for r in small.collect()]
    assert Counter(map(tuple, divergence.audit(small).collect())) == divergence_brute(rows)
    some = [(f"Alpha beta{i % 3} GAMMA_delta {'ñandú ' * (i % 5)}é{i % 2} x" * (1 + i % 2), ["en", None, "de"][i % 3], f"s{i % 4}" if i % 7 else None) for i in range(60)]
    some += [(None, "en", "void"), ("", "fr", "s0"), ("!! 12", "fr", "s1"), ("lonely", "it", "s0"), ("word " * 300_000, "en", "s1")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in some], "text string, lang string, source string, _key int, term string").repartition(5)
    assert Counter(map(tuple, divergence.audit(frame, top=3).collect())) == divergence_brute(some, top=3)
    assert Counter(map(tuple, divergence.audit(odd, least=1).collect())) == divergence_brute([(r.text, r.lang, r.source) for r in odd.collect()], least=1)
    assert divergence.audit(frame.where("false")).collect() == []


def test_divergence_tells_colliding_words_apart(spark, small):
    rows = [(r.text, r.lang, r.source) for r in small.limit(40).collect()]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    few = lambda term: F.pmod(F.xxhash64(term), F.lit(13))
    assert Counter(map(tuple, divergence.audit(frame, digest=few).collect())) == divergence_brute(rows)
