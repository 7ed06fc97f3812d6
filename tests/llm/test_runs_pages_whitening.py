"""Periodic runs, main text of pages and whitening against brute-force versions, on odd rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from galeworks.llm.entries import op11_periodic_runs, op12_html_extraction, op13_embedding_whitening
from galeworks.llm.mainpage import Extractor, chances, extract_main, fit_extractor, labelled_pages, leaf_blocks, mark_blocks, viterbi
from galeworks.llm.periodic import SuffixTree, kept_words, lyndon_lengths, periodic_runs, repeat_tails, word_runs
from galeworks.llm.whitening import covariance, refined_eigen, whiten, whole_numbers

DIR = "/root/testdata/sf0.001"


def brute_runs(words, least):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(s <= i and i + length <= s + n_ for s, n_, p in found if p < q):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def odd_texts(r):
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a b " * 6, "  " * 13, "x y " * 12, "É é " * 7, "😀 " * 30, "lone " + "same same2 " * 40 + "end"]
    for _ in range(150):
        words = [f"w{r.randint(1, r.choice([1, 2, 3, 40]))}" for _ in range(r.randint(0, 90))]
        if r.random() < 0.6 and words:
            a = r.randrange(len(words))
            p = 1 + (len(words) - a) // r.randint(3, 10)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        texts.append(r.choice([" ", "\n", " \t"]).join(words))
    return texts


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_against_all_periods(spark, least):
    r = random.Random(least)
    texts = odd_texts(r)
    rows = [(None if i == 5 else i % 100, t, 1, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, words string, start string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df, least).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = brute_runs(words, least)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i is None, i or 0, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=str)
    assert periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, 1)


def test_suffix_tree_extensions_and_ranks():
    r = random.Random(4)
    for size in (1, 2, 7, 60):
        text = [r.randint(1, 3) for _ in range(size)]
        tree = SuffixTree(text)
        pairs = [(a, b) for a in range(size + 1) for b in range(size + 1) if a != b]
        want = [next((k for k in range(size + 1) if max(a, b) + k >= size or text[a + k] != text[b + k]), 0) for a, b in pairs]
        assert tree.extension(*np.array(pairs).T).tolist() == want
        for turned in (False, True):
            sign = -1 if turned else 1
            order = sorted(range(size + 1), key=lambda i: [sign * c for c in text[i:]])
            assert np.argsort(tree.ranks(turned)).tolist() == order
            lengths = lyndon_lengths(tree.ranks(turned)).tolist()
            for i in range(size):
                own = [sign * c for c in text[i:]]
                assert lengths[i] == max(k for k in range(1, len(own) + 1) if all(own[:k] < own[j:k] for j in range(1, k)))


def test_long_periodic_text():
    words = [b"%d" % (i % 1700) for i in range(20000)]
    assert word_runs(words, 12).tolist() == [[0, 20000, 1700]]
    assert kept_words(words, word_runs(words, 12)) == words[:1700]
    assert word_runs([b"a"] * 30000, 12).tolist() == [[0, 30000, 1]]


def test_op11(spark):
    rows = {r["doc_id"]: r for r in op11_periodic_runs(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for r in docs:
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 12) if n < 1500 else [tuple(x) for x in word_runs([w.encode() for w in words], 12).tolist()]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        most = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *most, 1000 * most[1] // most[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
        got = rows[r["doc_id"]]
        assert tuple(got[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
    odd = spark.createDataFrame([(None, "a b c"), (0, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, repeat_tails(odd).collect()), key=str) == sorted([(None, "a b c"), (0, None), (3, "")], key=str)


def test_blocks_of_odd_markup():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts("<p>a &amp; b<br>c<p><b>d\n e</p>f<div>g<p>h</div>i") == ["a & b c", "d e", "f", "g", "h", "i"]
    assert texts('<script>var t="</p><p>x";</script><style>p{}</style><p title="a>b">y</p><!-- <p>no</p> -->z') == ["y", "z"]
    assert texts("") == texts("<p></p><div> \n</div>") == []
    assert texts("a < b > c &lt;i&gt; &#233;&nbsp;x") == ["a < b > c <i> é x"]
    assert texts('<p class="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts("<script>all is script") == texts("<!-- all is comment") == [] and texts("<p>x</p") == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e<table><tr><td>f<td>g<tr><th>h</table>") == list("abcdefgh")
    long = "<div>" * 20000 + "x" + "</i></div>" * 20000 + "<p>y" * 20000 + "<a '" * 5000
    assert len(texts(long)) == 20001
    inside = leaf_blocks("<body><article class='Post big'><p>t</p><aside>u</aside></article><p>v")
    assert [("a:article" in b.features, "nc:post" in b.features, "n:aside" in b.features) for b in inside] == [(True, True, False), (True, False, True), (False, False, False)]


def test_chain_against_all_labellings():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores, ends, steps = r.normal(size=n), r.normal(size=(2, 2)), r.normal(size=(2, 2))
        every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        weight = [ends[0, y[0]] + ends[1, y[-1]] + sum(s for s, v in zip(scores, y) if v) + sum(steps[a, b] for a, b in zip(y, y[1:])) for y in every]
        assert viterbi(scores.tolist(), ends, steps) == every[int(np.argmax(weight))]
        chance, pairs, total = chances(scores, ends, steps)
        p = np.exp(weight - np.logaddexp.reduce(weight))
        assert np.isclose(total, np.logaddexp.reduce(weight))
        assert np.allclose(chance[:, 1], [sum(q for q, y in zip(p, every) if y[i]) for i in range(n)])
        assert np.allclose(pairs, [[[sum(q for q, y in zip(p, every) if (y[i], y[i + 1]) == (a, b)) for b in (0, 1)] for a in (0, 1)] for i in range(n - 1)] or np.zeros((0, 2, 2)))
    assert viterbi([], np.zeros((2, 2)), np.zeros((2, 2))) == []


PAGE = """<html><head><title>Big title</title></head><body><header>My Site</header><nav><a href=/>Home</a> <a href=/b>About us</a></nav><main><h1>Big title</h1>
<p>First paragraph of the story, with several words in it.</p><div class="ad">Buy now! Great deals on all products.</div><p>Second one &amp; more words, as they come.</p>
<section class="comments"><h2>Comments</h2><p>I liked this very much, thank you for the article. It is great.</p></section></main><aside>Related: <a href=x>Other story</a></aside>
<div id="cookie-notice">We use cookies to improve the site. Accept</div><form><label>Email</label><input><button>Subscribe</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text_of_unseen_layouts(spark):
    """Blocks of labelled pages that were not trained on; a page written by hand; the given pages, whose article is marked."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = fit_extractor(labelled_pages(pages.where("page_id % 2 = 0")))
    wrong = every = 0
    for row in labelled_pages(pages.where("page_id % 2 = 1"), 60).collect():
        blocks = leaf_blocks(row["html"])
        truth = mark_blocks(blocks, row["main"])
        assert "\n".join(b.text for b, y in zip(blocks, truth) if y) == row["main"]
        wrong += sum(x != y for x, y in zip(truth, model.labels(blocks)))
        every += len(blocks)
    assert every > 1000 and wrong < 0.02 * every
    odd = [(1, "u", PAGE, "x", 1), (2, None, None, "x", 1), (None, "", "", "x", 1), (3, "u", "no markup", "x", 1), (1, "u", PAGE, "x", 1), (4, "w", "<article>" + "<p>Some words of text. </p>" * 20000 + "</article>", "x", 1)]
    got = extract_main(spark.createDataFrame(odd, "page_id long, url string, html string, text string, n_chars int"), model).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(r[0], r[1]) for r in odd]
    assert got[0]["text"] == "Big title\nFirst paragraph of the story, with several words in it.\nSecond one & more words, as they come." == got[4]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [got[1]["text"], got[2]["text"]] == ["", ""]
    assert got[5]["text"] == "\n".join(["Some words of text."] * 20000)
    assert extract_main(pages.where("false"), model).count() == 0


def test_without_pages_nothing_is_main(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = fit_extractor(labelled_pages(pages))
    assert isinstance(model, Extractor) and model.labels(leaf_blocks("<p>x")) == [0]
    assert op12_html_extraction(spark, DIR).count() == 50


def test_labels_follow_the_last_alignment():
    blocks = leaf_blocks("<title>T</title><h1>T</h1><p>a</p><p>b</p>")
    assert mark_blocks(blocks, "T\na\n\n b ") == [0, 1, 1, 1] and mark_blocks(blocks, "") == [0, 0, 0, 0]


def exact(vectors, scale=1024, shift=100_000):
    fine = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(np.float64(c) * scale)) + shift for c in v] for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return [i for i, _ in fine], x, n, sums, cov


def test_whitening_against_exact_fractions(spark):
    r = np.random.default_rng(6)
    vectors = [(i, [float(np.float32(c)) for c in r.normal(size=5) * [3, 1, 1, 0.3, 0.1] + 2]) for i in range(60)]
    vectors += [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [float("nan")] + [0.0] * 4), (63, [float("inf")] * 5), (0, vectors[0][1]), (None, vectors[1][1]), (64, [0.0] * 5)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, n string, component int")
    ids, x, n, sums, cov = exact(vectors)
    got = whiten(df.repartition(3), components=3).collect()
    assert len(got) == 3 * n and {g["n"] for g in got} == {n}
    values, axes = np.linalg.eigh(np.array(cov, float))
    values, axes = values[::-1], axes[:, ::-1]
    assert np.allclose([g["explained"] for g in got if g["vec_id"] == 5], values[:3] / values.sum())
    far = {}
    for i, row in zip(ids, x):
        far.setdefault(i, []).append(row)
    for k in range(3):
        mine = {}
        for g in got:
            if g["component"] == k + 1:
                mine.setdefault(g["vec_id"], []).append(g)
        want = {i: [(np.array(row) - np.array([s / n for s in sums])) @ axes[:, k] / np.sqrt(values[k]) for row in rows] for i, rows in far.items()}
        sign = np.sign(want[5][0] * mine[5][0]["whitened"])
        for i, rows in want.items():
            assert np.allclose(sorted(sign * g["whitened"] for g in mine[i]), sorted(rows), atol=1e-9)
            assert [g["deviation"] for g in mine[i]] == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in far[i]]
    assert len({g["identity_error"] for g in got}) == 1 and got[0]["identity_error"] < 1e-12


def test_covariance_is_exact_for_large_entries(spark):
    r = np.random.default_rng(7)
    vectors = [(i, [float(c) for c in r.normal(size=3) * [1e9, 1e5, 1]]) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    _, _, n, sums, cov = exact(vectors)
    got = covariance(whole_numbers(df, 1024, 100_000, "vec_id", "embedding"), 3)
    assert got[:2] == (n, sums) and [[Fraction(c, n * n) for c in row] for row in got[2]] == cov
    assert {g["deviation"] for g in whiten(df.union(df)).collect() if g["vec_id"] == 3} == {None}


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)] + [(9, [1.0])], schema)).collect()
    assert {g["component"] for g in line} == {1} and len(line) == 5 and np.isclose(line[0]["explained"], 1.0)


@pytest.mark.parametrize("values", [[9, 9 * (1 - 1e-9), 9 * (1 - 2e-9), 5, 1, 1e-6], [4, 4, 4, 2, 2, 1], [1, 0, 0, 0], [3], [2, 2]])
def test_clustered_eigenvalues(values):
    r = np.random.default_rng(8)
    d = len(values)
    q = np.linalg.qr(r.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - 0.5 * q.T @ q)
    a = (q * np.array(values, np.longdouble)) @ q.T
    found, x = refined_eigen((a + a.T) / 2)
    assert np.allclose(found, values, rtol=1e-15, atol=1e-15 * values[0])
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14 and np.abs(a @ x - x * found).max() < 1e-14 * values[0]
    if d == 6 and values[1] < values[0]:
        assert np.abs(np.abs(np.diag((q.T @ x).astype("f8"))[:3]) - 1).max() < 1e-9


def test_op13(spark):
    got = op13_embedding_whitening(spark, DIR).toPandas()
    vectors = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.floor(np.stack(vectors.embedding).astype("f8") * 1024).astype("i8") + 100_000
    n, c = len(x), x - x.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / n)
    want = c @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors.vec_id].to_numpy()
    assert np.allclose(want, mine * np.sign((want * mine).sum(0)), atol=1e-8)
    assert (got[got.component == 1].set_index("vec_id").deviation.loc[vectors.vec_id] == ((n * x - x.sum(0)) ** 2).sum(1)).all()
    assert got.identity_error.max() < 1e-10
