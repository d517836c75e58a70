"""Operators 6 and 10: site style trees and PU learning."""

import html
import re

import numpy as np
import pytest

from plumbline.llm import queries as q
from plumbline.llm import site_style, toxicity

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["main_text"] for r in df.collect()}


def test_main_text_of_marked_articles(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in q.op6_main_text(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_main_text_prunes_what_is_named(spark):
    page = """<!DOCTYPE html><title>T</title><header class="site"><h1>Site</h1></header><div class="cookieNotice">We use cookies</div>
    <div id="sidebar"><p>x</p></div><div class="post-content"><h2>Title &amp; <i>so</i> on</h2><p>First  para<br>more &lt;b&gt; &#233; 3 < 4
    <p>Second <a href="x>y">link</a> text<ul><li>one<li>two</ul><form>Name <input> <button>go</button></form><div class="comments"><p>nice!</div>
    <!-- <p>gone</p> --><script>if(a<b){"</p>"}</script><table><tr><td>a<td>b<tr><td>c</table></div><footer>f</footer>"""
    nested = "<main><article><header><h1>H</h1></header><p>A</p><article><p>I disagree</p></article><footer>shared</footer></article></main>"
    out = texts(site_style.main_text(pages(spark, [(1, "http://a/1", page), (2, "http://a/2", nested)])))
    assert out == {1: "Title & so on\nFirst para more <b> é 3 < 4\nSecond link text\none\ntwo\na b\nc", 2: "H\nA"}


@pytest.mark.parametrize("few", [0, 10**6])
def test_style_tree_decides_where_pages_say_nothing(spark, few):
    page = "<body><div class=top>Our firm since 1900</div><div class=x><p>{0} is here</p><p>and {0} there</p></div><div class=bot><b>Call us</b></div>"
    rows = [(i, f"https://u@site.example:80/{i}?q=//", page.format(f"word{i}")) for i in range(6)]
    rows += [(10 + i, "http://copies.example", "<p>same text</p>") for i in range(6)]  # nothing but copies: kept
    out = texts(site_style.main_text(pages(spark, rows), broadcast_rows=few))
    assert out == {i: f"word{i} is here\nand word{i} there" for i in range(6)} | {10 + i: "same text" for i in range(6)}
    tree = {r["key"]: r["importance"] for r in site_style.style_tree(pages(spark, rows)).where("host like 'site%'").collect()}
    assert tree[site_style._key("body>div.top")] < 0.2 < 0.8 < tree[site_style._key("body>div.x>p")]


def test_style_tree_decides_inside_marked_roots(spark):
    """What every page of a host repeats goes from inside its article: a branch of its own, and a leaf beside real text."""
    page = "<article><h1>Title {0}</h1><div class=box><p>Read our other stories</p></div><p>Only {0} says this</p><p>Sign up now</p><p>and {0} that</p></article>"
    rows = [(i, "http://news.example/", page.format(f"word{i}")) for i in range(12)]
    rows += [(20 + i, "http://once.example/", page.format("same")) for i in range(12)]  # one page, twelve times: one page
    rows += [(40 + i, f"http://h{i}.example/", page.format("x")) for i in range(3)]  # alone on its host
    whole = lambda w: f"Title {w}\nRead our other stories\nOnly {w} says this\nSign up now\nand {w} that"
    want = {i: f"Title word{i}\nOnly word{i} says this\nand word{i} that" for i in range(12)}
    assert texts(site_style.main_text(pages(spark, rows))) == want | {20 + i: whole("same") for i in range(12)} | {40 + i: whole("x") for i in range(3)}


def test_root_is_chosen_by_its_text(spark):
    card = "<main><p>A long text that stands in the main element, word after word, and goes on.</p><article><p>A card</p></article></main>"
    named = '<div class="layout has-sidebar"><div class="no-comments"><p>Text one</p></div></div><div class="sidebar-wrap"><article><p>Text two</p></article></div>'
    readers = '<article><p>Story</p></article><div id="comments"><article><p>I disagree with all of this, and at length, again and again</p></article></div>'
    out = texts(site_style.main_text(pages(spark, [(1, "http://a", card), (2, "http://b", named), (3, "http://c", readers)])))
    assert out == {1: "A long text that stands in the main element, word after word, and goes on.\nA card", 2: "Text one\nText two", 3: "Story"}


def test_a_named_branch_that_holds_the_text_is_kept(spark):
    page = '<body><div class="menu"><p>Home {0}</p><p>About {0}</p></div><div class="widget-text"><p>{1} is what this page is about, at some length</p></div><div class="x">Body {0}</div>{2}</body>'
    readers = '<div class="comments"><p>{} I disagree with all of this, and at great length, again and again and again and once more for good measure</p></div>'
    rows = [(i, "http://a.example/", page.format(i, f"word{i}", "")) for i in range(8)]
    rows += [(20 + i, "http://c.example/", f"<div class=y>Story {i}</div>" + readers.format(i)) for i in range(8)]  # readers' parts stay what they are
    rows += [(40, "http://alone.example/", page.format(0, "word", ""))]  # one page does not tell
    out = texts(site_style.main_text(pages(spark, rows)))
    assert out == {i: f"word{i} is what this page is about, at some length\nBody {i}" for i in range(8)} | {20 + i: f"Story {i}" for i in range(8)} | {40: "Body 0"}


def test_style_tree_equals_brute_force(spark):
    import math

    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(1000 + i, "http://z", f"<p>a</p><div class=b><p>{i % 3}</p><p>x</p></div>" + "<p>b</p>" * (i % 2)) for i in range(7)]
    leaves, counts = {}, {}  # (host, path) -> text or number of blocks -> the distinct pages that show it
    for _, url, page in rows:
        found, host = site_style.blocks(page), site_style.host_of(url)
        copy = tuple(t for _, t, _, beside, _ in found if not beside)
        for path in {b[0] for b in found}:
            own = [b[1] for b in found if b[0] == path]
            counts.setdefault((host, path), {}).setdefault(len(own), set()).add(copy)
            for t in own:
                leaves.setdefault((host, path), {}).setdefault(t, set()).add(copy)
    want = {}
    for (host, path), numbers in counts.items():
        n, texts_ = [len(c) for c in numbers.values()], {t: len(c) for t, c in leaves[host, path].items()}
        m = sum(n)
        most = math.log(max(2, m))
        presentation = -sum(c / m * math.log(c / m) for c in n) / most
        content = sum(1 - math.log(c) / most for c in texts_.values()) / len(texts_)
        w = 0.9 ** len(n)
        key = site_style._key(path)
        want[host, key] = 1 - (1 - ((1 - w) * presentation + w * content)) * (1 - 1 / m)
        for t, c in texts_.items():
            if c > 1:
                want[host, key ^ site_style._key(t)] = 1 - math.log(c) / most * (1 - 1 / m)
    got = {(r["host"], r["key"]): r["importance"] for r in site_style.style_tree(pages(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_main_text_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain < text & more"), (4, "x", "<p>a</b></p><div"), (5, "x", "<script>p"), (6, "x", "<p>" * 3000 + "deep"), (7, "x", "<a href='unclosed>text"), (7, "x", "<!-- open")]
    df = pages(spark, rows).selectExpr("*", "1 AS MAIN_TEXT")
    got = site_style.main_text(df).collect()
    assert sorted((r["page_id"], r["main_text_"]) for r in got) == [(1, ""), (2, ""), (3, "plain < text & more"), (4, "a"), (5, ""), (6, "deep"), (7, ""), (7, "text")]
    assert site_style.main_text(pages(spark, [])).count() == 0


# ---- toxicity


def test_toxicity_held_out_accuracy(spark):
    out = {r["doc_id"]: r for r in q.op10_toxicity(spark, SF2).collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    import zlib

    assert set(out) == docs
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in out.items())
    held = [(labels[d], out[d]["predicted"]) for d in labels if out[d]["held_out"]]
    right = sum(a == b for a, b in held) / len(held)
    assert right >= 0.95, right


def test_features_come_in_any_number_of_passes(spark):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    one, many = toxicity.train(docs, labels), toxicity.train(docs.withColumn("f", docs.doc_id), labels.union(labels.limit(1).selectExpr("CAST(NULL AS BIGINT)", "quality", "1")), features_at_once=300)
    assert one.index == many.index and len(one.index) > 10 and (one.weights == many.weights).all()


def test_nnpu_finds_the_positives_among_the_unlabelled():
    rng = np.random.default_rng(3)

    def rows(n, toxic):
        return [np.unique(np.append(rng.integers(5, 200, 30), rng.integers(0, 5, 2) if toxic else [])).astype(np.int32) for _ in range(n)]

    hidden = rng.random(3000) < 0.2
    unlabelled = [rows(1, h)[0] for h in hidden]
    w, b = toxicity.fit_nnpu(rows(300, True), unlabelled, 200, 0.2)
    found = toxicity.Model({}, w, b).score(unlabelled) >= 0.5
    assert (found == hidden).mean() > 0.92
    assert w[:5].min() > np.abs(w[5:]).max()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, 1)], [(9, 1)], [(1, 0)]])
def test_toxicity_without_enough_labels(spark, rows):
    docs = spark.createDataFrame([(1, "a fine text"), (2, None), (2, ""), (3, "x " * 5000)], "doc_id long, text string").selectExpr("*", "0 AS score")
    model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    out = toxicity.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r["score_"] <= 1 for r in out)


def test_words_and_counts_of_features_in_chunks(spark):
    from collections import Counter

    import numpy as np
    import xxhash

    texts_ = [None, "", "Plain words, plain_words 12ab", "É ça ²x Ⅷ漢字 İstanbul ǅ", "tab\tand space x\x1cy", "ascii\x1conly\x0bhere", "naïve " * 3] + [f"repeatedly repeating word{i % 7}abc été" for i in range(600)]
    want = [toxicity._WORD.findall((t or "").lower()) for t in texts_]
    assert [toxicity.words(t) for t in texts_] == want
    counts = Counter(f for own in want for f in {f for w in own for f in toxicity.word_features(w)})
    of = {f: int(np.uint64(xxhash.xxh64_intdigest(f.encode(), 42)).view(np.int64)) for f in counts}
    df = spark.createDataFrame([(t,) for t in texts_], "text string").coalesce(1)
    got = {r["h"]: r["n"] for r in toxicity._hash_counts(df, "text", np.sort(np.array(list(of.values()), dtype=np.int64))).collect()}
    assert got == {of[f]: n for f, n in counts.items()}
