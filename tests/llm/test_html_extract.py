import html
import re

import numpy as np

from parity.llm import boosting
from parity.llm import html_extract as H


def test_trees_learn_a_rule():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.fit(x[:3000], y[:3000], trees=30, depth=3)
    assert ((model.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_held_out_pages():
    maker, model = H._Maker(12345), H.model()
    wrong = total = 0
    for _ in range(150):
        page, want = H.labelled(maker.page())
        kept = page.decode(model.log_odds(page.features()))
        wrong += (kept[1:] != want[1:]).sum()
        total += len(want) - 1
    assert wrong / total < 0.02


def test_decoding_keeps_nothing_below_a_dropped_node_and_is_the_likeliest():
    page = H.Page("<div><p>a</p><div>b<p>c</p></div></div><p>d</p>")
    n = len(page.tags)
    r = np.random.default_rng(3)
    for _ in range(50):
        odds = r.normal(size=n) * 2
        best, score = None, -np.inf
        for code in range(2 ** (n - 1)):
            kept = [True] + [bool(code >> k & 1) for k in range(n - 1)]
            if all(not kept[i] or kept[page.parents[i]] for i in range(1, n)):
                s = sum(-np.logaddexp(0, -odds[i] if kept[i] else odds[i]) for i in range(1, n))
                if s > score:
                    best, score = kept, s
        assert page.decode(odds).tolist() == best


def test_parsing_of_broken_markup():
    page = H.Page('<p><b>One &amp; two&nbsp;\n three<br><p>Four <i>five</i> 1 < 2<script>var t="</p>";</script> six<!-- no --><div title="a>b">seven')
    assert page.text(np.ones(len(page.tags), bool)) == "One & two three\nFour five 1 < 2 six\nseven"
    assert H.Page("").text(np.ones(1, bool)) == ""
    assert H.Page("<script>never closed").text(np.ones(1, bool)) == ""


def test_only_scripts_styles_templates_and_controls_are_dropped_by_name():
    text = lambda source: (p := H.Page(source)).text(np.ones(len(p.tags), bool))
    assert text("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.<video>No video.</video><p>b<svg/>c") == "So x=2 holds.\nNo video.\nb\nc"
    for name in ("svg", "object", "canvas", "audio", "iframe", "noscript"):
        assert text(f"<div>a<{name}>b</{name}>c</div>") == "a\nb\nc" and text(f"<p>a<{name}>b<p>c") == "a\nb\nc"
    for name in ("template", "textarea", "select"):
        assert text(f"<p>a<{name}>b</{name}>c") == "ac" and text(f"<p>a<{name}><p>c") == "a\nc"
    assert text("<p>a<style>b<p>c") == text("<p>a<script>b<p>c") == "a"


def test_edges(spark):
    long = "<article>" + "".join(f"<p>Thing number {k}, said here.</p>" for k in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (3, "u", long, 1), (3, "u", long, 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.n_chars, r.text.count("\n")) for r in H.extract(df).collect())
    assert got[0][:2] == (1, 0) and got[1][:2] == (2, 0) and got[2] == got[3] and got[2][2] == 19_999
    assert H.extract(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    def article(source):
        body = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(x for x in blocks if x)

    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in H.op4_html_extraction(spark, sf_dir).collect()} == want


def test_deep_pages_with_end_tags_of_nothing_take_time_in_proportion():
    import time

    from parity.llm.html_extract import Page

    def seconds(n):
        began = time.process_time()
        page = Page("<div>" * n + "x" + "</nothing>" * n + "</div>" * n)
        assert len(page.tags) == n + 2
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.01)
