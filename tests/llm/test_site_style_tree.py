"""Extraction of articles: planted pages, odd mark-up, and the importances against brute force."""

import html as entities
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kgspark.llm import site_style_tree as trees
from kgspark.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, site string, place int, noise string, text string, c0 int"


def frame(spark, rows):
    """Pages with extra columns named like the operator's own."""
    return spark.createDataFrame([(i, u, h, "x", 1, "y", "z", 2) for i, u, h in rows], SCHEMA)


def text_of(page):
    root = trees.parse(page)
    trees.mark_containers(root)
    return trees.main_text(root, set())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two <b>bold<p>three</b> end", "one\n\ntwo bold\n\nthree end"),
        ("<p>a<br>b\n\n c&nbsp;d&#x21;</p>", "a b c d!"),
        ("<ul><li>x<li>y</ul><nav>menu</nav>z", "x\n\ny\n\nz"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2\n\n3"),
        ("<!-- no --><script>var a = '</p><p>';</script>yes<style>p{}</style>", "yes"),
        ("<script>never closed <p>x", ""),
        ("<p>cut &am", "cut &am"),
        ("<p>cut <div clas", "cut"),
        ("a < b <3 <p>c</p", "a < b <3\n\nc"),
        ("<a title='x > y' href=\"</p>\">link</a> after", "link after"),
        ("<P CLASS=Ad>buy</P><p>text</P>", "text"),
        ("<header>top</header><article><header><h1>T</h1></header><p>p</p><div class='post-comments'>no</div></article>out", "T\n\np"),
        ("<body class='has-sidebar'><div id=side-bar>a</div><div class='col sidebar'>b</div><div class=wide>c</div>", "c"),
        ("<div class='is-sticky sidebar'>a</div><div id=site-header>b</div><section class='post no-ads'>c</section>", "c"),
        ("<div class=header>a</div><div class='page-header wrap'><main><div class=post-header>b</div>c</main></div>", "b\n\nc"),
        ("<div class=adventure>a</div><div class=cookieNotice>b</div><div class='cookie-notice'>c</div><p class=shared>d</p>", "a\n\nd"),
        ("<div class='page footer-wide'><main>m</main></div><footer>f</footer>", "m"),
        ("<div class=related><article>other</article></div><article>this</article>", "this"),
        ("<form action=x><article>whole page in a form</article></form>", "whole page in a form"),
        ("<article>a<article class='comment'>c</article></article>", "a"),
        ("<article>é &copy &lt;b&gt; &#0;</article>", "é © <b> �"),
        ("<title>t</title>no head<p>x</body></html>", "no head\n\nx"),
        ("<div>a<span>b</span>c</div><div role=navigation>d</div><aside>e</aside><form>f</form>", "abc"),
        ("</p>x</div></br>y", "x y"),
    ],
)
def test_mark_up_in_all_states(page, want):
    assert text_of(page) == want


def test_long_and_deep_pages():
    assert text_of("<div>" * 50_000 + "x") == "x"
    assert text_of("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    assert len(text_of("<p>word</p>" * 50_000)) == 50_000 * 6 - 2
    assert text_of("<a href=\"x" * 3_000) == ""
    assert text_of("<" * 100_000) == "<" * 100_000


def site(rng, pages, host):
    """Pages without telling names: the notice is the same everywhere, the menu is all links."""
    rows = []
    for k in range(pages):
        words = lambda n: " ".join(rng.choice(["lo", "rem", "ip", "sum", "dol"]) + str(rng.random())[2:6].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
        paragraphs = [words(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<div class=i{k}><a href=/{words(1)}>{words(1)}</a></div>" for _ in range(4))
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<html><body><div class=u1>{menu}</div><div class=u2>Read our other pages, number {k}.</div><div class=u3>{body}</div></body></html>"
        rows.append((f"https://{host}/{k}", page, "\n\n".join(paragraphs)))
    return rows


def test_noise_is_found_without_names(spark):
    rng = random.Random(3)
    made = site(rng, 12, "a.example") + site(rng, 40, "b.example")
    got = trees.extract_main_text(frame(spark, [(i, u, h) for i, (u, h, _) in enumerate(made)]))
    assert sorted(got.columns) == sorted(SCHEMA.replace("html string, ", "").replace(",", " ").split()[::2])
    found = {r.page_id: (r.text, r.url, r.place) for r in got.collect()}
    assert found == {i: (t, u, 1) for i, (u, _, t) in enumerate(made)}


def test_one_page_of_a_site_keeps_its_text(spark):
    got = trees.extract_main_text(frame(spark, [(1, "http://x.example/", "<div class=q>alone</div><div class=r><a>all link</a></div>")]))
    assert [r.text for r in got.collect()] == ["alone"]


def test_copies_of_one_page_do_not_empty_it(spark):
    rows = [(k, "http://x.example/", "<div class=q>the same</div>") for k in range(20)]
    rows += [(100 + k, "http://y.example/", "<article><p>the same</p></article>") for k in range(20)]
    assert {r.text for r in trees.extract_main_text(frame(spark, rows)).collect()} == {"the same"}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://x", ""), (None, "no host", "<p>a"), (4, "", "<p>b"), (4, "", "<p>b"), (5, "ftp://", " \n ")]
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in trees.extract_main_text(frame(spark, rows)).collect())
    assert got == [(0, "no host", "a"), (1, "", ""), (2, "http://x", ""), (4, "", "b"), (4, "", "b"), (5, "ftp://", "")]
    assert trees.extract_main_text(frame(spark, rows).limit(0)).collect() == []


def brute_importance(pages):
    """Recursion over the merged tree, place by place, as the definition reads."""
    keys = trees._Keys()
    styles, texts, above, links = defaultdict(Counter), defaultdict(Counter), {}, defaultdict(lambda: [0, 0])
    for site_key, page in pages:
        rows = {}
        for key, up, up_style, _, value, letters, linked in trees.place(trees.parse(page), site_key, keys):
            rows.setdefault((key, value, letters > 0), []).append((up, up_style, letters, linked))
        for (key, value, is_text), found in rows.items():
            (texts if is_text else styles)[key][value] += 1
            above[key] = found[0][:2]
            for _, _, letters, linked in found:
                links[key][0] += letters
                links[key][1] += linked

    def variety(counts):
        n = sum(counts.values())
        if n < trees.LEAST_PAGES:
            return 1.0
        return -sum(c / n * math.log(c / n, n) for c in counts.values())

    def score(key):
        if key in texts:
            value = variety(texts[key]) * (1 - links[key][1] / links[key][0])
            return value, value
        n, damped, inner, top = sum(styles[key].values()), trees.DAMPING ** len(styles[key]), 0, 0
        for style, count in styles[key].items():
            under = [score(k) for k, up in above.items() if up == (key, style)]
            if under:
                inner += count / n * sum(i for i, _ in under) / len(under)
                top = max(top, *(h for _, h in under))
        value = (1 - damped) * variety(styles[key]) + damped * inner
        return value, max(value, top)

    return {key: score(key) for key in {*styles, *texts}}


def test_importances_match_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(u, h) for u, h, _ in site(rng, 9, "a.example") + site(rng, 5, "b.example") + site(rng, 2, "c.example")]
    rows += [(f"http://a.example/{k}", f"<p>1<p><a>{k}</a><div class=z>same<div>{'<b>x</b>' * k}</div>") for k in range(6)]
    pages = frame(spark, [(i, u, h) for i, (u, h) in enumerate(rows)])
    sites = [r.site for r in trees._read(pages, "url", "html").withColumn("n", F.monotonically_increasing_id()).collect()]
    htmls = [r.html for r in trees._read(pages, "url", "html").collect()]
    path = str(tmp_path / "tree")
    trees.style_tree(pages).write.parquet(path)
    got = {r.place: (r.importance, r.highest) for r in trees.importance(spark.read.parquet(path)).collect()}
    want = brute_importance(list(zip(sites, htmls)))
    assert got.keys() == want.keys()
    for key, (value, top) in want.items():
        assert got[key] == (pytest.approx(value, abs=1e-9), pytest.approx(top, abs=1e-9))


def test_articles_of_the_tables(spark):
    """The tables' pages hold plain articles: blocks between the tags, read off by patterns."""
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op13_html_extraction"](spark, folder)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
