"""Operator 12: parsing, alignment, templates, and whole tables against an independent reading of their pages."""

import html
import re
import string

import numpy as np
import pytest

from zonewright.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, x int"


def main_of(page):
    return [t.text for t in H._main(H.texts(H.parse(page)))]


def test_op12_on_the_table(spark, duck, sf_dir):
    """The tables' pages hold one article of headings and paragraphs each, whose ends may be missing."""
    got = {r.page_id: r for r in H.op12_html_extraction(spark, sf_dir).collect()}
    pages = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        article = re.search("<article>(.*?)(</article>|<footer>|$)", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(filter(None, blocks))
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("a < b & c &amp;amp; &lt;p&gt; &#228;&#x41;&copy &bogus;", ["a < b & c &amp; <p> äA© &bogus;"]),
        ("<p>one<p>two<br>lines\n  and&nbsp;more<div>three<b>bold</b>er</div>tail", ["one", "two lines and more", "threebolder", "tail"]),
        ("<script>var t='</p><article>x';</script><style>p{}</style><p>x</p><!-- <p>no</p> --><textarea><p>n</p></textarea>", ["x"]),
        ("<body><header>H</header><nav>N</nav><p>body</p><aside>A</aside><form>F</form><footer>F</footer>", ["body"]),
        ("<p>out</p><article><header><h1>T</h1></header><p>in</p><div class='ad-slot'>buy</div><p class=x>more</p></article><p>after</p>", ["T", "in", "more"]),
        ("<main><p>m</p><div id=comments><article class=comment>c</article></div></main><p>o</p>", ["m"]),
        ("<article><p>a</p><article class='comment'>c</article><section class=commentList><p>d</p></section></article>", ["a"]),
        ("<p><a href=x>all link</a></p><p>text with <a href=y>one</a></p>", ["text with one"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<div hidden>h</div><div aria-hidden=true>i</div><p title='a > b'>x</p>", ["x"]),
        ("<p>un<b>closed <i>in</b>line</i></p></div></p>x", ["unclosed inline", "x"]),
        ("<p>x</p><p a='b>c", ["x", "c"]),
        ("<p>x</p>a < b <i", ["x", "a < b <i"]),
    ],
)
def test_parse(page, want):
    assert main_of(page) == want


def test_long_and_deep_pages():
    deep = "<div>" * 30000 + "x" + "</div>" * 30000
    assert main_of(deep) == ["x"]
    assert main_of("<a 'b" * 50000)[0].endswith("'b")
    assert main_of("<b 'b" * 50001 + "><p>c") == ["c"]
    many = "".join(f"<p>{i}</p>" for i in range(20000))
    assert main_of(many) == [str(i) for i in range(20000)]
    a, b = H.parse(many), H.parse("<p>new</p>" + many.replace("<p>7777</p>", "<p>other</p>"))
    shapes, same = H.Shapes(), {}
    shapes.number(a)
    shapes.number(b)
    H.match(shapes, a, b, same)
    assert len(same) == 19999


def brute_common(a, b):
    """Simple tree matching, straight from its recurrence."""
    if a.label != b.label:
        return 0
    m = np.zeros((len(a.children) + 1, len(b.children) + 1), int)
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + brute_common(x, y))
    return 1 + m[-1, -1]


def random_tree(rng, depth):
    n = H.Node(rng.choice(["p", "div", "ul"]))
    if depth:
        for _ in range(rng.integers(0, 5)):
            n.children.append(random_tree(rng, depth - 1))
    if not n.children:
        leaf = H.Node("#")
        leaf.text = str(rng.choice(list(string.ascii_lowercase[:6])))
        n.children.append(leaf)
    return n


def test_simple_tree_matching(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        b.label = a.label
        shapes = H.Shapes()
        shapes.number(a)
        shapes.number(b)
        assert shapes.common(a.shape, b.shape) == brute_common(a, b)
        # Split alignments weigh as much as whole ones.
        w = H._Weights(shapes, a.children, b.children)
        weight = lambda pairs: sum(int(w.line(i, j, j + 1)[0]) for i, j in pairs)  # noqa: B023, E731
        whole = H._aligned(w, 0, len(a.children), 0, len(b.children))
        monkeypatch.setattr(H, "CELLS", 2)
        parts = H._aligned(w, 0, len(a.children), 0, len(b.children))
        monkeypatch.undo()
        assert weight(whole) == weight(parts)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(parts, parts[1:], strict=False))


def site(rng, host, n, notice="All rights to these words stay with us.", copies=0):
    """Pages without telling names: a constant head, a constant line amid the paragraphs, a varying story."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    first = None
    for i in range(n):
        paras = [" ".join(word() for _ in range(12)) for _ in range(rng.integers(2, 7))]
        if i < copies:
            first = first or paras
            paras = [*first, f"copy {i} {word()}"]
        at = rng.integers(0, len(paras) + 1)
        body = "".join(f"<p>{p}</p>" for p in paras[:at]) + f"<p>{notice}</p>" + "".join(f"<p>{p}</p>" for p in paras[at:])
        rows.append((f"http://{host}/{i}", f"<html><body><div><div>Site of {host}</div><div>Our motto for all</div></div><div>{body}</div><div>Made by us</div></body></html>", "\n".join(paras)))
    return rows


@pytest.mark.parametrize("few", [True, False])
def test_induction(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(6)
    # On the last host a third of the pages are near copies of one story: their shared text stays.
    pages = site(rng, "A.example", 40) + site(rng, "b.example", 60, "Another line of this site") + site(rng, "c.example", 60, copies=20)
    rows = [(i, u, h, "clash", 1) for i, (u, h, _) in enumerate(pages)]
    lone = [(900, "http://one.example/", pages[0][1], None, None), (901, None, pages[0][1], None, None), (902, "no host", None, None, None), (903, "http://a.example/x", "", None, None), (904, "http://a.example/x", None, None, None), (None, "http://a.example/y", "<p>Only this</p>", None, None)]
    got = H.extracted(spark.createDataFrame(rows + lone + [rows[5]], SCHEMA).repartition(5))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert len(got) == len(rows) + len(lone) + 1
    by = {r.page_id: r.text for r in got}
    assert [by[i] for i in range(len(pages))] == [t for _, _, t in pages]
    whole = "\n".join(main_of(pages[0][1]))
    assert (by[900], by[901], by[902], by[903], by[904], by[None]) == (whole, whole, "", "", "", "Only this")
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert H.extracted(spark.createDataFrame([], SCHEMA)).collect() == []
