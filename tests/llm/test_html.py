import itertools
import time

import numpy as np
import pytest
from stagelens.llm import html_extract as H
from stagelens.llm.dom import parse
from stagelens.llm.labelled_pages import labelled_pages


def brute(f, weights, edges):
    """Marginals by listing every assignment."""
    n = len(f.parent)
    score = f.features @ weights
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(score[i] * y[i] for i in range(n)) + sum(edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        total += np.exp(s)
        mass += np.exp(s) * np.array(y)
    return mass / total, np.log(total)


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    pages = [parse("<div><p>a</p><ul><li>b<li>c</ul></div><nav>d</nav>"), parse("<p>x")]
    weights, edges = rng.normal(size=H.WIDTH), rng.normal(size=(H.EDGES, 2, 2))
    p, pair, z = H.marginals(H.forest(pages), weights, edges)
    at, logs = 0, 0.0
    for nodes in pages:
        want, one = brute(H.forest([nodes]), weights, edges)
        assert np.allclose(p[at : at + len(nodes)], want)
        at, logs = at + len(nodes), logs + one
    f = H.forest(pages)
    low = f.parent >= 0
    assert np.isclose(z, logs) and np.allclose(pair[low].sum(axis=(1, 2)), 1) and np.allclose(pair[low][:, :, 1].sum(axis=1), p[low])


def test_held_out_pages():
    pages = [parse(s) for s in labelled_pages(150, seed=31)]
    y = np.concatenate([H.labels(p) for p in pages]) == 1
    leaf = np.array([n.tag == "#" for p in pages for n in p])
    p, _, _ = H.marginals(H.forest(pages), *H.model())
    assert ((p >= 0.5) == y)[leaf].mean() > 0.98


CASES = {
    "semantic": ("<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><h1>Title</h1><p>One &amp; two.</p><p>Three<br>four   five.</main><aside><p>Read this too.</p></aside><footer>&copy; 2024</footer>", "Title\nOne & two.\nThree four five."),
    "classes": ('<body><div class="cookie-notice">We use cookies.</div><div id="menu"><ul><li><a href=/a>A</a></li></ul></div><div class="post-content"><h2>Head</h2><p>First text here.</p><div class="ad">Buy now, cheap.</div><p>Second text here.</p></div><div class="comments"><p>Nice post, thanks.</p></div><div id="footer">Copyright us</div>', "Head\nFirst text here.\nSecond text here."),
    "form": ('<article><h1>T</h1><p>Body text.</p><form><p>Subscribe to our letter.</p><input><select><option>x</select><textarea>y</textarea></form></article>', "T\nBody text."),
    "raw": ('<article><p>a</p><script>var t="</p><p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><noscript>no</noscript><p>b &lt;i&gt; c</p></article>', "a\nb <i> c"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_pages(name):
    source, text = CASES[name]
    assert H.texts([source], H.model()) == [text]


@pytest.mark.parametrize("source", ["", " ", "<", "<p", "</", "<!--", "<!DOCTYPE", "<p class='x>y", "&", "</p></p>", "<table><td>", "<b>" * 3000, "<div>" * 3000 + "x", "<script>", "a < b > c", "<p>" * 5000])
def test_odd_sources(source):
    assert len(H.texts([source, "<article><p>fine</p></article>"], H.model())) == 2


def test_structure():
    nodes = parse("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>e<td>f</table>")
    assert [(n.text, nodes[n.parent].tag) for n in nodes if n.tag == "#"] == [("a", "li"), ("b", "li"), ("c", "p"), ("d", "p"), ("e", "td"), ("f", "td")]


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ('<html><head><title>x</title><div class="content"><p>a<p>b</div>', ["a", "b"]),
        ("<head><title>x</title>text<p>b", ["text", "b"]),
        ('<div style="display:none"><div>a</div>SECRET</div><p>ok', ["ok"]),
        ("<div hidden><ul><li>a<li>b</ul>c</div>d", ["d"]),
        ("<p hidden>a<p>b", ["b"]),
        ("<ul><li hidden>a<li>b</ul>", ["b"]),
        ("<button>x<p>rest", ["x", "rest"]),
        ("<select><option>a<option>b<p>rest", ["ab", "rest"]),
        ("<select><option>a<option>b</select><p>rest", ["rest"]),
        ("<div>a<object>b</div><p>rest</p></object>", ["a", "rest"]),
        ("<button><div>x</div>more</button>rest", ["rest"]),
        ("<p>a</p><div><template><p>t<p>u</template>v</div>", ["a", "v"]),
    ],
)
def test_open_and_nested_elements(source, texts):
    assert [n.text for n in parse(source) if n.tag == "#"] == texts


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<div>" * 100_000 + "x" + "</div>" * 100_000, "<p><td>" + "<div>" * 100_000, "<ul><li><ul>" + "<div>" * 100_000 + "<li>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000])
def test_time_with_depth(source):
    began = time.monotonic()
    parse(source)
    assert time.monotonic() - began < 20  # about 2 s; time with the square of the depth would be some minutes


def test_links_that_are_content():
    source = "<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>Text of it, and more text.</p><h2>Sources</h2><ul><li><a href=/a>First one</a></li><li><a href=/b>Second</a></li></ul></article><footer>x</footer>"
    assert H.texts([source], H.model()) == ["T\nText of it, and more text.\nSources\nFirst one\nSecond"]


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><h1>T</h1><p>é x</p></article>", "q"), (None, None, None, None), (1, "u", "", "")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [("1", "", 0), ("1", "T\né x", 5), ("None", "", 0)] and H.extract(df.limit(0)).count() == 0
