import itertools

import numpy as np
import pytest

from levelgrid.llm import html_crf as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def crf(spark):
    return H.train(H.labelled(H.sample(spark.read.parquet(f"{SF}/pages.parquet"))))


def test_blocks():
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- <p>no</p> --><p>a <b>b&amp;\n c<br>d<p>e<ul><li>f<li>g</ul><div class='x y' id=z>h<span>i</span></div>tail"
    found = H.leaf_blocks(page)
    assert [b.text for b in found] == ["T", "a b& c d", "e", "f", "g", "hi", "tail"]
    assert found[5].path[-1] == ("div", ("x", "y", "z")) or found[5].path[-1][0] == "div"
    assert H.leaf_blocks(None) == H.leaf_blocks("") == H.leaf_blocks("<p> </p>") == []


def test_only_raw_content_is_skipped():
    texts = lambda page: [b.text for b in H.leaf_blocks(page)]
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<noscript><p>plain</p></noscript><object data=a><p>in <object>two</object> out</p></object><svg><style>p{}</style><title>t</title><path d=''/><text>drawn</text></svg></article>"
    assert " ".join(texts(page)) == "so x=2 holds plain in two out t drawn"
    for name in ("noscript", "object", "svg", "math", "canvas", "audio", "video"):
        assert texts(f"<div><{name}>a</div><p>rest</p>") == ["a", "rest"]
    for name in ("script", "style", "template", "textarea", "iframe", "noembed", "noframes"):
        assert texts(f"<p>a<{name}>no <p>no</p></{name}>b</p>") == ["a b"]


@pytest.mark.parametrize("page", ["<", "<p", "</p></div>x", "<p class='>a", "<script>never closed", "&#x110000;&bogus; &#65;", "<![CDATA[x]]>y", "<a<b>c", "<p/>x<br/>y"])
def test_odd_markup(crf, page):
    H.leaf_blocks(page)
    assert isinstance(crf.extract(page), str)


def test_viterbi_and_marginals_against_all_sequences():
    rng = np.random.default_rng(0)
    crf = H.Crf({})
    crf.pairs, crf.begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    score = rng.normal(size=(6, 2))
    value = lambda y: crf.begin[y[0]] + sum(score[i, v] for i, v in enumerate(y)) + sum(crf.pairs[a, b] for a, b in zip(y, y[1:]))
    each = {y: value(y) for y in itertools.product((0, 1), repeat=6)}
    assert tuple(crf.viterbi(score)) == max(each, key=each.get)
    total = sum(np.exp(v) for v in each.values())
    p, both = crf.marginals(score)
    assert np.allclose(p[:, 1], [sum(np.exp(v) for y, v in each.items() if y[i]) / total for i in range(6)])
    assert np.isclose(both[0, 1], sum(np.exp(v) * sum(a == 0 and b == 1 for a, b in zip(y, y[1:])) for y, v in each.items()) / total)


def test_held_out_pages(spark, crf):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    used = set(H.sample(spark.read.parquet(f"{SF}/pages.parquet")))
    right = []
    for r in pages:
        if r.html not in used:
            blocks = H.leaf_blocks(r.html)
            want = "\n".join(b.text for b, y in zip(blocks, H.own_labels(blocks)) if y)
            right.append(crf.extract(r.html) == want)
    assert len(right) > 50 and np.mean(right) > 0.99


MAIN = "<h1>A title here</h1><p>Some long sentence about a thing, and more of it.</p><h2>Part</h2><p>Ti.</p><ul><li>one item</li><li>two items</li></ul><p>The end of it, at last.</p>"
TEXT = "A title here\nSome long sentence about a thing, and more of it.\nPart\nTi.\none item\ntwo items\nThe end of it, at last."
LAYOUTS = [
    "<header><h1>Site</h1></header><nav><a href=/>Home</a><a href=/b>More</a></nav><article>{m}</article><footer>&copy; us</footer>",
    "<div class='menu'><ul><li><a href=/>Home</a></li></ul></div><main>{m}<div class=ad>Buy this now.</div></main><aside><p>Side text of some length, it is.</p></aside>",
    "<div id='cookie-notice'>We use cookies here.</div><article>{m}<section class=comments><h3>Comments</h3><div class=comment><p>I liked this a lot, thanks.</p></div></section></article>",
    "<nav>x</nav><article>{m}<form><label>Name</label><button>Send it</button></form></article><div class=sidebar><p>Other things to read.</p></div>",
    "<body><div class=banner>Big sale</div><div class='post content'>{m}</div><div class='related'><p>More like it.</p></div><footer>end</footer>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_other_layouts(crf, layout):
    assert crf.extract("<html><head><title>A title here</title></head><body>" + layout.format(m=MAIN) + "</body></html>") == TEXT


def test_table(spark, frame, crf):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long_page = "<article>" + "<p>words of a long page.</p>" * 5000 + "</article>"
    rows = [{"page_id": 1}, {"page_id": 2, "html": ""}, {"page_id": None, "html": long_page}, {"page_id": 3, "url": "u", "html": "<article><p>x y.</p></article>"}] * 2
    found = H.extract(frame(schema, rows), crf).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in found) == sorted([("1", 0), ("2", 0), ("None", len("words of a long page.\n") * 5000 - 1), ("3", 4)] * 2)
    assert H.extract(frame(schema), crf).collect() == []
    assert H.train([]).extract(long_page) == ""


def test_learns_from_pages_that_can_be_labelled(frame):
    schema = "page_id long, url string, html string"
    bare = [{"page_id": i, "html": f"<div><p>bare text number {i}</p></div>"} for i in range(H.SAMPLE_PAGES + 250)]
    with pytest.raises(ValueError, match="no labelled page"):
        H.learn(frame(schema, bare))
    named = [{"page_id": -i, "html": f"<nav><a>home</a></nav><ARTICLE class=x><p>Some longer main text, page {i}.</p></ARTICLE>"} for i in range(1, 4)]
    assert len(H.sample(frame(schema, bare + named))) == 3
    assert H.learn(frame(schema, bare + named)).names
    assert not H.learn(frame(schema, [{"page_id": 1}, {"page_id": 2, "html": " "}])).names
    assert not H.learn(frame(schema)).names
