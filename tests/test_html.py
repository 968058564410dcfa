import html as python_html
import random

import pyarrow as pa
from pyspark.sql import functions as F

from wordloom.functions import html
from wordloom.functions.html import (
    Selector,
    decode_entities,
    element_markups,
    element_text,
    html_to_text,
    matching,
    page_elements,
    visible_markup,
)


def value(spark, text, use):
    return spark.createDataFrame([(text,)], "t string").select(use(F.col("t")).alias("t")).first()["t"]


def text_of(spark, page, selector):
    return value(spark, page, lambda t: element_text(visible_markup(t), selector))


def test_text_without_scripts_and_comments(spark):
    page = '<p>a<b>b</b><!-- <p>no</p> --><script>var t="</p>";</script><style>p{}</style>c</p>\nd'
    assert value(spark, page, html_to_text) == "abc\nd"


def test_entities_decode_once(spark):
    for raw in ["&amp;lt; &lt;b&gt; &#44032;&#xAC00; &nbsp;&copy;&quot;&apos;", "&#38;lt; &amp;amp; &x; & &unknown;", "&#x26;amp;", "none"]:
        assert value(spark, raw, decode_entities) == python_html.unescape(raw).replace("&unknown;", "&unknown;")


def test_nested_elements_of_the_same_name(spark):
    page = '<div id="a"><div>one<div>two</div></div>three</div>four'
    assert text_of(spark, page, Selector("div", "id", "a")) == "onetwothree"


def test_unclosed_and_empty_and_missing(spark):
    assert text_of(spark, "<div id='a'>x<p>y", Selector("div", "id", "a")) == "xy"
    assert text_of(spark, '<div id="a"></div>z', Selector("div", "id", "a")) == ""
    assert text_of(spark, '<div id="ab">z</div>', Selector("div", "id", "a")) is None


def test_class_is_one_of_several(spark):
    page = '<span class="t1">no</span><SPAN lang="ko" class="big t11 x">yes</SPAN>'
    assert text_of(spark, page, Selector("span", "class", "t11")) == "yes"


def test_inside(spark):
    page = '<a>out</a><div id="footer"><address>x <a href="#">in</a></address></div>'
    inner = Selector("a", inside=Selector("address", inside=Selector("div", "id", "footer")))
    assert text_of(spark, page, inner) == "in"


def test_inside_any_of_several(spark):
    """The first address and the first footer hold no link."""
    page = (
        '<div id="footer"><p>none</p></div><a>out</a>'
        '<div id="footer"><address>no link</address><div><address>x <a>in</a></address></div></div>'
    )
    footer = Selector(None, "id", "footer")
    assert text_of(spark, page, Selector("a", inside=Selector("address", inside=footer))) == "in"
    assert text_of(spark, page, Selector("a", inside=Selector("address", inside=footer), first_outer=True)) is None
    assert text_of(spark, page, Selector("address", inside=footer)) == "no link"


def test_one_walk_for_all_selectors(spark):
    page = "<div id=a>1<p>2</div>3<P class='x y'>4<br/><i>5</p>6</i>"
    found = {(e.tag, page[e.start : e.end]) for e in page_elements(page)}
    assert found == {("div", "1<p>2"), ("p", "2</div>3<P class='x y'>4<br/><i>5</p>6</i>"), ("p", "4<br/><i>5"), ("i", "5</p>6")}
    wanted = [Selector("p", "class", "y"), Selector("em"), Selector(None, "id", "a"), Selector("i", inside=Selector("p", "class", "x"))]
    assert value(spark, page, lambda t: element_markups(t, wanted)) == ["4<br/><i>5", None, "1<p>2", "5</p>6"]
    assert value(spark, None, lambda t: element_markups(t, wanted)) == [None] * 4


def test_walk_equals_plain_nesting():
    """Random well-formed pages: every element's inner markup, and descendants by plain recursion."""
    rng = random.Random(4)

    def build(depth):
        tag = rng.choice(["div", "p", "a"])
        parts = [build(depth - 1) if depth and rng.random() < 0.7 else ("", rng.choice(["x", "y"]), []) for _ in range(rng.randint(0, 3))]
        return tag, "".join(markup for _, markup, _ in parts) if not tag else f"<{tag}>" + "".join(m for _, m, _ in parts) + f"</{tag}>", parts

    def nested(node, tags, under=False):
        tag, markup, parts = node
        here = [markup] if tag == tags[1] and under else []
        return here + [m for part in parts for m in nested(part, tags, under or tag == tags[0])]

    for _ in range(60):
        root = build(4)
        elements = page_elements(root[1])
        for outer in ("div", "p", "a"):
            for inner in ("div", "p", "a"):
                found = matching(elements, Selector(inner, inside=Selector(outer)))
                assert [f"<{inner}>{root[1][e.start : e.end]}</{inner}>" for e in found] == nested(root, (outer, inner))


def test_markups_of_a_batch_are_found_in_arrow():
    """A batch of pages stays in Arrow but for the few that are worked on."""
    rules = html.json.dumps([html.asdict(Selector("h1")), html.asdict(Selector("p"))])
    for size in (0, 1, 150):
        pages = [None if i % 7 == 3 else f"<h1>{i}</h1><p>ö{i}" if i % 2 else "" for i in range(size)]
        found = html._first_markups.func(pa.array(pages, pa.string()), pa.array([rules] * size, pa.string()))
        assert isinstance(found, pa.Array)
        assert found.to_pylist() == [[str(i), f"ö{i}"] if page else [None, None] for i, page in enumerate(pages)]
