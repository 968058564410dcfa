import datetime
import json

from wordloom.functions.html import Selector
from wordloom.operators import extract

ARTICLE = """<html><head><title>x</title></head><body>
<span class="t11">2019.10.03. 오후 2:15</span><h3 id="articleTitle">제목 &amp; 글</h3>
<em class="guide_categorization_item">정치</em>
<div id="articleBodyContents"><script>// flash 오류를 우회하기 위한 함수 추가
function _flash_removeCallback() {}</script>
 첫 줄<br>둘째 <div>안</div> 줄
</div>%s</body></html>"""
FOOTER = '<div id="footer"><address>&copy; <a href="/">한 신문</a></address></div>'


def pages(spark, *htmls):
    return spark.createDataFrame([(f"u{i}", html) for i, html in enumerate(htmls)], "url string, html string")


def test_article(spark):
    found = extract.extract_articles(pages(spark, ARTICLE % FOOTER, ARTICLE % "")).orderBy("url").collect()
    assert found[0].asDict() == {
        "pdate": "2019.10.03.", "articleTitle": "제목 & 글", "article": "첫 줄둘째 안 줄", "pcompany": "한 신문",
        "url": "u0", "aclass": "정치", "pub_date": datetime.date(2019, 10, 3),
    }
    assert found[1]["pcompany"] == ""


def test_missing_title_is_rejected(spark):
    bad = (ARTICLE % FOOTER).replace("articleTitle", "other")
    found = extract.extract_articles(pages(spark, ARTICLE % FOOTER, bad))
    assert [r["url"] for r in extract.complete_articles(found).collect()] == ["u0"]
    assert [tuple(r) for r in extract.rejected_articles(found).collect()] == [("u1", ["articleTitle"])]


def test_patterns_run_once_under_a_filter(spark):
    kept = extract.complete_articles(extract.extract_articles(pages(spark, ARTICLE % FOOTER)))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("articleTitle\\") <= 2 and plan.count("guide_categorization_item") == 1


def test_links(spark):
    html = '<a class="_url x" href="https://n.example/1?a=1&amp;b=2">a</a><a class="_url" href="http://other/">b</a><a href="https://n.example/9">c</a>'
    landed = pages(spark, html, "<p>none</p>")
    anchor = Selector("a", "class", "_url")
    found = extract.extract_links(landed, anchor, "https://n.example")
    assert [tuple(r) for r in found.collect()] == [("u0", 0, "https://n.example/1?a=1&b=2")]
    assert [r["url"] for r in extract.pages_without_links(landed, anchor, "https://n.example").collect()] == ["u1"]


def test_ranking(spark):
    blocks = "".join(
        f'<div id="ranking_10{k}"><h5>s{k}</h5><ul>'
        + "".join(f'<li><div><a href="/{k}/{i}" title="t{i}">..</a></div></li>' for i in range(7)) + "</ul></div>"
        for k in range(7)
    )
    found = extract.extract_ranking(pages(spark, blocks), "https://n.example").collect()
    assert len(found) == 30
    assert sorted({r["blind"] for r in found}) == [f"s{k}" for k in range(6)]
    assert ("u0", "s2", 4, "https://n.example/2/4", "t4") in {tuple(r) for r in found}


def responses(spark, *bodies):
    return spark.createDataFrame([("u", body) for body in bodies], "url string, body string")


def test_jsonp_comments(spark):
    comments = [
        {"contents": "h*i", "userIdNo": "u1", "sympathyCount": 3, "antipathyCount": 1, "userBlind": False},
        {"contents": 'a "quoted", one); two', "userIdNo": "plain", "sympathyCount": 0, "antipathyCount": 7, "userBlind": False},
    ]
    body = "jQuery17_15(" + json.dumps({"result": {"count": {"comment": 3}, "commentList": comments}}) + ");"
    landed = responses(spark, body)
    found = sorted(map(tuple, extract.extract_comments_jsonp(landed).collect()))
    assert found == [("u", 'a "quoted", one); two', 0, 7), ("u", "h*i", 3, 1)]
    assert tuple(extract.comment_completeness(landed).first()) == ("u", 3, 2, False)


def test_json_comments(spark):
    body = json.dumps([{"id": 5, "parentId": 0, "content": "가", "createdAt": "2019-10-03T01:02:03", "likeCount": 2, "dislikeCount": 1, "x": {}}])
    found = extract.extract_comments_json(responses(spark, body, "[]", "broken"))
    assert [tuple(r) for r in found.collect()] == [("u", "가", datetime.datetime(2019, 10, 3, 1, 2, 3), 2, 1)]


def test_url_parameters(spark):
    urls = ["https://n.example/read?mode=a&oid=001&aid=22&sid=3", "https://n.example/v/2019"]
    found = extract.url_params(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert tuple(found[0])[1:] == ("001", "22", "read?mode=a&oid=001&aid=22&sid=3", "news001,22")
    assert tuple(found[1])[1:] == (None, None, "2019", None)


def test_fields_of_any_tag(spark):
    html = (
        "<td class='t11'>2020.01.02. 10:00</td><h3 id='articleTitle'>T</h3>"
        "<section id='articleBodyContents'>a <section>b</section> c</section> x"
        "<p id='footer'><address>by <a href='#'>Paper</a></address></p>"
    )
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    row = extract.extract_articles(pages).first()
    assert (row["pdate"], row["article"], row["pcompany"]) == ("2020.01.02.", "a b c", "Paper")


def test_responses_that_cannot_be_read(spark):
    bodies = ['{"code":500}', '[{"id":1,"content":"a"', '[{"id":1,"content":"a"}]', "[]", None, "oops"]
    plain = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "url string, body string")
    assert [(r["url"], r["content"]) for r in extract.extract_comments_json(plain).collect()] == [("2", "a")]
    assert sorted(r["url"] for r in extract.rejected_json(plain).collect()) == ["0", "1", "4", "5"]
    good = 'cb({"result":{"count":{"comment":1},"commentList":[{"contents":"a","sympathyCount":1,"antipathyCount":0}]}});'
    wrapped = spark.createDataFrame([("0", good), ("1", good[:60]), ("2", 'cb({"code":500});')], "url string, body string")
    assert [r["url"] for r in extract.extract_comments_jsonp(wrapped).collect()] == ["0"]
    assert sorted(r["url"] for r in extract.rejected_jsonp(wrapped).collect()) == ["1", "2"]
