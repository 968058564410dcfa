"""Every operator bound to the given tables, by name.

Each query takes a session and a folder of parquet tables and reads those tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.constants import COMMENT_PAGE_SIZE, MEASURES, PIPELINE_THRESHOLD, RANKING_SECTION_IDS, TOP_N
from wordloom.functions.html import Selector, element_text, html_to_text, visible_markup
from wordloom.functions.text import clean_text, normalise_body, normalise_date, parse_date, text_halves, tokenize
from wordloom.operators import articles as art
from wordloom.operators import centrality, cooc, extract, graph, paths, terms
from wordloom.operators.communities import communities
from wordloom.operators.blocks import BlockGraph
from wordloom.operators.search_index import build_index
from wordloom.plans.articles import (
    Articles,
    article_index,
    landed_articles,
    landed_week_details,
    search_articles as search_plan,
    week_details,
    week_ranking,
)
from wordloom.plans.keyword_graph import keyword_graph, term_cells, top_graph
from wordloom.session import checkpoint
from wordloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# Decimals kept of doubles, so that engines agree whatever their order of summation.
DECIMALS = 6

ENGLISH_STOP_WORDS = ["and", "for", "in", "is", "of", "that", "the", "to", "with"]
SEARCH_WORD = "tion"
SEARCH_WORDS = ["tion", "License", "ö", "schung", "zzqq", "con de"]
SEARCH_EVENT = "purchase"
SEARCH_DAYS = ("2024-01-05", "2024-01-20")
PORTAL_DAYS = ("1993-01-01", "1996-12-31")
AS_OF = "2024-01-10"
MIN_COUNT = 50

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def rounded(column: str):
    return F.round(column, DECIMALS).alias(column)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents", spread_by="doc_id").select("doc_id", "text")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages", spread_by="page_id")


# Text


@query("clean_text")
def clean_documents(spark, folder):
    return documents(spark, folder).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("tokenize")
def tokenize_documents(spark, folder):
    return terms.tokens(documents(spark, folder))


@query("tokenize_min1")
def tokenize_min1(spark, folder):
    return terms.tokens(documents(spark, folder), min_token_len=1)


# What the cleaning steps look for, put around the given texts, one to each document in turn.
MARKERS = [
    "홍길동 기자 hong@news.co.kr",
    "<그림 1>",
    "(서울=연합)",
    "[앵커]",
    "【속보】",
    "02-123-4567",
    "1588-1234",
    "www.a.b 끝",
    "b xcom",
    "나.co.kr",
    "다.go.kr",
    "/서울=홍길동 =",
    "漢字",
    "①◆",
    "2019-10-11",
    "12:13:14",
]


@query("clean_marked_text")
def clean_marked_text(spark, folder):
    marker = F.get(F.array(*[F.lit(text) for text in MARKERS]), (F.col("doc_id") % len(MARKERS)).cast("int"))
    marked = documents(spark, folder).select("doc_id", F.concat_ws(" ", marker, "text", marker).alias("text"))
    return marked.select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("split_corpus")
def split_corpus(spark, folder):
    return terms.split_single_document(documents(spark, folder))


@query("split_single_doc")
def split_single_doc(spark, folder):
    halves = text_halves(F.col("text"))
    return documents(spark, folder).select("doc_id", F.posexplode(halves).alias("half", "text"))


@query("stopword_filter")
def stopword_filter(spark, folder):
    return terms.drop_stop_words(terms.term_frequency(documents(spark, folder)), ENGLISH_STOP_WORDS)


@query("dict_lookup")
def dict_lookup(spark, folder):
    words = terms.tokens(documents(spark, folder)).select(F.col("token").alias("word"))
    return terms.lookup_words(words, _dictionary(spark, folder))


@query("dict_oov")
def dict_oov(spark, folder):
    words = terms.tokens(documents(spark, folder)).select(F.col("token").alias("word"))
    return terms.unknown_words(words, _dictionary(spark, folder))


def _dictionary(spark, folder):
    benchmark = read_table(spark, folder, "benchmark")
    return benchmark.select(F.explode(tokenize(F.col("text"))).alias("word")).distinct()


# Terms


@query("term_frequency")
def term_frequency(spark, folder):
    return terms.term_frequency(documents(spark, folder))


@query("vocab_stats")
def vocab_stats(spark, folder):
    return terms.vocab_stats(documents(spark, folder))


@query("vocab_pruned")
def vocab_pruned(spark, folder):
    return terms.vocab_pruned(documents(spark, folder))


@query("vocab_index")
def vocab_index(spark, folder):
    return terms.vocab_index(terms.vocab_pruned(documents(spark, folder))).select("term", "idx")


@query("term_idf")
def term_idf(spark, folder):
    return terms.term_idf(documents(spark, folder)).select("term", "df", rounded("idf"))


@query("doc_tfidf")
def doc_tfidf(spark, folder):
    return terms.doc_tfidf(documents(spark, folder)).select("doc_id", "term", rounded("tfidf"))


@query("tfidf_top100")
def tfidf_top100(spark, folder):
    return terms.tfidf_table(documents(spark, folder)).select("term", rounded("score"))


@query("tfidf_json")
def tfidf_json(spark, folder):
    return terms.tfidf_json(terms.tfidf_table(documents(spark, folder)).select("term", rounded("score")))


# Co-occurrence


@query("cooc_edges")
def cooc_edges(spark, folder):
    return cooc.edges_above(term_cells(documents(spark, folder)))


@query("cooc_binary")
def cooc_binary(spark, folder):
    return cooc.edges_above(term_cells(documents(spark, folder), binary=True))


@query("cooc_min_count")
def cooc_min_count(spark, folder):
    return cooc.edges_above(term_cells(documents(spark, folder)), MIN_COUNT)


@query("node_weight")
def node_weight(spark, folder):
    weights = cooc.node_weights(term_cells(documents(spark, folder)))
    return weights.select("term", "strength", rounded("weight"))


# Graph


def _edges(spark, folder) -> DataFrame:
    return checkpoint(cooc.edges_above(term_cells(documents(spark, folder))))


def _top_graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    return top_graph(term_cells(documents(spark, folder)), "weighted_degree", TOP_N)


def _by_first_letter(nodes: DataFrame) -> DataFrame:
    """A fixed partition of the terms, for operators that take one."""
    return nodes.select("term", F.ascii("term").cast("long").alias("group"))


@query("apsp_inverse")
def apsp_inverse(spark, folder):
    inverse = _edges(spark, folder).withColumn("weight", F.lit(1.0) / F.col("weight"))
    return paths.distance_pairs(BlockGraph(inverse)).select("src", "dst", F.round("dist", 9).alias("dist"))


@query("cent_weighted_degree")
def cent_weighted_degree(spark, folder):
    return centrality.weighted_degree(_edges(spark, folder))


@query("cent_closeness")
def cent_closeness(spark, folder):
    return centrality.closeness(_edges(spark, folder)).select("term", rounded("score"))


@query("cent_betweenness")
def cent_betweenness(spark, folder):
    return centrality.betweenness(_edges(spark, folder)).select("term", rounded("score"))


@query("cent_pagerank")
def cent_pagerank(spark, folder):
    return centrality.pagerank(_edges(spark, folder)).select("term", F.round("score", 9).alias("score"))


@query("cent_eigenvector")
def cent_eigenvector(spark, folder):
    return centrality.eigenvector(_edges(spark, folder)).select("term", rounded("score"))


@query("centrality_by")
def centrality_by(spark, folder):
    edges = _edges(spark, folder)
    rows = None
    for name in MEASURES:
        scores = graph.centrality_by(edges, name)
        if scores is None:  # frequency has none
            continue
        decimals = 9 if name in ("weighted_degree", "pagerank") else DECIMALS
        scores = scores.select(F.lit(name).alias("measure"), "term", F.round("score", decimals).alias("score"))
        rows = scores if rows is None else rows.unionByName(scores)
    return rows


@query("graph_top_n")
def graph_top_n(spark, folder):
    edges = _edges(spark, folder)
    return graph.subgraph(edges, graph.top_terms(graph.centrality_by(edges, "weighted_degree")))


@query("edge_p75_scale")
def edge_p75_scale(spark, folder):
    return graph.scale_edges(_edges(spark, folder)).select("src", "dst", "weight", rounded("width"))


@query("edge_nor_weight")
def edge_nor_weight(spark, folder):
    return graph.scale_edges(_edges(spark, folder)).select("src", "dst", "weight", rounded("nor_weight"))


@query("graph_attributed")
def graph_attributed(spark, folder):
    nodes, edges = _top_graph(spark, folder)
    of_src = nodes.select(F.col("term").alias("src"), F.col("weight").alias("src_weight"))
    of_dst = nodes.select(F.col("term").alias("dst"), F.col("weight").alias("dst_weight"))
    return edges.join(of_src, "src").join(of_dst, "dst").select(
        "src", "dst", "weight", rounded("nor_weight"), rounded("src_weight"), rounded("dst_weight")
    )


@query("graph_threshold")
def graph_threshold(spark, folder):
    nodes, edges = _top_graph(spark, folder)
    kept_nodes, kept_edges = graph.threshold_graph(nodes, edges, PIPELINE_THRESHOLD)
    ends = kept_edges.select(F.explode(F.array("src", "dst")).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_edges")
    )
    return kept_nodes.join(ends, "term").select("term", rounded("weight"), "n_edges")


@query("modularity")
def modularity(spark, folder):
    edges = _edges(spark, folder)
    return graph.modularity(edges, _by_first_letter(cooc.endpoints(edges))).select(rounded("modularity"))


@query("edge_group")
def edge_group(spark, folder):
    edges = _edges(spark, folder)
    return graph.group_edges(edges, _by_first_letter(cooc.endpoints(edges))).select("src", "dst", "weight", "group")


@query("graph_node_link")
def graph_node_link(spark, folder):
    nodes, edges = _top_graph(spark, folder)
    kept_nodes, kept_edges = graph.threshold_graph(nodes, edges, PIPELINE_THRESHOLD)
    groups = _by_first_letter(kept_nodes)
    grouped = kept_nodes.join(groups, "term").select("term", rounded("weight"), "group")
    links = graph.group_edges(kept_edges, groups).withColumn("nor_weight", F.round("nor_weight", DECIMALS))
    return graph.node_link_json(grouped, links)


@query("graph_node_link_lines")
def graph_node_link_lines(spark, folder):
    edges = graph.scale_edges(_edges(spark, folder)).withColumn("nor_weight", F.col("nor_weight").cast("decimal(12,6)"))
    groups = _by_first_letter(cooc.endpoints(edges))
    nodes = groups.withColumn("weight", F.length("term"))
    return graph.node_link_lines(nodes, graph.group_edges(edges, groups))


def _whole_graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole graph that the threshold leaves."""
    cells = term_cells(documents(spark, folder))
    edges = checkpoint(graph.scale_edges(cooc.edges_above(cells)))
    nodes, kept = graph.threshold_graph(cooc.node_weights(cells), edges, PIPELINE_THRESHOLD)
    return nodes, checkpoint(kept)


@query("communities")
def louvain(spark, folder):
    return communities(_whole_graph(spark, folder)[1])


@query("community_facts")
def community_facts(spark, folder):
    """What must hold of any good partition, whichever it is."""
    edges = _whole_graph(spark, folder)[1]
    groups = communities(edges)
    return graph.partition_facts(edges, groups)


@query("keyword_graph")
def whole_keyword_graph(spark, folder):
    kept = keyword_graph(documents(spark, folder)).kept_edges
    return kept.select("src", "dst", "weight", rounded("nor_weight"))


@query("keyword_graph_nodes")
def keyword_graph_nodes(spark, folder):
    """Kept nodes, and whether their edges' groups are those of their first ends."""
    found = keyword_graph(documents(spark, folder))
    of_edges = found.kept_edges.groupBy(F.col("src").alias("term")).agg(
        F.count(F.lit(1)).alias("n_first"), F.min("group").alias("least"), F.max("group").alias("most")
    )
    agree = (F.col("least") == F.col("group")) & (F.col("most") == F.col("group"))
    joined = found.kept_nodes.join(of_edges, "term", "left")
    return joined.select("term", rounded("weight"), F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce(agree, F.lit(True)).alias("agree"))


# Extraction


# Where the given pages keep the fields; they carry no date.
PAGE_RULES = {
    "pdate": extract.Rule(Selector("time")),
    "articleTitle": extract.Rule(Selector("h1")),
    "article": extract.Rule(Selector("article"), normalise_body),
    "pcompany": extract.Rule(Selector("footer"), lambda text: F.nullif(F.regexp_extract(text, "^© ([^ ]+) ·", 1), F.lit(""))),
    "aclass": extract.Rule(None, lambda page: F.nullif(F.regexp_extract(page, '<html lang="([^"]*)"', 1), F.lit(""))),
}


@query("html_to_text")
def html_text(spark, folder):
    return pages(spark, folder).select("page_id", html_to_text(F.col("html")).alias("text"))


@query("normalise_body")
def body_text(spark, folder):
    markup = pages(spark, folder).select("page_id", visible_markup(F.col("html")).alias("page"))
    return markup.select("page_id", normalise_body(element_text(F.col("page"), Selector("article"))).alias("body"))


@query("extract_article")
def extract_article(spark, folder):
    return extract.extract_articles(pages(spark, folder), PAGE_RULES)


@query("extract_rejects")
def extract_rejects(spark, folder):
    rejected = extract.rejected_articles(extract.extract_articles(pages(spark, folder), PAGE_RULES))
    return rejected.select("url", F.array_join("missing", ",").alias("missing"))


# Pages in the portal's layout, one for each document: the date is that of the order with
# the document's number, pages in Spanish lack the section.


def _portal_pages(spark, folder) -> DataFrame:
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    docs = read_table(spark, folder, "documents", spread_by="doc_id").join(orders, "doc_id", "left")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.replace(F.replace(F.replace(F.substring("text", 1, 40), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    dated = F.concat(F.lit('<span class="t11">'), F.date_format("o_orderdate", "yyyy.MM.dd. HH:mm"), F.lit("</span>"))
    section = F.concat(F.lit('<em class="guide_categorization_item">'), F.col("lang"), F.lit("</em>"))
    html = F.concat(
        F.lit("<html><body>"),
        F.coalesce(dated, F.lit("")),
        F.lit('<h3 id="articleTitle">'),
        head,
        F.lit('</h3><div id="articleBodyContents">'),
        escaped,
        F.lit("</div>"),
        F.when(F.col("lang") == "es", "").otherwise(section),
        F.concat(F.lit('<div id="footer"><address>by <a href="/">'), F.col("source"), F.lit("</a></address></div></body></html>")),
    )
    return docs.select(F.concat(F.lit("https://portal.example/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


@query("portal_articles")
def portal_articles(spark, folder):
    pages_ = _portal_pages(spark, folder)
    even = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    return landed_articles(pages_.where(even), pages_.where(~even), pages_.where(even)).articles


@query("portal_rejects")
def portal_rejects(spark, folder):
    rejected = landed_articles(_portal_pages(spark, folder)).rejects
    return rejected.select("url", F.array_join("missing", ",").alias("missing"))


@query("portal_search")
def portal_search(spark, folder):
    whole = landed_articles(_portal_pages(spark, folder))
    landed = Articles(checkpoint(whole.articles), whole.rejects)
    found = search_plan(landed, SEARCH_WORD, *PORTAL_DAYS, index=article_index(landed))
    return found.select("url", "pdate", "articleTitle", "pub_date")


@query("search_repeatedly")
def search_repeatedly(spark, folder):
    docs = documents(spark, folder)
    index = build_index(docs, "doc_id", ["text"])
    rows = None
    for word in SEARCH_WORDS:
        found = art.search(docs, word, ["text"], tie=["doc_id"], index=index).select(F.lit(word).alias("word"), "doc_id")
        rows = found if rows is None else rows.unionByName(found)
    return rows


# Ranking pages in the portal's layout, one for each day and type: a section block for
# each event type, the most active users as its links; every other link has a title.


def _ranking_pages(spark, folder) -> DataFrame:
    ranked = _rankings(read_table(spark, folder, "events"))
    sections = ranked.select("section").distinct().withColumn("number", F.dense_rank().over(Window.orderBy("section")) - 1)
    ids = F.array(*[F.lit(name) for name in RANKING_SECTION_IDS])
    text = F.concat(F.lit("user "), F.col("item").cast("string"))
    title = F.when(F.col("position") % 2 == 1, F.concat(F.lit(' title="'), text, F.lit(' &amp; co"'))).otherwise("")
    link = F.concat(F.lit('<li><b>.</b><a href="/c'), F.col("item").cast("string"), F.lit('"'), title, F.lit(">"), text, F.lit("</a></li>"))
    blocks = ranked.join(sections, "section").groupBy("rank_date", "ranking_type", "section", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", link.alias("link")))), lambda x: x["link"]), "").alias("links")
    )
    block = F.concat(
        F.lit('<div class="ranking" id="'), F.get(ids, F.col("number").cast("int")), F.lit('"><div><h5>'), "section", F.lit("</h5></div><ol>"), "links", F.lit("</ol></div>")
    )
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("block")))), lambda x: x["block"]), "<hr>")
    pages_ = blocks.groupBy("rank_date", "ranking_type").agg(page.alias("page"))
    return pages_.select("rank_date", "ranking_type", F.concat(F.lit("<html><body><a href='/top'>top</a>"), "page", F.lit("</body></html>")).alias("html"))


@query("portal_ranking")
def portal_ranking(spark, folder):
    return extract.extract_ranking(_ranking_pages(spark, folder), "https://portal.example")


def _customer_pages(spark, folder) -> DataFrame:
    customers = read_table(spark, folder, "customer")
    html = F.concat(
        F.lit('<span class="t11">2024.01.01.</span><h3 id="articleTitle">'), "c_name", F.lit('</h3><div id="articleBodyContents">of '),
        "c_mktsegment", F.lit('</div><em class="guide_categorization_item">'), "c_mktsegment", F.lit("</em>"),
    )
    return customers.select(F.concat(F.lit("https://portal.example/c"), F.col("c_custkey").cast("string")).alias("url"), html.alias("html"))


@query("portal_week_details")
def portal_week_details(spark, folder):
    details = landed_articles(_customer_pages(spark, folder))
    found = landed_week_details(_ranking_pages(spark, folder), details, AS_OF, "https://portal.example")
    return found.select("rank_date", "ranking_type", "blind", "position", "url", "articleTitle", "aclass")


@query("pages_without_links")
def pages_without_links(spark, folder):
    return extract.pages_without_links(pages(spark, folder), Selector("a"), "/t")


@query("extract_links")
def extract_links(spark, folder):
    return extract.extract_links(pages(spark, folder), Selector("a"), "/t")


@query("extract_ranking")
def extract_ranking(spark, folder):
    return extract.extract_ranking(
        pages(spark, folder).select("page_id", "html"),
        base_url="https://example.com",
        sections=[Selector("html")],
        heading=Selector("h1"),
    )


@query("url_params")
def url_params(spark, folder):
    return extract.url_params(pages(spark, folder), "page", "ref")


# Comments: each conversation serves as the landed responses to one article, a page of
# comments per response. Turns of a conversation are distinct, so a page has at most
# COMMENT_PAGE_SIZE of them.


def _responses(spark, folder) -> DataFrame:
    turns = read_table(spark, folder, "conversations", spread_by="conv_id")
    url = F.concat(F.lit("https://example.com/"), F.col("conv_id").cast("string"))
    likes, dislikes = F.length("text").cast("long"), (F.col("turn") * 2).cast("long")
    plain = F.struct(
        F.col("turn").alias("id"),
        F.when(F.col("turn") <= 1, 0).otherwise(F.col("turn") - 1).cast("long").alias("parentId"),
        F.col("text").alias("content"),
        F.date_format(F.timestamp_seconds(F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt"),
        likes.alias("likeCount"),
        dislikes.alias("dislikeCount"),
    )
    wrapped = F.struct(
        F.col("text").alias("contents"), likes.alias("sympathyCount"), dislikes.alias("antipathyCount")
    )
    totals = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("comment"))
    packed = turns.groupBy("conv_id", F.floor(F.col("turn") / COMMENT_PAGE_SIZE).alias("page")).agg(
        F.collect_list(plain).alias("plain"), F.collect_list(wrapped).alias("wrapped")
    )
    result = F.struct(F.struct("comment").alias("count"), F.col("wrapped").alias("commentList"))
    return packed.join(totals, "conv_id").select(
        url.alias("url"),
        F.to_json("plain").alias("json"),
        F.concat(F.lit("cb("), F.to_json(F.struct(result.alias("result"))), F.lit(");")).alias("jsonp"),
    )


@query("extract_comments_json")
def extract_comments_json(spark, folder):
    return extract.extract_comments_json(_responses(spark, folder).select("url", F.col("json").alias("body")))


@query("extract_comments_jsonp")
def extract_comments_jsonp(spark, folder):
    return extract.extract_comments_jsonp(_responses(spark, folder).select("url", F.col("jsonp").alias("body")))


@query("comment_completeness")
def comment_completeness(spark, folder):
    return extract.comment_completeness(_responses(spark, folder).select("url", F.col("jsonp").alias("body")))


# Responses as they may land: every third conversation lacks its first page, every seventh
# response is cut off in the middle.


def _damaged_responses(spark, folder) -> DataFrame:
    number = F.substring_index("url", "/", -1).cast("long")
    landed = _responses(spark, folder).withColumn("number", number)
    first = F.get_json_object("json", "$[0].id").cast("long") < COMMENT_PAGE_SIZE
    kept = landed.where(~((F.col("number") % 3 == 0) & first))
    cut = F.col("number") % 7 == 0
    half = lambda body: F.when(cut, F.col(body).substr(F.lit(1), F.floor(F.length(body) / 2).cast("int"))).otherwise(F.col(body))
    return kept.select("url", half("json").alias("json"), half("jsonp").alias("jsonp"))


@query("comment_shortfall")
def comment_shortfall(spark, folder):
    return extract.comment_completeness(_damaged_responses(spark, folder).select("url", F.col("jsonp").alias("body")))


@query("comment_rejects")
def comment_rejects(spark, folder):
    landed = _damaged_responses(spark, folder)
    wrapped = extract.rejected_jsonp(landed.select("url", F.col("jsonp").alias("body"))).select("url", F.lit("jsonp").alias("kind"))
    plain = extract.rejected_json(landed.select("url", F.col("json").alias("body"))).select("url", F.lit("json").alias("kind"))
    return wrapped.unionByName(plain).groupBy("url", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("top_level_comments")
def top_level_comments(spark, folder):
    comments = extract.parse_comments_json(_responses(spark, folder).select("url", F.col("json").alias("body")))
    return art.top_level(comments).select("url", "id", "content")


@query("comments_by_favour")
def comments_by_favour(spark, folder):
    events = read_table(spark, folder, "events").select("user_id", "event_id", "value")
    return art.by_favour(events, "value", ["event_id"], per=["user_id"])


@query("article_comments")
def article_comments(spark, folder):
    turns = read_table(spark, folder, "conversations")
    articles = turns.where("turn = 0").select("conv_id", F.col("text").alias("article"))
    comments = turns.where("turn > 0").select("conv_id", "turn", F.col("text").alias("comment"))
    return art.article_comments(articles, comments, on="conv_id")


# Articles and events


@query("search_articles")
def search_articles(spark, folder):
    return art.search(documents(spark, folder), SEARCH_WORD, ["text"], tie=["doc_id"])


@query("search_events")
def search_events(spark, folder):
    events = read_table(spark, folder, "events")
    found = art.search(events, SEARCH_EVENT, ["event_type"], F.col("ts"), *SEARCH_DAYS, tie=["event_id"])
    props = F.get_json_object("props", "$.k").cast("long")
    return found.select("event_id", "ts", "user_id", "event_type", "value", props.alias("k"))


@query("normalise_date")
def normalise_order_date(spark, folder):
    orders = read_table(spark, folder, "orders")
    written = F.date_format("o_orderdate", "yyyy.MM.dd.")
    return orders.select(
        "o_orderkey", normalise_date(written).alias("digits"), parse_date(written).alias("order_date")
    )


@query("dedup_first")
def dedup_first(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return art.dedup_first(docs, ["text"], ["doc_id"])


@query("union_articles")
def union_articles(spark, folder):
    docs = read_table(spark, folder, "documents")
    first = docs.where("source <= 'src15'").select("doc_id", "text", "lang")
    second = docs.where("source > 'src15' or source is null").select("doc_id", "text")
    return art.union_articles(first, second)


def _rankings(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """Most viewed by all events; events with a ``k`` of 50 or more stand for comments."""
    discussed = F.get_json_object("props", "$.k").cast("long") >= 50
    return week_ranking(events, F.col("ts"), discussed, "event_type", "user_id", as_of)


@query("daily_top5")
def daily_top5(spark, folder):
    return _rankings(read_table(spark, folder, "events"))


@query("week_days")
def week_days(spark, folder):
    events = read_table(spark, folder, "events")
    return art.week_days(events.agg(F.max(F.col("ts").cast("date")).alias("as_of")))


@query("week_rank")
def week_rank(spark, folder):
    return _rankings(read_table(spark, folder, "events"), AS_OF)


@query("week_rank_detail")
def week_rank_detail(spark, folder):
    customers = read_table(spark, folder, "customer")
    detail = customers.select("c_custkey", "c_name", "c_mktsegment")
    return week_details(week_rank(spark, folder), detail, "c_custkey")
