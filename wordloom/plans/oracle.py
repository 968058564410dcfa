"""The same questions as the catalog's, in SQL for another engine to answer."""

from __future__ import annotations

from wordloom.constants import (
    BODY_BOILERPLATE,
    CLEAN_STEPS,
    MAX_FEATURES,
    SPACE,
    WORD,
)
from wordloom.plans.catalog import (
    AS_OF,
    ENGLISH_STOP_WORDS,
    MARKERS,
    MIN_COUNT,
    PORTAL_DAYS,
    SEARCH_DAYS,
    SEARCH_EVENT,
    SEARCH_WORD,
    SEARCH_WORDS,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(value: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({value}, {quoted(pattern)}, {by}, 'g')"


def token_list(minimum: int, text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), {quoted(f'[{WORD}]{{{minimum},}}')})"


def token_rows(minimum: int) -> str:
    return f"""
        with lists as (select doc_id, {token_list(minimum)} as l from documents)
        select doc_id, unnest(range(len(l)))::integer as pos, unnest(l) as token from lists"""


def cleaned(value: str = "text") -> str:
    for _, _, pattern in CLEAN_STEPS:
        value = replaced(value, pattern)
    return value


def body(text: str) -> str:
    one_line = f"replace(replace({text}, chr(10), ' '), {quoted(BODY_BOILERPLATE)}, '')"
    return replaced(one_line, rf"^[{SPACE}]+|[{SPACE}]+$")


VISIBLE = replaced("html", r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>")


def decoded(markup: str) -> str:
    plain = replaced(markup, "<[^>]+>")
    for name, character in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")]:
        plain = f"replace({plain}, {quoted(name)}, {quoted(character)})"
    return plain


def tag_text(tag: str) -> str:
    return decoded(f"regexp_extract(page, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1)")


TF = f"""
    tok as (select doc_id, unnest({token_list(2)}) as term from documents),
    tf as materialized (select doc_id, term, count(*)::bigint as tf from tok group by all),
    total as (select count(*) as n from documents),
    stats as materialized (select term, count(*)::bigint as df, sum(tf)::bigint as cf from tf group by term)"""
TFIDF = (
    TF
    + """,
    idf as (select term, df, ln((1.0::double + n) / (1.0::double + df)) + 1.0::double as idf from stats, total),
    w as materialized (select doc_id, term, tf * idf as w from tf join idf using (term)),
    norm as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
    weights as (select doc_id, term, w / norm as tfidf from w join norm using (doc_id)),
    keywords as (select term, sum(tfidf) as score from weights group by term
                 order by round(score, 9) desc, term limit 100)"""
)
VOCAB = (
    TF
    + f""",
    vocab as materialized (select term, df, cf from stats, total where df >= 0.01::double * n
                           order by cf desc, term limit {MAX_FEATURES}),
    numbered as materialized (select term, (row_number() over (order by term) - 1)::integer as idx from vocab)"""
)


def cells(count: str = "tf") -> str:
    return (
        VOCAB
        + f""",
    post as materialized (select doc_id, idx, {count} as c from tf join numbered using (term)),
    pairs as materialized (select a.idx as i, b.idx as j, sum(a.c * b.c)::bigint as weight
                           from post a join post b on a.doc_id = b.doc_id and a.idx <= b.idx group by all),
    edges as materialized (select s.term as src, d.term as dst, weight from pairs
                           join numbered s on s.idx = i join numbered d on d.idx = j where i < j),
    strength as (select term, weight as strength from pairs join numbered on idx = i where i = j),
    node_weight as (select term, strength, (strength - min(strength) over ())::double
                      / nullif(max(strength) over () - min(strength) over (), 0) as weight from strength)"""
    )


SCALE = """,
    low as (select min(weight) as lo, max(weight) as hi, quantile_cont(weight, 0.75) as p75 from {edges}),
    widths as (select src, dst, weight, (weight - lo) / (p75 - lo + 1e-9::double) + 0.2::double as width from {edges}, low),
    scaled as (select src, dst, weight, width,
                 (width - min(width) over ()) / nullif(max(width) over () - min(width) over (), 0) as nor_weight
               from widths)"""
DIRECTED = """,
    directed as materialized (select src, dst, weight from edges union all select dst, src, weight from edges),
    degree as materialized (select src as term, sum(weight)::double as score from directed group by src)"""
TOP = (
    DIRECTED
    + """,
    top as materialized (select term from degree order by score desc, term limit 50),
    top_edges as materialized (select * from edges where src in (from top) and dst in (from top))"""
)
THRESHOLD = """,
    kept as materialized (select * from scaled where nor_weight >= 0.05::double),
    ends as (select src as term from kept union all select dst from kept),
    kept_nodes as (select n.term, n.weight, count(*)::bigint as n_edges
                   from node_weight n join ends using (term) group by n.term, n.weight)"""

PAGERANK = (
    DIRECTED
    + """,
    size as (select count(*) as n from degree),
    moves as materialized (select directed.src, directed.dst, weight / score as share
                           from directed join degree on term = src),
    ranks as (
        select 0 as round, term, 1.0::double / n as score from degree, size
        union all
        select round + 1, dst, 0.85::double * sum(share * score) + (1.0::double - 0.85::double) / any_value(n)
        from ranks join moves on src = term, size where round < 100 group by round, dst),
    changes as (select b.round, sum(abs(a.score - b.score)) as change
                from ranks a join ranks b on a.term = b.term and b.round = a.round + 1 group by b.round),
    stop as (select min(round) as round from changes, size where change < n * 1e-6),
    pagerank as (select term, score from ranks where round = (select round from stop))"""
)
EIGENVECTOR = (
    DIRECTED
    + """,
    top_degree as (select max(score) as top from degree),
    powers as (
        select 0 as round, term, 1.0::double as x from degree
        union all
        select round + 1, dst, sum(weight * x) / any_value(top)
        from powers join directed on src = term, top_degree where round < 150 group by round, dst)"""
)


def hops(start: str, rounds: int) -> str:
    """Distances over ever more edges of ``tight``, unrolled."""
    steps = [f",\n    d0 as materialized ({start})"]
    for k in range(rounds):
        steps.append(f"""
    d{k + 1} as materialized (select src, dst, min(d) as d from (
        select src, dst, d from d{k}
        union all
        select a.src, t.dst, a.d + t.w from d{k} a join tight t on a.dst = t.src) group by all)""")
    return ",".join(steps)


def distances(weight: str, rounds: int) -> str:
    """Distances ``apart`` between numbered terms, over edges as long as ``weight``.

    Edges that a detour over one more node beats are on no shortest path and left out.
    """
    return (
        f""",
    steps as materialized (select s.idx as src, d.idx as dst, {weight} as w from edges
                           join numbered s on s.term = edges.src join numbered d on d.term = edges.dst),
    both_steps as materialized (select src, dst, w from steps union all select dst, src, w from steps),
    detours as (select a.src, b.dst, min(a.w + b.w) as d from both_steps a join both_steps b on a.dst = b.src
                where a.src < b.dst group by all),
    tight_half as materialized (select s.src, s.dst, s.w from steps s left join detours using (src, dst)
                                where d is null or s.w <= d),
    tight as materialized (select src, dst, w from tight_half union all select dst, src, w from tight_half)"""
        + hops("select src, dst, w as d from tight", rounds)
        + f""",
    apart as materialized (select src, dst, d from d{rounds} where src <> dst)"""
    )


INVERSE = distances("1.0::double / weight", 12)


def passages(rounds: int) -> str:
    """Shares of shortest paths through a node, ``passed(src, node, share)``.

    ``onward`` lists, per source, the edges its shortest paths use. Numbers of paths sum
    over paths of ever more edges, and shares over ever longer rests of a path.
    """
    ctes = [""",
    far as materialized (select src, dst, d from apart union all select idx, idx, 0.0 from numbered),
    onward as materialized (select a.src, a.dst as u, t.dst as v from far a join tight t on t.src = a.dst
                            join far b on b.src = a.src and b.dst = t.dst and b.d = a.d + t.w),
    e0 as materialized (select idx as src, idx as v, 1.0::double as c from numbered)"""]
    for k in range(rounds):
        ctes.append(f"""
    e{k + 1} as materialized (select o.src, o.v, sum(c) as c from onward o join e{k} e on e.src = o.src and e.v = o.u group by all)""")
    every = " union all ".join(f"select src, v, c from e{k}" for k in range(rounds + 1))
    ctes.append(f"""
    counts as materialized (select src, v, sum(c) as c from ({every}) group by all),
    ratios as materialized (select o.src, o.u, o.v, a.c / b.c as r from onward o
        join counts a on a.src = o.src and a.v = o.u join counts b on b.src = o.src and b.v = o.v),
    f0 as (select src, v, 1.0::double as f from counts)""")
    for k in range(rounds):
        ctes.append(f"""
    f{k + 1} as materialized (select r.src, r.u as v, sum(r * f) as f from ratios r join f{k} f on f.src = r.src and f.v = r.v group by all)""")
    every = " union all ".join(f"select src, v, f from f{k + 1}" for k in range(rounds))
    ctes.append(f"""
    passed as (select src, v as node, f as share from ({every}) where src <> v)""")
    return ",".join(ctes)


PAGE = f"pages_seen as (select page_id, url, html, {VISIBLE} as page from pages)"
COMMENTS = """
    comments as (select 'https://example.com/' || conv_id as url, turn as id,
                   case when turn <= 1 then 0 else turn - 1 end as parent, text,
                   length(text)::bigint as likes, (turn * 2)::bigint as dislikes,
                   to_timestamp(turn * 60) at time zone 'UTC' as created from conversations)"""


def rankings(condition: str = "true") -> str:
    def one(name: str, extra: str) -> str:
        return f"""
        select rank_date, '{name}' as ranking_type, section, position, item, n from (
          select *, row_number() over (partition by rank_date, section order by n desc, item)::integer as position from (
            select ts::date as rank_date, event_type as section, user_id as item, count(*)::bigint as n
            from events where {condition} and {extra} group by all)) where position <= 5"""

    return one("popular_day", "true") + " union all " + one("popular_memo", "(props->>'$.k')::bigint >= 50")


WEEK = f"ts >= date '{AS_OF}' - 6 and ts < date '{AS_OF}' + 1"
STOP_LIST = ", ".join(quoted(word) for word in ENGLISH_STOP_WORDS)
SEARCH_FROM, SEARCH_TO = SEARCH_DAYS

ORACLE: dict[str, str] = {
    "clean_text": f"select doc_id, {cleaned()} as cleaned from documents",
    "tokenize": token_rows(2),
    "tokenize_min1": token_rows(1),
    "split_single_doc": """
        with w as (select doc_id, string_split(text, ' ') as w, len(string_split(text, ' ')) // 2 as half from documents)
        select doc_id, 0 as half, array_to_string(w[1:half], ' ') as text from w
        union all select doc_id, 1, array_to_string(w[half + 1:], ' ') from w""",
    "stopword_filter": f"with {TF} select doc_id, term, tf from tf where term not in ({STOP_LIST})",
    "dict_lookup": f"""
        with {TF}, known as (select distinct unnest({token_list(2)}) as word from benchmark)
        select stats.term as word, known.word is not null as found from stats left join known on known.word = stats.term""",
    "dict_oov": f"""
        with {TF}, known as (select distinct unnest({token_list(2)}) as word from benchmark)
        select term as word from stats where term not in (select word from known)""",
    "term_frequency": f"with {TF} select doc_id, term, tf from tf",
    "vocab_stats": f"with {TF} select term, df, cf from stats",
    "vocab_pruned": f"with {VOCAB} select term, df, cf from vocab",
    "vocab_index": f"with {VOCAB} select term, idx from numbered",
    "term_idf": f"with {TFIDF} select term, df, round(idf, 6) as idf from idf",
    "doc_tfidf": f"with {TFIDF} select doc_id, term, round(tfidf, 6) as tfidf from weights",
    "tfidf_top100": f"with {TFIDF} select term, round(score, 6) as score from keywords",
    "tfidf_json": f"""
        with {TFIDF}, shown as (select term, round(score, 6) as score from keywords)
        select '{{"TF-IDF":{{' || string_agg('"' || term || '":' || score, ',' order by score desc, term) || '}}}}' as json
        from shown""",
    "cooc_edges": f"with {cells()} select src, dst, weight from edges",
    "cooc_binary": f"with {cells('1')} select src, dst, weight from edges",
    "cooc_min_count": f"with {cells()} select src, dst, weight from edges where weight > {MIN_COUNT}",
    "node_weight": f"with {cells()} select term, strength, round(weight, 6) as weight from node_weight",
    "apsp_inverse": f"""
        with {cells()} {INVERSE}
        select s.term as src, t.term as dst, round(d, 9) as dist from apart
        join numbered s on s.idx = src join numbered t on t.idx = dst where src < dst""",
    "cent_weighted_degree": f"with {cells()} {DIRECTED} select term, score from degree",
    "cent_closeness": f"""
        with {cells()} {INVERSE}, size as (select count(distinct src) as n from both_steps)
        select term, round(count(*) / sum(d) * (count(*) / (any_value(n) - 1.0::double)), 6) as score
        from apart join numbered on idx = src, size group by term""",
    "cent_betweenness": f"""
        with {cells()} {distances('weight::double', 8)} {passages(8)},
        size as (select count(distinct src) as n from both_steps)
        select term, round(coalesce(sum(share), 0) / any_value((n - 1) * (n - 2)), 6) as score
        from (select distinct src as idx from both_steps) join numbered using (idx)
        left join passed on node = idx, size group by term""",
    "cent_pagerank": f"with recursive {cells()} {PAGERANK} select term, round(score, 9) as score from pagerank",
    "cent_eigenvector": f"""
        with recursive {cells()} {EIGENVECTOR}, last as (select term, x from powers where round = 150)
        select term, round(x / sqrt((select sum(x * x) from last)), 6) as score from last""",
    "graph_top_n": f"with {cells()} {TOP} select src, dst, weight from top_edges",
    "edge_p75_scale": f"""
        with {cells()} {SCALE.format(edges='edges')} select src, dst, weight, round(width, 6) as width from scaled""",
    "edge_nor_weight": f"""
        with {cells()} {SCALE.format(edges='edges')}
        select src, dst, weight, round(nor_weight, 6) as nor_weight from scaled""",
    "graph_attributed": f"""
        with {cells()} {TOP} {SCALE.format(edges='top_edges')}
        select src, dst, scaled.weight, round(nor_weight, 6) as nor_weight,
          round(s.weight, 6) as src_weight, round(d.weight, 6) as dst_weight
        from scaled join node_weight s on s.term = src join node_weight d on d.term = dst""",
    "graph_threshold": f"""
        with {cells()} {TOP} {SCALE.format(edges='top_edges')} {THRESHOLD}
        select term, round(weight, 6) as weight, n_edges from kept_nodes""",
    "modularity": f"""
        with {cells()},
        parts as (select weight, ord(src) as a, ord(dst) as b from edges),
        sums as (select g, sum(weight) as total, sum(if(inner_edge, weight, 0)) as inside from (
            select a as g, weight, a = b as inner_edge from parts
            union all select b, weight, a = b from parts) group by g),
        whole as (select sum(total)::double as m2 from sums)
        select round(sum(inside / m2 - (total / m2) * (total / m2)), 6) as modularity from sums, whole""",
    "edge_group": f"with {cells()} select src, dst, weight, ord(src)::bigint as \"group\" from edges",
    "graph_node_link_lines": f"""
        with {cells()} {SCALE.format(edges='edges')},
        ends as (select src as term from edges union select dst from edges)
        select * from (values (0, '', '', '{{"directed":false,"multigraph":false,"graph":{{}},"nodes":['),
            (2, '', '', '],"links":['), (4, '', '', ']}}')) f(part, first, second, line)
        union all select 1, term, '', if(term = (select min(term) from ends), '', ',')
            || '{{"id":"' || term || '","weight":' || length(term) || ',"group":' || ord(term) || '}}' from ends
        union all select 3, src, dst, if((src, dst) = (select min((src, dst)) from edges), '', ',')
            || '{{"source":"' || src || '","target":"' || dst || '","weight":' || weight
            || ',"nor_weight":' || nor_weight::decimal(12,6) || ',"group":' || ord(src) || '}}' from scaled""",
    "graph_node_link": f"""
        with {cells()} {TOP} {SCALE.format(edges='top_edges')} {THRESHOLD},
        n as (select string_agg('{{"id":"' || term || '","weight":' || round(weight, 6)
                || ',"group":' || ord(term) || '}}', ',' order by term) as l from kept_nodes),
        e as (select string_agg('{{"source":"' || src || '","target":"' || dst || '","weight":' || weight
                || ',"nor_weight":' || round(nor_weight, 6) || ',"group":' || ord(src) || '}}', ',' order by src, dst) as l
              from kept)
        select '{{"directed":false,"multigraph":false,"graph":{{}},"nodes":[' || n.l || '],"links":[' || e.l || ']}}' as json
        from n, e""",
    "html_to_text": f"with {PAGE} select page_id, {decoded('page')} as text from pages_seen",
    "normalise_body": f"with {PAGE} select page_id, {body(tag_text('article'))} as body from pages_seen",
    "extract_article": f"""
        with {PAGE}
        select null::varchar as pdate, {tag_text('h1')} as "articleTitle", {body(tag_text('article'))} as article,
          regexp_extract({tag_text('footer')}, '^© ([^ ]+) ·', 1) as pcompany, url,
          regexp_extract(page, '<html lang="([^"]*)"', 1) as aclass, null::date as pub_date
        from pages_seen""",
    "extract_rejects": "select url, 'pdate' as missing from pages",
    "extract_links": f"""
        with {PAGE},
        listed as (select page_id, url, regexp_extract_all(page, '<a href="([^"]*)"', 1) as l from pages_seen),
        found as (select page_id, url, unnest(range(len(l))) as p, unnest(l) as href from listed)
        select url, (row_number() over (partition by page_id order by p) - 1)::integer as position, href
        from found where starts_with(href, '/t')""",
    "extract_ranking": f"""
        with {PAGE},
        found as (select page_id, {tag_text('h1')} as blind, regexp_extract_all(page, '<a href="([^"]*)"', 1)[1:5] as h,
                    regexp_extract_all(page, '<a href="[^"]*">([^<]*)</a>', 1)[1:5] as t from pages_seen)
        select page_id, blind, unnest(range(len(h)))::integer as position, 'https://example.com' || unnest(h) as href,
          unnest(t) as title from found""",
    "url_params": """
        with q as (select url, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page,
                     nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') as ref from pages)
        select url, page, ref, string_split(url, '/')[-1] as post_id,
          'news' || page || ',' || ref as object_id from q""",
    "extract_comments_json": f"""
        with {COMMENTS}
        select url, text as content, created as "createdAt", likes as "likeCount", dislikes as "dislikeCount" from comments""",
    "extract_comments_jsonp": f"""
        with {COMMENTS}
        select url, text as comment, likes as "sympathyCount", dislikes as "antipathyCount" from comments""",
    "comment_completeness": f"""
        with {COMMENTS}
        select url, count(*)::bigint as announced, count(*)::bigint as landed, true as complete from comments group by url""",
    "top_level_comments": f"with {COMMENTS} select url, id, text as content from comments where parent = 0",
    "comments_by_favour": f"""
        select user_id, event_id, value from events order by user_id, value desc, event_id""",
    "article_comments": """
        select c.conv_id, a.text as article, c.turn, c.text as comment
        from conversations a join conversations c using (conv_id) where a.turn = 0 and c.turn > 0""",
    "search_articles": f"select doc_id, text from documents where contains(text, {quoted(SEARCH_WORD)}) order by doc_id",
    "search_events": f"""
        select event_id, ts, user_id, event_type, value, (props->>'$.k')::bigint as k from events
        where contains(event_type, {quoted(SEARCH_EVENT)})
          and ts::date between date '{SEARCH_FROM}' and date '{SEARCH_TO}' order by ts desc, event_id""",
    "normalise_date": """
        select o_orderkey, strftime(o_orderdate, '%Y%m%d') as digits, o_orderdate::date as order_date from orders""",
    "dedup_first": """
        select doc_id, text, lang, source from (
            select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1""",
    "union_articles": """
        select doc_id, text, lang from documents where source <= 'src15'
        union all select doc_id, text, null from documents where source > 'src15' or source is null""",
    "daily_top5": rankings(),
    "week_days": """
        with last as (select max(ts)::date as as_of from events)
        select as_of, (as_of - back)::date as day from last, (select unnest(range(7))::integer as back)""",
    "week_rank": rankings(WEEK),
    "week_rank_detail": f"""
        select r.*, c_custkey, c_name, c_mktsegment from ({rankings(WEEK)}) r join customer on c_custkey = item""",
}

ORACLE["centrality_by"] = " union all ".join(
    f"select '{measure}' as measure, term, score from ({ORACLE[name]})"
    for measure, name in {
        "pagerank": "cent_pagerank",
        "betwenness": "cent_betweenness",
        "weighted_degree": "cent_weighted_degree",
        "closeness": "cent_closeness",
        "eigenvector": "cent_eigenvector",
    }.items()
)

# The groups are Louvain's; everything before them can be asked of SQL.
ORACLE["keyword_graph"] = f"""
    with {cells()} {INVERSE}, size as (select count(distinct src) as n from both_steps),
    close as (select term, round(count(*) / sum(d) * (count(*) / (any_value(n) - 1.0::double)), 9) as score
              from apart join numbered on idx = src, size group by term),
    top as materialized (select term from close order by score desc, term limit 50),
    top_edges as materialized (select * from edges where src in (from top) and dst in (from top))
    {SCALE.format(edges='top_edges')} {THRESHOLD}
    select src, dst, weight, round(nor_weight, 6) as nor_weight from kept"""

MARKED = f"([{', '.join(quoted(text) for text in MARKERS)}])[doc_id % {len(MARKERS)} + 1]"
PORTAL = f"""
    portal as (
        select 'https://portal.example/' || doc_id as url, strftime(o_orderdate, '%Y.%m.%d.') as pdate,
            substr(text, 1, 40) as "articleTitle", {body('text')} as article, source as pcompany,
            if(lang = 'es', null, lang) as aclass, o_orderdate::date as pub_date
        from documents left join orders on o_orderkey = doc_id),
    whole as (select * from portal where pdate is not null and aclass is not null)"""
ORACLE |= {
    "clean_marked_text": f"select doc_id, {cleaned(f"{MARKED} || ' ' || text || ' ' || {MARKED}")} as cleaned from documents",
    "split_corpus": "select doc_id, text from documents",
    "pages_without_links": f"""
        with {PAGE}
        select url from pages_seen where len(list_filter(regexp_extract_all(page, '<a href="([^"]*)"', 1), lambda h: starts_with(h, '/t'))) = 0""",
    "portal_articles": f"with {PORTAL} select * from whole",
    "portal_rejects": f"""
        with {PORTAL}
        select url, concat_ws(',', if(pdate is null, 'pdate', null), if(aclass is null, 'aclass', null)) as missing
        from portal where pdate is null or aclass is null""",
    "portal_search": f"""
        with {PORTAL}
        select url, pdate, "articleTitle", pub_date from whole
        where (contains("articleTitle", {quoted(SEARCH_WORD)}) or contains(article, {quoted(SEARCH_WORD)}))
          and pub_date between date '{PORTAL_DAYS[0]}' and date '{PORTAL_DAYS[1]}' order by pub_date desc, url""",
}

WHOLE = "with " + cells() + SCALE.format(edges="edges") + THRESHOLD
RANKED_PAGES = f"""
    with ranked as ({rankings()}),
    shown as (select rank_date, ranking_type, section as blind, (position - 1)::integer as position, 'https://portal.example/c' || item as href,
        if(position % 2 = 1, 'user ' || item || ' & co', 'user ' || item) as title from ranked)"""
DAMAGED = """
    with turns as (select conv_id, turn, turn // 20 as page from conversations),
    page_sizes as (select conv_id, page, count(*)::bigint as n, min(turn) as first from turns group by all),
    landed as (select conv_id, page, n, conv_id % 7 = 0 as cut from page_sizes where not (conv_id % 3 = 0 and page = 0))"""
ORACLE |= {
    "search_repeatedly": " union all ".join(
        f"select {quoted(word)} as word, doc_id from documents where contains(text, {quoted(word)})" for word in SEARCH_WORDS
    ),
    "portal_ranking": f"{RANKED_PAGES} select * from shown",
    "portal_week_details": f"""
        {RANKED_PAGES}
        select rank_date, ranking_type, blind, position, href as url, c_name as "articleTitle", c_mktsegment as aclass
        from shown join customer on href = 'https://portal.example/c' || c_custkey
        where rank_date between date '{AS_OF}' - 6 and date '{AS_OF}'""",
    "comment_shortfall": f"""
        {DAMAGED}, totals as (select conv_id, count(*)::bigint as announced from turns group by all)
        select 'https://example.com/' || conv_id as url, if(bool_and(cut), null, any_value(announced)) as announced,
            sum(if(cut, 0, n))::bigint as landed, coalesce(if(bool_and(cut), null, any_value(announced)) = sum(if(cut, 0, n)), false) as complete
        from landed join totals using (conv_id) group by conv_id""",
    "comment_rejects": f"""
        {DAMAGED}
        select 'https://example.com/' || conv_id as url, kind, count(*)::bigint as n
        from landed, (values ('jsonp'), ('json')) k(kind) where cut group by all""",
    "community_facts": f"""
        {WHOLE} select count(*)::bigint as n_terms, true as once, true as numbered, true as settled, true as beats_one, true as beats_singles
        from kept_nodes""",
    "keyword_graph_nodes": ORACLE["keyword_graph"].rsplit("select src, dst, weight", 1)[0] + """
        select n.term, round(any_value(n.weight), 6) as weight, count(*) filter (kept.src = n.term)::bigint as n_first, true as agree
        from kept join node_weight n on n.term = kept.src or n.term = kept.dst group by n.term""",
}
