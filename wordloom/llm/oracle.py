"""SQL for the queries whose results SQL can express on whole tables."""

from __future__ import annotations

from wordloom.llm.columns import LOWER, UPPER
from wordloom.llm.lattice_dedup import COSINE
from wordloom.llm.minhash import PERCENT
from wordloom.llm.mixing import BLOCK_WORDS, MAX_REPEATS, PERIOD, SEED, STEP, UNEVEN, WEIGHT_CYCLE
from wordloom.llm.shingles import WORDS
from wordloom.llm.spelling import LOSS, MIN_COUNT, MIN_LENGTH, RATIO
from wordloom.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def labels(nodes: str) -> str:
    """Least node that ``links(a, b)`` reach, from a table with column ``node``."""
    return f"""
        both_ways as (select a, b from links union all select b, a from links),
        reached as (select node, node as other from {nodes} union select node, b from reached join both_ways on a = other),
        label as (select node, min(other) as component from reached group by node)"""


SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""
    with recursive
        lists as (select doc_id, regexp_extract_all({lowered('text')}, '{SPACED}') as l from documents),
        sets as materialized (
            select distinct doc_id, array_to_string(l[i:i + {WORDS - 1}], ' ') as s
            from lists, unnest(range(1, greatest(len(l) - {WORDS - 1}, 1) + 1)) t(i) where len(l) > 0),
        sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
        shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from sets x join sets y using (s)
                   where x.doc_id < y.doc_id group by all),
        links as materialized (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
                               where 100 * k >= {PERCENT} * (p.n + q.n - k)),
        nodes as (select doc_id as node from documents),
        {labels('nodes')}
    select doc_id, coalesce(n, 0)::bigint as n_shingles, component as component_id, component = doc_id as kept
    from documents join label on node = doc_id left join sizes using (doc_id)"""

CONTAMINATION = f"""
    with items as (select item_id, regexp_extract_all({lowered('text')}, '{PLAIN}') as l from benchmark),
        sized as (select item_id, l, least(len(l), 10) as k from items where len(l) > 0),
        windows as materialized (
            select distinct item_id, k, array_to_string(l[i:i + k - 1], ' ') as g from sized, unnest(range(1, len(l) - k + 2)) t(i)),
        lists as materialized (select doc_id, regexp_extract_all({lowered('text')}, '{PLAIN}') as l from documents),
        found as materialized (
            select doc_id, i, k, item_id from (
                select doc_id, i, k, array_to_string(l[i:i + k - 1], ' ') as g
                from lists, (select distinct k from windows), unnest(range(1, len(l) - k + 2)) t(i))
            join windows using (k, g)),
        hits as (select doc_id, count(distinct p) as n from found, unnest(range(i, i + k)) t(p) group by doc_id),
        named as (select doc_id, count(*) as n, string_agg(name, ',' order by name) as ids
                  from (select distinct doc_id, item_id::varchar as name from found) group by doc_id)
    select doc_id, len(l)::bigint as n_words, coalesce(hits.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
    from lists left join hits using (doc_id) left join named using (doc_id)"""

MIXING = f"""
    with docs as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::bigint as size,
                md5(concat('{SEED}|', coalesce(doc_id::varchar, '~'), '|', coalesce(text, ''))) as mark from documents),
        sources as (select source, sum(size)::bigint as source_size from docs group by source),
        ranked as (select *, row_number() over (order by source nulls last) - 1 as k from sources),
        weighed as (select *, (k % {WEIGHT_CYCLE} + 1)::double as weight, ({MAX_REPEATS} * source_size)::double as most from ranked),
        levels as (select *, (sum(source_size) over ()::double
                - coalesce(sum(most) over (order by most / weight, k rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by most / weight, k rows between current row and unbounded following) as level from weighed),
        chosen as (select coalesce(arg_min(level, (most / weight, k)) filter (level <= most / weight), 0) as level from levels),
        targets as (select k, source, source_size, least(most, weight * chosen.level) as target from weighed, chosen),
        line as (select docs.*, row_number() over () as text_row, k, source_size, target, least(round(target)::bigint, {MAX_REPEATS} * source_size) as words,
                coalesce(sum(size) over (partition by docs.source order by mark, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from docs join targets on docs.source is not distinct from targets.source),
        needs as (select k, ceil(least(round(target)::bigint, {MAX_REPEATS} * source_size) / {BLOCK_WORDS}::double)::bigint as blocks from targets),
        edges as (select k, blocks, coalesce(sum(blocks) over (order by k rows between unbounded preceding and 1 preceding), 0)::double
                / sum(blocks) over () as low, sum(blocks) over (order by k)::double / sum(blocks) over () as high from needs where blocks > 0),
        ends as (select *, ceil((blocks + {UNEVEN}) / (high - low))::bigint as ending from edges),
        points as (select id, (id % {PERIOD}) * {STEP} % {PERIOD} / {PERIOD}::double as point
                   from (select unnest(range(coalesce((select max(ending) from ends), 0))) as id)),
        visits as (select k, blocks, id, row_number() over (partition by k order by id) - 1 as block
                   from points join ends on point >= low and point < high and id < ending),
        slots as materialized (select k, block, row_number() over (order by id) - 1 as slot from visits where block < blocks),
        parts as (select doc_id, text_row, k, start + e * source_size as first, least(start + e * source_size + size, words) as last
                  from line, unnest(range({MAX_REPEATS})) t(e) where size > 0),
        pieces as (select text_row, parts.k, block, least(last, (block + 1) * {BLOCK_WORDS}) - greatest(first, block * {BLOCK_WORDS}) as n
                   from parts, unnest(range(first // {BLOCK_WORDS}, (last - 1) // {BLOCK_WORDS} + 1)) t(block) where first < last),
        taken as (select text_row, sum(n)::bigint as taken, min(slot)::bigint as first_slot, count(*)::bigint as n_pieces
                  from pieces join slots using (k, block) group by text_row)
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, coalesce(n_pieces, 0)::bigint as n_pieces
    from line left join taken using (text_row)"""

VECTOR_LINKS = f"""
    with recursive
        usable as materialized (
            select vec_id as node, embedding::double[] as v from embeddings where embedding is not null
              and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as materialized (select p.node as a, q.node as b from usable p join usable q on p.node < q.node and len(p.v) = len(q.v)
                               where list_cosine_similarity(p.v, q.v) >= {COSINE}),
        nodes as (select vec_id as node from embeddings),
        {labels('nodes')},
        counts as (select a as node, count(*) as n from both_ways group by a)
    select node as vec_id, coalesce(n, 0)::bigint as n_links, component as component_id, component = node as kept
    from label left join counts using (node)"""

# crc32 is worked out byte by byte: code points up to 255 are one byte or two in UTF-8.
SPELLING = f"""
    with recursive
        crc as (select list_transform(range(256), lambda i: list_reduce(range(8),
                    lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as entry),
        runs as (select doc_id, unnest(regexp_extract_all({lowered('text')}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
        places as materialized (select coalesce(doc_id::varchar, '') as id, run, count(*) as k from runs group by all),
        bytes as (select id, run, k, flatten(list_transform(string_split(concat(id, ':', run), ''),
                    lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end)) as b from places),
        marks as (select run, k, xor(4294967295, list_reduce(b, lambda c, x: xor(entry[xor(c & 255, x) + 1], c >> 8), 4294967295)) as h from bytes, crc),
        kept as (select k, case when h % {LOSS} = 0 then concat(left(run, (h % length(run))::int), substr(run, (h % length(run))::int + 2)) else run end as word from marks),
        words as materialized (select word, sum(k)::bigint as n from kept where length(word) >= {MIN_LENGTH} group by word having sum(k) >= {MIN_COUNT}),
        cut as materialized (select word, n, left(word, i::int) as a, substr(word, i::int + 2) as b from words, unnest(range(length(word))) t(i)),
        near as materialized (
            select x.word, y.word as other, y.n as m from cut x join cut y using (a, b) where x.word <> y.word and length(x.word) = length(y.word)
            union select c.word, w.word, w.n from cut c join words w on w.word = concat(c.a, c.b)
            union select w.word, c.word, c.n from cut c join words w on w.word = concat(c.a, c.b)),
        best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as form, max(m) as form_n from near group by word),
        chosen as materialized (
            select word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= {RATIO} * n then form end as form,
                case when form_n >= {RATIO} * n then form_n end as form_n from words left join best using (word)),
        steps as (select word, word as target, 0 as step from chosen
                  union all select steps.word, chosen.form, step + 1 from steps join chosen on chosen.word = target where chosen.form is not null),
        roots as (select word, arg_max(target, step) as root from steps group by word)
    select word, form, root, n, n_near, form_n from chosen join roots using (word)"""



def lloyd_rounds() -> str:
    """Each round assigns every part by a full scan and moves the entries."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
        near{r} as materialized (
            select k, parts.p, arg_min(e, (d, e)) as e, min(d) as d from (
                select k, parts.p, e, list_sum(list_transform(list_zip(c, b), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d
                from parts join book{r} using (p)) parts group by all)""")
        if r < ROUNDS:
            steps.append(f"""
        sums{r} as (select p, e, j, sum(c[j])::bigint as s, count(*) as n from near{r} join parts using (k, p), unnest(range(1, len(c) + 1)) t(j) group by all),
        means{r} as (select p, e, list((s - (s % n + n) % n) // n order by j) as b from sums{r} group by all),
        book{r + 1} as materialized (select p, e, coalesce(m.b, o.b) as b from book{r} o left join means{r} m using (p, e))""")
    return ",".join(steps)


VECTOR_CODES = f"""
    with kept as materialized (
            select row_number() over (order by vec_id) as k, vec_id, label, list_transform(embedding::double[], lambda x: floor({SCALE} * x)::bigint) as v
            from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as materialized (select k, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as c from kept, unnest(range({PARTS})) t(p)),
        book0 as materialized (select p, k - 1 as e, c as b from parts where k <= {ENTRIES}),
        {lloyd_rounds().strip()},
        coded as (select k, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near{ROUNDS} group by k),
        flat as (select p, e, j, b[j] as x from book{ROUNDS}, unnest(range(1, len(b) + 1)) t(j)),
        digest as (select sha256(string_agg(x::varchar, ',' order by p, e, j)) as codebooks_sha256 from flat)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
    from kept join coded using (k), digest"""

ORACLE: dict[str, str] = {
    "op1_minhash": NEAR_DUPLICATES,
    "op3_decontamination": CONTAMINATION,
    "op6_mixing": MIXING,
    "op7_lattice": VECTOR_LINKS,
    "op11_vector_codes": VECTOR_CODES,
    "op13_spelling": SPELLING,
}
