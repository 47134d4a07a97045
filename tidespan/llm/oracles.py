"""DuckDB SQL with the rows of those queries that SQL can express on whole tables."""

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
 k as (select doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i : i + 49], ' '))) as k, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
 f as (select k, min(doc_id) as m from k group by k),
 g as (select distinct doc_id, i + j as pos from k join f using (k), range(50) t(j) where m < doc_id),
 p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
 q as (select p.doc_id, string_agg(word, ' ' order by pos) filter (g.pos is null) as kept, count(g.pos) as n_removed from p left join g using (doc_id, pos) group by p.doc_id)
 select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join q using (doc_id)"""

#: Smallest node reachable over links (a, b), both ways, as (a, low).
REACH = """reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
 low as (select a, least(a, min(b)) as low from reach group by a)"""

OP4 = f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
 where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links(a, b) as materialized (select x.vec_id, y.vec_id from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95), {REACH},
 n as (select a, count(*) as n from links group by a)
 select vec_id, coalesce(n, 0) as n_links, coalesce(low, vec_id) as component_id, coalesce(low, vec_id) = vec_id as kept from embeddings left join n on n.a = vec_id left join low on low.a = vec_id"""

OP8 = f"""with d as (select doc_id, {WORDS.format("lower(text)")} as w from documents where text is not null),
 it as (select item_id, {WORDS.format("lower(text)")} as w from benchmark where text is not null),
 i5 as (select item_id, len(w) as n, unnest(range(0, len(w) - 4)) as o, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s from it where len(w) >= 5),
 d5 as (select doc_id, len(w) as m, unnest(range(0, len(w) - 4)) as p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s from d where len(w) >= 5),
 c as (select distinct doc_id, item_id, n, greatest(0, least(p - o, m - n)) as start from d5 join i5 using (s) where m >= n),
 a as (select c.*, d5.s, count(*) as ca from c join d5 on d5.doc_id = c.doc_id and d5.p between c.start and c.start + c.n - 5 group by all),
 b as (select item_id, s, count(*) as cb from i5 group by all),
 l as (select doc_id, item_id, n, start, sum(least(ca, cb)) as l from a join b using (item_id, s) group by all),
 r as (select *, l / (2.0::double * (n - 4) - l) as sim from l where l / (2.0::double * (n - 4) - l) >= 0.8)
 select doc_id, item_id, cast(arg_max(start, (sim, -start)) as integer) as start, cast(arg_max(n, (sim, -start)) as integer) as n_words, round(max(sim), 6) as similarity from r group by doc_id, item_id"""

OP9 = f"""with recursive d as (select doc_id, {WORDS.format(ASCII_LOWER)} as w from documents),
 s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
 x as (select doc_id, len(s) as n, unnest(s) as g from s),
 links(a, b) as materialized (select x.doc_id, y.doc_id from x join x y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))), {REACH}
 select doc_id, len(s) as n_shingles, coalesce(low, doc_id) as component_id from s left join low on low.a = doc_id"""

#: Ten rounds, written out: a CTE for the assignment and one for the centroids of each.
KMEANS = """v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as integer) as c, e from v qualify c < 8),
 """ + ",\n ".join(
    f"""a{r} as materialized (select vec_id, v.e, arg_min(c, (list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c{r}.e[i]) * (v.e[i] - c{r}.e[i]))), c)) as c,
 min(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c{r}.e[i]) * (v.e[i] - c{r}.e[i])))) as d from v, c{r} group by all)"""
    + (f""", m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as e from (select c, i, sum(e[i]) as s, count(*) as n from a{r}, range(1, 65) t(i) group by c, i) group by c),
 c{r + 1} as materialized (select c, coalesce(m{r}.e, c{r}.e) as e from c{r} left join m{r} using (c))""" if r < 10 else "")
    for r in range(11)
)
OP11 = f"""with {KMEANS}, s as (select c, sum(d) as s from a10 group by c) select vec_id, c as cluster, cast(d as bigint) as distance, cast(s as bigint) as cluster_inertia,
 cast((select sum(d) from a10) as bigint) as inertia, sha256(array_to_string(c10.e, ',')) as centroid_sha256 from a10 join s using (c) join c10 using (c)"""

OP13 = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
 where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) as bigint) as score from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0)
 select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p qualify rank <= 5"""

ORACLE_SQL = {"op3_substring_dedup": OP3, "op4_vector_join": OP4, "op8_decontamination": OP8, "op9_jaccard_join": OP9, "op11_centroids": OP11, "op13_topk_lists": OP13}
