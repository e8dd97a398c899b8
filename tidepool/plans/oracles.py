"""The registered queries' results in DuckDB SQL over the same tables."""

from __future__ import annotations

from tidepool.operators.evaluate import _POISSON
from tidepool.operators.rewrite import UNITS
from tidepool.plans.queries import GLOSSARY, PHRASES
from tidepool.schema import CAPTION_NAMESPACE, CHART_KEYWORDS, LINES_PER_PAGE, MAX_PAIR_TOKENS, MIN_TEXT_LEN, PROSE_KEYWORDS, REFUSAL_ENGLISH, REFUSAL_KOREAN, REFUSAL_SIGNS, TABLE_KEYWORDS, TEXT_NAMESPACE, TF_BUCKETS, VISION_NAMESPACE

_WHITE = r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SOURCE = "concat_ws('/', coalesce(source, ''), doc_id::varchar)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"(SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (('0x' || substr(h, 17, 1))::int & 3) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) FROM (SELECT {h} AS h))"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _buckets(x: str) -> str:
    return f"list_transform({_tokens(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % {TF_BUCKETS})"


def _coverage(q: str, t: str, most: int | None = None) -> str:
    asked = _tokens(q) if most is None else f"({_tokens(q)})[1:{most}]"
    there = _tokens(t) if most is None else f"({_tokens(t)})[1:{most} - len({asked})]"
    own = f"list_distinct({asked})"
    return f"CASE WHEN len({own}) = 0 THEN 0.0 ELSE round(len(list_intersect({own}, {there})) / len({own}), 6) END"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _raw(docs: str = "documents", name: str = "raw_blocks") -> str:
    return f"""{name}_l AS (SELECT doc_id, {_SOURCE} AS source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM {docs}),
{name} AS (SELECT doc_id, source, (pos // {LINES_PER_PAGE} + 1)::int AS page, block_type, (row_number() OVER (PARTITION BY source, block_type ORDER BY pos) - 1)::int AS block_index, text, pos
  FROM (SELECT *, CASE WHEN contains(line, '|') THEN 'table' ELSE 'text' END AS block_type, {_strip("line")} AS text FROM {name}_l))"""


_RAW = _raw()
_BLOCKS = f"{_RAW}, blocks AS (SELECT * FROM raw_blocks WHERE length(text) >= {MIN_TEXT_LEN})"
_NAME = "concat_ws(':', source, block_type, block_index::varchar)"
_POINTS = f"{_BLOCKS}, points AS (SELECT {_uuid5(TEXT_NAMESPACE, _NAME)} AS id, source, page, block_type, block_index, text FROM blocks)"
_QUESTIONS = "questions AS (SELECT item_id AS qid, text AS query FROM benchmark)"
_PAGES = f"""page_l AS (SELECT {_SOURCE} AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
pages_ AS (SELECT source, (p + 1)::int AS page, array_to_string(lines[p * {LINES_PER_PAGE} + 1 : (p + 1) * {LINES_PER_PAGE}], chr(10)) AS page_text FROM (SELECT source, lines, unnest(range((len(lines) + {LINES_PER_PAGE - 1}) // {LINES_PER_PAGE})) AS p FROM page_l))"""


def _search(corpus: str, queries: str, k: int, out: str) -> str:
    """CTEs that end in `out`: the k best rows of corpus (id, text) for queries (qid, query)."""
    return f"""{out}_d AS (SELECT id, b, count(*) AS tf FROM (SELECT id, unnest({_buckets("text")}) AS b FROM {corpus}) GROUP BY ALL),
{out}_q AS (SELECT qid, b, count(*) AS tf FROM (SELECT qid, unnest({_buckets("query")}) AS b FROM {queries}) GROUP BY ALL),
{out}_dn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM {out}_d GROUP BY id), {out}_qn AS (SELECT qid, sqrt(sum(tf * tf)) AS n FROM {out}_q GROUP BY qid),
{out}_s AS (SELECT qid, id, round(dot / (q.n * d.n), 6) AS score FROM (SELECT qid, id, sum(q.tf * d.tf) AS dot FROM {out}_q q JOIN {out}_d d USING (b) GROUP BY ALL) JOIN {out}_qn q USING (qid) JOIN {out}_dn d USING (id)),
{out} AS (SELECT h.qid, h.rank, h.score, c.* FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::int AS rank FROM {out}_s QUALIFY rank <= {k}) h JOIN {corpus} c USING (id))"""


_GLOSSED = f"""glossary AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY)}) g(term, target)),
translated AS (SELECT qid, string_agg(coalesce(target, word), ' ' ORDER BY pos) AS query FROM (SELECT qid, unnest(string_split(query, ' ')) AS word, unnest(range(len(string_split(query, ' ')))) AS pos FROM questions) LEFT JOIN glossary ON lower(word) = term GROUP BY qid)"""
_TURNS = """turns AS (SELECT conv_id, turn, conv_id::varchar || ':' || turn::varchar AS qid, text AS query, CASE WHEN next_role = 'assistant' THEN next_text END AS passage
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""
_PATCHES = "patches AS (SELECT vec_id // 20 AS doc_id, vec_id % 20 - 4 AS patch, embedding AS v FROM embeddings WHERE vec_id % 20 >= 4), toks AS (SELECT vec_id // 20 AS qid, vec_id % 20 AS token, embedding AS q FROM embeddings WHERE vec_id % 20 < 4)"
_DOTS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2]::double))"


def _cosine(a: str, b: str) -> str:
    return f"({_DOTS.format(a=a, b=b)} / (sqrt({_DOTS.format(a=a, b=a)}) * sqrt({_DOTS.format(a=b, b=b)})))"


_MAXSIM = f"""{_PATCHES}, late AS (SELECT qid, doc_id, round(sum(best), 6) AS score FROM (SELECT qid, token, doc_id, max({_cosine("q", "v")}) AS best FROM toks, patches GROUP BY ALL) GROUP BY ALL)"""
_VISION = f"""{_MAXSIM}, vpages AS (SELECT doc_id, count(*)::int AS n_patches FROM patches GROUP BY doc_id),
vnamed AS (SELECT d.doc_id, {_uuid5(VISION_NAMESPACE, "s || ':page:1'")} AS id, s AS source, 1 AS page, n_patches FROM (SELECT doc_id, {_SOURCE} AS s FROM documents) d JOIN vpages USING (doc_id)),
vall AS (SELECT qid, id, source, page, n_patches, score FROM late JOIN vnamed USING (doc_id))"""


def _vhits(k: int, questions: bool = True) -> str:
    only = "WHERE qid IN (SELECT qid FROM questions)" if questions else ""
    return f"vhits AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::int AS rank FROM vall {only} QUALIFY rank <= {k})"


_ROUTE = f"""CASE WHEN {_any("query", CHART_KEYWORDS)} AND NOT {_any("query", PROSE_KEYWORDS)} THEN 'chart-leaning' WHEN {_any("query", TABLE_KEYWORDS)} AND NOT {_any("query", PROSE_KEYWORDS)} THEN 'table — both useful'
  WHEN {_any("query", PROSE_KEYWORDS)} AND NOT {_any("query", CHART_KEYWORDS)} AND NOT {_any("query", TABLE_KEYWORDS)} THEN 'prose-leaning' ELSE 'balanced (default)' END"""
_WEIGHT = "CASE rationale WHEN 'chart-leaning' THEN {a} WHEN 'prose-leaning' THEN {b} ELSE 0.5 END"
_ROUTED = f"""routed AS (SELECT qid, ({_WEIGHT.format(a=0.3, b=0.7)})::double AS w_text, ({_WEIGHT.format(a=0.7, b=0.3)})::double AS w_vision, rationale FROM (SELECT qid, {_ROUTE} AS rationale FROM asked))"""
_ASKED = f"{_TURNS}, {_QUESTIONS}, asked AS (SELECT qid, query FROM turns UNION ALL SELECT 'item:' || qid, query FROM questions)"
_FUSED = f"""{_POINTS}, {_QUESTIONS}, asked AS (SELECT * FROM questions), {_ROUTED}, {_search("points", "questions", 8, "hits")}, {_VISION}, {_vhits(8)},
lists AS (SELECT qid, source, page, rank AS ord, 'text' AS list, w_text / (60 + rank) AS part, score FROM hits JOIN routed USING (qid) UNION ALL SELECT qid, source, page, rank + 1000000, 'vision', w_vision / (60 + rank), score FROM vhits JOIN routed USING (qid)),
fused AS (SELECT qid, source, page, sum(part) AS fused_score, string_agg(list, ',' ORDER BY ord) AS sources, min(ord) AS first_ord, arg_min(score, ord) AS score FROM lists GROUP BY ALL)"""
_TOP3 = "top3 AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, first_ord))::int AS rank FROM fused QUALIFY rank <= 3)"
_CAPTION = "array_to_string(list_filter([regexp_extract(page_text, '^[^\\n]*'), array_to_string(regexp_extract_all(page_text, '[0-9]+'), ' ')], lambda x: true), ' ')"
_CAPTIONS = f"""{_PAGES}, captions AS (SELECT source, page, array_to_string(string_split({_CAPTION}, ' ')[1:512], ' ') AS caption, page_text FROM pages_),
capped AS (SELECT {_uuid5(CAPTION_NAMESPACE, "concat_ws(':', source, 'caption', 'page', page::varchar)")} AS id, source, page, caption AS text FROM captions WHERE length(caption) > 0)"""
_ANSWER = """CASE WHEN c > 0 THEN t ELSE CASE WHEN regexp_matches(query, '[가-힣]') THEN '{ko}' ELSE '{en}' END END""".format(ko=REFUSAL_KOREAN, en=REFUSAL_ENGLISH)


def _answers(hits: str, name: str = "answers") -> str:
    return f"""{name}_s AS (SELECT qid, rank, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT qid, rank, regexp_split_to_array(coalesce(text, ''), '\\n|[.!?] ') AS s FROM {hits})),
{name}_b AS (SELECT qid, arg_min(c, (-c, rank, i)) AS c, arg_min(s, (-c, rank, i)) AS t FROM (SELECT s.*, {_coverage("q.query", "s.s")} AS c FROM {name}_s s JOIN questions q USING (qid)) GROUP BY qid),
{name}_n AS (SELECT qid, sum(len({_tokens("text")})) AS n FROM {hits} GROUP BY qid),
{name} AS (SELECT qid, query, {_ANSWER} AS answer, CASE WHEN c > 0 THEN 'end_turn' ELSE 'refusal' END AS stop_reason, (coalesce(n, 0) + len({_tokens("query")}))::bigint AS input_tokens FROM questions LEFT JOIN {name}_b USING (qid) LEFT JOIN {name}_n USING (qid))"""


def _context(hits: str, k: int) -> str:
    return f"context AS (SELECT qid, string_agg('[Passage ' || rank || ' — ' || source || ' p' || page || ' ' || block_type || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM {hits} WHERE rank <= {k} GROUP BY qid)"


_CASES = f"cases AS (SELECT qid, list_filter({_tokens('query')}, lambda t: length(t) >= 7) AS w FROM questions)"
_KEYWORDS = f"{_CASES}, keywords AS (SELECT qid, list_distinct(w) AS kws FROM cases)"


def _khit(hits: str) -> str:
    return f"SELECT k.qid, coalesce(len(list_filter(kws, lambda w: contains(a, w))) > 0, false) AS hit FROM keywords k LEFT JOIN (SELECT qid, lower(string_agg(text, ' ' ORDER BY rank)) AS a FROM {hits} GROUP BY qid) USING (qid)"


_POOL = f"{_search('points', 'questions', 20, 'pool')}, reranked AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, prior_rank))::int AS rank FROM (SELECT p.qid, p.id, p.text, p.score, p.rank AS prior_rank, {_coverage('q.query', 'p.text', MAX_PAIR_TOKENS)} AS rerank_score FROM pool p JOIN questions q USING (qid)) QUALIFY rank <= 3)"
_RESULTS = f"""{_POINTS}, {_QUESTIONS}, {_KEYWORDS}, {_GLOSSED}, {_search("points", "questions", 3, "h1")}, {_search("points", "translated", 3, "h2")}, {_POOL},
results AS (SELECT *, 'baseline' AS mode FROM ({_khit("h1")}) UNION ALL SELECT *, 'qt' FROM ({_khit("h2")}) UNION ALL SELECT *, 'rerank' FROM ({_khit("reranked")}))"""
_VARIANTS = "SELECT qid, coalesce(bool_or(hit) FILTER (mode = 'baseline'), false) AS baseline, coalesce(bool_or(hit) FILTER (mode = 'qt'), false) AS qt, coalesce(bool_or(hit) FILTER (mode = 'rerank'), false) AS rerank FROM results GROUP BY qid"
_GOLD = f"gold AS (SELECT DISTINCT qid, {_SOURCE} AS source FROM documents d JOIN questions q ON contains(d.text, q.query))"
_SOURCES = "firsts AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM (SELECT qid, source, min(rank) AS r FROM hits GROUP BY ALL))"
_VECTORS = "corpus AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings), asked AS (SELECT vec_id AS qid, embedding AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0)"
_NEAREST = f"WITH {_VECTORS}, nearest AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::int AS rank FROM (SELECT qid, id, label, q_label, round({_cosine('q', 'v')}, 6) AS score FROM asked, corpus WHERE qid <> id) QUALIFY rank <= 10)"
_EM = "trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '([0-9]),([0-9])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
_ELEMENT = "(?is)<(?:h1|p|li)(?:\\s[^>]*)?>(.*?)</(?:h1|p|li)>"
_MODES = f"""{_FUSED}, {_TOP3}, {_PAGES}, {_search("points", "questions", 5, "h5")}, {_vhits(3).replace("vhits", "v3", 1)}, {_KEYWORDS},
captions AS (SELECT source, page, array_to_string(string_split({_CAPTION}, ' ')[1:512], ' ') AS caption FROM pages_), capped AS (SELECT {_uuid5(CAPTION_NAMESPACE, "concat_ws(':', source, 'caption', 'page', page::varchar)")} AS id, source, page, caption AS text FROM captions WHERE length(caption) > 0),
{_search("capped", "questions", 5, "c5")}, vtop AS (SELECT qid, rank, coalesce(page_text, '') AS text FROM v3 LEFT JOIN pages_ USING (source, page)), htop AS (SELECT qid, rank, coalesce(page_text, '') AS text FROM top3 LEFT JOIN pages_ USING (source, page)),
{_answers("h5", "a_text")}, {_answers("vtop", "a_vision")}, {_answers("c5", "a_caption")}, {_answers("htop", "a_hybrid")}"""
_TEXT5 = f"WITH {_POINTS}, {_QUESTIONS}, {_search('points', 'questions', 5, 'hits')}"

ORACLE_SQL = {
    "extract_blocks": f"WITH {_RAW} SELECT source, page, block_type, block_index, text FROM raw_blocks",
    "min_len_filter": f"WITH {_BLOCKS} SELECT source, page, block_type, block_index, text FROM blocks",
    "chunk_ids": f"WITH {_POINTS} SELECT id, source, block_type, block_index FROM points",
    "page_ids": f"WITH {_PAGES} SELECT source, page, {_uuid5(VISION_NAMESPACE, chr(39).join(['concat_ws(', ':', ', source, ', 'page', ', page::varchar)']))} AS page_id, {_uuid5(CAPTION_NAMESPACE, chr(39).join(['concat_ws(', ':', ', source, ', 'caption', ', ', 'page', ', page::varchar)']))} AS caption_id FROM pages_",
    "page_count": f"WITH {_PAGES} SELECT source, count(*)::int AS n_pages FROM pages_ GROUP BY source",
    "page_lookup": f"WITH {_PAGES} SELECT source, page, md5(page_text) AS page_md5 FROM pages_ WHERE source IN (SELECT {_SOURCE} FROM documents WHERE doc_id % 20 = 0)",
    "html_blocks": f"""WITH e AS (SELECT page_id, url AS source, unnest(x) AS raw, unnest(range(len(x)))::int AS block_index FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'), '{_ELEMENT}', 1) AS x FROM pages)),
f AS (SELECT page_id, source, block_index, {_strip("regexp_replace(raw, '<[^>]*>', '', 'g')")} AS text FROM e) SELECT * FROM f WHERE length(text) >= {MIN_TEXT_LEN}""",
    "index_stats": f"WITH {_BLOCKS} SELECT source, 'text' AS collection, count(*) AS chunks, count(*) FILTER (block_type = 'text') AS n_text, count(*) FILTER (block_type = 'table') AS n_table FROM blocks GROUP BY source",
    "upsert_dedup": f"""WITH loud AS (SELECT doc_id, source, replace(text, 'e', 'E') AS text FROM documents WHERE doc_id % 2 = 0), {_RAW}, {_raw("loud", "loud_blocks")},
a AS (SELECT {_uuid5(TEXT_NAMESPACE, _NAME)} AS id, text FROM raw_blocks WHERE length(text) >= {MIN_TEXT_LEN}), b AS (SELECT {_uuid5(TEXT_NAMESPACE, _NAME)} AS id, text FROM loud_blocks WHERE length(text) >= {MIN_TEXT_LEN})
SELECT id, md5(text) AS text_md5 FROM b UNION ALL SELECT id, md5(text) FROM a WHERE id NOT IN (SELECT id FROM b)""",
    "collection_upsert": f"""WITH loud AS (SELECT doc_id, source, replace(text, 'e', 'E') AS text FROM documents WHERE doc_id % 2 = 0), {_RAW}, {_raw("loud", "loud_blocks")},
a AS (SELECT {_uuid5(TEXT_NAMESPACE, _NAME)} AS id, text FROM raw_blocks WHERE length(text) >= {MIN_TEXT_LEN}), b AS (SELECT {_uuid5(TEXT_NAMESPACE, _NAME)} AS id, text FROM loud_blocks WHERE length(text) >= {MIN_TEXT_LEN})
SELECT id, md5(text) AS text_md5 FROM b UNION ALL SELECT id, md5(text) FROM a WHERE id NOT IN (SELECT id FROM b)""",
    "tf_embed": f"WITH {_BLOCKS}, b AS (SELECT source, block_type, block_index, unnest({_buckets('text')}) AS b FROM blocks), c AS (SELECT source, block_type, block_index, b, count(*) AS tf FROM b GROUP BY ALL) SELECT source, block_type, block_index, count(*) AS n_buckets, sum(tf * tf)::bigint AS norm2 FROM c GROUP BY ALL",
    "l2_normalize": f"SELECT vec_id, unnest(range(len(embedding)))::int AS pos, round(unnest(embedding)::double / n, 6) AS x FROM (SELECT vec_id, embedding, sqrt({_DOTS.format(a='embedding', b='embedding')}) AS n FROM embeddings)",
    "cosine_topk": f"{_NEAREST} SELECT qid, rank, id, score FROM nearest",
    "maxsim_topk": f"WITH {_VISION}, {_vhits(5, False)} SELECT qid, rank, id, source, page, n_patches, score FROM vhits",
    "maxsim_pruned": f"WITH {_VISION}, {_vhits(5, False)} SELECT qid, rank, id, source, page, n_patches, score FROM vhits",
    "patch_stats": f"WITH {_PATCHES} SELECT source, 'vision' AS collection, count(*) AS pages, sum(n)::bigint AS total_patches FROM (SELECT {_SOURCE} AS source, n FROM documents JOIN (SELECT doc_id, count(*) AS n FROM patches GROUP BY doc_id) USING (doc_id)) GROUP BY source",
    "fp16_roundtrip": "SELECT vec_id, unnest(range(len(embedding)))::int AS pos, floor(unnest(embedding)::double * 64) / 64 AS x FROM embeddings",
    "text_topk": f"{_TEXT5} SELECT qid, rank, id, source, page, block_type, score FROM hits",
    "file_pages": f"WITH {_PAGES} SELECT source, page, md5(page_text) AS page_md5 FROM pages_",
    "file_collection": f"WITH {_POINTS} SELECT id, source, md5(text) AS text_md5 FROM points UNION ALL SELECT '', 'skipped', md5('no such file')",
    "stream_state": f"""WITH latest AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') WHEN doc_id % 2 = 0 THEN array_to_string(string_split(coalesce(text, ''), chr(10))[1 : greatest(1, len(string_split(coalesce(text, ''), chr(10))) // 2)], chr(10)) ELSE text END AS text FROM documents),
{_raw("latest", "raw_latest")}, kept AS (SELECT * FROM raw_latest WHERE length(text) >= {MIN_TEXT_LEN})
SELECT {_uuid5(TEXT_NAMESPACE, _NAME)} AS id, source, md5(text) AS text_md5 FROM kept""",
    "bucketed_lookup": f"WITH {_PAGES} SELECT source, page, md5(page_text) AS page_md5 FROM pages_ WHERE source IN (SELECT {_SOURCE} FROM documents WHERE doc_id % 20 = 0)",
    "udtf_blocks": f"WITH {_BLOCKS} SELECT source, page, block_type, block_index, text FROM blocks",
    "variant_phrases": f"""WITH RECURSIVE {_POINTS}, {_QUESTIONS}, phrases AS (SELECT string_split(p, ' ') AS p, t FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PHRASES)}) v(p, t)),
words AS (SELECT qid, string_split(coalesce(query, ''), ' ') AS w FROM questions), marked AS (SELECT qid, w, list_transform(w, lambda x: lower(x)) AS l, list_transform(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '[0-9]') OR (i > 1 AND regexp_matches(w[i - 1], '[0-9]') AND list_contains([{", ".join(f"'{u}'" for u in sorted(UNITS))}], lower(w[i])))) AS k FROM words),
walk AS (SELECT qid, 1 AS i, []::varchar[] AS o FROM marked UNION ALL
SELECT qid, i + coalesce(n, 1), list_append(o, coalesce(t, w[i])) FROM (SELECT walk.qid, walk.i, walk.o, w, (SELECT max(len(p)) FROM phrases WHERE l[walk.i : walk.i + len(p) - 1] = p AND NOT list_contains(k[walk.i : walk.i + len(p) - 1], true)) AS n, l FROM walk JOIN marked USING (qid) WHERE walk.i <= len(w)) s LEFT JOIN phrases ON len(p) = n AND l[i : i + n - 1] = p),
translated AS (SELECT qid, array_to_string(o, ' ') AS query FROM walk JOIN marked USING (qid) WHERE i > len(w)), {_search('points', 'translated', 3, 'hits')} SELECT qid, rank, id, score, 'phrases' AS variant, query AS rewritten_query FROM hits JOIN translated USING (qid)""",
    "bootstrap_poisson": f"""WITH {_RESULTS}, m AS ({_VARIANTS}), p AS (SELECT qid, rerank::int::double - baseline::int::double AS d FROM m),
sums AS (SELECT b, sum(w * d) / sum(w) AS m FROM (SELECT b, d, len(list_filter({_POISSON}, lambda t: t <= ('0x' || substr(md5('poisson:' || qid || ':' || b), 1, 8))::bigint)) AS w FROM p, range(1000) r(b)) WHERE w > 0 GROUP BY b)
SELECT round((SELECT avg(d) FROM p), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM sums""",
    "observed_costs": f"WITH {_CAPTIONS} SELECT count(*) AS captions, sum(len({_tokens('page_text')}))::bigint AS input_tokens, sum(len({_tokens('caption')}))::bigint AS output_tokens, round((sum(len({_tokens('page_text')})) * 1.0 + sum(len({_tokens('caption')})) * 5.0)::double / 1000000, 9) AS dollars FROM captions",
    "postings_topk": f"""WITH {_POINTS}, {_QUESTIONS}, tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_tokens('text')}) AS term FROM points) GROUP BY ALL), sizes AS (SELECT id, len({_tokens('text')}) AS l FROM points),
stats AS (SELECT count(*) AS n, avg(l) AS a FROM sizes), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tokens('query')}) AS term FROM questions) GROUP BY ALL),
scored AS (SELECT qid, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (id), stats GROUP BY ALL)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::int AS rank, id, score FROM scored QUALIFY rank <= 5""",
    "variant_baseline": f"WITH {_POINTS}, {_QUESTIONS}, {_search('points', 'questions', 3, 'hits')} SELECT qid, rank, id, score, 'baseline' AS variant, query AS rewritten_query FROM hits JOIN questions USING (qid)",
    "variant_qt": f"WITH {_POINTS}, {_QUESTIONS}, {_GLOSSED}, {_search('points', 'translated', 3, 'hits')} SELECT qid, rank, id, score, 'qt' AS variant, query AS rewritten_query FROM hits JOIN translated USING (qid)",
    "variant_hyde": f"WITH {_POINTS}, {_TURNS}, drafted AS (SELECT qid, coalesce(passage, query) AS query FROM turns), {_search('points', 'drafted', 3, 'hits')} SELECT qid, rank, id, score, 'hyde' AS variant, query AS rewritten_query FROM hits JOIN drafted USING (qid)",
    "router": f"WITH {_ASKED}, {_ROUTED} SELECT * FROM routed",
    "router_share": f"WITH {_ASKED}, {_ROUTED} SELECT rationale, count(*) AS n, round(count(*) / (SELECT count(*) FROM routed), 6) AS share FROM routed GROUP BY rationale",
    "rrf_fuse": f"WITH {_FUSED} SELECT qid, source, page, round(fused_score, 9) AS fused_score, round(score, 6) AS score FROM fused",
    "rrf_sources": f"WITH {_FUSED} SELECT qid, source, page, sources FROM fused",
    "hybrid_topk": f"WITH {_FUSED}, {_TOP3}, {_PAGES} SELECT qid, rank, source, page, round(fused_score, 9) AS fused_score, md5(page_text) AS page_md5 FROM top3 LEFT JOIN pages_ USING (source, page)",
    "hybrid_graph_answers": f"WITH {_FUSED}, {_TOP3}, {_PAGES}, top AS (SELECT qid, rank, coalesce(page_text, '') AS text FROM top3 LEFT JOIN pages_ USING (source, page)), {_answers('top')} SELECT qid, 'hybrid_graph' AS mode, answer, stop_reason FROM answers",
    "hybrid_answers": f"WITH {_FUSED}, {_TOP3}, {_PAGES}, top AS (SELECT qid, rank, coalesce(page_text, '') AS text FROM top3 LEFT JOIN pages_ USING (source, page)), {_answers('top')} SELECT qid, 'hybrid' AS mode, answer, stop_reason FROM answers",
    "page_hydrate": f"WITH {_QUESTIONS}, {_VISION}, {_vhits(3)}, {_PAGES} SELECT qid, rank, source, page, md5(page_text) AS page_md5 FROM vhits LEFT JOIN pages_ USING (source, page)",
    "rerank_topk": f"WITH {_POINTS}, {_QUESTIONS}, {_POOL} SELECT qid, rank, prior_rank, id, score, rerank_score FROM reranked",
    "format_context": f"{_TEXT5}, {_context('hits', 5)} SELECT qid, context FROM context",
    "prompt_assembly": f"{_TEXT5}, {_context('hits', 2)} SELECT qid, 'Question: ' || query || chr(10) || chr(10) || 'Passages:' || chr(10) || coalesce(context, '') AS prompt FROM questions LEFT JOIN context USING (qid)",
    "extractive_answer": f"{_TEXT5}, {_answers('hits')} SELECT qid, answer, stop_reason, input_tokens, len({_tokens('answer')})::bigint AS output_tokens FROM answers",
    "refusal_check": f"WITH {_TURNS}, a AS (SELECT qid, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN regexp_matches(query, '[가-힣]') THEN '{REFUSAL_KOREAN}' ELSE '{REFUSAL_ENGLISH}' END ELSE passage END AS answer FROM turns) SELECT qid, coalesce({_any('answer', REFUSAL_SIGNS)}, false) AS refuses FROM a",
    "caption_pages": f"WITH {_CAPTIONS} SELECT source, page, caption, len({_tokens('page_text')})::bigint AS input_tokens, len({_tokens('caption')})::bigint AS output_tokens FROM captions",
    "caption_stats": f"WITH {_CAPTIONS} SELECT source, 'caption' AS collection, count(*) AS captioned, sum(len({_tokens('page_text')}))::bigint AS input_tokens, sum(len({_tokens('caption')}))::bigint AS output_tokens FROM captions GROUP BY source",
    "caption_topk": f"WITH {_CAPTIONS}, {_QUESTIONS}, {_search('capped', 'questions', 5, 'hits')} SELECT qid, rank, id, source, page, score FROM hits",
    "image_base64": "SELECT page_id AS qid, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/webp' ELSE 'image/png' END AS media_type, md5(base64(encode(html))) AS data_md5, true AS cached FROM pages",
    "keyword_hit": f"WITH {_POINTS}, {_QUESTIONS}, {_KEYWORDS}, {_search('points', 'questions', 3, 'h1')} {_khit('h1')}",
    "variant_matrix": f"WITH {_RESULTS} {_VARIANTS}",
    "mode_matrix": f"""WITH {_MODES},
hit AS (SELECT qid, mode, len(list_filter(kws, lambda w: contains(lower(answer), w))) > 0 AS hit FROM (SELECT qid, 'text' AS mode, answer FROM a_text UNION ALL SELECT qid, 'vision', answer FROM a_vision UNION ALL SELECT qid, 'caption', answer FROM a_caption UNION ALL SELECT qid, 'hybrid', answer FROM a_hybrid) JOIN keywords USING (qid))
SELECT qid, bool_or(hit) FILTER (mode = 'text') AS text_only, bool_or(hit) FILTER (mode = 'vision') AS vision_only, bool_or(hit) FILTER (mode = 'caption') AS caption, bool_or(hit) FILTER (mode = 'hybrid') AS hybrid, bool_or(hit) FILTER (mode = 'hybrid') AS hybrid_graph FROM hit GROUP BY qid""",
    "pass_count": f"WITH {_RESULTS} SELECT mode, count(*) AS n, count(*) FILTER (hit) AS passed FROM results GROUP BY mode",
    "rerank_recovers": f"WITH {_RESULTS} SELECT qid, rerank AND NOT baseline AS recovered FROM ({_VARIANTS})",
    "hyde_recovers": f"WITH {_POINTS}, {_TURNS}, questions AS (SELECT qid, query FROM turns), drafted AS (SELECT qid, coalesce(passage, query) AS query FROM turns), {_KEYWORDS}, {_search('points', 'questions', 3, 'h1')}, {_search('points', 'drafted', 3, 'h2')} SELECT a.qid, b.hit AND NOT a.hit AS recovered FROM ({_khit('h1')}) a JOIN ({_khit('h2')}) b USING (qid)",
    "answer_keyword_hit": f"{_TEXT5}, {_answers('hits')}, {_KEYWORDS} SELECT qid, len(list_filter(kws, lambda w: contains(lower(answer), w))) > 0 AS hit FROM answers JOIN keywords USING (qid)",
    "vision_answers": f"WITH {_QUESTIONS}, {_VISION}, {_vhits(3)}, {_PAGES}, top AS (SELECT qid, rank, coalesce(page_text, '') AS text FROM vhits LEFT JOIN pages_ USING (source, page)), {_answers('top')} SELECT qid, 'vision_only' AS mode, answer, stop_reason FROM answers",
    "caption_answers": f"WITH {_CAPTIONS}, {_QUESTIONS}, {_search('capped', 'questions', 5, 'hits')}, {_answers('hits')} SELECT qid, 'caption' AS mode, answer, stop_reason FROM answers",
    "acceptance": f"WITH {_BLOCKS} SELECT source, count(*) FILTER (block_type = 'text') > 0 AS has_text, count(*) FILTER (block_type = 'table') >= 1 AS has_table, sum(length(text)) > 500 AS long_enough FROM blocks GROUP BY source",
    "recall_at_k": f"WITH {_POINTS}, {_QUESTIONS}, {_GOLD}, {_search('points', 'questions', 10, 'hits')}, {_SOURCES} SELECT qid, count(rank) AS n_found, count(*) AS n_gold, round(count(rank) / count(*), 6) AS recall, count(rank) > 0 AS hit FROM gold LEFT JOIN (SELECT * FROM firsts WHERE rank <= 5) USING (qid, source) GROUP BY qid",
    "recall_at_10": f"WITH {_POINTS}, {_QUESTIONS}, {_GOLD}, {_search('points', 'questions', 20, 'hits')}, {_SOURCES} SELECT qid, count(rank) AS n_found, count(*) AS n_gold, round(count(rank) / count(*), 6) AS recall, count(rank) > 0 AS hit FROM gold LEFT JOIN (SELECT * FROM firsts WHERE rank <= 10) USING (qid, source) GROUP BY qid",
    "ndcg_at_k": f"WITH {_POINTS}, {_QUESTIONS}, {_GOLD}, {_search('points', 'questions', 10, 'hits')}, {_SOURCES}, g AS (SELECT qid, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg, count(*) AS n FROM gold LEFT JOIN (SELECT * FROM firsts WHERE rank <= 5) USING (qid, source) GROUP BY qid) SELECT qid, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g",
    "missed_gold": f"{_TEXT5}, {_GOLD} SELECT qid, source FROM gold WHERE (qid, source) NOT IN (SELECT qid, source FROM hits)",
    "exact_match": f"WITH {_TURNS} SELECT qid, {_EM.format(x='o')} = {_EM.format(x='passage')} AS em FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN '  ' || replace(passage, ' ', '  ') || ' ' ELSE query END AS o FROM turns WHERE passage IS NOT NULL)",
    "answer_f1": f"""WITH {_TURNS}, t AS (SELECT qid, {_tokens("query")} AS a, {_tokens("passage")} AS g FROM turns WHERE passage IS NOT NULL)
SELECT qid, CASE WHEN len(a) + len(g) = 0 THEN 1.0 ELSE round(2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) / (len(a) + len(g)), 6) END AS f1 FROM t""",
    "hallucination_rate": f"WITH {_TURNS}, t AS (SELECT qid, list_distinct(regexp_extract_all(passage, '[0-9]+')) AS own, regexp_extract_all(query, '[0-9]+') AS there FROM turns WHERE passage IS NOT NULL) SELECT qid, CASE WHEN len(own) = 0 THEN 0.0 ELSE round(len(list_filter(own, lambda x: NOT list_contains(there, x))) / len(own), 6) END AS unsupported FROM t",
    "bootstrap_ci": f"""WITH {_RESULTS}, m AS ({_VARIANTS}), p AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, rerank::int::double - baseline::int::double AS d FROM m), n AS (SELECT count(*) AS n FROM p),
means AS (SELECT b, avg(d) AS m FROM (SELECT b, ('0x' || substr(md5('bootstrap:' || b || ':' || j), 1, 8))::bigint % n AS i FROM n, range(1000) r(b), range(100000) s(j) WHERE j < n) JOIN p USING (i) GROUP BY b)
SELECT round((SELECT avg(d) FROM p), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means""",
    "usage_cost": f"WITH {_CAPTIONS} SELECT source, round((sum(len({_tokens('page_text')})) * 1.0 + sum(len({_tokens('caption')})) * 5.0)::double / 1000000, 9) AS dollars FROM captions GROUP BY source",
    "storage_bytes": "SELECT label, sum(len(embedding) * 4)::bigint AS bytes FROM embeddings GROUP BY label",
    "metric_breakdown": "SELECT lang, toxic, count(*) AS n, round(avg(quality::double), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, toxic)",
    "repeat_average": "SELECT conv_id, round(avg(length(text)::double), 6) AS mean, count(DISTINCT turn) AS runs FROM conversations GROUP BY conv_id",
    "label_precision": f"{_NEAREST} SELECT qid, round(avg((label = q_label)::int::double), 6) AS precision FROM nearest GROUP BY qid",
    "trace_rows": f"""WITH {_POINTS}, {_QUESTIONS}, {_search("points", "questions", 3, "hits")}, {_answers("hits")}, h AS (SELECT qid, count(*)::int AS n, string_agg(source || ' p' || page, ';' ORDER BY rank) AS p, string_agg(printf('%.4f', score), ';' ORDER BY rank) AS s FROM hits GROUP BY qid)
SELECT qid, 'text_only' AS mode, 'standin:extractive' AS model, 'baseline' AS retriever_variant, stop_reason, coalesce(n, 0)::int AS n_hits, coalesce(p, '') AS hit_pages, coalesce(s, '') AS hit_scores FROM answers LEFT JOIN h USING (qid)""",
    "mode_traces": f"""WITH {_MODES},
listed AS (SELECT qid, mode, count(*)::int AS n, string_agg(source || ' p' || page, ';' ORDER BY rank) AS p, string_agg(printf('%.4f', score), ';' ORDER BY rank) AS s FROM (SELECT qid, 'text_only' AS mode, rank, source, page, score FROM h5 UNION ALL SELECT qid, 'vision_only' AS mode, rank, source, page, score FROM v3 UNION ALL SELECT qid, 'caption' AS mode, rank, source, page, score FROM c5 UNION ALL SELECT qid, 'hybrid' AS mode, rank, source, page, score FROM top3 UNION ALL SELECT qid, 'hybrid_graph' AS mode, rank, source, page, score FROM top3) GROUP BY qid, mode)
SELECT qid, mode, 'standin:extractive' AS model, stop_reason, input_tokens, coalesce(n, 0)::int AS n_hits, coalesce(p, '') AS hit_pages, coalesce(s, '') AS hit_scores FROM (SELECT qid, 'text_only' AS mode, stop_reason, input_tokens FROM a_text UNION ALL SELECT qid, 'vision_only' AS mode, stop_reason, input_tokens FROM a_vision UNION ALL SELECT qid, 'caption' AS mode, stop_reason, input_tokens FROM a_caption UNION ALL SELECT qid, 'hybrid' AS mode, stop_reason, input_tokens FROM a_hybrid UNION ALL SELECT qid, 'hybrid_graph' AS mode, stop_reason, input_tokens FROM a_hybrid) LEFT JOIN listed USING (qid, mode)""",
    "record_breakdown": f"""WITH {_POINTS}, {_QUESTIONS}, {_GLOSSED}, {_PAGES}, asked AS (SELECT qid || ':en' AS qid, qid AS item, 'en' AS language, query FROM questions UNION ALL SELECT qid || ':ko', qid, 'ko', query FROM translated),
{_search("points", "asked", 20, "hits")}, firsts AS (SELECT qid, source, page, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM (SELECT qid, source, page, min(rank) AS r FROM hits GROUP BY ALL)),
gold AS (SELECT DISTINCT qid AS item, source, page FROM pages_ JOIN questions ON contains(page_text, query)), kinds AS (SELECT qid AS item, CASE WHEN length(query) > 200 THEN 'long' ELSE 'short' END AS type FROM questions),
each AS (SELECT a.qid, language, type, count(*) AS n_gold, count(*) FILTER (rank <= 5) AS f5, count(*) FILTER (rank <= 10) AS f10, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg FROM asked a JOIN kinds USING (item) JOIN gold g USING (item) LEFT JOIN firsts f ON f.qid = a.qid AND f.source = g.source AND f.page = g.page GROUP BY ALL)
SELECT language, type, count(*) AS n, sum(n_gold)::bigint AS n_gold, round(avg(f5 / n_gold), 6) AS recall_5, round(avg(f10 / n_gold), 6) AS recall_10, round(avg(dcg / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_5 FROM each GROUP BY CUBE (language, type)""",
    "found_by_both": f"WITH {_POINTS}, {_QUESTIONS}, {_CAPTIONS}, {_search('points', 'questions', 8, 'h1')}, {_search('capped', 'questions', 8, 'h2')} SELECT qid, source, page FROM h1 INTERSECT SELECT qid, source, page FROM h2",
    "snippets": f"WITH {_POINTS}, {_QUESTIONS}, {_search('points', 'questions', 3, 'hits')} SELECT qid, rank, replace(substr(text, 1, 150), chr(10), ' / ') AS snippet FROM hits",
    "stream_upkeep": f"WITH {_POINTS} SELECT id, source, md5(text) AS text_md5 FROM points",
    "table_markdown": f"""WITH {_RAW}, b AS (SELECT source, pos, line, pos - row_number() OVER (PARTITION BY source ORDER BY pos) AS run FROM raw_blocks_l WHERE contains(line, '|')),
c AS (SELECT source, run, pos, list_transform(string_split(regexp_replace({_strip("line")}, '^\\||\\|$', '', 'g'), '|'), lambda x: {_strip("x")}) AS c FROM b),
w AS (SELECT *, len(first(c) OVER (PARTITION BY source, run ORDER BY pos)) AS w, row_number() OVER (PARTITION BY source, run ORDER BY pos) AS n FROM c),
r AS (SELECT source, run, pos, n, w, '| ' || array_to_string(list_concat(c, list_transform(range(w), lambda i: ''))[1:w], ' | ') || ' |' AS line FROM w)
SELECT source, min(pos)::int AS first_line, count(*)::int AS n_rows, md5(string_agg(CASE WHEN n = 1 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY pos)) AS markdown_md5 FROM r GROUP BY source, run""",
    "collection_search": f"{_TEXT5} SELECT qid, rank, id, source, page, block_type, score FROM hits",
    "caption_collection": f"WITH {_CAPTIONS} SELECT id, source, page, text AS caption, true AS same FROM capped",
    "vision_collection": f"WITH {_QUESTIONS}, {_VISION}, {_vhits(5)} SELECT qid, rank, id, score FROM vhits",
    "cosine_collection": f"{_NEAREST} SELECT qid, rank, id, score FROM nearest WHERE rank <= 5",
    "rrf_payload": f"""WITH {_FUSED}, first AS (SELECT qid, source, page, h.id, h.block_type, md5(h.text) AS text_md5, NULL::int AS n_patches, first_ord FROM fused f JOIN hits h USING (qid, source, page) WHERE h.rank = f.first_ord UNION ALL SELECT qid, source, page, v.id, NULL, NULL, v.n_patches, first_ord FROM fused f JOIN vhits v USING (qid, source, page) WHERE v.rank + 1000000 = f.first_ord)
SELECT qid, source, page, id, block_type, text_md5, n_patches FROM first""",
    "page_images": f"WITH {_PAGES} SELECT source, page, 2 * greatest(1, list_max(list_transform(string_split(page_text, chr(10)), lambda l: length(l))))::int AS width, 2 * len(string_split(page_text, chr(10)))::int AS height FROM pages_",
    "vision_requests": "SELECT page_id % 7 AS qid, count(*)::int AS n_images, CASE WHEN count(*) > 1 THEN 'image,image' ELSE 'image,text' END AS first, least(count(*), 3)::int AS marked, 'Question: ' || min(url) AS question, 'ephemeral' AS system_mark FROM pages GROUP BY ALL",
    "generated_answers": f"WITH {_QUESTIONS} SELECT qid, 'Question: ' || coalesce(query, '') AS answer, 'end_turn' AS stop_reason, (1 + len({_tokens('query')}))::bigint AS input_tokens, 1::bigint AS cache_creation_input_tokens, 0::bigint AS cache_read_input_tokens FROM questions",
    "short_completions": f"WITH {_TURNS} SELECT qid, array_to_string(string_split(trim(passage), ' ')[1:8], ' ') AS completion, array_to_string(string_split(trim(passage), ' ')[1:256], ' ') AS whole FROM turns WHERE passage IS NOT NULL",
    "judge_marks": f"WITH {_TURNS} SELECT qid, (1 + floor(4 * {_coverage('passage', 'query').replace('round(', '(').replace(', 6)', ')')} + 0.5))::int AS mark FROM turns WHERE passage IS NOT NULL",
    "variant_written": f"WITH {_POINTS}, {_QUESTIONS}, cut AS (SELECT qid, array_to_string(string_split(trim(lower(query)), ' ')[1:6], ' ') AS query FROM questions), {_search('points', 'cut', 3, 'hits')} SELECT qid, rank, id, score, 'written' AS variant, query AS rewritten_query FROM hits JOIN cut USING (qid)",
    "mode_breakdown": f"WITH {_RESULTS}, asked AS (SELECT * FROM questions), {_ROUTED} SELECT mode, rationale, count(*) AS n, round(avg(hit::int::double), 6) AS mean FROM results JOIN routed USING (qid) GROUP BY CUBE (mode, rationale)",
    "page_hosts": "SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), ''), 'localhost') AS host FROM pages",
}
