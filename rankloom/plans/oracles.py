"""SQL of the registered queries, for an independent engine."""

from __future__ import annotations

from ..functions.stemmer import BEGINNINGS, DOUBLES, KEPT, KEPT_AFTER_1A, LI_ENDINGS, OWN_STEM, STEP_2, STEP_3, STEP_4
from ..functions.text import IDENTIFIERS, REFUSAL_MARKERS, STOP_WORDS

_WORD = r"[\p{L}\p{N}_]{2,}"


def _tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_WORD}')"


_CHUNKS = """c0 AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 512 THEN 1 ELSE CAST(ceil((length(text) - 512) / 448.0) * 448 AS BIGINT) + 1 END, 448)) AS start_char FROM documents WHERE length(text) > 0),
chunks AS (SELECT doc_id, CAST(start_char / 448 AS INT) AS chunk_index, printf('%d::%04d', doc_id, CAST(start_char / 448 AS INT)) AS chunk_id, regexp_replace(substring(text, CAST(start_char AS INT) + 1, 512), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text, CAST(start_char AS INT) AS start_char, CAST(start_char AS INT) + length(regexp_replace(substring(text, CAST(start_char AS INT) + 1, 512), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS end_char FROM c0 WHERE regexp_replace(substring(text, CAST(start_char AS INT) + 1, 512), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '')"""


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def _rank(k: int | None, ties: str = "chunk_id", source: str = "scored") -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    return f"(SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, {ties}) AS rank FROM {source}){cut})"


def _bm25(k: int, table: str = "(SELECT doc_id AS chunk_id, text FROM documents)", p: str = "b", name: str = "bm25", asked: str = "(SELECT item_id AS query_id, text FROM benchmark)") -> str:
    return f"""{p}t AS (SELECT chunk_id, {_tok('text')} AS w FROM {table}),
{p}m AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {p}t),
{p}q AS (SELECT DISTINCT query_id, unnest({_tok('text')}) AS term FROM {asked}),
{p}f AS (SELECT term, chunk_id, count(*) AS tf, any_value(size) AS size FROM (SELECT chunk_id, len(w) AS size, unnest(w) AS term FROM {p}t) WHERE term IN (SELECT term FROM {p}q) GROUP BY ALL),
{p}d AS (SELECT term, count(*) AS df FROM {p}f GROUP BY term),
{p}s AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM {p}q JOIN {p}f USING (term) JOIN {p}d USING (term), {p}m GROUP BY ALL),
{name} AS {_rank(k, source=p + 's')}"""


def _overlap(k: int | None) -> str:
    return f"""oq AS (SELECT item_id AS query_id, list_distinct({_tok('text')}) AS terms FROM benchmark),
oe AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM oq),
ow AS (SELECT doc_id AS chunk_id, unnest(list_distinct({_tok('text')})) AS term FROM documents),
os AS (SELECT query_id, chunk_id, count(*) / any_value(n) AS score FROM oe JOIN ow USING (term) GROUP BY ALL),
overlap AS {_rank(k, source='os')}"""


def _dense(k: int, more: str = "") -> str:
    return f"ds AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0{more}), dense AS {_rank(k, source='ds')}"


_GOLDEN = """gf AS (SELECT item_id AS query_id, list_sort(list_distinct(list(doc_id))) AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
golden AS (SELECT item_id AS query_id, coalesce(relevant, []) AS relevant, CASE WHEN relevant IS NULL THEN 'unanswerable' WHEN len(relevant) > 1 THEN 'multi' ELSE 'single' END AS kind FROM benchmark b LEFT JOIN gf ON gf.query_id = b.item_id)"""


def _results(name: str = "results", source: str = "bm25", join: str = "LEFT JOIN") -> str:
    def rec(k):
        return f"CASE WHEN len(relevant) = 0 THEN 1.0 ELSE len(list_intersect(retrieved[1:{k}], relevant)) / len(relevant) END"

    def ndcg(k):
        return f"CASE WHEN len(relevant) = 0 THEN 1.0 ELSE coalesce(list_sum([CASE WHEN list_contains(relevant, x) THEN 1 / log2(i + 1) ELSE 0.0 END FOR x, i IN retrieved[1:{k}]]), 0.0) / list_sum([1 / log2(j + 1) FOR j IN range(1, least(len(relevant), {k}) + 1)]) END"

    def prec(k):
        return f"CASE WHEN len(relevant) = 0 OR len(retrieved) = 0 THEN 0.0 ELSE len([x FOR x IN retrieved[1:{k}] IF list_contains(relevant, x)]) / len(retrieved[1:{k}]) END"

    def hit(k):
        return f"CASE WHEN len(relevant) = 0 THEN 1.0 WHEN list_has_any(retrieved[1:{k}], relevant) THEN 1.0 ELSE 0.0 END"

    cols = ", ".join(f"round({f(k)}, 6) AS {n}_at_{k}" for n, f in (("recall", rec), ("precision", prec), ("ndcg", ndcg), ("hit", hit)) for k in (1, 3, 5))
    return f"""{name}_l AS (SELECT query_id, list(chunk_id ORDER BY rank) AS retrieved FROM {source} WHERE rank <= 20 GROUP BY query_id),
{name}_g AS (SELECT g.query_id, kind, relevant, coalesce(retrieved, []) AS retrieved FROM golden g {join} {name}_l l ON l.query_id = g.query_id),
{name}_f AS (SELECT *, list_min([i FOR x, i IN retrieved IF list_contains(relevant, x)]) AS first_rank FROM {name}_g),
{name} AS (SELECT query_id, kind, {cols}, round(CASE WHEN len(relevant) = 0 THEN 1.0 ELSE coalesce(1 / first_rank, 0.0) END, 6) AS mrr, first_rank, len(relevant) AS n_relevant FROM {name}_f)"""


def _embedded(k: int) -> str:
    return f"ev AS {_units('documents', 'doc_id')}, eq AS (SELECT item_id, v AS q FROM {_units('benchmark', 'item_id')}), es AS (SELECT item_id AS query_id, doc_id AS chunk_id, list_dot_product(v, q) AS score FROM eq, ev), embedded AS {_rank(k, source='es')}"


def _rrf(k: int = 60, wa: float = 1.0, wb: float = 1.0, name: str = "fused") -> str:
    return f"""{name}_u AS (SELECT query_id, chunk_id, rank, 0 AS l, {wa} AS w FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 1, {wb} FROM overlap),
{name}_s AS (SELECT query_id, chunk_id, sum(w / ({k} + rank)) AS score, min(l * 1000 + rank) AS first FROM {name}_u GROUP BY ALL),
{name} AS {_rank(5, "first, chunk_id", name + "_s")}"""


_IDS = IDENTIFIERS
_LEXICAL = " OR ".join(f"regexp_matches(text, '{p}')" for p in _IDS.values())
_WHICH = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _IDS.items()) + " END"
_EDGES = """often AS (SELECT l_partkey AS e FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2),
m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem WHERE l_partkey IN (SELECT e FROM often)),
edges AS (SELECT a.e AS src, b.e AS dst, count(*) AS weight FROM m a JOIN m b ON a.c = b.c AND a.e <> b.e GROUP BY 1, 2)"""
_HITS = f"{_CHUNKS}, {_bm25(15, 'chunks')}, hits AS (SELECT b.query_id, b.chunk_id, b.rank, b.score, c.doc_id, c.start_char, c.end_char FROM bm25 b JOIN chunks c ON c.chunk_id = b.chunk_id)"
_BLOCKS = f"{_HITS}, blocks AS (SELECT h.query_id, h.rank, '[' || h.rank || '] ' || d.source || ' (' || h.doc_id || ')' || chr(10) || c.text AS block FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN documents d ON d.doc_id = h.doc_id WHERE h.rank <= 5), used AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blocks)"
_GATE = f"{_overlap(5)}, gate AS (SELECT item_id AS query_id, coalesce(best, 0.0) AS best_score, best IS NULL OR best < 0.6 AS abstain FROM benchmark LEFT JOIN (SELECT query_id, max(score) AS best FROM overlap GROUP BY 1) o ON o.query_id = item_id)"
_KINDS = "SELECT {kind} AS kind, count(*) AS n, round(avg(recall_at_1), 4) AS recall_at_1, round(avg(recall_at_3), 4) AS recall_at_3, round(avg(recall_at_5), 4) AS recall_at_5, round(avg(mrr), 4) AS mrr, round(avg(ndcg_at_5), 4) AS ndcg_at_5, round(avg(CASE WHEN n_relevant > 0 THEN recall_at_5 END), 4) AS answerable_recall_at_5, round(avg(CASE WHEN n_relevant = 0 THEN 1.0 ELSE least(1.0, 1 / n_relevant) END), 4) AS max_recall_at_1 FROM results GROUP BY ALL"
_REFUSED = " OR ".join("contains(lower(t), '" + m.replace("'", "''") + "')" for m in REFUSAL_MARKERS)
_JT = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9\\-_.]*'))"

_FIXED = "(SELECT item_id AS query_id, 'the of and in' AS text FROM benchmark)"
def _stems(words: str) -> str:
    """CTEs that stem the column word of a table of distinct words step by step; the last is stems (word, stem)."""
    def suffix(name, column, source, pattern):
        return f"{name} AS (SELECT *, regexp_extract({column}, '({pattern})$') AS x FROM {source}), {name}b AS (SELECT *, left({column}, length({column}) - length(x)) AS base FROM {name})"

    def replaced(step):
        return "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in step.items()) + " END"

    region, short = "^[^aeiouy]*[aeiouy]+[^aeiouy]", "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
    return f"""st0 AS (SELECT word, regexp_replace(CASE WHEN word LIKE 'y%' THEN 'Y' || substr(word, 2) ELSE word END, '([aeiouy])y', '\\1Y', 'g') AS s FROM {words}),
st1 AS (SELECT *, CASE WHEN regexp_matches(s, '^({'|'.join(BEGINNINGS)})') THEN length(regexp_extract(s, '^({'|'.join(BEGINNINGS)})')) WHEN regexp_matches(s, '{region}') THEN length(regexp_extract(s, '{region}')) ELSE length(s) END AS r1 FROM st0),
st2 AS (SELECT *, CASE WHEN regexp_matches(substr(s, r1 + 1), '{region}') THEN r1 + length(regexp_extract(substr(s, r1 + 1), '{region}')) ELSE length(s) END AS r2 FROM st1),
st3 AS (SELECT word, r1, r2, CASE WHEN s LIKE '%sses' THEN left(s, length(s) - 2) WHEN regexp_matches(s, 'ie[ds]$') THEN left(s, length(s) - CASE WHEN length(s) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(s, '[us]s$') THEN s WHEN regexp_matches(s, '[aeiouy].+s$') THEN left(s, length(s) - 1) ELSE s END AS a FROM st2),
{suffix('st4', 'a', 'st3', 'eedly|ingly|edly|eed|ing|ed')},
st5 AS (SELECT word, r1, r2, a, CASE WHEN x LIKE 'eed%' THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE a END WHEN x <> '' AND regexp_matches(base, '[aeiouy]') THEN CASE WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e' WHEN regexp_matches(base, '({'|'.join(DOUBLES)})$') THEN left(base, length(base) - 1) WHEN r1 >= length(base) AND regexp_matches(base, '{short}') THEN base || 'e' ELSE base END ELSE a END AS b FROM st4b),
st6 AS (SELECT word, r1, r2, a, CASE WHEN length(b) > 2 AND regexp_matches(b, '[^aeiouy][yY]$') THEN left(b, length(b) - 1) || 'i' ELSE b END AS c FROM st5),
{suffix('st7', 'c', 'st6', '|'.join(STEP_2))},
st8 AS (SELECT word, r1, r2, a, CASE WHEN x <> '' AND length(base) >= r1 AND (x NOT IN ('ogi', 'li') OR (x = 'ogi' AND base LIKE '%l') OR (x = 'li' AND regexp_matches(base, '[{LI_ENDINGS}]$'))) THEN base || {replaced(STEP_2)} ELSE c END AS d FROM st7b),
{suffix('st9', 'd', 'st8', '|'.join(STEP_3))},
st10 AS (SELECT word, r1, r2, a, CASE WHEN x <> '' AND length(base) >= CASE WHEN x = 'ative' THEN r2 ELSE r1 END THEN base || {replaced(STEP_3)} ELSE d END AS e FROM st9b),
{suffix('st11', 'e', 'st10', '|'.join(STEP_4))},
st12 AS (SELECT word, r1, r2, a, CASE WHEN x <> '' AND length(base) >= r2 AND (x <> 'ion' OR regexp_matches(base, '[st]$')) THEN base ELSE e END AS f FROM st11b),
st13 AS (SELECT word, a, CASE WHEN f LIKE '%e' AND (length(f) - 1 >= r2 OR (length(f) - 1 >= r1 AND NOT regexp_matches(left(f, length(f) - 1), '{short}'))) THEN left(f, length(f) - 1) WHEN f LIKE '%ll' AND length(f) - 1 >= r2 THEN left(f, length(f) - 1) ELSE f END AS g FROM st12),
stems AS (SELECT word, CASE WHEN length(word) <= 2 OR word IN {KEPT} THEN word {' '.join(f"WHEN word = '{k}' THEN '{v}'" for k, v in OWN_STEM.items())} WHEN a IN {KEPT_AFTER_1A} THEN a ELSE replace(g, 'Y', 'y') END AS stem FROM st13)"""


_STRIP = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_OVER = "rs AS (SELECT b.query_id, b.chunk_id, o.score, b.rank AS rank_before FROM bm25 b JOIN overlap o ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, rank_before) AS rank FROM rs)"
#: A hash of each word of a text; of these, signed counts by place, as a vector of length 1.
_HASHED = "[CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) FOR w IN regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')]"
_SIGNED = "[coalesce(list_sum([1 - 2 * ((n // 16) % 2) FOR n IN codes IF n % 16 = i]), 0)::DOUBLE FOR i IN range(16)]"


def _units(table: str, key: str) -> str:
    return f"(SELECT {key}, [CASE WHEN size > 0 THEN x / size ELSE x END FOR x IN v] AS v FROM (SELECT {key}, v, sqrt(list_sum([y * y FOR y IN v])) AS size FROM (SELECT {key}, {_SIGNED} AS v FROM (SELECT {key}, {_HASHED.format(t='text')} AS codes FROM {table}))))"


def _line(x: str) -> str:
    plain = _STRIP.format(x="regexp_replace(" + _STRIP.format(x=x) + ", '^\\s*(?:[-*•]|[0-9]+[.)])\\s*', '')")
    return _STRIP.format(x=f"regexp_replace({plain}, '^\"+|\"+$', '', 'g')")


ORACLES = {
    "doc_scan_filter": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000",
    "doc_title": "WITH h AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE WHEN t <> '' THEN t ELSE translate(regexp_extract(url, '([^/]*)/?$', 1), '-_', '  ') END AS title FROM h",
    "content_sha": "SELECT doc_id, substr(sha256(text), 1, 16) AS sha FROM documents",
    "chunk_fixed": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, chunk_index, start_char, end_char, md5(text) AS text_md5 FROM chunks",
    "chunk_stats": f"WITH {_CHUNKS} SELECT count(*) AS n_chunks, min(length(text)) AS min_chars, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS max_chars, count(*) FILTER (NOT regexp_matches(text, '[.!?:]\\s*$')) AS cut_mid_sentence FROM chunks",
    "chunk_adjacent_overlap": f"WITH {_CHUNKS}, n AS (SELECT doc_id, chunk_id, end_char, lead(chunk_id) OVER w AS next_id, lead(start_char) OVER w AS next_start FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, chunk_id, next_id, greatest(0, end_char - next_start) AS shared_chars FROM n WHERE next_id IS NOT NULL",
    "chunk_histogram": f"WITH {_CHUNKS} SELECT CAST(floor(length(text) / 64) AS BIGINT) AS bucket, count(*) AS n FROM chunks GROUP BY 1",
    "tokenize": f"SELECT doc_id, len({_tok('text')}) AS n_tokens, len(list_distinct({_tok('text')})) AS n_types FROM documents",
    "term_stats_df_idf": f"WITH d AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_tok('text')})) AS term FROM documents) GROUP BY 1), m AS (SELECT count(*) AS n FROM documents) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, m",
    "dense_topk": f"WITH {_dense(5)} SELECT * FROM dense",
    "dense_topk_prefilter": f"WITH {_dense(5, more=' AND v.label = 3')} SELECT * FROM dense",
    "dense_postfilter_contrast": f"WITH {_dense(10)} SELECT query_id, count(*) AS n_left FROM dense JOIN embeddings ON vec_id = chunk_id WHERE label = 3 GROUP BY 1",
    "bm25_topk": f"WITH {_bm25(5)} SELECT * FROM bm25",
    "rrf_fusion": f"WITH {_bm25(20)}, {_overlap(20)}, {_rrf()} SELECT * FROM fused",
    "rrf_weighted": f"WITH {_bm25(20)}, {_overlap(20)}, {_rrf(60, 2.0, 0.5)} SELECT * FROM fused",
    "rrf_k_sweep": f"WITH {_bm25(20)}, {_overlap(20)}, " + ", ".join(_rrf(k, name=f"f{k}") for k in (1, 10, 60, 200)) + " " + " UNION ALL ".join(f"SELECT {k} AS rrf_k, query_id, chunk_id, score, rank FROM f{k}" for k in (1, 10, 60, 200)),
    "variants_fusion": f"WITH {_dense(10)}, n AS (SELECT query_id // 300 AS q, count(DISTINCT query_id) AS n FROM dense GROUP BY 1), vs AS (SELECT query_id // 300 AS query_id, chunk_id, CASE WHEN any_value(n) = 1 THEN max(score) ELSE sum(1 / (60 + rank)) END AS score, min((query_id // 100 % 3) * 1000 + rank) AS first, any_value(n) AS n_variants FROM dense JOIN n ON q = query_id // 300 GROUP BY ALL), r AS {_rank(5, 'first, chunk_id', 'vs')} SELECT query_id, chunk_id, r.score, rank, n_variants FROM r JOIN vs USING (query_id, chunk_id)",
    "rerank_overlap": f"WITH {_bm25(10)}, {_overlap(None)}, rs AS (SELECT b.query_id, b.chunk_id, o.score, b.rank AS rank_before FROM bm25 b JOIN overlap o ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, rank_before) AS rank FROM rs) SELECT query_id, chunk_id, score, rank, rank_before, rank_before - rank AS moved FROM r WHERE rank <= 5",
    "rerank_movement": f"WITH {_bm25(10)}, {_overlap(None)}, rs AS (SELECT b.query_id, b.chunk_id, o.score, b.rank AS rank_before FROM bm25 b JOIN overlap o ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, rank_before) AS rank FROM rs) SELECT rank_before - rank AS moved, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1",
    "depth_sweep": f"WITH {_bm25(50)}, {_GOLDEN}, h AS (SELECT g.query_id, min(b.rank) AS best FROM golden g LEFT JOIN bm25 b ON b.query_id = g.query_id AND list_contains(g.relevant, b.chunk_id) WHERE len(g.relevant) > 0 GROUP BY 1) SELECT depth, round(avg(CASE WHEN best <= depth THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM h, (SELECT unnest([3, 5, 10, 25, 50]) AS depth) GROUP BY 1",
    "route_lexical": f"SELECT conv_id, turn, {_LEXICAL} AS lexical, {_WHICH} AS pattern FROM conversations",
    "route_crosstab": f"SELECT role, count(*) FILTER ({_LEXICAL}) AS lexical, count(*) FILTER (NOT ({_LEXICAL})) AS semantic FROM conversations GROUP BY 1",
    "dedupe_to_documents": f"WITH {_dense(20)}, b AS (SELECT query_id, chunk_id % 40 AS doc, min(rank) AS best FROM dense GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM b",
    "golden_labels": f"WITH {_GOLDEN} SELECT query_id, kind, len(relevant) AS n_relevant FROM golden",
    "golden_validate": "WITH g AS (SELECT item_id % 30 AS id, CASE WHEN item_id % 4 = 0 THEN 'unanswerable' ELSE 'lookup' END AS kind, CASE WHEN item_id % 5 = 0 THEN [] ELSE [item_id, item_id * 1000000 + 7] END AS relevant FROM benchmark) SELECT id, 'duplicate id' AS problem FROM g GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'missing document' FROM (SELECT id, unnest(relevant) AS doc_id FROM g) WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT DISTINCT id, 'wrong kind' FROM g WHERE (kind = 'unanswerable') <> (len(relevant) = 0)",
    "metrics_per_question": f"WITH {_bm25(20)}, {_GOLDEN}, {_results()} SELECT * FROM results",
    "metrics_by_kind": f"WITH {_bm25(20)}, {_GOLDEN}, {_results()} {_KINDS.format(kind='kind')} UNION ALL {_KINDS.format(kind=chr(39) + 'ALL' + chr(39))}",
    "ceiling_flag": f"WITH {_bm25(20)}, {_GOLDEN}, {_results()} SELECT count(*) AS n, coalesce(round(avg(recall_at_1), 4) >= 0.95 AND round(avg(recall_at_3), 4) >= 0.95 AND round(avg(recall_at_5), 4) >= 0.95, false) AS ceiling_reached FROM results WHERE n_relevant > 0",
    "near_misses": f"WITH {_embedded(20)}, {_GOLDEN}, {_results('other', 'embedded', 'JOIN')} SELECT query_id, first_rank, CASE WHEN first_rank IS NULL THEN 'absent' ELSE 'near miss' END AS what FROM other WHERE n_relevant > 0 AND (first_rank IS NULL OR first_rank > 3)",
    "run_compare": f"WITH {_bm25(20)}, {_overlap(20)}, {_GOLDEN}, {_results()}, {_results('other', 'overlap', 'JOIN')}, u AS (SELECT 'bm25' AS run, query_id, recall_at_5 AS recall FROM results UNION ALL SELECT 'overlap', query_id, recall_at_5 FROM other WHERE n_relevant > 0) SELECT run, count(*) AS n, round(avg(recall), 4) AS recall FROM u WHERE query_id IN (SELECT query_id FROM u GROUP BY 1 HAVING count(DISTINCT run) = 2) GROUP BY 1",
    "abstain_gate": f"WITH {_GATE} SELECT * FROM gate",
    "threshold_sweep": f"WITH {_GATE}, {_GOLDEN} SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (best_score < threshold AND len(relevant) = 0) AS caught, count(*) FILTER (best_score < threshold AND len(relevant) > 0) AS wrongly_refused FROM gate JOIN golden USING (query_id), (SELECT unnest([0.5, 0.6, 0.7, 0.9]) AS threshold) GROUP BY 1",
    "crag_split": f"WITH {_GATE} SELECT CASE WHEN best_score >= 0.9 THEN 'correct' WHEN best_score >= 0.5 THEN 'ambiguous' ELSE 'incorrect' END AS verdict, count(*) AS n FROM gate GROUP BY 1",
    "context_budget": f"WITH {_BLOCKS} SELECT query_id, count(*) AS n_blocks, CAST(max(used) AS BIGINT) AS used FROM used WHERE used <= 1500 GROUP BY 1",
    "prompt_build": f"WITH {_BLOCKS}, c AS (SELECT query_id, count(*) AS n_blocks, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM used WHERE used <= 2500 GROUP BY 1), p AS (SELECT item_id AS query_id, coalesce(n_blocks, 0) AS n_blocks, CASE WHEN context IS NULL THEN 'No context passages were retrieved.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Say that the corpus contains nothing relevant to this question.' ELSE 'Context passages:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' END AS prompt FROM benchmark LEFT JOIN c ON c.query_id = item_id) SELECT query_id, n_blocks, length(prompt) AS chars, md5(prompt) AS prompt_md5 FROM p",
    "judge_groundedness": f"WITH {_bm25(1)}, {_GOLDEN}, a AS (SELECT b.query_id, i.text AS t, {_JT.format(c='i.text')} AS a, {_JT.format(c='d.text')} AS c, [substring(i.text, 1, 12), 'no such words'] AS expected, len(relevant) > 0 AS answerable FROM bm25 b JOIN documents d ON d.doc_id = b.chunk_id JOIN benchmark i ON i.item_id = b.query_id JOIN golden g ON g.query_id = b.query_id) SELECT query_id, CASE WHEN answerable THEN round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, c)) / len(a) END, 3) ELSE CAST(({_REFUSED}) AS DOUBLE) END AS groundedness, CASE WHEN answerable THEN round(len([x FOR x IN expected IF contains(lower(t), lower(x))]) / len(expected), 3) ELSE CAST(({_REFUSED}) AS DOUBLE) END AS relevance, CASE WHEN NOT answerable THEN CAST(({_REFUSED}) AS DOUBLE) END AS correct_refusal FROM a",
    "refusal_detect": f"WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' The passage Does Not Mention it.' ELSE text END AS t FROM conversations) SELECT conv_id, turn, {_REFUSED} AS refused FROM c",
    "citations_extract": "WITH a AS (SELECT doc_id, 'As [1] and [' || (doc_id % 7) || ', 3] say: ' || text || ' [2][1] [x] [' || (n_chars % 11) || ']' AS answer FROM documents), n AS (SELECT doc_id, flatten([string_split(replace(m, ' ', ''), ',') FOR m IN regexp_extract_all(answer, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1)]) AS l FROM a), o AS (SELECT doc_id, [CAST(x AS INT) FOR x, i IN l IF list_position(l, x) = i] AS l FROM n) SELECT doc_id, array_to_string([x FOR x IN l IF x BETWEEN 1 AND 5], ',') AS cited FROM o",
    "cooccurrence_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "hub_prune": f"WITH {_EDGES} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edges) WHERE n <= 3",
    "graph_stats": f"WITH {_EDGES}, d AS (SELECT src, count(*) AS degree FROM edges GROUP BY 1) SELECT count(*) AS entities, CAST(floor(sum(degree) / 2) AS BIGINT) AS edges, round(avg(degree), 4) AS mean_degree, max(degree) AS max_degree FROM d",
    "graph_retrieve_1hop": f"WITH {_EDGES}, near AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edges) WHERE n <= 10), t AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_partkey % 100 = 0), r AS (SELECT i AS query_id, i AS entity, 0 AS distance FROM t UNION ALL SELECT DISTINCT i, dst, 1 FROM t JOIN near ON src = i WHERE dst <> i), g AS (SELECT query_id, l_orderkey AS chunk_id, sum(1 / (1 + distance)) AS score FROM r JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_partkey = entity GROUP BY ALL), x AS {_rank(5, source='g')} SELECT * FROM x",
    "multihop_accumulate": f"WITH {_dense(8)}, g AS (SELECT query_id // 200 AS query_id, chunk_id, max(score) AS score, count(DISTINCT query_id) AS n_hops FROM dense GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM g) SELECT query_id, chunk_id, score, n_hops, rank FROM x WHERE rank <= 5",
    "cost_accounting": "WITH u AS (SELECT (['large', 'small', 'mid'])[conv_id % 3 + 1] AS model, length(text) AS n, turn FROM conversations), p AS (SELECT * FROM (VALUES ('large', 5.0, 25.0), ('small', 1.0, 5.0), ('mid', 2.0, 10.0)) t(model, i, o)) SELECT model, count(*) AS n, round(sum((n * i + CASE WHEN turn = 0 THEN n ELSE 0 END * i * 1.25 + CASE WHEN turn > 0 THEN n ELSE 0 END * i * 0.1 + (n // 4) * o) / 1e6), 6) AS cost_usd FROM u JOIN p USING (model) GROUP BY 1",
    "ingest_cost_model": f"WITH {_CHUNKS} SELECT CAST(sum(CASE WHEN chunk_index = 0 THEN n_chars ELSE 0 END) AS BIGINT) AS written, CAST(sum(CASE WHEN chunk_index = 0 THEN 0 ELSE n_chars END) AS BIGINT) AS read_again FROM chunks JOIN documents USING (doc_id)",
    "upsert_chunks": "SELECT doc_id AS chunk_id, md5(text) AS sha FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new' || quality FROM labels",
    "cache_misses_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "quality_slices": "SELECT lang, quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic, max(n_chars) AS longest FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "windows_of_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "variant_clean": f"WITH l AS (SELECT conv_id, turn, [x FOR x IN [{_line('y')} FOR y IN string_split_regex(text, '\\r\\n|\\n|\\r')] IF length(x) >= 8 AND NOT ends_with(x, ':')][1:4] AS lines FROM conversations WHERE role = 'user') SELECT conv_id, turn, len(lines) AS n_lines, coalesce(lines[1], '') AS first_line FROM l",
    "json_tolerant_parse": "WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Sure: ' || props || ' done' ELSE props END AS raw FROM events) SELECT event_id, (CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.k') ELSE json_extract_string(nullif(regexp_extract(raw, '(?s)\\{.*?\\}'), ''), '$.k') END) IS NOT NULL AS has_k, length(raw) AS chars FROM r",
    "entity_frequency": "SELECT lower(source) AS entity, count(*) AS n FROM documents GROUP BY 1",
    "most_common_entities": "SELECT lower(concat_ws('-', source, lang)) AS entity, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, entity LIMIT 12",
    "graph_seeds": f"WITH e AS (SELECT DISTINCT unnest({_tok('text')}) AS entity FROM benchmark) SELECT item_id AS query_id, entity FROM benchmark, e WHERE length(entity) > 4 AND contains(lower(text), entity)",
    "teaching_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 448)) AS a FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(a / 448 AS INT) AS chunk_index, md5(substring(text, CAST(a AS INT) + 1, 512)) AS text_md5 FROM c",
    "chunk_subset": f"WITH {_CHUNKS} SELECT DISTINCT doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "list_overlap_count": f"WITH {_bm25(10)}, {_overlap(10)} SELECT b.query_id, count(*) AS shared FROM bm25 b JOIN overlap o ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id GROUP BY 1",
    "lists_side_by_side": f"WITH {_bm25(5)}, {_overlap(5)} SELECT query_id, rank, b.chunk_id AS left_id, o.chunk_id AS right_id FROM bm25 b FULL JOIN overlap o USING (query_id, rank)",
    "first_rank_of_fragment": f"WITH {_bm25(20)} SELECT b.query_id, min(b.rank) AS first_rank FROM bm25 b JOIN documents d ON d.doc_id = b.chunk_id JOIN benchmark i ON i.item_id = b.query_id WHERE contains(d.text, substring(i.text, 1, 20)) GROUP BY 1",
    "cosine_matrix": "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings) v",
    "saturated_kinds": f"WITH {_bm25(20)}, {_GOLDEN}, {_results()} SELECT kind, round(avg(recall_at_3), 4) AS recall_at_3 FROM results WHERE kind <> 'unanswerable' GROUP BY 1 HAVING round(avg(recall_at_3), 4) >= 0.5",
    "run_totals": "SELECT round(avg(event_id % 997), 1) AS ms, round(sum(value), 6) AS cost_usd FROM events",
    "router_agreement": f"SELECT CASE WHEN {_LEXICAL} THEN 'lexical' ELSE 'semantic' END AS a_route, CASE WHEN length(text) < 200 THEN 'lexical' ELSE 'semantic' END AS b_route, count(*) AS n FROM conversations GROUP BY 1, 2",
    "shortlist_crosstab": f"WITH {_bm25(10)}, {_overlap(None)}, {_GOLDEN}, {_OVER}, g AS (SELECT query_id, unnest(relevant) AS doc FROM golden) SELECT in_shortlist, in_top, count(*) AS n FROM (SELECT g.query_id, bool_or(r.rank IS NOT NULL) AS in_shortlist, bool_or(coalesce(r.rank <= 3, false)) AS in_top FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.chunk_id = g.doc GROUP BY 1) GROUP BY 1, 2",
    "described_lengths": "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS least, median(n_chars) AS median, max(n_chars) AS most, grouping(lang) = 1 AS total FROM documents GROUP BY ROLLUP (lang)",
    "heads_per_group": "SELECT lang, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 2",
    "moved_questions": f"WITH {_bm25(20)}, {_embedded(20)}, {_GOLDEN}, {_results()}, {_results('other', 'embedded', 'JOIN')} SELECT query_id, a.first_rank AS before, b.first_rank AS after FROM results a FULL JOIN other b USING (query_id) WHERE a.first_rank IS DISTINCT FROM b.first_rank",
    "passages_spread": f"WITH {_HITS} SELECT h.query_id, count(DISTINCT h.doc_id) AS n_docs, CAST(sum(length(c.text)) AS BIGINT) AS chars FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id WHERE h.rank <= 5 GROUP BY 1",
    "refusals_by_config": f"WITH {_GATE}, {_GOLDEN}, a AS (SELECT config, len(relevant) > 0 AS answerable, CAST(best_score < config AS INT) AS refused FROM gate JOIN golden USING (query_id), (SELECT CAST(unnest([0.5, 0.8]) AS DOUBLE) AS config)) SELECT config, count(*) AS n, round(avg(CASE WHEN NOT answerable THEN refused END), 4) AS correct_refusal, round(avg(CASE WHEN answerable THEN refused END), 4) AS false_refusal FROM a GROUP BY 1",
    "hash_embedding": f"SELECT doc_id, round(v[1], 6) AS v0, round(v[8], 6) AS v7, round(v[16], 6) AS v15 FROM {_units('documents', 'doc_id')}",
    "embedded_search": f"WITH {_embedded(5)} SELECT * FROM embedded",
    "vector_table_search": f"WITH {_dense(5, ' AND v.label = 3')} SELECT * FROM dense",
    "payload_round_trip": "SELECT doc_id, lang, source, n_chars FROM documents",
    "transform_rewrite": "SELECT item_id AS query_id, text || '|Short query\"' AS variants FROM benchmark",
    "transformed_retrieval": f"WITH {_bm25(10)}, {_bm25(10, p='f', name='fixed', asked=_FIXED)}, u AS (SELECT query_id, chunk_id, rank, 0 AS v FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM fixed), g AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min(v * 1000 + rank) AS first FROM u GROUP BY ALL), x AS {_rank(5, 'first, chunk_id', 'g')} SELECT *, 2 AS n_variants FROM x",
    "identity_retrieval": f"WITH {_bm25(5)} SELECT *, 1 AS n_variants FROM bm25",
    "multihop_loop": f"WITH {_bm25(5)}, {_bm25(5, p='f', name='fixed', asked=_FIXED)}, g AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM bm25 UNION ALL SELECT * FROM fixed) GROUP BY ALL), x AS {_rank(5, source='g')} SELECT * FROM x",
    "multihop_trace": "SELECT item_id AS query_id, 2 AS hops, text || '|the of and in' AS queries, 'follow-up repeated an earlier query' AS stopped_because FROM benchmark",
    "answers_generated": f"WITH {_BLOCKS}, c AS (SELECT query_id, sum(length(block) + 2) - 2 AS chars FROM used WHERE used <= 2500 GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM blocks GROUP BY 1), p AS (SELECT item_id AS query_id, CAST(CASE WHEN chars IS NULL THEN length('No context passages were retrieved.') + 2 + length('Question: ' || text) + 2 + length('Say that the corpus contains nothing relevant to this question.') ELSE length('Context passages:') + 2 + chars + 2 + length('Question: ' || text) + 2 + length('Answer:') END AS BIGINT) AS chars FROM benchmark LEFT JOIN c ON c.query_id = item_id), l AS (SELECT query_id, rank, line, i, len(list_intersect({_words('line')}, {_words('string_split(text, chr(10))[1]')})) AS shared FROM (SELECT query_id, rank, unnest(string_split(block, chr(10))[2:]) AS line, generate_subscripts(string_split(block, chr(10))[2:], 1) AS i FROM used WHERE used <= 2500) JOIN benchmark ON item_id = query_id), b AS (SELECT * FROM l WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, rank, i) = 1) SELECT p.query_id, CASE WHEN b.line IS NULL THEN 'Nothing in the passages answers this.' ELSE trim(b.line) || ' [' || b.rank || ']' END AS answer, chars AS prompt_chars, coalesce(n, 0) AS n_contexts FROM p LEFT JOIN n ON n.query_id = p.query_id LEFT JOIN b ON b.query_id = p.query_id",
    "answers_cited": f"WITH {_HITS}, m AS (SELECT item_id AS query_id, unnest(list_distinct_in_order) AS rank, generate_subscripts(list_distinct_in_order, 1) - 1 AS place FROM (SELECT item_id, CASE WHEN item_id % 5 + 1 IN (1, 2) THEN [2, 1, 9] ELSE [2, 1, 9, item_id % 5 + 1] END AS list_distinct_in_order FROM benchmark)) SELECT h.query_id, m.place, h.rank, h.chunk_id FROM m JOIN hits h ON h.query_id = m.query_id AND h.rank = m.rank WHERE h.rank <= 5",
    "answers_gated": f"WITH {_overlap(5)} SELECT item_id AS query_id, coalesce(best, 0) < 0.9 AS abstained, coalesce(best, 0) >= 0.9 AS generated, coalesce(n, 0) AS n_contexts FROM benchmark LEFT JOIN (SELECT query_id, max(score) AS best, count(*) AS n FROM overlap GROUP BY 1) o ON o.query_id = item_id",
    "crag_answers": f"WITH {_bm25(3)}, {_bm25(9, p='w', name='wide')}, n AS (SELECT query_id, count(*) AS n FROM bm25 GROUP BY 1), m AS (SELECT query_id, count(*) AS m FROM wide GROUP BY 1), g AS (SELECT item_id AS query_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, CASE WHEN n IS NULL THEN 'incorrect' WHEN starts_with(text, 'Th') THEN 'ambiguous' WHEN starts_with(text, 'A') THEN 'incorrect' ELSE 'correct' END AS verdict, CASE WHEN n IS NULL THEN 1.0 WHEN starts_with(text, 'Th') THEN 1.0 WHEN starts_with(text, 'A') THEN 0.7 ELSE 0.0 END AS confidence FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN m ON m.query_id = item_id) SELECT query_id, verdict, CAST(confidence AS DOUBLE) AS confidence, verdict = 'ambiguous' AND m > 3 AS widened, CASE WHEN verdict = 'ambiguous' THEN m ELSE n END AS n_contexts, verdict = 'incorrect' AS refused FROM g",
    "batch_by_id": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS custom_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'told' END AS text FROM conversations",
    "stemmed_terms": f"WITH t AS (SELECT doc_id, [w FOR w IN {_tok('text')} IF w NOT IN {STOP_WORDS}] AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM t), ws AS (SELECT DISTINCT word FROM u), {_stems('ws')}, j AS (SELECT doc_id, count(*) AS n_terms, string_agg(stem, ' ' ORDER BY i) AS terms FROM u JOIN stems USING (word) GROUP BY doc_id) SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, md5(coalesce(terms, '')) AS terms_md5 FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id",
    "serialised_results": f"WITH {_HITS} SELECT query_id, count(*) AS n FROM hits WHERE rank <= 5 GROUP BY 1",
}
_HYBRID = f"{_embedded(10)}, {_bm25(10)}, hu AS (SELECT query_id, chunk_id, rank, 0 AS l, score AS dense, NULL::DOUBLE AS bm25 FROM embedded UNION ALL SELECT query_id, chunk_id, rank, 1, NULL, score FROM bm25), hs AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min(l * 1000 + rank) AS first, max(dense) AS dense, max(bm25) AS bm25 FROM hu GROUP BY ALL), hr AS {_rank(5, 'first, chunk_id', 'hs')}, hybrid AS (SELECT hr.*, dense, bm25 FROM hr JOIN hs USING (query_id, chunk_id))"
_NEAR = "near AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edges) WHERE n <= {n})"
_WALK = "w AS (SELECT DISTINCT l_partkey AS query_id, l_partkey AS entity, 0 AS distance FROM lineitem WHERE l_partkey % 100 = 0 UNION SELECT query_id, dst, distance + 1 FROM w JOIN near ON src = entity WHERE distance < 3), reached AS (SELECT query_id, entity, min(distance) AS distance FROM w GROUP BY 1, 2)"
_DEPTHS = "(SELECT unnest([1, 3, 5, 10, 20]) AS depth)"


def _grid(floors: str) -> str:
    return f"""{_bm25(20)}, {_overlap(20)}, {_GOLDEN}, gu AS (SELECT 'bm25' AS run, query_id, chunk_id, rank, score FROM bm25 UNION ALL SELECT 'overlap', query_id, chunk_id, rank, score FROM overlap),
gb AS (SELECT run, query_id, max(score) AS best, max(rank) AS length, list(rank ORDER BY rank) FILTER (list_contains(relevant, chunk_id)) AS ranks FROM gu JOIN golden USING (query_id) GROUP BY 1, 2),
ge AS (SELECT r.run, g.query_id, kind, depth, floor, len(relevant) AS nr, best, coalesce(length, 0) AS length, [x FOR x IN coalesce(ranks, []) IF x <= depth] AS ranks FROM golden g CROSS JOIN (VALUES ('bm25'), ('overlap')) r(run) CROSS JOIN {_DEPTHS} CROSS JOIN (SELECT unnest([{floors}])::DOUBLE AS floor) LEFT JOIN gb ON gb.run = r.run AND gb.query_id = g.query_id),
gm AS (SELECT *, floor IS NOT NULL AND (best IS NULL OR best < floor) AS refused, CASE WHEN nr = 0 THEN 1.0 ELSE len(ranks) / nr END AS recall, CASE WHEN nr = 0 OR least(length, depth) = 0 THEN 0.0 ELSE len(ranks) / least(length, depth) END AS precision, CASE WHEN nr = 0 THEN 1.0 WHEN len(ranks) = 0 THEN 0.0 ELSE 1 / ranks[1] END AS mrr, CASE WHEN nr = 0 THEN 1.0 ELSE coalesce(list_sum([1 / log2(x + 1) FOR x IN ranks]), 0.0) / list_sum([1 / log2(j + 1) FOR j IN range(1, least(nr, depth) + 1)]) END AS ndcg, CASE WHEN nr = 0 OR len(ranks) > 0 THEN 1.0 ELSE 0.0 END AS hit FROM ge),
cells AS (SELECT run, depth, floor, CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind END AS kind, count(*) AS n, count(*) FILTER (refused) AS n_refused, round(avg(refused::INT) FILTER (nr = 0), 4) AS correct_refusal, round(avg(refused::INT) FILTER (nr > 0), 4) AS false_refusal, {', '.join(f'round(avg({m}) FILTER (NOT refused), 4) AS {m}' for m in ('recall', 'precision', 'mrr', 'ndcg', 'hit'))} FROM gm GROUP BY GROUPING SETS ((run, depth, floor, kind), (run, depth, floor)))"""


ORACLES |= {
    "hybrid_scores": f"WITH {_HYBRID} SELECT query_id, chunk_id, rank, round(dense, 6) AS dense_score, round(bm25, 6) AS bm25_score, round(score, 6) AS rrf_score FROM hybrid",
    "hybrid_gate": f"WITH {_HYBRID}, b AS (SELECT query_id, coalesce(max(dense), max(score)) AS best FROM hybrid GROUP BY 1) SELECT item_id AS query_id, round(coalesce(best, 0.0), 6) AS best_score, best IS NULL OR best < 0.6 AS abstain FROM benchmark LEFT JOIN b ON b.query_id = item_id",
    "paragraph_ranks": f"WITH pl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), pp AS (SELECT doc_id || '#' || i AS id, doc_id, {_STRIP.format(x='t')} AS text FROM pl WHERE length({_STRIP.format(x='t')}) > 80), pv AS {_units('pp', 'id')}, pq AS {_units('benchmark', 'item_id')}, ps AS (SELECT item_id AS query_id, id AS chunk_id, list_dot_product(pv.v, pq.v) AS score FROM pq, pv), px AS {_rank(10, source='ps')}, {_GOLDEN} SELECT px.query_id, min(rank) FILTER (list_contains(relevant, CAST(string_split(chunk_id, '#')[1] AS BIGINT))) AS first_rank FROM px JOIN golden USING (query_id) GROUP BY 1",
    "window_islands": f"WITH {_HITS}, wi AS (SELECT query_id, h.doc_id, rank, score, greatest(start_char - 300, 0) AS a, least(end_char + 300, n_chars) AS b FROM hits h JOIN documents d ON d.doc_id = h.doc_id), wb AS (SELECT *, CASE WHEN a >= max(b) OVER (PARTITION BY query_id, doc_id ORDER BY a, b, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS begins FROM wi), wn AS (SELECT *, sum(begins) OVER (PARTITION BY query_id, doc_id ORDER BY a, b, rank ROWS UNBOUNDED PRECEDING) AS island FROM wb) SELECT query_id, doc_id, min(a) AS from_char, max(b) AS to_char, count(*) AS merged_windows, min(rank) AS best_rank, arg_min(score, rank) AS score FROM wn GROUP BY query_id, doc_id, island",
    "graph_retrieve_3hop": f"WITH RECURSIVE {_EDGES}, {_NEAR.format(n=10)}, {_WALK}, g AS (SELECT query_id, l_orderkey AS chunk_id, sum(1 / (1 + distance)) AS score FROM reached JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_partkey = entity GROUP BY ALL), x AS {_rank(5, source='g')} SELECT * FROM x",
    "graph_levels": f"WITH RECURSIVE {_EDGES}, {_NEAR.format(n=3)}, {_WALK} SELECT query_id, distance, count(*) AS n FROM reached GROUP BY 1, 2",
    "graph_stats_all": f"WITH {_EDGES}, d AS (SELECT e, (SELECT count(*) FROM edges WHERE src = e) AS degree FROM often UNION ALL SELECT user_id, 0 FROM events GROUP BY user_id HAVING count(*) >= 2) SELECT count(*) AS entities, CAST(floor(sum(degree) / 2) AS BIGINT) AS edges, round(avg(degree), 4) AS mean_degree, max(degree) AS max_degree FROM d",
    "eval_grid": f"WITH {_grid('NULL, 0.6, 0.9')} SELECT * FROM cells",
    "eval_report": f"WITH {_grid('NULL')} SELECT kind, depth, max(ndcg) FILTER (run = 'bm25') AS bm25, max(ndcg) FILTER (run = 'overlap') AS overlap FROM cells GROUP BY kind, depth",
    "cells_exact": f"WITH {_dense(5)} SELECT * FROM dense",
    "cells_filtered": "SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label = 3 GROUP BY 1",
    "cells_recall": "SELECT count(*) AS n_questions, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "merged_table": "WITH m AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN 'again' WHEN quality IS NOT NULL THEN 'q' || quality ELSE md5(text) END AS sha FROM documents LEFT JOIN labels USING (doc_id)) SELECT * FROM m WHERE sha = 'again' OR source NOT IN (SELECT source FROM documents WHERE doc_id % 20 = 3)",
    "question_events": f"WITH a AS ({ORACLES['answers_generated']}) SELECT query_id, 2 + len(regexp_extract_all(answer, '\\s*\\S+')) AS n_events, 'done' AS last_event FROM a",
    "bm25_stemmed": f"WITH t AS (SELECT doc_id AS id, 0 AS q, [w FOR w IN {_tok('text')} IF w NOT IN {STOP_WORDS}] AS t FROM documents UNION ALL SELECT item_id, 1, [w FOR w IN {_tok('text')} IF w NOT IN {STOP_WORDS}] FROM benchmark), u AS (SELECT id, q, len(t) AS size, unnest(t) AS word FROM t), ws AS (SELECT DISTINCT word FROM u), {_stems('ws')}, f AS (SELECT id, q, stem, any_value(size) AS size, count(*) AS tf FROM u JOIN stems USING (word) GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t WHERE q = 0), df AS (SELECT stem, count(*) AS df FROM f WHERE q = 0 GROUP BY 1), bs AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * b.tf * 2.5 / (b.tf + 1.5 * (0.25 + 0.75 * b.size / mean))) AS score FROM f a JOIN f b ON a.stem = b.stem AND a.q = 1 AND b.q = 0 JOIN df ON df.stem = a.stem, n GROUP BY 1, 2), x AS {_rank(5, source='bs')} SELECT * FROM x",
    "multihop_missing": f"WITH {_bm25(5)}, h AS (SELECT query_id, list_distinct(flatten(list({_tok('substring(d.text, 1, 220)')}))) AS have FROM bm25 JOIN documents d ON d.doc_id = chunk_id GROUP BY 1), g AS (SELECT item_id AS query_id, unnest(list_distinct({_tok('text')})) AS w FROM benchmark), mw AS (SELECT query_id, w AS text FROM g LEFT JOIN h USING (query_id) WHERE NOT coalesce(list_contains(have, w), false) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, w) = 1), {_bm25(5, p='f', name='more', asked='mw')}, u AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM bm25 UNION ALL SELECT * FROM more) GROUP BY ALL), x AS {_rank(5, source='u')} SELECT * FROM x",
}
ORACLES["generation_means"] = f"SELECT count(*) AS n, round(avg(groundedness), 4) AS groundedness, round(avg(relevance), 4) AS relevance, round(avg(correct_refusal), 4) AS correct_refusal FROM ({ORACLES['judge_groundedness']})"
ORACLES["run_matrix"] = "SELECT kind, max(CASE WHEN run = 'bm25' THEN r END) AS bm25, max(CASE WHEN run = 'overlap' THEN r END) AS overlap FROM (" + f"WITH {_bm25(20)}, {_overlap(20)}, {_GOLDEN}, {_results()}, {_results('other', 'overlap', 'JOIN')}, u AS (SELECT 'bm25' AS run, * FROM results UNION ALL SELECT 'overlap', * FROM other) SELECT run, kind, round(avg(recall_at_5), 4) AS r FROM u GROUP BY ALL UNION ALL SELECT run, 'ALL', round(avg(recall_at_5), 4) FROM u GROUP BY ALL" + ") GROUP BY 1"
for _name, _column in ({"abstain_gate": "best_score"} | dict.fromkeys(("dense_topk", "dense_topk_prefilter", "bm25_topk", "rrf_fusion", "rrf_weighted", "rrf_k_sweep", "variants_fusion", "rerank_overlap", "graph_retrieve_1hop", "multihop_accumulate", "embedded_search", "vector_table_search", "transformed_retrieval", "identity_retrieval", "multihop_loop", "window_islands", "graph_retrieve_3hop", "cells_exact", "bm25_stemmed", "multihop_missing"), "score")).items():
    ORACLES[_name] = f"SELECT * REPLACE (round({_column}, 6) AS {_column}) FROM ({ORACLES[_name]})"
