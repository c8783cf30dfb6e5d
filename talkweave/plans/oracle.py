"""DuckDB statements that check the registered queries on the same tables."""
from __future__ import annotations

from ..fixed_values import STOPWORDS, SYNONYMS

ORACLE: dict[str, str] = {}

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


# ------------------------------------------------------------------ expressions
def raw(x: str) -> str:
    low = f"replace(replace(replace(lower({x}), '§', ' section '), 'n''t', ' not'), 'n’t', ' not')"
    low = rf"regexp_replace({low}, '([a-z])[''’](s|re|ll|d|ve|m)($|[^\p{{L}}\p{{N}}_])', '\1\3', 'g')"
    return (f"list_transform(regexp_extract_all({low}, '[a-z0-9]+(?:[.,][0-9]+)*'), lambda t: "
            f"CASE WHEN regexp_full_match(t, '[0-9][0-9,]*[0-9]') THEN replace(t, ',', '') ELSE t END)")


def stem(t: str) -> str:
    def cut(k):
        return f"left({t}, length({t}) - {k})"

    def undouble(k):
        b = cut(k)
        return (f"CASE WHEN length({b}) > 3 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) "
                f"AND right({b}, 1) NOT IN ('l', 's', 'z') THEN {cut(k + 1)} ELSE {b} END")
    base = (f"CASE WHEN {t} LIKE '%ies' AND length({t}) > 5 THEN {cut(3)} || 'y' "
            f"WHEN {t} LIKE '%sses' AND length({t}) > 6 THEN {cut(2)} "
            f"WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN {undouble(3)} "
            f"WHEN {t} LIKE '%ed' AND length({t}) > 4 THEN {undouble(2)} "
            f"WHEN regexp_matches({t}, '(s|x|z|ch|sh)es$') AND length({t}) > 4 THEN {cut(2)} "
            f"WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') AND length({t}) > 3 THEN {cut(1)} "
            f"ELSE {t} END")
    return (f"CASE WHEN length({t}) <= 3 OR regexp_full_match({t}, '[0-9]+') THEN {t} "
            rf"ELSE regexp_replace({base}, '^(.{{4,}})e$', '\1') END")


def content(x: str) -> str:
    return f"list_transform(list_filter({raw(x)}, lambda t: t NOT IN ({STOP})), lambda t: {stem('t')})"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def numbers(x: str) -> str:
    """Distinct numerals in order of first appearance."""
    found = rf"list_transform(regexp_extract_all({x}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda n: replace(n, ',', ''))"
    return f"list_filter({found}, lambda n, i: list_position({found}, n) = i)"


def first_units(x: str) -> str:
    """Units of a one-line text."""
    plain = (rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z0-9\x22''(])', '\1' || chr(1) || '\2', 'g'), chr(1))")
    row = (rf"[array_to_string(list_filter(list_transform(string_split(regexp_replace({x}, '^\|+|\|+$', '', 'g'), '|'), "
           rf"lambda c: trim(c)), lambda c: c <> ''), ' - ')]")
    units = (rf"CASE WHEN regexp_matches({x}, '^([-*+]|[0-9]+[.)])\s+') "
             rf"THEN [regexp_replace({x}, '^([-*+]|[0-9]+[.)])\s+', '')] "
             rf"WHEN {x} LIKE '|%' THEN {row} ELSE {plain} END")
    return f"list_filter({units}, lambda u: len(string_split(u, ' ')) >= 3)"


# ------------------------------------------------------------------ shared steps
WINDOWS = f"""
w0 AS (SELECT doc_id, source, list_filter(string_split({squeeze('text')}, ' '), lambda w: w <> '') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id || '§' || (k + 1) AS chunk_id, doc_id::VARCHAR AS doc_id, k + 1 AS section,
         'Part ' || (k + 1) AS section_title, source, array_to_string(w[k * 180 + 1 : (k + 1) * 180], ' ') AS text
  FROM w0, unnest(range(0, (len(w) + 179) // 180)) AS u(k))"""

TOKENS = WINDOWS + f""",
tok AS MATERIALIZED (
  SELECT chunk_id, doc_id, section, source, text,
         {content("doc_id || '. ' || section_title || '. ' || text")} AS tk FROM win),
post AS MATERIALIZED (
  SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT chunk_id, len(tk) AS dl, unnest(tk) AS term FROM tok) GROUP BY chunk_id, term),
size AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM tok),
idf AS MATERIALIZED (
  SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM post, size GROUP BY term)"""

STATUS = """,
st AS (SELECT d.doc_id::VARCHAR AS doc_id, CASE WHEN l.quality = 0 THEN 'superseded' ELSE 'current' END AS status,
       CASE WHEN l.quality = 0 AND EXISTS (SELECT 1 FROM documents r WHERE r.doc_id = d.doc_id + 1) THEN 1 ELSE 0 END
         AS demote FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

BUCKETS = """,
ctv AS (SELECT chunk_id, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS x
        FROM (SELECT chunk_id, tf, ('0x' || substr(md5(term), 1, 4))::INTEGER AS h FROM post) GROUP BY ALL),
cv AS MATERIALIZED (SELECT c.chunk_id, b, x / norm AS x FROM ctv c JOIN (
        SELECT chunk_id, sqrt(sum(x * x)) AS norm FROM ctv GROUP BY chunk_id) n ON n.chunk_id = c.chunk_id WHERE norm > 0)"""

READINGS = f""",
rd0 AS (SELECT item_id AS qid, 0 AS v, text FROM benchmark UNION ALL
        SELECT item_id, 1, regexp_extract(text, '^([^.]*)\\.', 1) FROM benchmark
        WHERE regexp_extract(text, '^([^.]*)\\.', 1) <> ''),
rd AS MATERIALIZED (SELECT qid, v, text, {content('text')} AS tk FROM rd0)"""

BM25 = """,
qt AS (SELECT DISTINCT qid, v, unnest(tk) AS term FROM rd),
bms AS MATERIALIZED (
  SELECT qid, v, chunk_id, round(sum(idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term), size GROUP BY qid, v, chunk_id),
bm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, v ORDER BY score DESC, chunk_id) AS rank
  FROM bms WHERE score > 0 QUALIFY rank <= 30)"""

DENSE = BUCKETS + """,
qtv AS (SELECT qid, v, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x
        FROM (SELECT qid, v, ('0x' || substr(md5(term), 1, 4))::INTEGER AS h
              FROM (SELECT qid, v, unnest(tk) AS term FROM rd)) GROUP BY ALL),
qv AS (SELECT q.qid, q.v, b, x / norm AS x FROM qtv q JOIN (
        SELECT qid, v, sqrt(sum(x * x)) AS norm FROM qtv GROUP BY ALL) n ON n.qid = q.qid AND n.v = q.v WHERE norm > 0),
cosall AS MATERIALIZED (SELECT qid, v, chunk_id, sum(qv.x * cv.x) AS cos FROM qv JOIN cv USING (b) GROUP BY ALL),
de AS MATERIALIZED (SELECT qid, v, chunk_id, round(cos, 6) AS score,
        row_number() OVER (PARTITION BY qid, v ORDER BY round(cos, 6) DESC, chunk_id) AS rank
        FROM cosall QUALIFY rank <= 30)"""


def pool(bm: str = "bm", de: str = "de", tag: str = "") -> str:
    """Fusion, better reading, ten candidates."""
    return f""",
lists{tag} AS (SELECT qid, v, chunk_id, rank AS b, NULL::BIGINT AS d FROM {bm} UNION ALL
         SELECT qid, v, chunk_id, NULL, rank FROM {de}),
rrf{tag} AS MATERIALIZED (SELECT qid, v, chunk_id, max(b) AS bm25_rank, max(d) AS dense_rank,
         coalesce(1.0::DOUBLE / (60 + max(b)), 0) + coalesce(1.0::DOUBLE / (60 + max(d)), 0) AS rrf
         FROM lists{tag} GROUP BY ALL),
best{tag} AS (SELECT * FROM rrf{tag}
         QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY rrf DESC, v) = 1),
cand{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS pool_rank
         FROM best{tag} QUALIFY pool_rank <= 10)"""


def reranked(tag: str = "") -> str:
    cover = "len(list_intersect(list_distinct(r.tk), list_distinct(t.tk)))::DOUBLE / len(list_distinct(r.tk))"
    return f""",
pair{tag} AS (SELECT c.qid, c.chunk_id, c.rrf, c.bm25_rank, c.dense_rank,
         round(8 * CASE WHEN len(r.tk) > 0 THEN {cover} ELSE 0 END + 4 * coalesce(a.cos, 0) - 6, 6) AS logit
         FROM cand{tag} c JOIN rd r ON r.qid = c.qid AND (r.v = 0 OR c.pool_rank <= 5)
         JOIN tok t ON t.chunk_id = c.chunk_id
         LEFT JOIN cosall a ON a.qid = c.qid AND a.v = r.v AND a.chunk_id = c.chunk_id),
hit{tag} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT p.qid, p.chunk_id, t.doc_id || ' §' || t.section AS label, any_value(p.rrf) AS rrf,
           any_value(p.bm25_rank) AS bm25_rank, any_value(p.dense_rank) AS dense_rank,
           any_value(st.status) AS status, round(max(logit) - 4.0 * any_value(st.demote), 6) AS score
    FROM pair{tag} p JOIN tok t ON t.chunk_id = p.chunk_id JOIN st ON st.doc_id = t.doc_id GROUP BY ALL)
  QUALIFY rank <= 8)"""


LISTS = TOKENS + READINGS + BM25 + DENSE
HITS = LISTS + STATUS + pool() + reranked()


def w(steps: str, body: str) -> str:
    return f"WITH {steps.strip()}\n{body}"


# ------------------------------------------------------------------ sources
ORACLE["chunk_windows"] = w(WINDOWS, """SELECT chunk_id, doc_id, section_title,
    len(string_split(text, ' '))::INTEGER AS n_words, text FROM win""")
LINES = "lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)," \
        "sec AS (SELECT doc_id, source, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS t " \
        "FROM lines, unnest(range(1, len(l) + 1)) AS u(i))"
ORACLE["markdown_sections"] = w(LINES, """SELECT 'D' || doc_id || '§' || i AS chunk_id, 'D' || doc_id AS doc_id,
    'Line ' || i AS section_title, 'Document ' || doc_id AS doc_title, source AS category, 'current' AS status,
    md5(t) AS text_md5 FROM sec WHERE t <> ''""")
ORACLE["heading_sections"] = w(LINES, """SELECT 'D' || doc_id || '§' || i AS chunk_id,
    'Heading ' || i AS section_title, length(t)::INTEGER AS n_chars FROM sec WHERE t <> ''""")
ORACLE["front_matter"] = """SELECT 'D' || doc_id AS doc_id, 'Document ' || doc_id AS title, source AS category,
    'current' AS status FROM documents"""
ORACLE["jsonl_sections"] = """SELECT conv_id || '§' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_id,
    turn, role FROM conversations"""
CHUNK_UNITS = WINDOWS + f""",
cu AS MATERIALIZED (SELECT *, {first_units('text')} AS units FROM win)""" + STATUS
ORACLE["doc_rollup"] = w(CHUNK_UNITS, """SELECT doc_id, doc_id AS title, any_value(status) AS status,
    count(*) AS sections, sum(len(units))::BIGINT AS units FROM cu JOIN st USING (doc_id) GROUP BY doc_id""")
ORACLE["corpus_stats"] = w(CHUNK_UNITS, """SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks,
    sum(len(units))::BIGINT AS units, min(len(string_split(text, ' '))) AS min_words,
    max(len(string_split(text, ' '))) AS max_words,
    round(sum(len(string_split(text, ' ')))::DOUBLE / count(*), 6) AS mean_words FROM cu""")
ORACLE["duplicate_chunk_ids"] = w(WINDOWS, """SELECT n, count(*) AS chunk_ids FROM (
    SELECT chunk_id, count(*) AS n FROM win GROUP BY chunk_id) GROUP BY n""")
ORACLE["corpus_validation"] = w(WINDOWS, r"""SELECT doc_id, 'sections not sequential' AS error FROM win
    GROUP BY doc_id HAVING count(*) < 3 UNION ALL
    SELECT doc_id, 'non-ASCII characters' FROM win GROUP BY doc_id
    HAVING max(regexp_matches(replace(text, '§', ''), '[^\x00-\x7F]')::INT) = 1""")

ORACLE["corpus_fingerprint"] = """SELECT substr(sha256(p0 || '/' || p1 || '/' || n), 1, 16) AS fingerprint, n AS n_files FROM (
    SELECT bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS p0, bit_xor(('0x' || substr(h, 16, 15))::BIGINT) AS p1, count(*) AS n
    FROM (SELECT sha256('doc_' || doc_id || text) AS h FROM documents))"""

# ------------------------------------------------------------------ text functions
for name, f in (("raw_tokens", raw), ("content_tokens", content)):
    ORACLE[name] = f"""SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {f('text')} AS t FROM documents)"""
ORACLE["stem_terms"] = f"""SELECT word, count(*) AS n, {stem('word')} AS stem FROM (
    SELECT unnest({raw('text')}) AS word FROM documents) GROUP BY word"""
ORACLE["numbers_in"] = f"""SELECT doc_id, array_to_string(n, ' ') AS numbers FROM (
    SELECT doc_id, {numbers('text')} AS n FROM documents) WHERE len(n) > 0"""
ORACLE["sentence_units"] = rf"""
WITH bl AS (SELECT doc_id, b, string_split(regexp_replace(blocks[b], '\r\n', chr(10), 'g'), chr(10)) AS l
            FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS blocks FROM documents), unnest(range(1, len(blocks) + 1)) AS u(b)),
l0 AS (SELECT doc_id, b, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS t FROM bl, unnest(range(1, len(l) + 1)) AS u(i)),
l1 AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, b ORDER BY i) AS nx FROM l0 WHERE t <> ''),
l2 AS (SELECT doc_id, b, i, t, CASE WHEN regexp_matches(t, '^([-*+]|[0-9]+[.)])\s+') THEN 'bullet'
              WHEN t LIKE '|%' THEN 'row' ELSE 'para' END AS kind FROM l1
       WHERE NOT (t LIKE '|%' AND coalesce(regexp_full_match(nx, '\|?[\s:|-]+\|?'), false))),
l3 AS (SELECT *, count(*) FILTER (kind = 'bullet') OVER (PARTITION BY doc_id, b ORDER BY i) AS seg FROM l2),
rows_ AS (SELECT doc_id, b, seg, i, list_filter(list_transform(string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|'),
              lambda c: trim(c)), lambda c: c <> '') AS c FROM l3 WHERE kind = 'row'),
un AS (
  SELECT doc_id, b, seg, 0 AS part, i, 0 AS k, regexp_replace(t, '^([-*+]|[0-9]+[.)])\s+', '') AS u FROM l3 WHERE kind = 'bullet'
  UNION ALL SELECT doc_id, b, seg, 1, i, 0, array_to_string(c, ' - ') FROM rows_
       WHERE len(list_filter(c, lambda x: NOT regexp_full_match(x, ':?-{{2,}}:?'))) > 0
  UNION ALL SELECT doc_id, b, seg, 2, 0, k, p[k] FROM (
       SELECT doc_id, b, seg, string_split(regexp_replace(string_agg(t, ' ' ORDER BY i),
              '([.!?])\s+([A-Z0-9\x22''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p
       FROM l3 WHERE kind = 'para' GROUP BY ALL), unnest(range(1, len(p) + 1)) AS v(k)),
cl AS (SELECT doc_id, b, seg, part, i, k, {squeeze('u')} AS u FROM un),
ag AS (SELECT doc_id, count(*) AS n, string_agg(u, chr(10) ORDER BY b, seg, part, i, k) AS us FROM cl
       WHERE len(string_split(u, ' ')) >= 3 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_units, md5(coalesce(us, '')) AS units_md5
FROM documents d LEFT JOIN ag ON ag.doc_id = d.doc_id"""
_SYN = ", ".join(f"({stem(repr(k))}, {i}, {stem(repr(v))})" for k, vs in SYNONYMS.items()
                 for i, v in enumerate(vs.split()))
ORACLE["expand_terms"] = f"""
WITH syn(t, i, s) AS (VALUES {_SYN}),
c AS (SELECT conv_id, turn, {content("role || CASE role WHEN 'user' THEN ' taxi and food ' WHEN 'assistant' THEN ' rooms wifi ' ELSE ' holidays ' END || text")} AS tk
      FROM conversations),
p AS (SELECT conv_id, turn, tk, k, tk[k] AS t FROM c, unnest(range(1, len(tk) + 1)) AS u(k)),
x AS (SELECT conv_id, turn, s, min(k * 100 + i) AS pos FROM p JOIN syn USING (t)
      WHERE NOT list_contains(tk, s) GROUP BY conv_id, turn, s)
SELECT c.conv_id, c.turn, coalesce(string_agg(s, ' ' ORDER BY pos), '') AS added
FROM c LEFT JOIN x ON x.conv_id = c.conv_id AND x.turn = c.turn GROUP BY c.conv_id, c.turn"""

# ------------------------------------------------------------------ index tables
ORACLE["term_freq"] = w(TOKENS, "SELECT chunk_id, term, tf FROM post")
ORACLE["doc_length"] = w(TOKENS, "SELECT chunk_id, len(tk)::INTEGER AS dl FROM tok")
ORACLE["corpus_size"] = w(TOKENS, "SELECT n, round(avgdl, 6) AS avgdl FROM size")
ORACLE["idf_salience"] = w(TOKENS, """SELECT term, df, round(idf, 6) AS idf,
    round(idf / (SELECT max(idf) FROM idf), 6) AS salience FROM idf""")
ORACLE["proper_terms"] = w(WINDOWS, rf"""SELECT DISTINCT {stem('word')} AS term FROM (
    SELECT lower(x) AS word, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '[a-z,] ([A-Z][a-zA-Z]{{2,}})\b', 1)) AS x FROM win)
    GROUP BY 1) c LEFT JOIN (SELECT t, count(*) AS m FROM (SELECT unnest({raw('text')}) AS t FROM win) GROUP BY t) a
    ON a.t = c.word WHERE word NOT IN ({STOP}) AND coalesce(m, 0) - n <= 0""")
ORACLE["index_persistence"] = w(TOKENS + f", us AS (SELECT {first_units('text')} AS u FROM win)", """
    SELECT 'chunks' AS table_name, count(*) AS rows FROM tok UNION ALL SELECT 'postings', count(*) FROM post
    UNION ALL SELECT 'sentences', sum(len(u))::BIGINT FROM us""")

# ------------------------------------------------------------------ retrieval
ORACLE["bm25_scores"] = w(TOKENS + READINGS + BM25, """SELECT qid AS qkey, count(*) AS chunks, max(score) AS best,
    round(sum(score), 4) AS total FROM bms WHERE v = 0 AND score > 0 GROUP BY qid""")
ORACLE["bm25_topk"] = w(TOKENS + READINGS + BM25, """SELECT qid AS qkey, chunk_id, score, rank::INTEGER AS rank
    FROM bm WHERE v = 0""")
ORACLE["dense_topk_hashed"] = w(TOKENS + READINGS + DENSE, """SELECT qid, chunk_id, score, rank::INTEGER AS rank
    FROM de WHERE v = 0""")
ORACLE["dense_topk_embeddings"] = """
WITH x AS (SELECT vec_id, label, d, embedding[d]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS u(d)),
c AS (SELECT label, d, round(avg(x), 6) AS m FROM x GROUP BY ALL),
cl AS (SELECT label, list(m ORDER BY d) AS q FROM c GROUP BY label),
s AS (SELECT cl.label, e.vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM cl, embeddings e)
SELECT label, vec_id, score, (row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id))::INTEGER AS rank
FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 30"""
ORACLE["rrf_hybrid"] = w(LISTS + pool(), """SELECT qid, chunk_id, round(rrf, 9) AS rrf,
    bm25_rank::INTEGER AS bm25_rank, dense_rank::INTEGER AS dense_rank FROM rrf WHERE v = 0""")
ORACLE["rrf_variant_maxpool"] = w(LISTS + pool(), """SELECT qid, chunk_id, round(rrf, 9) AS rrf,
    bm25_rank::INTEGER AS bm25_rank, dense_rank::INTEGER AS dense_rank, pool_rank::INTEGER AS pool_rank FROM cand""")
ORACLE["rerank_hits"] = w(HITS, """SELECT qid, chunk_id, label, score, round(rrf, 9) AS rrf,
    bm25_rank::INTEGER AS bm25_rank, dense_rank::INTEGER AS dense_rank, rank::INTEGER AS rank FROM hit""")
ORACLE["rerank_pairs_scored"] = w(LISTS + pool(), """SELECT c.qid, count(*) AS pairs FROM cand c
    JOIN rd r ON r.qid = c.qid AND (r.v = 0 OR c.pool_rank <= 5) GROUP BY c.qid""")
ORACLE["no_rerank_hits"] = w(LISTS + STATUS + pool(), """
    SELECT qid, chunk_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id))::INTEGER AS rank
    FROM (SELECT qid, chunk_id, round(rrf * 100 - 0.8 * demote, 6) AS score FROM cand JOIN tok USING (chunk_id)
          JOIN st USING (doc_id))
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 8""")
SENT = rf""",
se AS (SELECT t.chunk_id, i - 1 AS sent_idx, {content("t.doc_id || ' - Part ' || t.section || ': ' || u[i]")} AS stk
  FROM (SELECT chunk_id, doc_id, section, {first_units('text')} AS u FROM tok
        WHERE chunk_id IN (SELECT chunk_id FROM hit WHERE rank <= 3)) t, unnest(range(1, least(len(u), 8) + 1)) AS x(i)),
sr AS (SELECT qid, tk FROM rd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC) = 1),
sp AS (SELECT h.qid, h.chunk_id, h.rank, sent_idx, sr.tk AS qtk, stk FROM hit h JOIN se USING (chunk_id)
       JOIN sr ON sr.qid = h.qid WHERE h.rank <= 3),
qb AS (SELECT qid, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (
       SELECT qid, ('0x' || substr(md5(t), 1, 4))::INTEGER AS h FROM (SELECT qid, unnest(tk) AS t FROM sr)) GROUP BY ALL),
sb AS (SELECT chunk_id, sent_idx, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (
       SELECT chunk_id, sent_idx, ('0x' || substr(md5(t), 1, 4))::INTEGER AS h FROM (
       SELECT chunk_id, sent_idx, unnest(stk) AS t FROM se)) GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(x * x)) AS n FROM qb GROUP BY qid),
sn AS (SELECT chunk_id, sent_idx, sqrt(sum(x * x)) AS n FROM sb GROUP BY ALL),
dp AS (SELECT sp.qid, sp.chunk_id, sp.sent_idx, sum(qb.x * sb.x) AS dot FROM sp JOIN qb ON qb.qid = sp.qid
       JOIN sb ON sb.chunk_id = sp.chunk_id AND sb.sent_idx = sp.sent_idx AND sb.b = qb.b GROUP BY ALL)"""
ORACLE["sentence_rerank"] = w(HITS + SENT, """
    SELECT sp.qid, sp.chunk_id, sp.rank::INTEGER AS rank, sp.sent_idx::INTEGER AS sent_idx,
      round(8 * CASE WHEN len(qtk) > 0 THEN len(list_intersect(list_distinct(qtk), list_distinct(stk)))::DOUBLE
            / len(list_distinct(qtk)) ELSE 0 END
            + 4 * CASE WHEN coalesce(qn.n * sn.n, 0) > 0 THEN coalesce(dot, 0) / (qn.n * sn.n) ELSE 0 END - 6, 6) AS ce
    FROM sp LEFT JOIN dp ON dp.qid = sp.qid AND dp.chunk_id = sp.chunk_id AND dp.sent_idx = sp.sent_idx
    LEFT JOIN qn ON qn.qid = sp.qid LEFT JOIN sn ON sn.chunk_id = sp.chunk_id AND sn.sent_idx = sp.sent_idx""")
ORACLE["mode_ablation"] = w(
    LISTS + STATUS + ", none AS (SELECT * FROM bm WHERE false)" + pool() + reranked()
    + pool("none", "de", "_d") + reranked("_d") + pool("bm", "none", "_b") + reranked("_b"), """
    SELECT qid, count(*) FILTER (h) AS hybrid, count(*) FILTER (d) AS dense, count(*) FILTER (b) AS bm25,
      count(*) FILTER (h AND d) AS hybrid_dense, count(*) FILTER (h AND b) AS hybrid_bm25
    FROM (SELECT qid, chunk_id, bool_or(m = 'h') AS h, bool_or(m = 'd') AS d, bool_or(m = 'b') AS b FROM (
      SELECT qid, chunk_id, 'h' AS m FROM hit UNION ALL SELECT qid, chunk_id, 'd' FROM hit_d
      UNION ALL SELECT qid, chunk_id, 'b' FROM hit_b) GROUP BY ALL) GROUP BY qid""")
ORACLE["fuse_across_queries"] = w(HITS, """
    SELECT 'len' || (length(b.text) // 50) AS turn_key, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused,
      count(*) AS queries, max(score) AS owner_score
    FROM hit h JOIN benchmark b ON b.item_id = h.qid WHERE rank <= 4 GROUP BY ALL""")
ORACLE["superseded_demotion"] = w(WINDOWS + STATUS, """SELECT status, count(*) AS chunks, sum(demote)::BIGINT AS demoted
    FROM win JOIN st USING (doc_id) GROUP BY status""")
ORACLE["usable_evidence"] = w(HITS, """
    SELECT qid, chunk_id, score, use_rank::INTEGER AS use_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS use_rank FROM (
        SELECT *, bool_or(status <> 'superseded') OVER (PARTITION BY qid) AS cur FROM hit WHERE score >= -5)
      WHERE status <> 'superseded' OR NOT cur) WHERE use_rank <= 4""")
BASE = """SELECT qid, chunk_id, score, rank FROM de WHERE v = 0 AND rank <= 5"""
ORACLE["label_lookup"] = w(TOKENS + READINGS + DENSE, f"""SELECT qid, doc_id || ' §' || section AS label, chunk_id,
    length(text)::INTEGER AS n_chars FROM ({BASE}) JOIN win USING (chunk_id)""")
ORACLE["baseline_search"] = w(TOKENS + READINGS + DENSE, f"""SELECT qid, chunk_id, round(score * 10, 6) AS score,
    rank::INTEGER AS rank FROM ({BASE})""")
ORACLE["query_cache"] = rf"""SELECT 2 * count(*) AS asked,
    count(DISTINCT lower({squeeze('text')})) AS searched FROM benchmark"""

# ------------------------------------------------------------------ grounding
CLAIMS = TOKENS + f""",
cl AS MATERIALIZED (SELECT chunk_id || '#' || i AS claim_id, doc_id, section, body, list_distinct({content('body')}) AS ctk,
    {numbers('body')} AS cn FROM (SELECT chunk_id, doc_id, section, i, u[i] AS body
      FROM (SELECT *, {first_units('text')} AS u FROM tok), unnest(range(1, len(u) + 1)) AS x(i))),
src AS (SELECT doc_id, section, tk, {numbers("doc_id || '. Part ' || section || '. ' || text")} AS sn FROM tok)"""
ORACLE["extract_citations"] = w(CLAIMS, """SELECT claim_id, doc_id || ' §' || section || '|' || doc_id || ' §' ||
    (section + 1) AS labels, md5(trim(body)) AS body_md5 FROM cl""")
VERIFY = CLAIMS + """,
sc AS MATERIALIZED (SELECT claim_id, cl.doc_id, cl.section, b.doc_id IS NULL AS fake,
    CASE WHEN len(list_filter(cn, lambda n: NOT list_contains(list_concat(a.sn, coalesce(b.sn, [])), n))) > 0 THEN 0.0
         WHEN len(ctk) = 0 THEN 1.0
         ELSE len(list_intersect(ctk, list_concat(a.tk, coalesce(b.tk, []))))::DOUBLE / len(ctk) END AS score
    FROM cl JOIN src a ON a.doc_id = cl.doc_id AND a.section = cl.section
    LEFT JOIN src b ON b.doc_id = cl.doc_id AND b.section = cl.section + 1),
vf AS (SELECT claim_id, round(score, 6) AS score, score >= 0.7 AND NOT fake AS supported,
    CASE WHEN fake THEN doc_id || ' §' || (section + 1) ELSE '' END AS fabricated_ids,
    array_to_string(list_sort(list_filter([CASE WHEN section > 2 THEN doc_id || ' §' || section END,
      CASE WHEN section + 1 > 2 AND NOT fake THEN doc_id || ' §' || (section + 1) END],
      lambda x: x IS NOT NULL)), '|') AS unretrieved_ids FROM sc)"""
ORACLE["verify_claims"] = w(VERIFY, """SELECT claim_id, score, supported,
    supported AND unretrieved_ids = '' AS supported_strict, fabricated_ids, unretrieved_ids FROM vf""")
ORACLE["support_rates"] = w(VERIFY, """SELECT count(*) AS claims, count(*) FILTER (supported) AS supported,
    count(*) FILTER (supported AND unretrieved_ids = '') AS supported_strict,
    count(*) FILTER (fabricated_ids <> '') AS fabricated,
    sum(CASE WHEN unretrieved_ids = '' THEN 0 ELSE len(string_split(unretrieved_ids, '|')) END)::BIGINT AS unretrieved,
    round(count(*) FILTER (supported)::DOUBLE / count(*), 6) AS support_rate FROM vf""")
ORACLE["support_other_source"] = w(CLAIMS, """SELECT claim_id, round(s, 6) AS score, s >= 0.7 AND NOT fake AS supported,
    fake::INTEGER AS fabricated FROM (SELECT claim_id, b.doc_id IS NULL AS fake, CASE WHEN b.doc_id IS NULL THEN 0.0
      WHEN len(list_filter(cn, lambda n: NOT list_contains(b.sn, n))) > 0 THEN 0.0 WHEN len(ctk) = 0 THEN 1.0
      ELSE len(list_intersect(ctk, b.tk))::DOUBLE / len(ctk) END AS s
    FROM cl LEFT JOIN src b ON b.doc_id = cl.doc_id AND b.section = cl.section + 1)""")
