"""The registered queries of this folder and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exactdedup, linededup, lm, phrases, pii, quality, resample, sentencepiece, simhash, tokenfile, vectors
from .common import stage, table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    """Where the named public vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark, sf):
    return decontaminate.decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))


@query
def op6_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op7_line_dedup(spark, sf):
    """Per document: lines, deleted lines, and length and digest of what is left."""
    cut = linededup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"),
                      F.length("row.text").cast("long").alias("n_chars_left"), F.sha2("row.text", 256).alias("text_sha256"))


ORACLE["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT *, greatest(1, len(regexp_extract_all(line, '[^ 	
]+'))) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w),
f AS (SELECT a.doc_id, a.i AS p, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49
      WHERE b.c - a.c + a.w >= 50 GROUP BY ALL
      UNION
      SELECT b.doc_id, max(a.i) AS p, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49
      WHERE b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.i),
t AS (SELECT f.doc_id, p, e, string_agg(line, chr(10) ORDER BY i) AS run FROM f JOIN l ON l.doc_id = f.doc_id AND l.i BETWEEN p AND e GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS n FROM t),
d AS (SELECT DISTINCT g.doc_id, l.i FROM g JOIN l ON l.doc_id = g.doc_id AND l.i BETWEEN p AND e WHERE n > 1),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(d.i) AS n_deleted,
        coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (d.i IS NULL), '') AS t
      FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_deleted, length(t) AS n_chars_left, sha256(t) AS text_sha256 FROM s
"""


@query
def op9_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))


@query
def op2_sentencepiece(spark, sf):
    """Per document: how many ids, a digest of them and of the text that they decode to."""
    path = tokenizer(PIECE_MODEL)
    ids = sentencepiece.encode(table(spark, sf, "documents").select("doc_id", "text"), path)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxh64"),
                      F.sha2(sentencepiece.decoded(F.col("ids"), path), 256).alias("text_sha256"))


@query
def op5_token_file(spark, sf):
    path = tokenfile.write(table(spark, sf, "documents").select("doc_id", "text"), tokenizer(BYTE_BPE))
    return tokenfile.digest(tokenfile.read(spark, path))


@query
def op4_lm_scores(spark, sf):
    return lm.score(table(spark, sf, "documents").select("doc_id", "text"))


PLANTED = r"\### Assistant: </turn> ok"


@query
def op8_chat_format(spark, sf):
    """All conversations and one that holds template marks, formatted, written and read back."""
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    parts = stage(chat.render(chat.fold(chat.log_of(given.unionByName(odd)))), "chat")
    return chat.read_back(parts)


@query
def op10_vector_dedup(spark, sf):
    return vectors.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))

SURROGATE_KEY = b"change this key for your corpus"


@query
def op3_surrogates(spark, sf):
    """Every document with surrogates for its personal data."""
    new = pii.replace(table(spark, sf, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return new.select("row.doc_id", F.size("spans").cast("long").alias("n_entities"), "row.text")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + 12], ' ') AS k
      FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(p) WHERE len(w) > 0),
s AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM i), unnest(range(1, len(w) - n + 2)) AS u(p)),
h AS (SELECT doc_id, p, s.n, item_id FROM s JOIN i ON i.k = s.k AND i.n = s.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
o AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""

ORACLE["op8_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS t,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS l,
    sum(17 + length(role) + length(text) + length(regexp_replace(text, '[^<>\\]', '', 'g')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""

ORACLE["op10_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.node = vec_id
"""


@query
def op11_phrases(spark, sf):
    return phrases.mine(table(spark, sf, "documents").select("lang", "text"))


@query
def op12_exact_dedup(spark, sf):
    return exactdedup.classes(exactdedup.numbered(table(spark, sf, "documents"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op13_resample(spark, sf):
    return resample.resample(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text"))


_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

ORACLE["op11_phrases"] = rf"""
WITH p AS (SELECT lang, regexp_extract_all(x, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\n\x0b\f\r]')) AS x FROM documents)),
g AS (SELECT lang, w[i:i + m - 1] AS w, count(*) AS f FROM p, (SELECT unnest(range(1, 5)) AS m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT lang, w, f AS a FROM g WHERE len(w) > 1 AND f >= 30),
s AS (SELECT lang, w[i:i + m - 1] AS w, max(a) AS around FROM c, (SELECT unnest(range(2, 4)) AS m), unnest(range(1, len(w) - m + 2)) AS u(i)
      WHERE m < len(w) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN s ON s.lang = c.lang AND s.w = c.w WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
q AS (SELECT k.lang, k.w, k.a, h.f AS l, t.f AS r, u.j, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
      FROM k, unnest(range(1, len(w))) AS u(j) JOIN g h ON h.lang = k.lang AND h.w = k.w[1:u.j] JOIN g t ON t.lang = k.lang AND t.w = k.w[u.j + 1:]),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase,
        a, l, r, score FROM b)
SELECT o.*, n FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE["op12_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOW} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

ORACLE["op13_resample"] = f"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT x FROM (SELECT unnest(w) AS x FROM d UNION ALL SELECT unnest(w) FROM b)),
y AS (SELECT x, list_prepend(4294967295, list_transform(range(length(hex(x)) // 2), lambda i: ('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT)) AS y FROM v),
h AS (SELECT x, xor(list_reduce(y, lambda c, z: xor(c >> 8, tab[xor(c & 255, z) + 1])), 4294967295) % 10000 AS k FROM y, tab),
o AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
s AS (SELECT k, sum(c) AS s FROM o JOIN h USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM (SELECT unnest(w) AS x FROM b) JOIN h USING (x) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT k FROM h) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
w AS (SELECT doc_id, sum(c * gain)::BIGINT AS weight FROM o JOIN h USING (x) JOIN g USING (k) GROUP BY doc_id),
e AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT e.*, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
