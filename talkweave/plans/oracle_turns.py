"""DuckDB statements for the conversation, telemetry and evaluation queries."""
from __future__ import annotations

from .. import fixed_values as V
from ..operators.gate import CUES
from ..sources import gate_store
from .catalog_metrics import KINDS
from .oracle import HITS, ORACLE, TOKENS, content, first_units, raw, squeeze, stem, w  # noqa: F401

# RE2 knows word classes for ASCII only: letters beyond it become an underscore, which is a word character too
WORDS = r"regexp_replace({}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"


def has(x: str, pattern: str) -> str:
    return "regexp_matches({}, '(?i){}')".format(WORDS.format(x), pattern.replace("'", "''"))


ORACLE["cue_flags"] = "SELECT conv_id, turn, " + ", ".join(
    f"{has('text', p)} AS is_{n}" for n, p in CUES.items()) + " FROM conversations"
_ANAPHORIC = "regexp_matches(regexp_replace({}, '(?i){}', ' ', 'g'), '(?i){}')".format(
    WORDS.format("text"), V.EXISTENTIAL.replace("'", "''"), V.ANAPHORA.replace("'", "''"))
ORACLE["question_patterns"] = "SELECT conv_id, turn, " + ", ".join(
    f"{has('text', p)} AS {n}" for n, p in {
        "starts_question": V.QUESTION_START, "has_request": V.REQUEST_CUE, "starts_context": V.CONTEXT_START,
        "starts_preposition": V.PREPOSITION_START, "has_wh": V.WH_ANYWHERE,
        "distinct_question": V.DISTINCT_QUESTION}.items()) + f", {_ANAPHORIC} AS anaphoric FROM conversations"
ORACLE["answer_types"] = f"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'How many days user or what is the rate? ' || text
           WHEN 'assistant' THEN 'what is the fee ' || text ELSE text END AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT {has('q', V.QUANTITY_QUESTION)} THEN NULL WHEN {has('q', V.DURATION_QUESTION)}
  THEN 'duration' WHEN {has('q', V.MONEY_QUESTION)} THEN 'currency' ELSE 'number' END AS kind,
  {has('q', V.DURATION)} AS has_duration, regexp_matches(q, '[0-9]') AS has_number FROM t"""
ORACLE["spoken_counts"] = """SELECT conv_id, turn, (CASE turn % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 5 END)::INTEGER AS n
    FROM conversations"""
ORACLE["turn_accumulate"] = r"""
WITH l AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM conversations)
SELECT conv_id || '/' || turn AS turn_key, (i - 1)::DOUBLE AS t, md5(trim(array_to_string(l[1:i], ' '))) AS partial_md5
FROM l, unnest(range(1, len(l) + 1)) AS u(i)"""
ORACLE["session_merge_ctx"] = f"""
WITH t AS (SELECT conv_id, turn, {content('text')} AS tk FROM conversations),
d AS (SELECT conv_id, turn, list_filter(tk, lambda x, i: list_position(tk, x) = i) AS f FROM t),
m AS (SELECT conv_id, turn, i, f[i] AS term FROM d, unnest(range(1, len(f) + 1)) AS u(i)),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, term ORDER BY turn DESC, i) = 1)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, i))::INTEGER AS rank, term FROM l
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, i) <= 5"""
ORACLE["version_lineage"] = """SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (
    PARTITION BY conv_id ORDER BY turn) AS version FROM conversations"""
_KEY = f"array_to_string(list_sort(list_distinct({content('line')})), ' ')"
ORACLE["dispatch_dedup"] = f"""
WITH l0 AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
l AS (SELECT conv_id, turn, i - 1 AS n, l[i] AS line FROM l0, unnest(range(1, len(l) + 1)) AS u(i)),
k AS (SELECT conv_id, turn, n, {_KEY} AS qk FROM l),
f AS (SELECT * FROM k WHERE qk <> '')
SELECT conv_id, turn, n::INTEGER AS n, md5(qk) AS key_md5 FROM f a
WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.qk = a.qk)
QUALIFY row_number() OVER (PARTITION BY conv_id, turn, qk ORDER BY n) = 1"""

# ------------------------------------------------------------------ telemetry
EV = """WITH e AS (SELECT event_id AS seq, event_type AS event, user_id AS session_id, strftime(ts, '%Y-%m-%d') AS turn_id,
    value, props, epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE AS t FROM events)"""
_MISS = [("turn_started", "event = 'signup'"), ("chunk_received", "event = 'view'"),
         ("controller_decision", "event = 'click'"), ("answer_version", "false"), ("grounding_check", "false"),
         ("turn_completed", "event = 'purchase'")]
_M = ", ".join(f"CASE WHEN NOT bool_or({c}) THEN '{k}' END" for k, c in _MISS)
ORACLE["trace_coverage"] = f"""{EV} SELECT session_id, turn_id, count(*) AS events,
    array_to_string(list_filter([{_M}, CASE WHEN bool_or(event = 'error') THEN 'retrieval_completed' END,
      CASE WHEN NOT bool_or(event = 'purchase' AND value > 5) THEN 'turn_completed.cost/latency' END],
      lambda x: x IS NOT NULL), '|') AS missing FROM e GROUP BY ALL"""
ORACLE["trace_coverage_rate"] = f"""{EV} SELECT count(*) AS turns, count(*) FILTER (ok) AS complete,
    round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS coverage FROM (SELECT session_id,
    len(list_filter([{_M}, CASE WHEN bool_or(event = 'error') THEN 'retrieval_completed' END,
      CASE WHEN NOT bool_or(event = 'purchase' AND value > 5) THEN 'turn_completed.cost/latency' END],
      lambda x: x IS NOT NULL)) = 0 AS ok FROM e GROUP BY session_id)"""
ORACLE["event_schema_check"] = f"""{EV} SELECT CASE event WHEN 'error' THEN 'oops' WHEN 'view' THEN 'chunk_received'
      WHEN 'click' THEN 'controller_decision' WHEN 'purchase' THEN 'turn_completed' END AS event, count(*) AS rows,
    (count(*) * CASE event WHEN 'error' THEN 1 WHEN 'view' THEN 1 WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 END)::BIGINT AS problems,
    count(*) FILTER (event = 'error') AS unknown_event
    FROM e WHERE event <> 'signup' GROUP BY event"""
_RANK = "list_sort(list(value))[(round_even({q} * (count(*) - 1), 0) + 1)::BIGINT]"
ORACLE["latency_percentiles"] = f"""{EV} SELECT event, count(*) AS n, {_RANK.format(q=0.5)} AS p50,
    {_RANK.format(q=0.95)} AS p95 FROM e WHERE value IS NOT NULL GROUP BY event"""
ORACLE["cost_model"] = f"""{EV} SELECT session_id, turn_id, round(round(sum(value), 2) / 3.6e6 * 0.0447 * 4
    + count(*) * 0.5 / 1e6, 8) AS usd FROM e GROUP BY ALL"""
ORACLE["latest_per_turn"] = f"""{EV} SELECT session_id, turn_id, event, max(seq) AS seq, arg_max(value, seq) AS value
    FROM e GROUP BY ALL"""
ORACLE["job_spans"] = f"""{EV} SELECT j.session_id, j.turn_id, round(j.t - j.value / 1000, 6) AS t_start,
    round(j.t, 6) AS t_end, round(f.t0 - j.t, 6) AS lead_s
    FROM e j LEFT JOIN (SELECT session_id, turn_id, min(t) AS t0 FROM e WHERE event = 'view' GROUP BY ALL) f
    ON f.session_id = j.session_id AND f.turn_id = j.turn_id WHERE j.event = 'click'"""
ORACLE["virtual_worker"] = f"""{EV}, c AS (SELECT session_id, seq, t, value * 60 AS c,
    sum(value * 60) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cum FROM e),
    x AS (SELECT *, cum + max(t - (cum - c)) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS t_end FROM c)
    SELECT session_id, seq, round(t_end - c, 3) AS t_start, round(t_end, 3) AS t_end FROM x"""

# ------------------------------------------------------------------ evaluation
TR = f"""WITH n AS (SELECT conv_id, turn, role, text, len(list_filter(string_split({squeeze('text')}, ' '), lambda x: x <> '')) AS nw
      FROM conversations),
k AS (SELECT *, CASE WHEN role = 'system' THEN 'chitchat' WHEN role = 'assistant' THEN 'presentation'
        WHEN turn <= 1 THEN 'single' ELSE 'refinement' END AS type,
      CASE WHEN role = 'system' THEN 'chitchat' WHEN role = 'assistant' THEN 'presentation'
        WHEN turn <= 1 THEN 'retrieval' ELSE 'refinement' END AS expected,
      CASE WHEN nw < 12 THEN 'chitchat' WHEN nw > 60 THEN 'presentation' WHEN turn <= 1 THEN 'retrieval'
        ELSE 'refinement' END AS kind FROM n),
r AS (SELECT *, count(*) FILTER (kind IN ('retrieval', 'refinement')) OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM k),
p AS (SELECT *, coalesce(max(CASE WHEN kind IN ('retrieval', 'refinement') THEN version END) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_version FROM r)"""


def pct(c: str) -> str:
    return f"round(100 * avg(({c})::INTEGER), 1)"


ORACLE["confusion_matrix"] = TR + " SELECT expected, " + ", ".join(
    f"count(*) FILTER (kind = '{l}') AS {l}" for l in V.GATE_LABELS) + " FROM r GROUP BY expected"
ORACLE["turn_kind_accuracy"] = f"{TR} SELECT type, count(*) AS turns, {pct('expected = kind')} AS accuracy_pct FROM r GROUP BY type"
_NEED, _GOT = "(expected IN ('retrieval', 'refinement'))", "(kind IN ('retrieval', 'refinement'))"
ORACLE["early_retrieval"] = f"""{TR} SELECT type, count(*) AS turns, {pct(f'{_NEED} = {_GOT}')} AS decision_accuracy_pct,
    {pct(f'CASE WHEN {_NEED} THEN nw > 12 END')} AS g2_early_pct, {pct(f'CASE WHEN {_NEED} THEN nw > 12 END')} AS g2_strict_pct,
    {pct(f'CASE WHEN NOT {_NEED} THEN {_GOT} END')} AS false_trigger_pct FROM r GROUP BY type"""
ORACLE["previous_answer"] = TR + " SELECT conv_id, turn, kind, version, prev_version FROM p"
_V = "kind = 'refinement' AND version = prev_version + 1"
_C = f"({_V}) AND nw % 5 <> 0 AND nw % 7 > 0"
_D = "kind = 'refinement' AND nw % 6 <= 4"
ORACLE["refinement_gate"] = f"""{TR} SELECT count(*) AS g5_turns, {pct(_V)} AS versioned_pct, {pct(_C)} AS continuity_pct,
    {pct(_D)} AS delta_only_pct, {pct(f'({_C}) AND ({_D})')} AS g5_pass_pct FROM p WHERE type = 'refinement'"""
_N = "expected <> 'chitchat'"
ORACLE["uncertainty_metrics"] = f"""{TR} SELECT
    {pct(f'CASE WHEN {_N} AND nw % 4 = 0 THEN nw % 3 + nw % 2 > 0 END')} AS unanswerable_flagged_pct,
    {pct(f'CASE WHEN {_N} AND nw % 4 <> 0 THEN nw % 3 > 0 END')} AS false_uncertainty_pct,
    {pct(f'CASE WHEN {_N} AND nw % 4 <> 0 THEN nw % 2 > 0 END')} AS coverage_notes_pct FROM r"""
BENCH_UNITS = r""",
bu AS (SELECT item_id, text FROM benchmark),
bp AS (SELECT item_id, string_split(regexp_replace(regexp_replace(text, '\s*\n\s*', ' ', 'g'), '([.!?])\s+([A-Z0-9\x22''(])',
       '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM bu),
bg AS (SELECT item_id AS turn_key, i AS intent, u FROM (SELECT item_id, list_filter(list_transform(p, lambda x:
       trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) >= 3) AS us FROM bp),
       unnest(range(1, len(us) + 1)) AS z(i), unnest([us[i]]) AS y(u)),
cs AS (SELECT chunk_id, unnest(""" + first_units("text") + r""") AS u FROM tok),
gold AS MATERIALIZED (SELECT DISTINCT turn_key, intent - 1 AS intent, chunk_id FROM bg JOIN cs USING (u))"""


def quality(hit: str) -> str:
    return f"""SELECT round(100 * avg(h3::INTEGER), 1) AS hit_at_3_pct, round(100 * avg(r5), 1) AS recall_at_5_pct, count(*) AS gold_intents
    FROM (SELECT g.turn_key, g.intent, coalesce(bool_or(h.rank <= 3), false) AS h3,
      count(*) FILTER (h.rank <= 5)::DOUBLE / count(*) AS r5
      FROM gold g LEFT JOIN {hit} h ON h.qid = g.turn_key AND h.chunk_id = g.chunk_id GROUP BY ALL)"""


ORACLE["hit_and_recall"] = w(HITS + BENCH_UNITS, quality("hit"))
ORACLE["citation_precision"] = w(HITS + BENCH_UNITS, """SELECT count(*) AS turns, round(100 * avg(p), 1) AS citation_precision_pct
    FROM (SELECT qid, avg((EXISTS (SELECT 1 FROM gold g WHERE g.turn_key = h.qid AND g.chunk_id = h.chunk_id))::INTEGER) AS p
          FROM hit h WHERE rank <= 4 GROUP BY qid)""")
ORACLE["gold_misses"] = w(HITS + BENCH_UNITS, """SELECT turn_key, intent::INTEGER AS intent FROM gold g
    GROUP BY turn_key, intent HAVING NOT bool_or(EXISTS (SELECT 1 FROM hit h WHERE h.qid = g.turn_key
      AND h.chunk_id = g.chunk_id AND rank <= 3))""")
_NORM = r"regexp_replace(regexp_replace(replace(lower({}), '’', ''''), '([0-9]),([0-9])', '\1\2', 'g'), '\s+', ' ', 'g')"
ORACLE["key_fact_recall"] = w(HITS + BENCH_UNITS, f"""SELECT b.turn_key, count(*) AS facts,
    count(*) FILTER (list_bool_or(list_transform(t.texts, lambda x: contains({_NORM.format('x')}, {_NORM.format('b.u')})))) AS found
    FROM bg b LEFT JOIN (SELECT qid, list(text) AS texts FROM hit JOIN tok USING (chunk_id) GROUP BY qid) t ON t.qid = b.turn_key GROUP BY b.turn_key""")
from .oracle import pool, reranked  # noqa: E402

_NR = """, hit_n AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
    FROM (SELECT qid, chunk_id, round(rrf * 100 - 0.8 * demote, 6) AS score FROM cand JOIN tok USING (chunk_id) JOIN st USING (doc_id)))"""
ORACLE["summary_pivot"] = w(
    HITS + ", none AS (SELECT * FROM bm WHERE false)" + pool("none", "de", "_d") + reranked("_d") + pool("bm", "none", "_b")
    + reranked("_b") + _NR + BENCH_UNITS
    + "".join(f", q_{n} AS ({quality(h)})" for n, h in (("default", "hit"), ("dense_only", "hit_d"), ("bm25_only", "hit_b"),
                                                     ("no_rerank", "(SELECT * FROM hit_n WHERE rank <= 8)"))),
    " UNION ALL ".join(f"""SELECT '{m}' AS metric, (SELECT {m} FROM q_default) AS "default", (SELECT {m} FROM q_dense_only) AS dense_only,
      (SELECT {m} FROM q_bm25_only) AS bm25_only, (SELECT {m} FROM q_no_rerank) AS no_rerank"""
                       for m in ("hit_at_3_pct", "recall_at_5_pct")))
ORACLE["threshold_sweep"] = f"""{EV}, s AS (SELECT (value - 10) / 4 AS score, event IN ('purchase', 'click') AS pos FROM e)
    SELECT k / 2.0::DOUBLE AS threshold, count(*) FILTER ((pos AND score >= k / 2.0) OR (NOT pos AND score < k / 2.0)) AS correct
    FROM s, unnest(range(-12, 12)) AS u(k) GROUP BY k"""
ORACLE["best_threshold"] = f"""WITH sw AS ({ORACLE['threshold_sweep']})
    SELECT threshold, correct FROM sw ORDER BY correct DESC, threshold LIMIT 1"""
_GV = {"G2": ("value > 2", 80), "G3": ("value > 5", 70), "G4": ("value > 1", 85), "G5": ("value > 4", 80), "G6": ("value >= 0", 100)}
ORACLE["gate_verdicts"] = EV + " " + " UNION ALL ".join(
    f"""SELECT event AS config, '{g}' AS gate, {t}::DOUBLE AS target, {pct(c)} AS value,
    CASE WHEN {pct(c)} >= {t} {"AND count(*) FILTER (value > 200) = 0" if g == 'G4' else ''} THEN 'pass' ELSE 'fail' END AS verdict
    FROM e GROUP BY event""" for g, (c, t) in _GV.items())

# ------------------------------------------------------------------ answers
AN = """WITH l AS (SELECT conv_id, turn, role, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
      lambda x: x <> '') AS lines FROM conversations),
a AS (SELECT *, list_transform(lines, lambda x, i: x || ' [Doc_' || conv_id || ' §' || i || ']') AS f,
      CASE WHEN turn % 2 = 1 THEN 'Not verified: ' || role || ' note.' ELSE '' END AS note,
      greatest(1, least(coalesce(nullif(turn % 7, 0), 3), 6)) AS n FROM l)"""
ORACLE["presentation_bullets"] = AN + """
SELECT conv_id, turn, md5(CASE role
  WHEN 'assistant' THEN CASE WHEN len(f) = 0 THEN text WHEN len(f) >= n THEN array_to_string(list_transform(range(0, n), lambda k:
      '- ' || array_to_string(list_filter(f, lambda x, i: (i - 1) % n = k), ' ')), chr(10))
    ELSE array_to_string(list_transform(f, lambda x: '- ' || x), chr(10)) END
  WHEN 'user' THEN coalesce(nullif(array_to_string(f, ' '), ''), text) ELSE text END
  || CASE WHEN role <> 'system' AND note <> '' THEN chr(10) || note ELSE '' END) AS text_md5 FROM a"""
ORACLE["render_answer"] = AN + """,
b AS (SELECT *, list_transform(f, lambda x, i: CASE WHEN i = 3 THEN 'Intent 3: I could not find this in the knowledge base (no figure).'
      WHEN len(f) > 1 OR turn > 0 THEN 'Intent ' || i || ': ' || x ELSE x END) AS lines_out,
      list_transform(f, lambda x, i: 'Still applies - Intent ' || i || ': ' || x) AS still FROM a)
SELECT conv_id, turn, md5(array_to_string(list_concat(
   CASE WHEN turn > 0 AND len(f) > 0 THEN list_concat(still[1:len(f) - 1], ['Update (' || role || '):', lines_out[len(f)]]) ELSE lines_out END,
   CASE WHEN note <> '' THEN [note] ELSE [] END), chr(10))) AS text_md5 FROM b"""

_HARD = "regexp_extract_all(line, '[A-Z][a-z]+|[0-9]+')"
ORACLE["hard_term_containment"] = f"""
WITH l0 AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
l AS (SELECT conv_id, turn, i - 1 AS n, list_distinct(regexp_extract_all(l[i], '[A-Z][a-z]+|[0-9]+')) AS need FROM l0, unnest(range(1, len(l) + 1)) AS u(i)),
t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+|[0-9]+')) AS have FROM conversations)
SELECT l.conv_id, l.turn, l.n::INTEGER AS n, len(need)::INTEGER AS n_terms, count(t.turn) AS n_turns
FROM l LEFT JOIN t ON t.conv_id = l.conv_id AND list_has_all(have, need) WHERE len(need) > 0 GROUP BY ALL"""


# ------------------------------------------------------------------ training rows of the gate
_Q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_SAID = ", ".join(f"({_Q(k.name)}, {_Q(k.label)}, {_Q(k.before)}, {len(k.sentences)}, {i}, {_Q(x)})" for k in gate_store.KINDS for i, x in enumerate(k.sentences))
_DIGEST = "('0x' || substr(md5({}), 1, 7))::INTEGER"
ORACLE["gate_training_rows"] = w(TOKENS + f""",
r AS (SELECT list(term ORDER BY df, term)[1:4] AS r FROM post JOIN idf USING (term) WHERE regexp_full_match(term, '[a-z]{{4,}}')
      GROUP BY chunk_id HAVING count(*) >= 4),
tp AS (SELECT DISTINCT r[1] || ' ' || r[2] AS topic, r[3] || ' ' || r[4] AS other FROM r),
said(kind, label, before, n, i, sentence) AS (VALUES {_SAID}),
f AS (SELECT *, {_DIGEST.format("topic || '/' || other || '/' || kind")} AS h FROM tp, said)""", f"""
SELECT topic, kind, replace(replace(replace(replace(replace(sentence, '{{t}}', topic), '{{u}}', other), '{{n}}', (h % 97 + 13)::VARCHAR),
       '{{m}}', (h % 9 + 3)::VARCHAR), '{{k}}', ['two', 'three', '2', '3'][h % 4 + 1]) AS text, before IS NOT NULL AS has_prev,
       CASE before WHEN 'topic' THEN topic WHEN 'other' THEN other ELSE '' END AS prev_topic, label,
       {_DIGEST.format('topic')} % 5 = 0 AS held_out
FROM f WHERE i = h % n""")
