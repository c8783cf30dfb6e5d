"""Text functions as Spark columns.  Everything here but ``windows`` and ``content_lists`` stays inside the JVM.

Each function takes a column name or a SQL expression, and has a ``*_sql`` twin that returns the
expression as text, so that long expressions reach the JVM in one call.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import STOPWORDS, SYNONYMS

# white space as the str methods of Python see it
WS = r"[\s\x0B\x1C-\x1F\u0085   -     　]+"
TOKEN = r"[a-z0-9]+(?:[.,][0-9]+)*"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
CONTRACTION = r"(?<=[a-z])['’](s|re|ll|d|ve|m)(?![\p{L}\p{N}_])"
EMPTY = "CAST(array() AS ARRAY<STRING>)"


def raw_string(pattern: str) -> str:
    """SQL literal of a pattern, backslashes kept."""
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze_ends_sql(x: str) -> str:
    return f"regexp_replace({x}, {raw_string('^' + WS + '|' + WS + '$')}, '')"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {raw_string(WS)}, ' '))"


def words_sql(x: str) -> str:
    return f"filter(split({squeeze_sql(x)}, ' '), w -> w <> '')"


def has_words_sql(x: str) -> str:
    """Whether ``words_sql`` finds any: a character that is no white space."""
    return f"{x} RLIKE {raw_string('[^' + WS[1:-1])}"


def raw_tokens_sql(x: str) -> str:
    low = f"replace(replace(replace(lower({x}), '§', ' section '), r\"n't\", ' not'), 'n’t', ' not')"
    found = f"regexp_extract_all(regexp_replace({low}, {raw_string(CONTRACTION)}, ''), {raw_string(TOKEN)}, 0)"
    # inside a token a comma only ever joins digits, and "2,00,000" is one numeral
    return (f"transform({found}, t -> IF(t RLIKE {raw_string('^[0-9][0-9,]*[0-9]$')}, replace(t, ',', ''), t))")


def stopword_sql(t: str) -> str:
    return f"{t} IN ({', '.join(repr(w) for w in STOPWORDS)})"


def stem_sql(t: str) -> str:
    """Suffix stripper for one token: the first suffix that fits decides."""
    def cut(k: int) -> str:
        return f"left({t}, length({t}) - {k})"

    def undouble(k: int) -> str:
        b = cut(k)
        doubled = f"length({b}) > 3 AND {b} RLIKE r'([^lsz])\\1$'"
        return f"IF({doubled}, {cut(k + 1)}, {b})"

    def fits(suffix: str, shortest: int) -> str:
        return f"endswith({t}, '{suffix}') AND length({t}) >= {shortest}"

    base = f"""CASE WHEN {fits('ies', 6)} THEN concat({cut(3)}, 'y')
        WHEN {fits('sses', 7)} THEN {cut(2)}
        WHEN {fits('ing', 6)} THEN {undouble(3)}
        WHEN {fits('ed', 5)} THEN {undouble(2)}
        WHEN {fits('es', 5)} AND {t} RLIKE r'(s|x|z|ch|sh)es$' THEN {cut(2)}
        WHEN {fits('s', 4)} AND NOT {t} RLIKE r'(ss|us|is)$' THEN {cut(1)}
        ELSE {t} END"""
    return f"""IF(length({t}) <= 3 OR {t} RLIKE r'^[0-9]+$', {t},
        regexp_replace({base}, r'^(.{{4,}})e$', '$1'))"""


def content_tokens_sql(x: str) -> str:
    return f"transform(filter({raw_tokens_sql(x)}, t -> NOT {stopword_sql('t')}), t -> {stem_sql('t')})"


def numbers_sql(x: str) -> str:
    found = f"regexp_extract_all({x}, {raw_string(NUMBER)}, 0)"
    return f"array_distinct(transform({found}, n -> replace(n, ',', '')))"


def squeeze_ends(x: str) -> Column:
    """Trim white space at both ends."""
    return F.expr(squeeze_ends_sql(x))


def squeeze(x: str) -> Column:
    """Collapse white space and trim."""
    return F.expr(squeeze_sql(x))


def words(x: str) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.expr(words_sql(x))


def raw_tokens(x: str) -> Column:
    """Lower-cased alphanumeric tokens; numerals lose their thousands commas."""
    return F.expr(raw_tokens_sql(x))


def is_stopword(x: str) -> Column:
    return F.expr(stopword_sql(x))


def stem(x: str) -> Column:
    return F.expr(stem_sql(x))


def content_tokens(x: str) -> Column:
    """Stop-word-free stemmed tokens, in order, duplicates kept."""
    return F.expr(content_tokens_sql(x))


def numbers_in(x: str) -> Column:
    """Distinct numerals without commas, in order of first appearance."""
    return F.expr(numbers_sql(x))


# ------------------------------------------------------------------ stems of single words
def _undouble(b: str) -> str:
    return b[:-1] if len(b) > 3 and b[-1] == b[-2] and b[-1] not in "lsz" else b


def stem_word(w: str) -> str:
    """Stem of one word, for the constant lists below and the batch helpers (``stem`` is the column form)."""
    n = len(w)
    if n <= 3 or w.isdigit():
        return w
    base = w
    if w.endswith("ies") and n >= 6:
        base = w[:-3] + "y"
    elif w.endswith("sses") and n >= 7:
        base = w[:-2]
    elif w.endswith("ing") and n >= 6:
        base = _undouble(w[:-3])
    elif w.endswith("ed") and n >= 5:
        base = _undouble(w[:-2])
    elif w.endswith("es") and n >= 5 and (w[-3] in "sxz" or w[-4:-2] in ("ch", "sh")):
        base = w[:-2]
    elif w.endswith("s") and w[-2] not in "sui":
        base = w[:-1]
    return base[:-1] if len(base) > 4 and base[-1] == "e" else base


# ------------------------------------------------------------------ tokens of whole tables (small Python helper)
_FIND_TOKENS = re.compile(TOKEN).findall
_CONTRACTION = re.compile(CONTRACTION.replace(r"[\p{L}\p{N}_]", r"\w"))
_STOP = frozenset(STOPWORDS)


def _raw(text: str | None) -> list[str]:
    """``raw_tokens`` of one text, numerals still with their commas."""
    if not text:
        return []
    low = text.lower().replace("§", " section ").replace("n't", " not").replace("n’t", " not")
    if "'" in low or "’" in low:
        low = _CONTRACTION.sub("", low)
    return _FIND_TOKENS(low)


def _numeral(word: str) -> str:
    plain = word.replace(",", "")
    return plain if plain.isdigit() else word


def _content(word: str) -> str | None:
    word = _numeral(word)
    return None if word in _STOP else stem_word(word)


def content_lists(texts: pa.Array) -> pa.ListArray:
    """``content_tokens`` of a batch of texts; a null text has none.  Each distinct word is stemmed once a batch."""
    found = [_raw(t) for t in texts.to_pylist()]
    words = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    stems = pa.array([_content(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    kept = stems.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.fromiter((len(f) for f in found), np.int64, len(found)))
    offsets = np.r_[0, np.r_[0, np.cumsum(kept)][ends]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), stems.drop_null())


def word_counts(df: DataFrame, x: str) -> DataFrame:
    """(word, n): how often each of the ``raw_tokens`` of a text column occurs, counted a batch at a time before words are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array(list(chain.from_iterable(_raw(t) for t in b.column(0).to_pylist())), pa.string()).dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([_numeral(w) for w in words.dictionary.to_pylist()], pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return df.select(x).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def synonym_map_sql() -> str:
    """map(stemmed word -> stemmed written terms)."""
    pairs = []
    for k, vs in SYNONYMS.items():
        values = ", ".join(repr(stem_word(v)) for v in vs.split())
        pairs.append(f"{stem_word(k)!r}, array({values})")
    return f"map({', '.join(pairs)})"


def synonyms_sql(term: str) -> str:
    return f"coalesce(try_element_at({synonym_map_sql()}, {term}), {EMPTY})"


def expand_terms(tokens: str) -> Column:
    """Append one hop of synonyms, keep the first occurrence of every term added."""
    extra = f"flatten(transform({tokens}, t -> {synonyms_sql('t')}))"
    return F.expr(f"concat({tokens}, array_except({extra}, {tokens}))")


def mentions(term: str, tokens: str) -> Column:
    """A term occurs, or a synonym does, or (from five letters on) one is a prefix of the other."""
    prefix = f"exists({tokens}, t -> startswith(t, {term}) OR (length(t) >= 5 AND startswith({term}, t)))"
    return F.expr(f"array_contains({tokens}, {term}) OR arrays_overlap({tokens}, {synonyms_sql(term)}) "
                  f"OR (length({term}) >= 5 AND {prefix})")


# ------------------------------------------------------------------ units and windows
BULLET = r"^([-*+]|[0-9]+[.)])\s+"
TABLE_RULE = r"^\|?[\s:|-]+\|?$"
CELL_RULE = r"^:?-{2,}:?$"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9\x22'(])"


def sentence_units_sql(x: str) -> str:
    lines = (f"filter(transform(split(block, r'\\R'), l -> {squeeze_ends_sql('l')}), l -> l <> '')")
    # the row above a table rule is a header
    body = (f"filter(lines, (l, i) -> NOT (startswith(l, '|') AND coalesce(get(lines, i + 1) RLIKE "
            f"{raw_string(TABLE_RULE)}, false)))")
    cells = (r"filter(transform(split(regexp_replace(l, r'^\|+|\|+$', ''), r'\|'), c -> trim(c)), c -> c <> '')")

    def sentences(para: str) -> str:
        return f"IF(size({para}) > 0, split(array_join({para}, ' '), {raw_string(SENTENCE_GAP)}), {EMPTY})"

    row = (f"IF(forall({cells}, c -> c RLIKE {raw_string(CELL_RULE)}), {EMPTY}, array(array_join({cells}, ' - ')))")
    bullet = f"l RLIKE {raw_string(BULLET)}"
    step = f"""CASE WHEN {bullet} THEN named_struct(
                   'units', concat(acc.units, {sentences('acc.para')}, array(regexp_replace(l, {raw_string(BULLET)}, ''))),
                   'para', {EMPTY})
               WHEN startswith(l, '|') THEN named_struct('units', concat(acc.units, {row}), 'para', acc.para)
               ELSE named_struct('units', acc.units, 'para', concat(acc.para, array(l))) END"""
    fold = f"""aggregate({body}, named_struct('units', {EMPTY}, 'para', {EMPTY}), (acc, l) -> {step},
               acc -> concat(acc.units, {sentences('acc.para')}))"""
    # one binding per block: the lines are used twice
    per_block = f"flatten(transform(array({lines}), lines -> {fold}))"
    units = f"flatten(transform(split({x}, r'\\n\\s*\\n'), block -> {per_block}))"
    return f"filter(transform({units}, u -> {squeeze_sql('u')}), u -> size(split(u, ' ')) >= 3)"


def sentence_units(x: str) -> Column:
    """Answer-sized units of a section body: bullets, table rows and sentences of at least three words.

    Each blank-line block is folded line by line; a bullet closes the running paragraph, a table
    row does not.
    """
    return F.expr(sentence_units_sql(x))


def windows_sql(x: str, size: int) -> str:
    """array<struct<section, section_title, text>>: consecutive runs of ``size`` words."""
    starts = f"IF(size(w) > 0, sequence(0, size(w) - 1, {size}), CAST(array() AS ARRAY<INT>))"
    part = (f"transform({starts}, (s, i) -> named_struct('section', i + 1, 'section_title', concat('Part ', i + 1), "
            f"'text', array_join(slice(w, s + 1, {size}), ' ')))")
    return f"flatten(transform(array({words_sql(x)}), w -> {part}))"


def windows(x: str, size: int) -> Column:
    """The same as ``windows_sql`` for whole tables: a small Python helper splits and joins, whose white space is ``WS``."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        words = [[] if t is None else t.split() for t in texts]
        return pd.Series([[" ".join(w[k:k + size]) for k in range(0, len(w), size)] for w in words], dtype=object)
    return F.transform(cut(_c(x)), lambda t, i: F.struct((i + 1).alias("section"), F.concat(F.lit("Part "), i + 1).alias("section_title"), t.alias("text")))
