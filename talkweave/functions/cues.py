"""Cue patterns and request clean-up as SQL expressions (case-insensitive, Unicode word classes)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import EMPTY, raw_string


def has(x: str, pattern: str) -> str:
    return f"({x} RLIKE {raw_string('(?iU)' + pattern)})"


def sub(x: str, pattern: str, to: str = "''", flags: str = "(?iU)") -> str:
    return f"regexp_replace({x}, {raw_string(flags + pattern)}, {to})"


def chain(x: str, *steps) -> str:
    for pattern, to in steps:
        x = sub(x, pattern, to)
    return x


def flag(x: str, pattern: str) -> Column:
    return F.expr(has(x, pattern))


def strip_chars(x: str, chars: str) -> str:
    return f"regexp_replace({x}, {raw_string(f'^[{chars}]+|[{chars}]+$')}, '')"


def anaphoric(x: str) -> str:
    return has(sub(x, V.EXISTENTIAL, "' '"), V.ANAPHORA)


def clean_request(x: str) -> str:
    """Request without preamble, planning verb, leading article and empty ending."""
    t = strip_chars(f"trim({sub(f'trim({x})', V.PREAMBLE)})", r" ,?.")
    t = chain(t, (V.PLAN_VERB_START, "''"), (V.ARTICLE_START, "''"), (V.APPROX_BEFORE_NUMBER, "'$2'"),
              (V.EMPTY_ENDING, "''"))
    return f"coalesce(nullif(trim({t}), ''), {strip_chars(f'trim({x})', ' ,?.')})"


def label(x: str) -> Column:
    """Short intent label of at most seven words."""
    wh = rf"\b{V.LABEL_WH}\b"
    head = f"regexp_extract(t, {raw_string('(?iU)^(.+?)(?=' + wh + ')')}, 1)"
    # a short lead before the question word is cut off
    t = f"IF({head} <> '' AND size(split(trim({head}), r'\\s+')) <= 6, substring(t, length({head}) + 1), t)"
    t = chain(t, (rf"^{V.LABEL_WH}\s+((the|a|an|any|my|our)\s+)?", "''"), (V.LABEL_AUX_START, "''"))
    short = chain("t", (V.LABEL_AUX_TAIL, "''"), (V.LABEL_MODAL_TAIL, "''"))
    cut = f"IF(trim({short}) <> '', {short}, t)"
    tail = f"trim({sub('trim(t)', V.LABEL_PREP_TAIL)})"
    dangling = ", ".join(repr(w) for w in V.DANGLING)
    seven = (f"aggregate(reverse(slice(w, 1, 7)), {EMPTY}, (acc, x) -> "
             f"IF(size(acc) = 0 AND lower(x) IN ({dangling}), acc, concat(array(x), acc)))")
    short_words = f"array_join(IF(size(w) > 7, {seven}, w), ' ')"
    capital = "concat(upper(left(t, 1)), substring(t, 2))"

    def let(value: str, body: str, name: str = "t") -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    words = "filter(split(t, r'\\s+'), x -> x <> '')"
    expr = let(clean_request(x), let(t, let(cut, let(tail, let(words, let(short_words, f"IF(t <> '', {capital}, {x})"),
                                                               "w")))))
    return F.expr(expr)


def answer_type(x: str) -> Column:
    """currency | duration | number | null: the figure a quantity question asks for."""
    return F.expr(f"CASE WHEN NOT {has(x, V.QUANTITY_QUESTION)} THEN NULL WHEN {has(x, V.DURATION_QUESTION)} "
                  f"THEN 'duration' WHEN {has(x, V.MONEY_QUESTION)} THEN 'currency' ELSE 'number' END")


def satisfies(kind: str, x: str) -> Column:
    return F.expr(f"CASE WHEN {kind} IS NULL THEN true WHEN {kind} = 'currency' THEN {has(x, V.CURRENCY)} "
                  f"WHEN {kind} = 'duration' THEN {has(x, V.DURATION)} ELSE {x} RLIKE '[0-9]' END")


def spoken_count(x: str) -> Column:
    """Number named before bullets, points, lines and the like."""
    named = "|".join(V.COUNT_WORDS)
    pattern = rf"\b(\d+|{named})\s+(?:\w+\s+)?({V.COUNT_NOUNS})\b"
    word = f"regexp_extract(lower({x}), {raw_string(pattern)}, 1)"
    table = ", ".join(f"'{k}', {v}" for k, v in V.COUNT_WORDS.items())
    return F.expr(f"coalesce(try_cast({word} AS INT), try_element_at(map({table}), {word}))")


def ends_dangling(x: str, tokens: str) -> str:
    dangling = ", ".join(repr(w) for w in V.DANGLING)
    return (f"(size({tokens}) = 0 OR element_at({tokens}, -1) IN ({dangling}) "
            f"OR {x} RLIKE r'[-,]\\s*$')")
