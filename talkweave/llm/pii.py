"""Surrogates for personal data: every detected entity is replaced by a made-up one of its kind and shape.

``detect`` finds mail addresses, telephone numbers, IPv4 addresses, card-like and other long numbers, secrets in assignments, and names after a
title (``Mr``, ``Frau``, ...).  ``replace`` gives each distinct entity of the corpus one surrogate, so what referred to one thing still does, and
different entities keep different surrogates.

A surrogate is made with a keyed hash (BLAKE2b) of kind, canonical entity and attempt, and keeps what is checked by type: digits stay digits and
separators stay, an international number keeps its country code; a number that passes the Luhn test gets a surrogate that does; parts of an IPv4 address stay in range; letters keep case and script
(Latin, Greek, Cyrillic, and others by their own block); hexadecimal secrets stay hexadecimal; names take the gender that the
title says, from a list of their script, and letters of that script are appended, more with every second attempt, when the list is used up.

Collisions are found by joins over the table of distinct entities: two entities with one surrogate, or a surrogate that is an entity of the corpus.  The
entities that lose try again with the next attempt until none is left.  Entities are grouped before they are shuffled, so one that
fills a third of the corpus is one row per task.  A surrogate follows from key, entity and attempt, so texts only need the few entities
that needed more than one attempt: a measured small table goes to the tasks and texts stay where they are; beyond
``SMALL`` rows the spans of each row are joined to it instead.

Defined cases: null stays null, empty stays empty; a text of any length is read whole; equal entities, also of different rows, get the same surrogate;
forms that differ in case only (mails, names) are one entity and keep their own case; telephone and other numbers are one entity when their digits (and a
leading plus) are equal, and each keeps its own separators; a capitalised name that a title introduces is replaced without its title too, anywhere in that
text (where titles of both genders introduce it, the last one before it counts); other columns are kept, whatever their names.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

ATTEMPTS = 64
LISTED = 9                   # attempts that give a name from the list as it is; later ones append two more letters every two attempts
SMALL = 200_000              # entities with later attempts (some 100 bytes each) that may be sent to the tasks
# Kinds of entities in order of precedence, with their patterns.
PATTERNS = (
    ("secret", r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[:=]\s*[\"']?)([A-Za-z0-9+/_\-]{12,})"),
    ("mail", r"([^\W_][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"),
    ("ipv4", r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3})(?![\d.]*\d)"),
    ("phone", r"(?<![\w])(\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d[\d .\-]{5,13}\d|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)"),
    ("number", r"(?<![\w.])(\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{13,19})(?!\w)"),
    ("name", r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|M|Sr|Sra|Señor|Señora|Madame|Monsieur|г-н|г-жа)\b\.? ((?:[^\W\d_][^\W\d_'\-]+)(?: [^\W\d_a-zа-яα-ω][^\W\d_'\-]+)?)"),
)
# Titles by gender; the first letter group of a surrogate name by script and gender.
FEMALE = ("mrs", "ms", "miss", "frau", "mme", "sra", "señora", "madame", "г-жа")
NAMES = {("latin", "f"): "Anna Clara Elena Irene Julia Laura Maria Nora Paula Sofia".split(),
         ("latin", "m"): "Adrian Bruno David Emil Felix Hugo Jonas Leo Martin Oscar".split(),
         ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга София".split(),
         ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Олег Павел Роман".split(),
         ("greek", "f"): "Άννα Ελένη Μαρία Σοφία Ειρήνη Δάφνη".split(),
         ("greek", "m"): "Γιώργος Νίκος Πέτρος Ανδρέας Ηλίας Λουκάς".split()}
# The country codes of one and of two digits; all others have three.
CODES = {1: ("1", "7"), 2: ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57",
                            "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_FORMS = {k: re.compile(p) for k, p in PATTERNS}
_WORD = re.compile(r"[^\W\d_]+")
_HINTS = {"secret": re.compile("(?i)token|passw|secret|key"), "mail": re.compile("@"), "ipv4": re.compile(r"\d\."), "phone": re.compile(r"\d[\d).\- ]"),
          "number": re.compile(r"\d{4}"), "name": re.compile(r"M|Fr|Herr|S[re]|г-")}


def script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s in ("latin", "cyrillic", "greek") if name.startswith(s.upper())), "other")


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) of the entities, not overlapping; the key is the canonical form that coreference goes by."""
    out: list[tuple[int, int, str, str]] = []
    for kind, form in _FORMS.items():
        if not text or not _HINTS[kind].search(text):
            continue
        for m in form.finditer(text):
            s, e = m.span(1)
            raw = text[s:e]
            if kind == "ipv4" and any(int(x) > 255 for x in raw.split(".")) or any(s < y and x < e for x, y, _, _ in out):
                continue
            if kind == "name":
                title = text[m.start():s].strip(" .").lower()
                out.append((s, e, kind, ("f " if title in FEMALE else "m ") + raw.casefold()))
            elif kind == "mail":
                out.append((s, e, kind, raw.casefold()))
            else:
                out.append((s, e, kind, _digits(raw) if kind in ("phone", "number") else raw))
    return sorted(out + _untitled(text, out))


def _digits(raw: str) -> str:
    """A number without its separators; a leading plus tells international numbers from others."""
    return ("+" if raw[0] == "+" else "") + re.sub(r"\D", "", raw)


def _untitled(text: str | None, found: list) -> list[tuple[int, int, str, str]]:
    """Further places of the names in ``found`` that stand without a title."""
    titled = sorted((s, e, key) for s, e, kind, key in found if kind == "name" and text[s].isupper())
    if not titled:
        return []
    by: dict[str, list[tuple[int, str]]] = {}
    for s, e, key in titled:
        by.setdefault(text[s:e], []).append((s, key))
    taken = sorted((s, e) for s, e, _, _ in found)
    words, more, i, at = [m.span() for m in _WORD.finditer(text)], [], 0, 0
    while i < len(words):
        hit = next(((words[i][0], words[j - 1][1], j) for j in (i + 2, i + 1)
                    if j <= len(words) and text[words[i][0]:words[j - 1][1]] in by), None)
        i += 1
        if hit is None:
            continue
        s, e, j = hit
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e:
            continue
        places = by[text[s:e]]
        before = bisect_left(places, (s, ""))
        more.append((s, e, "name", places[max(0, before - 1)][1]))
        i = j
    return more


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *of: str):
        self.key, self.of, self.n, self.pool = key[:64], "\0".join(of).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, m: int) -> int:
        while len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.of + self.n.to_bytes(4, "little"), key=self.key).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return x % m


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _letter(c: str, draw: _Stream) -> str:
    s = script(c)
    if s == "other":
        block = ord(c) & ~0xF
        near = [chr(x) for x in range(block, block + 16) if chr(x).isalpha() and chr(x).isupper() == c.isupper()]
        return near[draw.below(len(near))]
    x = ALPHABETS[s][draw.below(len(ALPHABETS[s]))]
    return x.upper() if c.isupper() else x


def _shaped(text: str, draw: _Stream) -> str:
    return "".join(str(draw.below(10)) if c.isdigit() else _letter(c, draw) if c.isalpha() else c for c in text)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of a canonical entity at an attempt."""
    draw = _Stream(key, kind, entity, str(attempt))
    if kind == "mail":
        user, _, host = entity.partition("@")
        more = _shaped("a" * (2 * max(0, (attempt - LISTED + 1) // 2)), draw)       # short users of short hosts run out: the user grows
        return f"{_shaped(user, draw)}{more}@{_shaped(host.rpartition('.')[0], draw)}.example"
    if kind == "ipv4":
        return ".".join(str(draw.below(256)) for _ in range(4))
    if kind == "secret":
        hexes = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", entity) else "0123456789ABCDEF" if re.fullmatch("[0-9A-F]+", entity) else None
        return "".join(hexes[draw.below(16)] for _ in entity) if hexes else _shaped(entity, draw)
    if kind == "name":
        gender, parts = entity[0], entity[2:].split(" ")
        written = script(parts[0][0])
        known = NAMES.get((written, gender))
        first = known[draw.below(len(known))] if known else _shaped(parts[0], draw)
        first += _shaped(ALPHABETS.get(written, parts[0])[0] * (2 * max(0, (attempt - LISTED + 1) // 2)), draw)
        return " ".join([first, *(_shaped(p, draw).capitalize() for p in parts[1:])])
    start = 0                                   # an international number keeps its country code
    if entity[0] == "+":
        start = 1 + next((n for n, codes in CODES.items() if entity[1:1 + n] in codes), 3)
    new = entity[:start] + "".join(str(draw.below(10)) for _ in entity[start:])
    if kind == "number" and luhn(entity):
        new = next(x for x in (new[:-1] + d for d in "0123456789") if luhn(x))
    return new


def in_form(kind: str, old: str, new: str) -> str:
    """The surrogate in the case (mails, names) or with the separators (numbers) of the form that it replaces."""
    if kind in ("phone", "number"):
        digit = iter(new.removeprefix("+"))
        return "".join(next(digit) if c.isdigit() else c for c in old)
    if kind not in ("mail", "name"):
        return new
    return new.upper() if old.isupper() else new.lower() if old.islower() else new


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, e) for t in b.column(0) for _, _, k, e in detect(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())], ["kind", "entity"])


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, surrogate) of the distinct entities of ``found(kind, entity)``; surrogates differ and none is an entity of its kind."""
    @F.arrow_udf("string")
    def make(kind: pa.Array, entity: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kind.to_pylist(), entity.to_pylist(), attempt.to_pylist())], pa.string())

    entities = stage(found.groupBy("kind", "entity").agg(F.count("*").alias("uses")).select("kind", "entity"), "entities")
    real = entities.select(F.col("kind").alias("k"), F.lower(F.when(F.col("kind") == "name", F.substring("entity", 3, 1 << 30)).otherwise(F.col("entity"))).alias("e")).distinct()
    left, done = entities, None
    for attempt in range(ATTEMPTS):
        tried = stage(left.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", make("kind", "entity", "attempt")), "tried")
        low = F.lower("surrogate")
        free = tried.join(real, (F.col("kind") == F.col("k")) & (low == F.col("e")), "left_anti")
        if done is not None:
            taken = done.select(F.col("kind").alias("k"), low.alias("t"))
            free = free.join(taken, (F.col("kind") == F.col("k")) & (low == F.col("t")), "left_anti")
        winner = free.groupBy("kind", low.alias("low")).agg(F.min("entity").alias("entity")).select("kind", "entity")
        won = tried.join(winner, ["kind", "entity"], "left_semi")
        done = stage(won if done is None else done.unionByName(won), "surrogates")
        left = stage(tried.join(done, ["kind", "entity"], "left_anti").select("kind", "entity"), "left")
        if left.isEmpty():
            return done
    raise ValueError("a kind of entity has more members than surrogates")


def swap(text: str | None, key: bytes, later: dict) -> tuple[str | None, list]:
    """The text with surrogates, and (kind, start, end) of each in it; ``later`` has attempts above 0 by (kind, entity)."""
    out, at, size, spans = [], 0, 0, []
    for s, e, kind, entity in detect(text):
        new = in_form(kind, text[s:e], surrogate(key, kind, entity, later.get((kind, entity), 0)))
        out += [text[at:s], new]
        size += s - at
        spans.append((kind, size, size + len(new)))
        size, at = size + len(new), e
    return ("".join([*out, text[at:]]) if out else text), spans


SPANS = "array<struct<kind:string,s:int,e:int>>"
_NEW = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())])))])


def _swapped(texts: pa.Array, key: bytes, later: Iterator[dict]) -> pa.Array:
    done = (swap(t.as_py(), key, x) for t, x in zip(texts, later))
    return pa.array([{"text": t, "spans": [dict(zip(("kind", "s", "e"), x)) for x in spans]} for t, spans in done], _NEW)


def replace(docs: DataFrame, key: bytes, small: int = SMALL) -> DataFrame:
    """(row, spans): the rows of ``docs`` with surrogates in ``text``, and where they stand in the new text."""
    table = surrogates(docs.select("text").mapInArrow(_found, "kind string, entity string"), key)
    late = stage(table.filter("attempt > 0").select("kind", "entity", "attempt"), "late")
    kind = f"struct<text:string,spans:{SPANS}>"
    if late.count() <= small:
        sent = {(r["kind"], r["entity"]): r["attempt"] for r in late.collect()}

        @F.arrow_udf(kind)
        def apply(texts: pa.Array) -> pa.Array:
            return _swapped(texts, key, repeat(sent))

        new = docs.select(F.struct("*").alias("row"), apply("text").alias("new"))
    else:
        rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rows")
        spans = rows.select("rid", "row.text").mapInArrow(_owned, "rid long, kind string, entity string").distinct()
        lists = spans.join(late, ["kind", "entity"]).groupBy("rid").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("late"))

        @F.arrow_udf(kind)
        def apply_own(texts: pa.Array, late: pa.Array) -> pa.Array:
            return _swapped(texts, key, ({(r["kind"], r["entity"]): r["attempt"] for r in x.as_py() or []} for x in late))

        new = rows.join(lists, "rid", "left").select("row", apply_own("row.text", "late").alias("new"))
    return new.select(F.col("row").withField("text", F.col("new.text")).alias("row"), "new.spans")


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r, k, x) for r, t in zip(b.column(0).to_pylist(), b.column(1)) for _, _, k, x in detect(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["rid", "kind", "entity"])
