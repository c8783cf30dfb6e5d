"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into ``SHARDS`` shards that are scanned in a cycle.  A scan counts phrases of all lengths that are active.  Words are active from the
first scan; a longer phrase becomes active at the end of the scan after which both its subphrases (without the last and without the
first word) have reached the threshold, and it is counted for exactly one full cycle from there, so its count is exact while
other lengths are still being counted.  The scans end when nothing is active and nothing can become so: at most four cycles.

Whether a phrase has reached the threshold is decided exactly when its cycle ends; before, a lower bound of its count activates
longer phrases earlier.

Shards are tables of blocks: a block lists its distinct words and holds its texts as positions in that list, so texts are split once and a scan reads
numbers.  In a scan each block adds up its equal phrases, by their 64-bit hash, before anything leaves it; these rows are appended to a table and the
sums of the current cycle are taken by Spark's aggregation.  Hashes that reach the threshold set two bits each in a last table, and one more pass over the
blocks takes the phrases of these bits with their texts: their words are compared there and Spark sums them by text, so a shared hash or bit costs
work and changes no count, and rows with texts are only those of found phrases.

Which phrases have reached the threshold, and when, is kept in a table of ``2 ** CELL_BITS`` bytes: a phrase sets two cells (by its 64-bit hash)
to the number of the scan unless they hold an earlier one, and it has reached it since the later of its two cells.  Cells are set once, so each
block sees the same start of a phrase at every scan.  A cell that two phrases share can only activate a phrase too early: it is then counted for
nothing, or over another full cycle with the same result.  So the table's size is fixed (it is what the driver holds and broadcasts), its
errors cost work and never change a count, and no list of phrases is collected.

Scores are exact: products are decimals.  Cuts meet the counts of their parts in joins that adaptive execution can split; the first rows per language are
found per language and salt before they meet.

Defined cases: a null language is ``und``; a null text is empty; pieces end at the text's end too; a phrase repeated in one text counts each time,
overlaps included; repeated rows count each; other columns, whatever their names, are not read; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import broadcast_if_small, top_per_key
from .blocks import pack_units, unpack_units
from .common import pack, stage, unpack

THRESHOLD = 30
LONGEST = 4
SHARDS = 3
TOP = 2000
BLOCK_WORDS = 2_000_000
CELL_BITS = 25
NEVER = 255                     # more scans than there can be
SALTS = 32
OUT_ROWS = 50_000
LIKELY_BITS = 16, 29            # of the table of found phrases: 64 MB at most

_UPPER = bytes(range(0x41, 0x5B))
TABLE = bytes.maketrans(_UPPER + b".,;:!?\x0a\x0b\x0c\x0d\x09", _UPPER.lower() + b"\n" * 10 + b" ")
COUNTED = "until int, known boolean, words byte, hash long, n long"
NAMED = "lang string, phrase binary, words byte, n long"
BLOCKS = "shard int, langs array<string>, sizes array<int>, totals array<long>, words binary, codes binary"


def pieces(text: bytes) -> list[bytes]:
    """The words, and b"\\n" where a piece ends."""
    return [*text.translate(TABLE).replace(b"\n", b" \n ").replace(b"  ", b" ").strip(b" ").split(b" "), b"\n"]


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Words of texts by language: codes are positions in the language's dictionary until the block is cut."""

    def __init__(self) -> None:
        self.words: dict[str, _Codes] = {}
        self.parts: list[tuple[str, np.ndarray]] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        seen = self.words.setdefault(lang, _Codes({b"\n": 0, b"": 1}))
        w = pieces(text)
        codes = np.fromiter(map(seen.__getitem__, w), np.uint32, len(w))
        self.parts.append((lang, codes[codes != 1]))             # 1: nothing between two blanks
        self.size += len(w)

    def row(self, shard: int) -> dict:
        """Code 0 ends a piece; the words of the languages follow each other from code 1 on."""
        langs = list(self.words)
        base, first = 0, {}
        for g in langs:
            first[g] = base
            base += len(self.words[g]) - 2                       # codes of a dictionary start at 2, after the two marks
        codes = np.concatenate([np.where(c == 0, 0, c + first[g] - 1).astype(np.uint32) for g, c in self.parts])
        totals = dict.fromkeys(langs, 0)
        for g, c in self.parts:
            totals[g] += int(np.count_nonzero(c))
        return {"shard": shard, "langs": langs, "sizes": [len(self.words[g]) - 2 for g in langs], "totals": [totals[g] for g in langs],
                "words": pack_units([x for g in langs for x in list(self.words[g])[2:]]), "codes": pack(codes)}


_BLOCKS = pa.schema([("shard", pa.int32()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("totals", pa.list_(pa.int64())),
                     ("words", pa.binary()), ("codes", pa.binary())])


def _cut(shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, shard = _Block(), TaskContext.get().partitionId() % shards
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                block.add(lang, text.as_py() or b"")
                if block.size >= most:
                    yield pa.RecordBatch.from_pylist([block.row(shard)], _BLOCKS)
                    block, shard = _Block(), (shard + 1) % shards
        if block.size:
            yield pa.RecordBatch.from_pylist([block.row(shard)], _BLOCKS)
    return run


def blocks(docs: DataFrame, shards: int = SHARDS, most: int = BLOCK_WORDS) -> DataFrame:
    """The shards of ``docs``.  A task deals its documents into them in turn, so all have the same share of every file."""
    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return stage(dealt.mapInArrow(_cut(shards, most), BLOCKS), "shards", "shard")


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _since(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The scan after which the phrases of these hashes had reached the threshold, or ``NEVER``."""
    mask = np.uint64(len(cells) - 1)
    return np.maximum(cells[h & mask], cells[(h >> np.uint64(32)) & mask])


def _opened(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, the language and the hash of each, and its codes."""
    units, codes = unpack_units(row["words"]), unpack(row["codes"])
    lang_of = np.repeat(np.arange(len(row["langs"])), row["sizes"])
    seeds = [xxhash.xxh64_intdigest(g.encode()) for g in row["langs"]]
    return units, lang_of, np.fromiter((xxhash.xxh64_intdigest(w, seeds[g]) for w, g in zip(units, lang_of.tolist())), np.uint64, len(units)), codes


def _longer(h: np.ndarray, word_hash: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
    """The hashes of the runs of ``length`` words from those of the runs that are a word shorter."""
    return _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ word_hash[codes[length - 1:]])


def _hashes(length: int, until: int, h: np.ndarray, n: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = _since(cells, h) < NEVER
    for i in range(0, len(h), OUT_ROWS):
        k = len(h[i:i + OUT_ROWS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, until, np.int32)), pa.array(known[i:i + OUT_ROWS]), pa.array(np.full(k, length, np.int8)),
             pa.array(h[i:i + OUT_ROWS].view(np.int64)), pa.array(n[i:i + OUT_ROWS].astype(np.int64))], ["until", "known", "words", "hash", "n"])


def _block_counts(row: dict, scan: int, cells: np.ndarray, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """What scan number ``scan`` (from 0) counts in a block, by hash."""
    units, _, hash_of, codes = _opened(row)
    if not units:
        return
    if scan < shards:                                            # words: active from the start
        yield from _hashes(1, shards - 1, hash_of, np.bincount(codes, minlength=len(units) + 1)[1:], cells)
    if scan == 0:
        return
    word_hash = np.concatenate([np.zeros(1, np.uint64), hash_of])
    h = word_hash[codes]
    since = np.concatenate([np.full(1, NEVER, np.uint8), _since(cells, hash_of)])[codes]
    for length in range(2, longest + 1):
        if len(since) < 2:
            return
        start = np.maximum(since[:-1], since[1:])
        h = _longer(h, word_hash, codes, length)
        since = np.where(start < NEVER, _since(cells, h), NEVER).astype(np.uint8)
        for s in range(max(0, scan - shards), scan):             # all places of a phrase have the same start
            same = np.sort(h[start == s])
            if len(same):
                first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
                yield from _hashes(length, s + shards, same[first], np.diff(np.r_[first, len(same)]), cells)


def _block_phrases(row: dict, likely: np.ndarray, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a block whose two bits are set in ``likely``, with their counts; a phrase may come in several rows."""
    units, lang_of, hash_of, codes = _opened(row)
    if not units:
        return
    words, langs, mask = pa.array(units, pa.binary()), pa.array(row["langs"], pa.string()), np.uint64((1 << bits) - 1)
    held = lambda x: likely[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & np.uint8(1)
    word_hash = np.concatenate([np.zeros(1, np.uint64), hash_of])
    h, inside = word_hash[codes], codes != 0
    low = np.uint64((1 << len(codes).bit_length()) - 1)          # the bits that a place takes
    for length in range(1, longest + 1):
        if length > 1:
            if len(h) < 2:
                return
            h, inside = _longer(h, word_hash, codes, length), inside[:-1] & inside[1:]
        at = np.flatnonzero(inside)
        at = at[(held(h[at] & mask) & held(h[at] >> np.uint64(32) & mask)).astype(bool)]
        if not len(at):
            continue
        p = np.sort(h[at] & ~low | at.astype(np.uint64))         # equal phrases meet by the high bits of their hash; their words decide
        cut = (p[1:] ^ p[:-1]) > low
        p = (p & low).astype(np.int64)
        for t in range(length):
            w = codes[p + t]
            cut |= w[1:] != w[:-1]
        first = np.flatnonzero(np.r_[True, cut])
        n, p = np.diff(np.r_[first, len(p)]), p[first]
        for i in range(0, len(p), OUT_ROWS):
            q = p[i:i + OUT_ROWS]
            text = words.take(pa.array(codes[q].astype(np.int64) - 1))
            if length > 1:
                text = pc.binary_join_element_wise(text, *(words.take(pa.array(codes[q + t].astype(np.int64) - 1)) for t in range(1, length)), pa.scalar(b" ", words.type))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang_of[codes[q].astype(np.int64) - 1])), text, pa.array(np.full(len(q), length, np.int8)),
                                              pa.array(n[i:i + OUT_ROWS].astype(np.int64))], ["lang", "phrase", "words", "n"])


def _over(shard: DataFrame, table, kernel, schema: str) -> DataFrame:
    """``kernel(block row, table)`` for each block; ``table`` is broadcast and compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(zstandard.ZstdDecompressor().decompress(table.value), np.uint8)
        for b in batches:
            for i in range(b.num_rows):
                yield from kernel(b.slice(i, 1).to_pylist()[0], held)
        pa.default_memory_pool().release_unused()
    return shard.select("langs", "sizes", "words", "codes").mapInArrow(run, schema)


def _sent(spark, table: np.ndarray):
    return spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(table.tobytes()))     # what is not set takes next to nothing


def _reached(tables: list[DataFrame], scan: int, threshold: int, longest: int) -> DataFrame:
    """(hash, done, cells): phrases that have reached the threshold after a scan, by the 64-bit hash of the phrase.

    Phrases whose cycle ends with this scan (``done``) are summed over all their rows.  Of the others only rows of two occurrences
    and more are summed, a lower bound: most rows say "once", and a phrase that needs those waits for the end of its cycle.
    """
    open_ = None
    for t in tables:
        row = t.filter((F.col("until") == scan) | ((F.col("until") > scan) & (F.col("n") > 1) & ~F.col("known") & (F.col("words") < longest)))
        row = row.select("hash", "n", (F.col("until") == scan).alias("done"), (F.col("words") < longest).alias("short"))
        open_ = row if open_ is None else open_.unionByName(row)
    return (open_.groupBy("hash").agg(F.sum("n").alias("n"), F.max("done").alias("done"), F.max("short").alias("short"))
            .filter(F.col("n") >= threshold).drop("n"))


def _bitmap(hashes: DataFrame, bits: int) -> list:
    """The cells of ``hashes(hash)`` as bitmaps of 32,768 cells: as many rows as the table has such parts, at most."""
    mask = (1 << bits) - 1
    cell = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(mask)))).alias("c"))
    return (cell.groupBy(F.shiftright("c", 15).alias("part")).agg(F.expr("bitmap_construct_agg(c & 32767)").alias("bits"))).collect()


def counts(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, most: int = BLOCK_WORDS,
           bits: int = CELL_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of the phrases of 1 to ``longest`` words that occur ``threshold`` times or more; and (lang, n), the words of each language."""
    spark = docs.sparkSession
    dealt = blocks(docs, shards, most)
    cells = np.full(1 << bits, NEVER, np.uint8)
    tables: list[DataFrame] = []
    likely = None
    scan, last = 0, shards - 1                                   # ``last``: the scan after which nothing is active
    while scan <= last:
        sent = _sent(spark, cells)
        count = partial(_count, scan=scan, shards=shards, longest=longest)
        tables.append(stage(_over(dealt.filter(F.col("shard") == scan % shards), sent, count, COUNTED), "counted"))
        sent.destroy()                                           # the counts are written
        reached = stage(_reached(tables[-shards:], scan, threshold, longest), "reached")
        done = reached.filter("done").select("hash")
        likely = done if likely is None else likely.unionByName(done)
        for r in _bitmap(reached.filter("short"), bits):
            part = cells[r["part"] << 15:(r["part"] + 1) << 15]
            new = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[:len(part)].astype(bool) & (part == NEVER)
            if new.any():
                part[new] = scan
                last = scan + shards
        scan += 1
    likely_bits = min(max(LIKELY_BITS[0], (16 * likely.count()).bit_length()), LIKELY_BITS[1])
    held = np.zeros(1 << likely_bits - 3, np.uint8)
    for r in _bitmap(likely, likely_bits):
        held[r["part"] << 12:(r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    sent = _sent(spark, held)
    named = _over(dealt, sent, partial(_name, bits=likely_bits, longest=longest), NAMED)
    exact = named.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("words").alias("words")).filter(F.col("n") >= threshold)
    words = dealt.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    found = stage(exact.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "n"), "phrases")
    sent.destroy()
    return found, stage(words.filter("n > 0"), "langs")


def _count(row: dict, cells: np.ndarray, scan: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    return _block_counts(row, scan, cells, shards, longest)


def _name(row: dict, likely: np.ndarray, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    return _block_phrases(row, likely, bits, longest)


def _parts(width: int) -> F.Column:
    """All shorter runs of two words or more in a phrase of ``width`` words."""
    return F.array(*(F.array_join(F.slice("w", i + 1, n), " ") for n in range(2, width) for i in range(width - n + 1)))


def mine(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    found, total = counts(docs, threshold, longest, **how)
    size = 64 * found.count()
    part = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("n_part"))
    cand = found.filter("words >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    # The longest count of a longer phrase around each candidate.
    longer = None
    for width in range(3, longest + 1):
        x = cand.filter(F.size("w") == width).select("lang", F.explode(F.array_distinct(_parts(width))).alias("phrase"), "a")
        longer = x if longer is None else longer.unionByName(x)
    if longer is not None:
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        cand = cand.join(longer, ["lang", "phrase"], "left")
        wide = F.lit(100).cast("decimal(20,0)") * F.col("around"), F.lit(80).cast("decimal(20,0)") * F.col("a")
        cand = cand.filter(F.col("around").isNull() | (wide[0] < wide[1])).drop("around")
    cuts = cand.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
                       F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("tail"))
    for side, n in (("head", "l"), ("tail", "r")):
        known = broadcast_if_small(part.select("lang", F.col("part").alias(side), F.col("n_part").alias(n)), size)
        cuts = cuts.join(known, ["lang", side])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (l + r)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = top_per_key(best, ["lang", "salt"], order, top, "place").drop("place", "salt")
    ranked = top_per_key(first, "lang", order, top)
    return (ranked.join(F.broadcast(total), "lang")                                          # one row a language
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
