"""Benchmark decontamination by a positional inverted index of the training text.

``build_index`` cuts the documents into segments of bounded size where they lie (no shuffle) and inverts each: one
row per segment and term with the gaps between the term's positions.  ``find`` takes windows of test words and, within each
segment, intersects the position lists of a window's terms, shifted by their offsets, from the rarest term on.
``slop = 0`` gives exact phrases; a positive ``slop`` gives proximity matches: every term of the window occurs at most
``slop`` words from where the phrase that starts at the rarest term would put it.

Defined cases: a null or empty text has no words and is never hit; a null or wordless item has no window; equal items are
all reported; equal documents, and rows with the same or a null ``doc_id``, are separate rows of the result; other
columns are not read.  A document of any length is one segment of its own if it is longer than a segment.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

WORDS = 13                    # words of a window
SEGMENT_WORDS = 2_000_000     # words after which a segment is closed
SHARE = 20                    # contaminated from one hit word in so many
BLOCK_BYTES = 32 << 20        # test text that is matched in one pass; more is matched block after block
GAP = 64                      # unused positions between documents, so no phrase (or slop below it) spans two

# Bytes of 0-9, a-z and everything from 0x80 stay, A-Z is lowered, all others part words.
_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
               for c in range(256))
POSTINGS = "segment long, kind int, term string, gaps array<int>, ord array<int>, doc_ids array<long>, n_words array<long>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def _segment_rows(segment: int, terms: dict, codes: list, base: list, ids: list, sizes: list) -> Iterator[pa.RecordBatch]:
    """The segment's documents (kind 0) and the postings of its terms (kind 1), in order of the terms."""
    schema = pa.schema([("segment", pa.int64()), ("kind", pa.int32()), ("term", pa.string()), ("gaps", pa.list_(pa.int32())),
                        ("ord", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_pylist([{"segment": segment, "kind": 0, "term": None, "gaps": base, "ord": list(range(len(ids))),
                                       "doc_ids": ids, "n_words": sizes}], schema)
    if not terms:
        return
    names = list(terms)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    code = rank[np.concatenate(codes)]
    where = np.concatenate([np.arange(b, b + n, dtype=np.int64) for b, n in zip(base, sizes)])
    key = (code << 32) | where
    key.sort()
    code, where = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    gaps = where.copy()
    gaps[1:] -= where[:-1]
    gaps[first] = where[first]
    ends = np.r_[first[1:], len(where)]
    for lo in range(0, len(names), 50_000):
        hi = min(len(names), lo + 50_000)
        off = np.r_[first[lo:hi], ends[hi - 1]].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array(gaps[off[0]:off[-1]]))
        n = hi - lo
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, segment)), pa.array(np.full(n, 1, np.int32)),
             pa.array([names[i].decode("utf-8", "replace") for i in order[lo:hi]]), lists,
             pa.nulls(n, schema.field(4).type), pa.nulls(n, schema.field(5).type), pa.nulls(n, schema.field(6).type)], schema=schema)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, segment = TaskContext.get().partitionId() << 24, 0
    terms, codes, base, ids, sizes, at = {}, [], [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            w = words(text.as_py())
            codes.append(np.fromiter((terms.setdefault(x, len(terms)) for x in w), np.int64, len(w)))
            base.append(at)
            ids.append(doc)
            sizes.append(len(w))
            at += len(w) + GAP
            if at >= SEGMENT_WORDS:
                yield from _segment_rows(part + segment, terms, codes, base, ids, sizes)
                segment += 1
                terms, codes, base, ids, sizes, at = {}, [], [], [], [], 0
    if ids:
        yield from _segment_rows(part + segment, terms, codes, base, ids, sizes)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all words of all rows; kind 0 holds a segment's documents, kind 1 the postings of a term."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(src.mapInArrow(_invert, POSTINGS), "postings")


def windows(items: list[tuple], size: int = WORDS) -> tuple[list[list[bytes]], list[list]]:
    """Distinct windows and, for each, the items that hold it."""
    found: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i:i + size]), set()).add(item)
    return [list(k) for k in found], [sorted(v, key=str) for v in found.values()]


def _near(a: np.ndarray, b: np.ndarray, slop: int, least=-(1 << 62), most=1 << 62) -> np.ndarray:
    """Which of ``a`` lie at most ``slop`` from a member of the sorted ``b`` that is between ``least`` and ``most``."""
    i = np.searchsorted(b, np.maximum(a - slop, least))
    return (i < len(b)) & (b[np.minimum(i, len(b) - 1)] <= np.minimum(a + slop, most))


def _matcher(wins: list[list[bytes]], owners: list[list], slop: int):
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for w in wins for t in w))}
    width = max(map(len, wins), default=1)
    grid = np.full((len(wins), width), len(terms))
    for i, w in enumerate(wins):
        grid[i, :len(w)] = [terms[t] for t in w]

    def match(rows: pa.Table) -> pa.Table:
        """Hits in one segment: per document the merged intervals of hit words and the items found."""
        lists, docs, sizes = [np.zeros(0, np.int64)] * len(terms), None, None
        for r in rows.to_batches():
            for kind, term, gaps, n_words in zip(r.column("kind").to_pylist(), r.column("term").to_pylist(), r.column("gaps"), r.column("n_words")):
                if kind == 0:
                    docs, sizes = np.asarray(gaps.values, np.int64), np.asarray(n_words.values, np.int64)
                elif (k := terms.get(term.encode())) is not None:
                    lists[k] = np.cumsum(np.asarray(gaps.values, np.int64))
        size = np.array([len(x) for x in lists] + [1 << 60])
        length = size[grid]
        out: dict[int, tuple[list, set]] = {}
        for i in np.flatnonzero(length.min(axis=1) > 0):
            n = len(wins[i])
            order = np.argsort(length[i, :n], kind="stable")
            start = lists[grid[i, order[0]]] - order[0]
            for j in order[1:]:
                start = start[_near(start, lists[grid[i, j]] - j, slop)]
                if not len(start):
                    break
            if not len(start):
                continue
            d = np.searchsorted(docs, start + order[0], side="right") - 1               # the rarest term lies in the document, the start may not
            if slop:
                inside = np.logical_and.reduce([_near(start, lists[grid[i, j]] - j, slop, docs[d] - j, docs[d] + sizes[d] - 1 - j) for j in order])
                start, d = start[inside], d[inside]
            at = start - docs[d]
            for s, e, d in zip(np.maximum(at, 0).tolist(), np.minimum(at + n, sizes[d]).tolist(), d.tolist()):
                spans, seen = out.setdefault(d, ([], set()))
                spans.append((s, e))
                seen.update(owners[i])
        segment = rows.column("segment")[0].as_py() if rows.num_rows else None
        return pa.Table.from_pylist(
            [{"segment": segment, "ord": d, "spans": [{"s": s, "e": e} for s, e in merge(spans)], "items": sorted(seen)}
             for d, (spans, seen) in out.items()], HIT_ARROW)
    return match


HIT_ARROW = pa.schema([("segment", pa.int64()), ("ord", pa.int32()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                       ("items", pa.list_(pa.int64()))])
HITS = "segment long, ord int, spans array<struct<s:int,e:int>>, items array<long>"


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _merged(lists) -> list:
    return [{"s": s, "e": e} for s, e in merge([(x["s"], x["e"]) for spans in lists for x in spans])]


def find(index: DataFrame, tests: DataFrame, size: int = WORDS, slop: int = 0, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(segment, ord, doc_id, n_words, spans, items) for every document of the index.

    The test set is read in blocks of ``BLOCK_BYTES`` of text, each sent to the tasks; only postings of its terms are read.
    """
    spark = index.sparkSession
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    t = tests.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = t.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-int(total) // BLOCK_BYTES)
    hits = None
    for b in range(blocks):
        part = t.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        wins, owners = windows([(r["item"], r["text"]) for r in part.collect()], size)
        if not wins:
            continue
        vocabulary = spark.createDataFrame([(x.decode("utf-8", "replace"),) for x in {x for w in wins for x in w}], "term string")
        near = index.select("segment", "kind", "term", "gaps", "n_words").join(F.broadcast(vocabulary), "term", "left_semi")
        near = near.unionByName(index.filter("kind = 0").select("segment", "kind", "term", "gaps", "n_words"))
        found = near.groupBy("segment").applyInArrow(_matcher(wins, owners, slop), HITS)
        hits = found if hits is None else hits.unionByName(found)
    docs = (index.filter("kind = 0").select("segment", F.explode(F.arrays_zip("ord", "doc_ids", "n_words")).alias("d"))
            .select("segment", "d.ord", F.col("d.doc_ids").alias("doc_id"), "d.n_words"))
    if hits is None:
        hits = spark.createDataFrame([], HITS)
    elif blocks > 1:
        union = F.udf(_merged, "array<struct<s:int,e:int>>")
        hits = hits.groupBy("segment", "ord").agg(union(F.collect_list("spans")).alias("spans"),
                                                  F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return docs.join(hits, ["segment", "ord"], "left")


def report(found: DataFrame) -> DataFrame:
    """One row per document: how many of its words lie in occurrences of test windows, and the verdict."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]).cast("long")), F.lit(0).cast("long"))
    items = F.coalesce(F.array_distinct(F.col("items")), F.array().cast("array<long>"))
    named = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return (found.withColumn("n_hit", n_hit)
            .select("segment", "ord", "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated")))


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report of all documents against all windows of the test set."""
    return report(find(build_index(docs, id_col), tests)).drop("segment", "ord")


def hash_items(items: list) -> str:
    """What ``items_sha256`` holds for a list of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
