"""Language-model scores from a weighted backoff automaton.

Smoothed n-grams are states.  A state (a history) has an arc for each word that followed it in the training rows and a failure arc to
the next shorter history.  With a Dirichlet prior of weight ``PRIOR`` on the shorter history, an arc weighs
(c(history, word) + PRIOR * p(word | shorter)) / (c(history) + PRIOR) and the failure arc PRIOR / (c(history) + PRIOR); a history that was never
seen is no state, and its failure costs nothing.  The lowest state holds every word:
(c + 0.1) / (N + 0.1 (V + 1)).  The weights of a state sum to one.

A text is read once from left to right; the state is the longest known history.  ``traverse`` does so for a whole block at
once: at each order the tokens whose arc exists take it, the others take the failure arc and go one order down.

The automaton grows with the corpus and is never sent anywhere whole.  Documents are cut into blocks (``blocks``); each block asks
for the counts of its own distinct n-grams.  Block counts are summed by the hash of the n-gram, and each block gets the sums of what it asked for back.

Defined cases: null and empty texts consist of the end token; a null id is text '' for the hold-out rule; equal rows each count; with no training row
the lowest state is uniform over the unseen word; extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import pack, partitions, stage, unpack

ORDER = 2
PRIOR = 8.0
ADD = 0.1                  # of the lowest state
HOLD = 10                  # crc32(id) mod 10 = 0 is held out
END = b""
_START = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def words(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the key of its history and that of its last word."""
    x = (a ^ (a >> np.uint64(33))) * _M1 + b
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Grams:
    """The n-gram keys of all tokens of a block; each document is preceded by a start mark."""

    def __init__(self, row: dict, order: int):
        codes, place = blocks.pieces_of(row)
        n = np.array(row["n"], np.int64)
        unit_key = np.zeros(len(place), np.uint64)
        held = {p["bucket"]: p["units"] for p in row["packs"]}
        for b, at in blocks.by_bucket(place):
            unit_key[at] = [xxhash.xxh64_intdigest(u) for u in blocks.unpack_units(held[b])]
        self.starts = np.cumsum(n + 1) - (n + 1)
        self.token = np.ones(len(codes) + len(n), bool)
        self.token[self.starts] = False
        self.n = n
        self.train = np.repeat(np.array(row["flags"], bool), n + 1)
        first = np.empty(len(self.token), np.uint64)
        first[self.token] = unit_key[codes]
        first[~self.token] = _START
        place_in = np.arange(len(first)) - np.repeat(self.starts, n + 1)
        self.keys = [(first, np.ones(len(first), bool))]
        for k in range(1, order):
            before, _ = self.keys[-1]
            key, there = np.zeros_like(first), place_in >= k
            at = np.flatnonzero(there)
            key[at] = _mix(before[at - 1], first[at])
            self.keys.append((key, there))

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of order k + 1 in rising order, how often each is in training rows, and each token's place among them."""
        key, there = self.keys[k]
        at = np.flatnonzero(there)
        u, inverse = np.unique(key[at], return_inverse=True)
        where = np.zeros(len(key), np.int64)
        where[at] = inverse
        return u, np.bincount(inverse, weights=self.train[at], minlength=len(u)).astype(np.int64), where


COUNTS = "bucket int, block long, k int, gaps binary, counts binary"


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _count(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                grams, out = Grams(row, order), []
                for k in range(order):
                    keys, counts, _ = grams.distinct(k)
                    for bucket, at in blocks.by_bucket((keys % np.uint64(buckets)).astype(np.int64)):
                        out.append({"bucket": bucket, "block": row["block"], "k": k, "gaps": pack(np.diff(keys[at], prepend=np.uint64(0))), "counts": pack(_small(counts[at]))})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("k", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())]))
    return run


SUMS = "block long, bucket int, k int, sums binary, n long, v long"


def _sum(rows: pa.Table) -> pa.Table:
    """For one bucket and order: each block's keys with their sums over all blocks, and (block -1) the tokens and words counted."""
    k = rows.column("k")[0].as_py()
    keys = [np.cumsum(unpack(g.as_py()), dtype=np.uint64) for g in rows.column("gaps")]
    counts = [unpack(c.as_py()) for c in rows.column("counts")]
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts).astype(float), minlength=len(u)).astype(np.int64)
    out, at = [], 0
    for block, x in zip(rows.column("block").to_pylist(), keys):
        out.append({"block": block, "bucket": rows.column("bucket")[0].as_py(), "k": k, "sums": pack(_small(total[inverse[at:at + len(x)]])), "n": None, "v": None})
        at += len(x)
    if k == 0:
        real = total[u != _START]
        out.append({"block": -1, "bucket": -1, "k": 0, "sums": None, "n": int(real.sum()), "v": int((real > 0).sum())})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("k", pa.int32()), ("sums", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]))


def traverse(grams: Grams, counts: list[np.ndarray], n: int, v: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 weight of every token by the automaton and by its lowest state alone; ``counts[k]`` is by position."""
    lowest = (counts[0] + ADD) / (n + ADD * (v + 1))
    weight, history = [lowest], [None]
    for k in range(1, len(counts)):
        h = np.zeros(len(lowest))
        h[1:] = np.where(grams.keys[k][1][1:], counts[k - 1][:-1], 0)
        history.append(h)
        weight.append((counts[k] + prior * weight[-1]) / (h + prior))
    total, left = np.zeros(len(lowest)), grams.token.copy()
    for k in range(len(counts) - 1, 0, -1):
        state = left & (history[k] > 0)
        arc = state & (counts[k] > 0)
        total[arc] += np.log10(weight[k][arc])
        fail = state & ~arc
        total[fail] += np.log10(prior / (history[k][fail] + prior))
        left &= ~arc
    total[left] += np.log10(lowest[left])
    return total, np.where(grams.token, np.log10(lowest), 0)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, buckets: int, n: int, v: int, prior: float):
    def use(row: dict, answers: list[dict]) -> pa.Table:
        grams, counts = Grams(row, order), []
        by = {(a["k"], a["bucket"]): a["sums"] for a in answers}
        for k in range(order):
            keys, _, where = grams.distinct(k)
            sums = np.zeros(len(keys), np.int64)
            for bucket, at in blocks.by_bucket((keys % np.uint64(buckets)).astype(np.int64)):
                sums[at] = unpack(by[k, bucket])
            counts.append(np.where(grams.keys[k][1], np.append(sums, 0)[where], 0).astype(float))
        total, base = traverse(grams, counts, n, v, prior)
        known = (counts[0] > 0) & grams.token

        def per_doc(x):
            return np.add.reduceat(x, grams.starts) if len(grams.starts) else np.zeros(0)
        m = len(grams.n)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array([not f for f in row["flags"]]), "n_tokens": pa.array(grams.n), "n_known": pa.array(per_doc(known.astype(np.int64))),
                         "train_tokens": pa.array(np.full(m, n, np.int64)), "base_score": pa.array(per_doc(base)), "score": pa.array(per_doc(total))})
    return use


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, most: int = blocks.BLOCK_UNITS) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)`` by a model of the rows that are not held out."""
    spark = docs.sparkSession
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(HOLD)) != 0
    held = blocks.write(docs.select("doc_id", train.alias("flag"), "text"), words, most)
    buckets = max(partitions(spark), 2 * held.count())
    asked = held.select("block", "flags", "n", "codes", "place", "packs").mapInArrow(_count(order, buckets), COUNTS)
    sums = stage(asked.groupBy("k", "bucket").applyInArrow(_sum, SUMS), "sums")
    size = sums.filter("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    answers = sums.filter("block >= 0").select("block", "bucket", "k", "sums")
    return blocks.join(held, answers, _score(order, buckets, size["n"], size["v"], prior), SCORED)
