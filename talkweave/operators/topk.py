"""Exact top-k of a query block over a partitioned corpus.

Each task scores the rows it reads and keeps, per query, only its own k best; what leaves a task is
at most queries x k rows however large the corpus is.  A window then picks the k best of those.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.layout import top_per_key

QUERY_SLICE = 512
HEAD = 1024              # rows of a batch that give the first bound
MIDDLE_LEVEL = 256       # tasks above which their lists are merged in two steps
# batch -> (ids, function of a query slice -> scores[slice, rows])
BatchScorer = Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[slice], np.ndarray]]]


def select_best(scores: np.ndarray, k: int, floor: float | None) -> np.ndarray:
    """Mask of the k largest per row; among equals the earlier column wins; values up to ``floor`` drop out."""
    n = scores.shape[1]
    if n <= k:
        keep = np.ones(scores.shape, dtype=bool)
    else:
        cut = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above, level = scores > cut, scores == cut
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (level & (np.cumsum(level, axis=1) <= room))
    return keep if floor is None else keep & (scores > floor)


def score_rows(ids: np.ndarray, score: Callable[[slice], np.ndarray], n_queries: int, k: int,
               floor: float | None, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What may be among a query's k best: at most the k best of the first ``HEAD`` rows, of the others what reaches those
    and ``least``, a score that k rows of each query are known to have (-inf: unknown)."""
    order = np.argsort(ids, kind="stable")
    head = order[:HEAD]
    out = []
    for start in range(0, n_queries, QUERY_SLICE):
        part = slice(start, min(start + QUERY_SLICE, n_queries))
        raw = score(part)
        known = np.full(len(raw), -np.inf) if least is None else least[part]
        open_ = bool((known == -np.inf).any())
        if open_:
            s = np.round(raw[:, head], 6) + 0.0
            qi, ci = np.nonzero(select_best(s, k, floor))
            out.append((qi + start, ids[head][ci], s[qi, ci]))
            known = np.maximum(known, kth_best(qi, s[qi, ci], len(raw), k))
        if not open_ or len(order) > HEAD:
            mask = raw >= known[:, None] - 1e-6              # rounding moves a score by less than that
            if floor is not None:
                mask &= raw > floor
            if open_:
                mask[:, head] = False
            qi, ci = np.nonzero(mask)
            s = np.round(raw[qi, ci], 6) + 0.0
            fits = s >= known[qi] if floor is None else (s >= known[qi]) & (s > floor)
            out.append((qi[fits] + start, ids[ci[fits]], s[fits]))
    return out


def kth_best(qi: np.ndarray, s: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th highest of each query's scores; -inf where there are fewer."""
    order = np.lexsort((-s, qi))
    first = np.searchsorted(qi[order], np.arange(n + 1))
    out = np.full(n, -np.inf)
    enough = np.diff(first) >= k
    out[enough] = s[order[first[:-1][enough] + k - 1]]
    return out


def prune(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qi, ids, sc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, -sc, qi))
    qi, ids, sc = qi[order], ids[order], sc[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], ids[keep], sc[keep]


def result_schema(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str) -> tuple[str, pa.Schema]:
    q, c = queries.schema[qkey].dataType, corpus.schema[ckey].dataType
    return (f"{qkey} {q.simpleString()}, {ckey} {c.simpleString()}, score double",
            pa.schema([(qkey, to_arrow_type(q)), (ckey, to_arrow_type(c)), ("score", pa.float64())]))


def to_batch(keys: np.ndarray, best: tuple, schema: pa.Schema) -> pa.RecordBatch:
    qi, ids, sc = best
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[qi], type=schema.field(0).type), pa.array(ids, type=schema.field(1).type), pa.array(sc)],
        schema=schema)


def scan_topk(corpus: DataFrame, shared, make_scorer: Callable[[object], tuple[np.ndarray, BatchScorer]], k: int,
              ddl: str, schema: pa.Schema, floor: float | None = None) -> DataFrame:
    """``shared`` is a broadcast; ``make_scorer`` turns its value into the query keys and a batch scorer."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scorer = make_scorer(shared.value)
        best: list = []
        least = np.full(len(keys), -np.inf)
        for b in batches:
            if b.num_rows == 0 or len(keys) == 0:
                continue
            ids, score = scorer(b)
            best = [prune(best + score_rows(ids, score, len(keys), k, floor, least), k)]
            least = kth_best(best[0][0], best[0][2], len(keys), k)
        if best:
            yield to_batch(keys, prune(best, k), schema)

    qkey, ckey = schema.names[0], schema.names[1]
    local = corpus.mapInArrow(scan, ddl)
    order = [F.desc("score"), F.asc(ckey)]
    tasks = corpus.rdd.getNumPartitions()
    if tasks > MIDDLE_LEVEL:                     # many tasks: their lists meet in groups first, so no window sees them all
        groups = math.isqrt(tasks)
        local = top_per_key(local.withColumn("_group", F.pmod(F.xxhash64(ckey), F.lit(groups))), [qkey, "_group"], order, k).drop("_group", "rank")
    return top_per_key(local, qkey, order, k)
