"""Near-duplicate vectors by randomised-rotation binary codes.

Equal vectors are one class.  A unit vector is rotated at random and each coordinate keeps its sign; the inner product f of code and vector is stored.
For a code x of a and a full vector b, <x, b> / f estimates <a, b> without bias, and its error is at most ``SIGMAS``
* sqrt((1 - f^2) / f^2 / (D - 1)) but for a chance of about 1e-5.  A pair whose upper bound is below the threshold is dropped, all others are
computed exactly in double precision.

Candidates share a stretch of k sign bits in one of several tables (more rotations give more bits).  k grows with the
logarithm of the number of classes, so chance groups keep their size, and the number of tables follows from k and the recall that a pair at
the threshold must have.  Groups above ``TILE`` vectors are cut into tiles and each pair of tiles is a task of its own.  A pair that
meets in several tables counts in the first of them.  Tasks return counts and a spanning forest, never pairs.

Defined cases: null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of different length don't link;
rows with equal ids are separate vectors; a null id is never a component's name unless the component has no other.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import components

THRESHOLD = 0.95
RECALL = 0.999              # of a pair at the threshold
GROUP = 16                  # vectors that share a table's bits by chance
SIGMAS = 4.5
TILE = 2048
SEED = 10


def layout(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits per table and number of tables for n classes."""
    bits = max(6, math.ceil(math.log2(max(2, n) / GROUP)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def rotations(dim: int, count: int) -> np.ndarray:
    """(count, dim, dim): random orthogonal matrices."""
    rng = np.random.default_rng([SEED, dim])
    return np.array([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)])


def keys_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the sign bits of each table as a number."""
    dim = unit.shape[1]
    turn = rotations(dim, -(-bits * tables // dim))
    signs = np.concatenate([unit @ r > 0 for r in turn], axis=1)[:, :bits * tables].reshape(len(unit), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their sign codes (unit length) and the stored inner products of the two."""
    turned = unit @ rotations(unit.shape[1], 1)[0]
    x = np.where(turned > 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, x, (turned * x).sum(axis=1)


def _spread(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per class and table."""
        for b in batches:
            cid, copies, vectors = (b.column(i) for i in range(3))
            size = np.diff(np.asarray(vectors.offsets))
            for dim in np.unique(size):
                at = pa.array(np.flatnonzero(size == dim))
                v = np.asarray(vectors.take(at).flatten(), np.float64).reshape(-1, dim)
                keys = keys_of(v / np.linalg.norm(v, axis=1, keepdims=True), bits, tables)
                n = len(v)
                raw = [x.tobytes() for x in v]
                all_keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t]), cid.take(at), copies.take(at),
                                                      pa.array(raw, pa.binary()), all_keys], ["dim", "t", "key", "cid", "copies", "vector", "keys"])
    return run


def _labels(adjacent: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The smallest name that each row or column of a tile reaches, rows first; names are of rows, then columns."""
    r = len(adjacent)
    a, b = name[:r].copy(), name[r:].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(adjacent, b[None, :], top).min(axis=1, initial=top))
        new_b = np.minimum(b, np.where(adjacent, new_a[:, None], top).min(axis=0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return np.r_[a, b]
        a, b = new_a, new_b


FOUND = "u long, v long, links long"


def _compare(threshold: float, sigmas: float):
    def run(rows: pa.Table) -> pa.Table:
        """Links within one tile pair: per class the weight of its links that count here, and an edge to a class it reaches."""
        side = np.asarray(rows.column("side").to_numpy())
        t = rows.column("t")[0].as_py()
        dim = rows.column("dim")[0].as_py()
        cid, copies = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
        v = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)[:, :t]
        same = (side == 2).all()                                              # a tile with itself
        left, right = (np.arange(len(cid)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        turned, x, f = codes(unit)
        f = np.maximum(f, 1e-9)
        bound = sigmas * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1))
        near = (x[left] @ turned[right].T) / f[left][:, None] + bound[left][:, None] >= threshold
        if same:
            near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        ok = np.empty(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            a, b = unit[left[i[lo:lo + (1 << 16)]]], unit[right[j[lo:lo + (1 << 16)]]]
            ok[lo:lo + (1 << 16)] = np.einsum("ij,ij->i", a, b) >= threshold
        i, j = i[ok], j[ok]
        linked = np.zeros(near.shape, bool)
        linked[i, j] = True
        reach = _labels(linked, np.r_[cid[left], cid[right]])
        first = np.ones(len(i), bool)
        for k in range(t):
            first &= keys[left[i], k] != keys[right[j], k]
        weight = np.bincount(left[i[first]], copies[right[j[first]]], len(cid)) + np.bincount(right[j[first]], copies[left[i[first]]], len(cid))
        low = cid.copy()
        np.minimum.at(low, left, reach[:len(left)])
        np.minimum.at(low, right, reach[len(left):])
        keep = (low != cid) | (weight > 0)
        return pa.table({"u": cid[keep], "v": low[keep], "links": weight[keep].astype(np.int64)})
    return run


def classes(vectors: DataFrame) -> DataFrame:
    """(cid, copies, least, embedding): the distinct usable vectors."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return stage(vectors.filter(usable).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
                 .withColumn("cid", F.monotonically_increasing_id()), "classes")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sigmas: float = SIGMAS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    held = classes(rows)
    bits, tables = layout(held.count(), threshold)
    spread = held.select("cid", "copies", "embedding").mapInArrow(
        _spread(bits, tables), "dim int, t int, key long, cid long, copies long, vector binary, keys array<long>")
    sizes = (held.select("cid", "copies", "embedding").mapInArrow(_keys_only(bits, tables), "dim int, t int, key long")
             .groupBy("dim", "t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    cut = stage(sizes.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")), "sizes")
    part = spread.join(cut.select("dim", "t", "key", "tiles"), ["dim", "t", "key"]).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(
        F.least("mine", o).alias("a"), F.greatest("mine", o).alias("b"), F.when(F.col("mine") == o, 2).when(F.col("mine") < o, 0).otherwise(1).alias("side")))
    tiled = part.withColumn("p", F.explode(pair)).select("dim", "t", "key", "p.a", "p.b", "p.side", "cid", "copies", "vector", "keys")
    found = stage(tiled.groupBy("dim", "t", "key", "a", "b").applyInArrow(_compare(threshold, sigmas), FOUND), "links")
    links = found.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    root = components(found.filter("u <> v").select("u", "v"))
    named = held.select("cid", "copies", "least", "embedding").join(links, "cid", "left").join(root, F.col("cid") == F.col("node"), "left")
    named = stage(named.select("embedding", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "named")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(named.join(best, "root").select("embedding", "n_links", "component_id", F.lit(True).alias("usable")), "embedding", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def _keys_only(bits: int, tables: int):
    whole = _spread(bits, tables)

    def run(batches):
        for b in whole(batches):
            yield b.select(["dim", "t", "key"])
    return run
