"""SentencePiece encoding and decoding as a relational lattice.

Texts become blocks of units (``blocks``): runs of characters between places that no piece crosses, so each unit is encoded on its own and
each distinct one once.  A unit is exploded into its substrings of bounded length, these are equi-joined to the piece
table, the edges are grouped by unit and a higher-order ``aggregate`` folds them into the ids.

The fold is what the model's type asks for.  A unigram model takes the Viterbi path of the highest score sum.  A BPE model, such as the public one,
merges: each step of the fold removes the boundary inside the best edge whose ends are boundaries and that holds
exactly one more.  Its scores are merge orders, so a Viterbi path over them would not give the model's ids.

Units above ``MASK`` characters (rows of dashes, say) don't fit the fold's bit mask and are encoded by a small helper with the same result.
Characters outside the vocabulary become bytes.

Defined cases: null and empty texts have no ids; "▁" in a text is read as a blank, as the library does; ids are decoded to the
text itself, less the blank that encoding puts first; equal texts have equal ids; extra columns are not read.
"""
from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import blocks
from .common import pack, stage, unpack

MASK = 62
SPACE = "▁"
UNKNOWN_PENALTY = 10.0     # fixed by the format: below the lowest score


class Pieces:
    """What the operator needs of a model file."""

    def __init__(self, path: str, model_type: int | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bpe = (model_type or proto.trainer_spec.model_type) == 2
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.raw = [bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.score[i] for i in self.ids.values())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without normalisation and with a leading blank are supported")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word start or a line end")
        self.pattern = re.compile(self._units())

    def _units(self) -> str:
        """Cuts where no piece crosses: at blanks, line ends and between characters that no chain of pieces connects to letters."""
        root: dict[str, str] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                c = root[c]
            return c
        for p in self.ids:
            q = p.replace(SPACE, "")
            for a, b in zip(q, q[1:]):
                root[find(a)] = find(b)
        letters = find("e")
        apart = "".join(re.escape(c) for c in sorted(root) if find(c) != letters and c not in " \n")
        return rf" *[^ \n{apart}]+| *[{apart}]+| +|\n" if apart else r" *[^ \n]+| +|\n"

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def single(self, c: str) -> list[int]:
        i = self.ids.get(c)
        return [i] if i is not None else [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]

    def cut(self, unit: str, mask: int) -> list[int]:
        """The ids of the stretches between the boundaries in ``mask`` (bit 0 and the last are set)."""
        out, s, get = [], 0, self.ids.get
        for e in range(1, len(unit) + 1):
            if mask >> e & 1:
                i = get(unit[s:e])
                if i is None:
                    out += self.single(unit[s:e])
                else:
                    out.append(i)
                s = e
        return out

    def encode_unit(self, unit: str) -> list[int]:
        """The helper for units that are too long for the fold."""
        return self._merge(unit) if self.bpe else self._best(unit)

    def _merge(self, u: str) -> list[int]:
        n = len(u)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(a):
            b = right[a]
            if b < n and (i := self.ids.get(u[a:end[b]])) is not None:
                heapq.heappush(heap, (-self.score[i], a, end[b], end[a]))
        for a in range(n):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, e, middle = heapq.heappop(heap)
            if not alive[a] or end[a] != middle or right[a] >= n or end[right[a]] != e:
                continue
            b = right[a]
            alive[b], end[a], right[a] = False, e, right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        out, a = [], 0
        while a < n:
            s = u[a:end[a]]
            out += [self.ids[s]] if len(s) > 1 else self.single(s)
            a = right[a]
        return out

    def _best(self, u: str) -> list[int]:
        best, back = [0.0] + [-np.inf] * len(u), [0] * (len(u) + 1)
        for s in range(len(u)):
            for e in range(s + 1, min(len(u), s + self.longest) + 1):
                i = self.ids.get(u[s:e])
                score = self.score[i] if i is not None else self.lowest - UNKNOWN_PENALTY if e == s + 1 else -np.inf
                if best[s] + score > best[e]:
                    best[e], back[e] = best[s] + score, s
        out, e = [], len(u)
        while e:
            s = u[back[e]:e]
            out = ([self.ids[s]] if len(s) > 1 else self.single(s)) + out
            e = back[e]
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@cache
def load(path: str, model_type: int | None = None) -> Pieces:
    return Pieces(path, model_type)


def piece_table(spark: SparkSession, p: Pieces) -> DataFrame:
    """(piece, rank, score): rank 0 is the highest score, equal scores share a rank.  Its size is the vocabulary's, whatever the corpus."""
    ranks = {x: r for r, x in enumerate(sorted({p.score[i] for i in p.ids.values()}, reverse=True))}
    return spark.createDataFrame([(t, ranks[p.score[i]], float(p.score[i])) for t, i in p.ids.items()], "piece string, rank long, score double")


def _merged(path: str, model_type: int | None):
    def run(rows: pa.Table) -> pa.Table:
        """All distinct units of a bucket once, and where each block has them."""
        p, at, seen = load(path, model_type), [], {}
        for u in rows.column("units"):
            units = blocks.unpack_units(u.as_py())
            at.append(pack(np.fromiter((seen.setdefault(x, len(seen)) for x in units), np.uint32, len(units))))
        units = [u.decode("utf-8", "replace") for u in seen]
        long = [i for i, u in enumerate(units) if len(u) > MASK]
        return pa.table({"shard": rows.column("shard")[:1], "bucket": rows.column("bucket")[:1], "units": pa.array([[None if len(u) > MASK else u for u in units]], pa.list_(pa.string())),
                         "blocks": pa.array([rows.column("block").to_pylist()], pa.list_(pa.int64())), "at": pa.array([at], pa.list_(pa.binary())),
                         "long": pa.array([long], pa.list_(pa.int32())), "long_ids": pa.array([[p.encode_unit(units[i].replace(" ", SPACE)) for i in long]], pa.list_(pa.list_(pa.int32())))})
    return run


# Edges in merge order, each with its two ends and what lies between them as bit masks of boundaries.
_EDGES = """
transform(edges, k -> struct(shiftleft(1L, cast(shiftright(k, 6) & 63 as int)) | shiftleft(1L, cast(k & 63 as int)) as ends,
                             shiftleft(1L, cast(k & 63 as int)) - shiftleft(1L, cast(shiftright(k, 6) & 63 as int) + 1) as inner))
"""
_BPE = """
aggregate(sequence(1, greatest(1, n - 1)), shiftleft(1L, n + 1) - 1L,
  (mask, t) -> mask & ~coalesce(get(filter(multi, x -> (mask & x.ends) = x.ends and bit_count(mask & x.inner) = 1), 0).inner, 0L))
"""
_VITERBI = """
aggregate(edges, struct(array(0D) as best, array(0) as back),
  (a, x) -> struct(
    case when x.e = size(a.best) then concat(a.best, array(get(a.best, x.s) + x.score))
         when get(a.best, x.s) + x.score > get(a.best, x.e) then concat(slice(a.best, 1, x.e), array(get(a.best, x.s) + x.score))
         else a.best end as best,
    case when x.e = size(a.best) then concat(a.back, array(x.s))
         when get(a.best, x.s) + x.score > get(a.best, x.e) then concat(slice(a.back, 1, x.e), array(x.s))
         else a.back end as back),
  a -> aggregate(sequence(1, n), struct(n as at, shiftleft(1L, n) as mask),
         (b, t) -> case when b.at = 0 then b else struct(get(a.back, b.at) as at, b.mask | shiftleft(1L, get(a.back, b.at)) as mask) end).mask)
"""


def lattice(units: DataFrame, pieces: DataFrame, p: Pieces) -> DataFrame:
    """(shard, bucket, i, mask) for ``units(shard, bucket, i, unit)``: the boundaries of the best segmentation as bits.

    A merging model needs no edges of one character; a unit without longer ones is left out and falls into characters.
    """
    least = 2 if p.bpe else 1
    u = units.select("shard", "bucket", "i", F.translate("unit", " ", SPACE).alias("unit")).withColumn("n", F.length("unit")).filter(F.col("n") >= least)
    sub = (u.withColumn("s", F.explode(F.expr(f"sequence(0, n - {least})")))
           .withColumn("len", F.explode(F.expr(f"sequence({least}, least({p.longest}, n - s))")))
           .withColumn("sub", F.expr("substring(unit, s + 1, len)")))
    keys, match = ["shard", "bucket", "i"], sub["sub"] == pieces["piece"]
    e = F.col("s") + F.col("len")
    if p.bpe:
        edges = sub.join(F.broadcast(pieces), match).select(*keys, "n", ((F.col("rank") * 64 + F.col("s")) * 64 + e).alias("k"))
        grouped = edges.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("k")).alias("edges"))
        return grouped.withColumn("multi", F.expr(_EDGES)).select(*keys, F.expr(_BPE).alias("mask"))
    score = F.coalesce("score", F.lit(p.lowest - UNKNOWN_PENALTY))
    edges = sub.join(F.broadcast(pieces), match, "left").filter("piece is not null or len = 1").select(*keys, "n", F.struct(e.alias("e"), "s", score.alias("score")).alias("x"))
    grouped = edges.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("x")).alias("edges"))
    return grouped.select(*keys, F.expr(_VITERBI).alias("mask"))


def _answers(path: str, model_type: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Back to the blocks: per block and bucket the ids of its units, one after the other, and how many each has."""
        p, schema = load(path, model_type), pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary()), ("flat", pa.binary())])
        for b in batches:
            for row in range(b.num_rows):                                    # one bucket at a time: the units of all together would not be bounded
                r = {name: b.column(i)[row] for i, name in enumerate(b.schema.names)}
                units = r["units"].as_py()
                mask = np.full(len(units), -1, np.int64)
                if r["i"].is_valid:
                    mask[r["i"].values.to_numpy()] = r["mask"].values.to_numpy()
                ids: list = [u and array("I", p.cut(u.replace(" ", SPACE), m)) for u, m in zip(units, mask.tolist())]
                for i, x in zip(r["long"].as_py(), r["long_ids"].as_py()):
                    ids[i] = array("I", x)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.uint16 if len(p.text) <= 1 << 16 else np.uint32)
                first, n = np.cumsum(n) - n, n.astype(np.uint16 if n.max() < 1 << 16 else np.uint32)
                for block, at in zip(r["blocks"].as_py(), r["at"]):
                    k = unpack(at.as_py()).astype(np.int64)
                    yield pa.RecordBatch.from_pylist([{"block": block, "bucket": r["bucket"].as_py(), "n": pack(n[k]), "flat": pack(flat[ragged(first[k], n[k])])}], schema)
    return run


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start[0], ..., start[0] + n[0] - 1, start[1], ..."""
    n = n.astype(np.int64)
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - np.r_[0, end[:-1]] if len(end) else start, n)


ENCODED = "doc_id long, ids array<int>"


def _assemble(row: dict, answers: list[dict]) -> pa.Table:
    codes, place = blocks.pieces_of(row)
    n = blocks.scatter(place, {a["bucket"]: unpack(a["n"]) for a in answers}, np.int64)
    first = np.zeros(len(place), np.int64)
    flats, offset = [], 0
    by = {a["bucket"]: a for a in answers}
    for b, at in blocks.by_bucket(place):
        flat = unpack(by[b]["flat"])
        first[at] = offset + np.r_[0, np.cumsum(n[at])[:-1]]
        flats.append(flat)
        offset += len(flat)
    flat = np.concatenate(flats) if flats else np.zeros(0, np.uint16)
    ids = flat[ragged(first[codes], n[codes])].astype(np.int32)
    per_unit = np.r_[0, np.cumsum(n[codes])]
    cuts = per_unit[np.r_[0, np.cumsum(np.array(row["n"], np.int64))]]
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))})


def encode(docs: DataFrame, path: str, model_type: int | None = None, most: int = blocks.BLOCK_UNITS) -> DataFrame:
    """doc_id and ids of every row of ``docs(doc_id, text)``."""
    spark, p = docs.sparkSession, load(path, model_type)
    held = blocks.write(docs.select("doc_id", F.lit(False).alias("flag"), "text"), p.split, most)
    merged = stage(blocks.packs(held).groupBy("shard", "bucket").applyInArrow(
        _merged(path, model_type), "shard long, bucket int, units array<string>, blocks array<long>, at array<binary>, long array<int>, long_ids array<array<int>>"), "units")
    units = (merged.select("shard", "bucket", "units").repartition(blocks.buckets(spark), "shard", "bucket")
             .select("shard", "bucket", F.posexplode("units").alias("i", "unit")).filter("unit is not null"))
    found = (lattice(units, piece_table(spark, p), p).groupBy("shard", "bucket").agg(F.collect_list("i").alias("i"), F.collect_list("mask").alias("mask")))
    answers = (merged.select("shard", "bucket", "units", "blocks", "at", "long", "long_ids").join(found, ["shard", "bucket"], "left")
               .mapInArrow(_answers(path, model_type), "block long, bucket int, n binary, flat binary"))
    return blocks.join(held.select("block", "ids", "n", "codes", "place"), answers, _assemble, ENCODED)


def decoded(ids: Column, path: str) -> Column:
    """The text of an id list as an expression."""
    @F.pandas_udf(StringType())
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = load(path)
        for x in lists:
            yield pd.Series([None if i is None else p.decode(i.tolist()) for i in x], dtype=object)
    return run(ids)
