"""Near-duplicates by SimHash fingerprints and multi-index hashing.

``near_duplicates`` links 64-bit fingerprints of three-word shingles at two bits or fewer.  The fingerprint is cut into a high and a low half.  Two fingerprints that differ in at most two bits differ in at most one
bit of the high half or in none of the low half, so each distinct fingerprint probes the 33 values of the radius-1 ball round its high
half and the one value of its low half; the table of halves gives the matches, and complete distances are verified.

Halves shared by more than ``CROWDED`` distinct fingerprints are not paired.  Every fingerprint in such a group, or with
a probe into it, lists the 65 complete codes at most one bit away; two codes differ in at most two bits exactly if they
have such a code in common, so linking everything that lists a code to the smallest one there loses no link and makes no
pairs.

``similar_groups`` links documents whose sets of five-word shingles are alike by ``SIMILARITY`` (Jaccard) or more, and no others: the exact sets
decide, so neither a signature nor the size of the table can change a link.  Candidates are first what the SimHash fingerprints of ``near_duplicates`` link (two bits
or fewer, by the same multi-index tables).  SimHash bits of texts at the threshold differ in a sixth of all places and more for short texts, so bands of ``ROWS`` minimum
hashes of the set give the candidates that two bits don't reach: a pair at the threshold shares one of the bands with the chance ``RECALL``, whatever the length of its texts.  Members of a band of more than ``DENSE`` sets are compared to its smallest id first; what is not yet joined to that one is compared to
the whole band tile by tile, which gives spanning edges.

Defined cases: null and empty texts have fingerprint zero and are linked like any others; copies and repeated rows share one
fingerprint and so one component; a null id never names a component unless all ids there are null.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from ..plans.layout import broadcast_if_small
from .common import shuffled, stage
from .graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
CROWDED = 64          # distinct fingerprints per half above which codes replace pairs
SIMILARITY = 0.8      # of the sets of WIDE-word shingles
WIDE = 5
ROWS = 4              # minimum hashes of a band
RECALL = 0.99999      # that a pair at the threshold shares a band
DENSE = 16            # sets per band above which tiles replace pairs
TILE = 512
_BITS_AT_ONCE = 1 << 18
_HASHES_AT_ONCE = 2048


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hash of every shingle of a text, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[:len(w) - size + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[size - 1:].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), _BITS_AT_ONCE):
        part = np.ascontiguousarray(h[lo:lo + _BITS_AT_ONCE])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text, SHINGLE))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bands_of(h: np.ndarray, bands: int) -> np.ndarray:
    """One number per band for a set of hashes: what its ``ROWS`` minimum hashes are; an empty set has none."""
    if not len(h):
        return np.zeros(0, np.int64)
    step = np.arange(ROWS * bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.full(ROWS * bands, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), _HASHES_AT_ONCE):
        np.minimum(low, _mixed(h[lo:lo + _HASHES_AT_ONCE, None] + step).min(axis=0), out=low)
    out = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, ROWS).T:
        out = _mixed(out ^ column)
    return out.view(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's wide shingles, sorted."""
    return np.unique(shingle_hashes(text, WIDE))


@F.pandas_udf(LongType())
def fingerprint_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([fingerprint(x) for x in t], dtype="int64")


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) whose closure joins all distinct fingerprints ``fp`` that differ in at most two bits."""
    high, low = _halves(F.col("fp"))
    ball = F.concat(F.array(high), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    probes = fps.select("fp", F.explode(ball).alias("value"), F.lit(0).alias("half")).unionByName(
        fps.select("fp", low.alias("value"), F.lit(1).alias("half")))
    held = fps.select(F.col("fp").alias("other"), high.alias("value"), F.lit(0).alias("half")).unionByName(
        fps.select(F.col("fp").alias("other"), low.alias("value"), F.lit(1).alias("half")))
    crowd = held.groupBy("half", "value").agg(F.count("*").alias("n"), F.min("other").alias("least"))
    calm, busy = crowd.filter(F.col("n") <= CROWDED), crowd.filter(F.col("n") > CROWDED)
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    sparse = shuffled(held).join(calm.select("half", "value"), ["half", "value"])
    pairs = (shuffled(probes).join(sparse, ["half", "value"]).filter("fp > other").filter(bits <= RADIUS)
             .select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct())
    touched = shuffled(probes).join(busy.select("half", "value"), ["half", "value"]).select("fp").distinct()
    fp = F.col("fp")
    codes = F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    listed = touched.select("fp", F.explode(codes).alias("code"))
    centre = listed.groupBy("code").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v <> most").select("code", "v")
    stars = shuffled(listed).join(centre, "code").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.unionByName(stars)


def groups(fingerprinted: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``fingerprinted(doc_id, fp)``."""
    fps = stage(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    root = components(links(fps.select("fp")))
    rooted = fps.join(shuffled(root), fps["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component of every row of ``docs(doc_id, text)``."""
    printed = stage(docs.select("doc_id", fingerprint_of("text").alias("fp")), "simhash")
    return printed.join(groups(printed), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bands_at(similarity: float = SIMILARITY) -> int:
    """How many bands give a pair at this similarity the chance ``RECALL`` to share one."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - similarity ** ROWS))


def signed_of(text: Column, bands: int) -> Column:
    @F.pandas_udf(StructType().add("sid", BinaryType()).add("size", LongType()).add("bands", ArrayType(LongType())).add("fp", LongType()))
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            sets = [shingle_set(x) for x in t]
            yield pd.DataFrame({"sid": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], "size": [len(h) for h in sets],
                                "bands": [bands_of(h, bands).tolist() for h in sets], "fp": [fingerprint(x) for x in t]})
    return signed(text)


@F.pandas_udf(ArrayType(LongType()))
def shingles_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([shingle_set(x).view(np.int64) for x in t], dtype=object)


def _tiles(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        """Edges that join what is alike within a tile or between two (side 0 and 1; 2 is a tile with itself) and not joined yet."""
        side, cid, label = (rows.column(c).to_numpy().copy() for c in ("side", "cid", "root"))
        length = rows.column("h").combine_chunks().value_lengths().to_numpy()
        member = np.unique(rows.column("h").combine_chunks().flatten().to_numpy(), return_inverse=True)[1]
        owner, ends = np.repeat(np.arange(len(cid)), length), np.cumsum(length)
        left, right = (np.arange(len(cid)),) * 2 if (side == 2).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        u, v = [], []
        for a in left:
            apart = right[label[right] != label[a]]
            if not len(apart):
                continue
            mine = np.zeros(member.max() + 1, bool)
            mine[member[ends[a] - length[a]:ends[a]]] = True
            shared = np.bincount(owner[mine[member]], minlength=len(cid))[apart]
            near = apart[shared / (length[a] + length[apart] - shared) >= similarity]
            joined, first = np.unique(label[near], return_index=True)
            u += [cid[a]] * len(first)
            v += cid[near[first]].tolist()
            label[np.isin(label, joined)] = label[a]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return run


def fingerprint_pairs(signed: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (u, v, size, size2) of sets whose SimHash fingerprints differ in at most two bits; those of one fingerprint meet its smallest."""
    printed = stage(signed.select("sid", "fp").distinct().join(held.select("sid", "cid", "size"), "sid").select("fp", F.struct("cid", "size").alias("set")), "fingerprints")
    hubs = printed.groupBy("fp").agg(F.min("set").alias("hub"))
    same = shuffled(printed).join(hubs, "fp").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    edges = links(hubs.select("fp"))
    near = (edges.join(shuffled(hubs.select(F.col("fp").alias("u"), F.col("hub").alias("a"))), "u")
            .join(shuffled(hubs.select(F.col("fp").alias("v"), F.col("hub").alias("b"))), "v").select("a", "b"))
    met = same.unionByName(near).filter("a.cid <> b.cid").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return met.select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v"), F.col("a.size").alias("size"), F.col("b.size").alias("size2"))


def similar_groups(signed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(sid, root, component_id) for every distinct shingle set of ``signed(doc_id, th, sid, size, bands, fp)``; ``texts(th, text)`` has the texts."""
    held = stage(signed.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("size").alias("size"), F.first("bands").alias("bands"))
                 .withColumn("cid", F.monotonically_increasing_id()), "sets")
    cut = held.select("cid", "size", F.explode("bands").alias("band"))
    sizes = cut.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("cid", "size")).alias("hub")).filter("n > 1")
    members = stage(shuffled(cut).join(sizes, "band"), "bands")
    calm, busy = members.filter(F.col("n") <= DENSE).select("band", "cid", "size"), members.filter(F.col("n") > DENSE)
    fits = F.least("size", "size2") / F.greatest("size", "size2") >= similarity
    pairs = shuffled(calm).join(calm.select("band", F.col("cid").alias("v"), F.col("size").alias("size2")), "band").filter("cid > v").filter(fits).select(F.col("cid").alias("u"), "v")
    spokes = busy.withColumn("size2", F.col("hub.size")).filter("cid <> hub.cid").filter(fits).select(F.col("cid").alias("u"), F.col("hub.cid").alias("v"))
    printed = fingerprint_pairs(signed, held).filter(fits).select("u", "v")
    pairs = stage(printed.unionByName(pairs).unionByName(spokes).distinct(), "pairs")
    needed = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).unionByName(busy.select("cid")).distinct()
    named = texts.join(held.join(needed, "cid").select("cid", "th"), "th").groupBy("cid").agg(F.min("text").alias("text"))
    sets = stage(named.select("cid", shingles_of("text").alias("h")), "shingles")
    shared = F.size(F.array_intersect("h", "h2"))
    few = broadcast_if_small(pairs, 32 * pairs.count(), 8 << 20)
    edges = stage((few if few is not pairs else shuffled(pairs)).join(sets.withColumnRenamed("cid", "u"), "u").join(sets.select(F.col("cid").alias("v"), F.col("h").alias("h2")), "v")
                  .filter(shared / (F.size("h") + F.size("h2") - shared) >= similarity).select("u", "v"), "alike")
    root = components(edges)
    rooted = busy.select("band", "cid", F.col("hub.cid").alias("hub")).join(shuffled(root), F.col("cid") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "cid"))
    centre = rooted.filter("cid = hub").select("band", F.col("root").alias("centre"))
    apart = F.col("root") != F.col("centre")
    rooted = stage(rooted.join(centre, "band").withColumn("apart", apart).drop("hub", "centre"), "rooted")
    open_ = rooted.groupBy("band").agg(F.count_if("apart").alias("k"), F.count_if(~F.col("apart")).alias("l")).filter("k > 0")
    open_ = stage(open_.select("band", *[F.ceil(F.col(c) / TILE).cast("int").alias(c) for c in "kl"]), "open")
    if not open_.isEmpty():
        placed = rooted.join(open_, "band").join(sets, "cid").withColumn(
            "mine", F.when(F.col("apart"), F.pmod(F.xxhash64("cid"), F.col("k"))).otherwise(F.col("k") + F.pmod(F.xxhash64("cid"), F.col("l"))).cast("int"))
        meet = F.transform(F.sequence(F.lit(0), F.when(F.col("apart"), F.col("k") + F.col("l")).otherwise(F.col("k")) - 1), lambda o: F.struct(
            F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"), F.when(F.col("mine") == o, 2).when(F.col("mine") < o, 0).otherwise(1).alias("side")))
        dense = (placed.withColumn("p", F.explode(meet)).select("band", "p.i", "p.j", "p.side", "cid", "root", "h")
                 .groupBy("band", "i", "j").applyInArrow(_tiles(similarity), "u long, v long"))
        root = components(edges.unionByName(dense))
    rooted = held.join(shuffled(root), held["cid"] == root["node"], "left").select("sid", "least", F.coalesce("root", "cid").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "root", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of similar documents does: the row with the smallest id."""
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    signed = stage(whole.select(F.col("id").alias("doc_id"), "th", signed_of(F.col("text"), bands_at(similarity)).alias("s")).select("doc_id", "th", "s.*"), "signed")
    least = signed.join(similar_groups(signed, whole.select("th", "text"), similarity), "sid").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = least.groupBy("root").agg(F.min(F.struct("doc_id", F.coalesce("th", F.lit(0)).alias("th"))).alias("kept")).select("kept.doc_id", F.col("kept.th").alias("kth"))
    return (whole.join(chosen, F.col("id").eqNullSafe(F.col("doc_id")) & (F.coalesce("th", F.lit(0)) == F.col("kth")), "left_semi")
            .dropDuplicates(["id", "th"]).select("row.*"))
