"""Token ids as Parquet: list columns with dictionary and delta encoding, small row groups and page indexes.

``write`` puts documents in order of their id by a range shuffle, encodes each partition as it streams by and writes the ids with
the document's place: ``part`` (the partition) and ``pos`` (ids before it there).  ``read`` adds the ids of all
earlier parts, one number per part, and so gives every document's ``start`` in the whole token stream.  Readers of a few
documents, or of the metadata only, skip pages and columns.

The library encodes stretches of text and a worker remembers their ids: the pre-tokeniser of byte-level BPE never joins text over
the places where ``_STRETCH`` cuts.  The memory has two generations of bounded size, so frequent stretches stay; what is
forgotten is encoded again.

Defined cases: null and empty texts have the end id alone; rows with a null id come first; rows with equal ids stay separate and
follow each other; extra columns are not read.
"""
from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1_000
MEMORY = 450_000              # stretches in each of the two generations that a worker remembers
TOGETHER = 2_000_000          # characters whose new stretches are encoded in one call
_STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s")
_ODD = re.compile("[\x1c-\x1f]|<\\|")        # white space for one library only, or perhaps a special token: encoded whole
FILE = "part int, pos long, doc_id long, n_tokens int, ids array<int>"
WRITER = {"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
          "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
          "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#pos": "false", "parquet.enable.dictionary#n_tokens": "false"}


class Encoder:
    """The library's encoder with a memory of stretches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.size = np.zeros(self.library.get_vocab_size(), np.int64)          # bytes of each id: its spelling has a character per byte
        for piece, i in self.library.get_vocab().items():
            self.size[i] = len(piece)

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches that start with a blank: encoded as one text, which the pre-tokeniser cuts before each, and cut by their bytes."""
        if not stretches:
            return []
        ids = np.array(self.library.encode_batch_fast(["".join(stretches)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(np.fromiter((len(s.encode()) for s in stretches), np.int64, len(stretches)))
        cuts = np.r_[0, np.searchsorted(np.cumsum(self.size[ids]), ends) + 1]
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _learn(self, new: set[str]) -> None:
        """Remembers the ids of new stretches.  Punctuation after a letter or digit is a run of its own."""
        known, older, tail, ask = self.known, self.older, {}, []
        for s in new:
            if s in older:
                known[s] = older[s]
                continue
            head = s.rstrip(punctuation)
            if head != s and head[-1:].isalnum():
                tail[s] = head
            else:
                ask.append(s)
        parts = {x for s, head in tail.items() for x in (head, s[len(head):])}.difference(known, ask)
        known.update((x, older[x]) for x in parts if x in older)
        ask += parts.difference(older)
        plain = [s for s in ask if s[0] == " " and len(s) > 1 and not s.isspace()]
        known.update(zip(plain, self._ids(plain)))
        alone = list(set(ask).difference(plain))
        for s, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False)):
            known[s] = np.array(e.ids, np.int32).tobytes()
        for s, head in tail.items():
            known[s] = known[head] + known[s[len(head):]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian 32-bit numbers."""
        odd = {t for t in texts if t and _ODD.search(t)}
        cut = [_STRETCH.findall(t) if t and t not in odd else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = set().union(*cut).difference(self.known)
        if new:
            self._learn(new)
        get, end = self.known.__getitem__, np.array([END_ID], np.int32).tobytes()
        whole = {t: np.array(e.ids, np.int32).tobytes() for t, e in zip(odd, self.library.encode_batch_fast(list(odd), add_special_tokens=False))} if odd else {}
        return [whole[t] + end if t in whole else b"".join(map(get, u)) + end for t, u in zip(texts, cut)] if whole else [b"".join(map(get, u)) + end for u in cut]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = t.as_py()
        ids.append(d)
        texts.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for b in batches:
            for docs, texts in _batches(b):
                raw = enc.encode(texts)
                n = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(pos + ends - n), pa.array(docs, pa.int64()), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int32)))],
                    ["part", "pos", "doc_id", "n_tokens", "ids"])
                pos += int(ends[-1])
    return run


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Writes the token file of ``docs(doc_id, text)`` and returns its place (a new one in the shared folder unless given)."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens/{uuid.uuid4().hex[:12]}"
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode(tokenizer_path), FILE).write.options(**WRITER).parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of a token file."""
    rows = spark.read.schema(FILE).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())   # a number per file
    before = np.r_[0, np.cumsum([n for _, n in totals], dtype=np.int64)].tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "of int, base long")
    return rows.join(F.broadcast(base), F.col("part") == F.col("of")).select("doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        off, flat = np.asarray(ids.offsets), np.asarray(ids.values, np.uint32)
        crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int64()), pa.array(crc, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids as they were read."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
