"""Chat formatting from an event log.

``fold`` rebuilds the final messages of a log of events (conv_id, message, turn, seq, kind, role, text):

* ``open`` starts a message, ``delta`` appends to it;
* ``edit`` replaces what the message holds so far;
* ``regenerate`` empties it; deltas after that build the new version.

An edit or a regeneration also ends the branch below it: messages of later turns that were opened before it are dropped.  The events of one
message meet in one group, whatever the length of its conversation; what earlier turns did to later ones is a running
maximum over blocks of turns.

``render`` puts messages in order by a range shuffle, so a conversation of any length spreads over tasks, and packs whole turns into
parts of about ``PART_CHARS``.  A part holds the formatted text and the loss mask (where assistant texts stand in it).

Template: ``<turn role>`` line end, text, line end ``</turn>`` line end.  In roles and texts a backslash becomes two, ``<`` becomes ``\\l`` and ``>``
becomes ``\\g`` (in roles a line end becomes ``\\n``), so no text can hold a mark and every text is got back.

Defined cases: null text or role is empty; null turns come first; rows with equal turns are separate turns, in order of their roles; a null
conv_id is a conversation; a message without events but ``open`` is an empty turn; extra columns are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20
DELTA_CHARS = 400
TURN_BLOCK = 4096
EVENTS = "conv_id long, message long, turn long, seq long, kind string, role string, text string"


def log_of(conversations: DataFrame) -> DataFrame:
    """The table ``conversations(conv_id, turn, role, text)`` as a log: each row opens a message and streams its text in deltas."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("message"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.ceil(F.length("text") / DELTA_CHARS).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        i.cast("long").alias("seq"), F.when(i == 0, "open").otherwise("delta").alias("kind"),
        F.when(i == 0, "").otherwise(F.substring("text", (i - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS))).alias("text")))
    return (rows.withColumn("e", F.explode(deltas))
            .select("conv_id", "message", "turn", "e.seq", "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, turn, role, text) of the messages that are left, each with its final text."""
    reset = F.col("kind").isin("open", "edit", "regenerate")
    e = events.withColumn("kept", F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))))
    m = (e.groupBy("conv_id", "message", "turn").agg(
        F.max(F.when(reset, F.col("seq"))).alias("from"), F.min(F.when(F.col("kind") == "open", F.col("seq"))).alias("opened"), F.max("role").alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("cut"),
        F.array_sort(F.collect_list(F.struct("seq", "kept"))).alias("log")))
    text = F.array_join(F.transform(F.filter("log", lambda x: x["seq"] >= F.coalesce(F.col("from"), x["seq"])), lambda x: x["kept"]), "")
    m = m.select("conv_id", "message", "turn", "opened", "cut", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    return m.join(_ended(m), ["conv_id", "message"], "left_anti") if "cut" in m.columns else m


def _ended(m: DataFrame) -> DataFrame:
    """(conv_id, message) of messages opened before an edit or regeneration of an earlier turn."""
    cuts = (m.filter("cut is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max("cut").alias("cut"))
            .withColumn("block", F.floor(F.col("turn") / TURN_BLOCK)))
    whole = cuts.groupBy("conv_id", "block").agg(F.max("cut").alias("top"))
    rows = (m.filter("turn is not null").join(cuts.select("conv_id").distinct(), "conv_id", "left_semi")
            .select("conv_id", "message", "turn", "opened", F.lit(None).cast("long").alias("cut")).withColumn("block", F.floor(F.col("turn") / TURN_BLOCK)))
    both = rows.unionByName(cuts.select("conv_id", F.lit(None).cast("long").alias("message"), "turn", F.lit(None).cast("long").alias("opened"), "cut", "block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.select("conv_id", "block").distinct().join(whole, ["conv_id", "block"], "left").withColumn("above", F.max("top").over(earlier)).drop("top")
    return (both.withColumn("near", F.max("cut").over(inside)).join(blocks, ["conv_id", "block"])
            .filter("message is not null and (near > opened or above > opened)").select("conv_id", "message"))


def _escaped(c, more: bool = False):
    for a, b in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), *((("\n", "\\n"),) if more else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">", "n": "\n"}.get(m[1], m[1]), s, flags=re.S)


PARTS = "conv_id long, part long, formatted string, loss array<struct<s:int,e:int>>"
_PARTS_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, now, text, loss, size, out = TaskContext.get().partitionId() << 32, None, [], [], 0, []
    for b in batches:
        for conv, role, escaped, learn in zip(*(b.column(i).to_pylist() for i in range(4))):
            if text and (conv != now or size >= PART_CHARS):
                out.append({"conv_id": now, "part": part, "formatted": "".join(text), "loss": loss})
                part, text, loss, size = part + 1, [], [], 0
            now, head = conv, f"<turn {role}>\n"
            if learn:
                loss.append({"s": size + len(head), "e": size + len(head) + len(escaped)})
            text.append(f"{head}{escaped}\n</turn>\n")
            size += len(text[-1])
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, _PARTS_ARROW)
                out = []
    if text:
        out.append({"conv_id": now, "part": part, "formatted": "".join(text), "loss": loss})
    yield pa.RecordBatch.from_pylist(out, _PARTS_ARROW)


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss): the conversations in parts of whole turns; ``part`` rises through a conversation."""
    order = ["conv_id", "turn", "plain", "message"]
    m = messages.select("conv_id", "turn", F.col("role").alias("plain"), "message", _escaped(F.col("role"), True).alias("role"), _escaped(F.col("text")).alias("text"),
                        (F.col("role") == LOSS_ROLE).alias("learn"))
    return m.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "learn").mapInArrow(_pack, PARTS)


_TURN = re.compile(r"<turn ([^>]*)>\n([^<]*)\n</turn>\n")
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, state = object(), None

    def done():
        n, turns, chars, loss, size = state
        return {"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}
    for b in batches:
        out = []
        for conv, formatted, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
            if state is None or conv != now:
                if state is not None:
                    out.append(done())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in _TURN.findall(formatted):
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            for x in loss:
                learnt = unescape(formatted[x["s"]:x["e"]])
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([done()], schema)


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation with digests of what the formatted parts say; parts stream by in order, none is kept."""
    return (parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss").mapInArrow(_read, READ))
