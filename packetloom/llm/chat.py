"""Chat formatting as a prefix tree.

Every turn is formatted as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts are escaped by a
backslash behind their first character (and a backslash by a second one), so that formatted text holds no control
string but the template's, and the escape can be undone.

Conversations with the same first turns share them: sorted by the hashes of their prefixes, each conversation differs
from the one before it in what follows their common turns, and only that is emitted. This is the depth-first order of
the prefix tree. An emitted turn (a node row) has its place in the stream of its shard, the position id of its first
character (as if its ancestors stood directly before it), the intervals of the stream it may attend to (its ancestors
and itself; those that stand next to each other are one interval, so a path has as many as it has forks, not turns) and the span that the
loss covers (the text of assistant turns). A conversation row then follows with the intervals of its whole path. Units are code points.

A shard is a range of the sorted conversations, cut by Spark, so a first turn that a third of all conversations share is
spread over many shards; each shard emits the turns that are open at its start once more. Equal turns are compared
as text, not only by hash.

Nulls and odd rows: a null text or role is empty; turns are ordered by (turn, role, text) with nulls first, repeated
rows are turns of their own; a null conv_id is one conversation; an empty table gives none. Only ``conv_id``,
``turn``, ``role`` and ``text`` are read. A task holds one conversation and its open path at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table, written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"
#: Strings that some chat template or tokenizer takes for control strings.
_CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>|</?(?:start|end)_of_turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

CONVERSATIONS = "conv_id long, path binary, roles array<string>, texts array<string>"
ROWS = ("shard int, seq long, conv_id long, depth int, start long, length long, position long, "
        "attends array<struct<start: long, stop: long>>, loss_start long, loss_stop long, text string")
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("start", pa.int64()),
    ("length", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("text", pa.string())])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of what the loss covers in it)."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    covered = (len(head), len(head) + len(body)) if role == LEARNED_ROLE else (0, 0)
    return head + body + END, *covered


def read_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn -> one row per conversation."""
    none = object()
    current, digest, path, roles, texts, done = none, b"", [], [], [], []

    def flush():
        columns = list(zip(*done)) if done else [()] * 4
        types = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "path", "roles", "texts"])
        done.clear()
        return batch

    def finish():
        if current is not none:
            done.append((current, b"".join(path), list(roles), list(texts)))
        for x in (path, roles, texts):
            x.clear()

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv_id != current:
                finish()
                current, digest = conv_id, b""
                if len(done) >= 1000:
                    yield flush()
            role, text = role or "", text or ""
            digest = hashlib.blake2b(digest + len(role).to_bytes(8, "big") + role.encode() + text.encode(), digest_size=8).digest()
            path.append(digest)
            roles.append(role)
            texts.append(text)
    finish()
    yield flush()


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order of their paths -> node and conversation rows of one shard."""
    task = TaskContext.get()
    shard, seq, place = task.partitionId() if task else 0, 0, 0
    turns: list[tuple[str, str]] = []  # the open path
    spans: list[list[dict[str, int]]] = []  # per open turn the intervals of its path
    position = [0]
    out: list[tuple] = []

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)
        out.clear()
        return batch

    for batch in batches:
        for conv_id, roles, texts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            own = list(zip(roles.as_py(), texts.as_py()))
            shared = 0
            while shared < min(len(own), len(turns)) and own[shared] == turns[shared]:
                shared += 1
            del turns[shared:], spans[shared:], position[shared + 1:]
            for role, text in own[shared:]:
                formatted, loss_start, loss_stop = format_turn(role, text)
                n = len(formatted)
                above = spans[-1] if spans else []
                if above and above[-1]["stop"] == place:
                    spans.append([*above[:-1], {"start": above[-1]["start"], "stop": place + n}])
                else:
                    spans.append([*above, {"start": place, "stop": place + n}])
                out.append((shard, seq, None, len(turns), place, n, position[-1], spans[-1], loss_start, loss_stop, formatted))
                turns.append((role, text))
                position.append(position[-1] + n)
                place += n
                seq += 1
            out.append((shard, seq, conv_id, len(turns), None, position[-1], None, spans[-1] if spans else [], None, None, None))
            seq += 1
            if len(out) >= 2000:
                yield flush()
    yield flush()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Node rows (``text`` set) and conversation rows (``text`` null) by shard, in the order of ``seq``."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    by_turn = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    gathered = by_turn.select("conv_id", "role", "text").mapInArrow(_gathered, CONVERSATIONS)
    return gathered.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_emitted, ROWS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and conversation rows of whole shards, in order -> what each conversation reads like."""
    open_path: list[tuple] = []  # (sha256 of the turns, sha256 of what the loss covers, its length, formatted length)
    start = (hashlib.sha256(), hashlib.sha256(), 0, 0)
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for conv_id, depth, loss_start, loss_stop, text in zip(*columns):
            if text is not None:
                del open_path[depth:]
                turns, loss, loss_chars, chars = open_path[-1] if open_path else start
                turns, loss = turns.copy(), loss.copy()
                role, body = read_turn(text)
                turns.update(f"{role}\n{body}\n".encode())
                learned = unescape(text[loss_start:loss_stop])
                loss.update(learned.encode())
                open_path.append((turns, loss, loss_chars + len(learned), chars + len(text)))
            else:
                turns, loss, loss_chars, chars = open_path[depth - 1] if depth else start
                out.append((conv_id, depth, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        columns = zip(*out) if out else [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation the digests of its turns and of the text under the loss, from the formatted rows alone."""
    ordered = rows.repartitionByRange("shard").sortWithinPartitions("shard", "seq")
    return ordered.select("conv_id", "depth", "loss_start", "loss_stop", "text").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(written(format_conversations(given.unionByName(extra)), "chat"))
