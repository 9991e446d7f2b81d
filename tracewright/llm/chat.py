"""Chat formatting as a prefix tree.

Conversations are sorted by the hashes of their growing prefixes, which is a depth-first walk of the tree of
all conversations: neighbours share their longest common beginning.  A packer walks this order and emits each
shared turn once, into packs of bounded size.  Of every node a pack has the place of its text, the position of
its first unit on the path from the root, and the intervals of its ancestors, which are all that its units may
attend to besides the node's own beginning.  Units are code points of the formatted text.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so control strings can't be forged and the original comes back.

Defined results: rows of a conversation are ordered by turn, then role, then text (nulls first); null roles
and texts are empty; repeated rows are repeated turns; rows without conv_id form one conversation without id.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, partitions_for

# Fixed values of the template.
START, STOP = "<|im_start|>", "<|im_end|>"
#: A pack is closed once it has so many units.
PACK_UNITS, PER_PARTITION = 1 << 20, 20_000
PACK = "pack_text string, nodes array<struct<start:int,text_start:int,text_end:int,end:int,position:int,parent:int,ancestors:array<struct<start:int,end:int>>>>, loss array<struct<start:int,end:int>>, conversations array<struct<conv_id:long,leaf:int>>"

_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    # a line end in a role would end it early
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{STOP}\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn doesn't begin where one ended")
        line, stop = text.index("\n", at), text.index(STOP, at)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text[at + len(START) : line], flags=re.S)
        turns.append((role, unescape(text[line + 1 : stop])))
        at = stop + len(STOP) + 1
    return turns


class Packer:
    """Takes conversations in depth-first order; ``close`` gives the pack so far and begins another."""

    def __init__(self):
        self.begin()

    def begin(self) -> None:
        self.text: list[str] = []
        self.units = 0
        self.nodes, self.loss, self.conversations = [], [], []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, body in turns[shared:]:
            piece, a, b = format_turn(role, body)
            above = self.nodes[self.path[-1][1]] if self.path else None
            ancestors = [] if above is None else [*above["ancestors"]]
            if above is not None:
                # a parent that stands right before its child lengthens the interval
                if ancestors and ancestors[-1]["end"] == above["start"]:
                    ancestors[-1] = {"start": ancestors[-1]["start"], "end": above["end"]}
                else:
                    ancestors.append({"start": above["start"], "end": above["end"]})
            position = above["position"] + above["end"] - above["start"] if above else 0
            at = self.units
            self.nodes.append({"start": at, "text_start": at + a, "text_end": at + b, "end": at + len(piece), "position": position, "parent": self.path[-1][1] if self.path else -1, "ancestors": ancestors})
            if role == "assistant":
                self.loss.append({"start": at + a, "end": at + b})
            self.text.append(piece)
            self.units += len(piece)
            self.path.append(((role, body), len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def close(self):
        out = "".join(self.text), self.nodes, self.loss, self.conversations
        self.begin()
        return out


def read_back(text: str, nodes: list[dict], loss: list[dict], leaf: int) -> tuple[list[tuple[str, str]], str, int]:
    """Turns, text under the loss mask and formatted length of one conversation, from its pack alone."""
    if leaf < 0:
        return [], "", 0
    own = nodes[leaf]
    spans = [(i["start"], i["end"]) for i in own["ancestors"]] + [(own["start"], own["end"])]
    formatted = "".join(text[a:b] for a, b in spans)
    if own["position"] + own["end"] - own["start"] != len(formatted):
        raise ValueError("position ids and attention intervals differ")
    masked, at = [], leaf
    while at >= 0:
        node = nodes[at]
        if (node["text_start"], node["text_end"]) in loss:
            masked.append(unescape(text[node["text_start"] : node["text_end"]]))
        at = node["parent"]
    return parse_turns(formatted), "".join(reversed(masked)), len(formatted)


def chat_packs(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text) as packs of a prefix tree."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = whole.withColumn("path", F.transform(F.slice("rows", 1, 8), lambda r: F.hex(F.xxhash64(r["role"], r["text"]))))
    if partitions is None:
        partitions = partitions_for(turns.count(), PER_PARTITION)
    # ids settle the place of equal paths, so that a crowd of equal conversations spreads over partitions
    salted = whole.withColumn("path", F.array_join("path", "")).withColumn("salt", F.xxhash64("conv_id"))
    ordered = salted.repartitionByRange(partitions, "path", "salt").sortWithinPartitions("path", F.transform("rows", lambda r: F.xxhash64(r["role"], r["text"])), "salt")

    def run(batches):
        packer, names = Packer(), ["pack_text", "nodes", "loss", "conversations"]
        kinds = [pa.string(), pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "text_start", "text_end", "end", "position", "parent")] + [("ancestors", pa.list_(span))])), pa.list_(span), pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packer.close(), kinds)], names)
        for batch in batches:
            for conv_id, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(conv_id, [(r["role"], r["text"]) for r in rows])
                if packer.units >= PACK_UNITS or len(packer.conversations) >= PER_PARTITION:
                    yield pack()
        if packer.conversations:
            yield pack()

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return in_arrow(ordered.select("conv_id", "rows"), run, PACK)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digests(packs: DataFrame) -> DataFrame:
    """Read every conversation back from its pack: counts and digests."""

    def run(batches):
        for batch in batches:
            for text, nodes, loss, conversations in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = {(s["start"], s["end"]) for s in loss}
                rows = []
                for c in conversations:
                    turns, masked, n = read_back(text, nodes, spans, c["leaf"])
                    said = "".join(f"{role}\n{body}\n" for role, body in turns)
                    rows.append((c["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), n))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in DIGEST.split(", ")])

    return in_arrow(packs, run, DIGEST)
