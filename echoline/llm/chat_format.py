"""Chat formatting on token level: conversations become id sequences with a loss mask.

A turn is an opening control, its text and a closing control.  Texts are encoded
segment by segment and never together with a control: controls are reserved ids
(those after the vocabulary) that are spliced between the segments' ids, so no
text can produce one.  Where a text holds a control's string, a backslash is put
behind its first character (one more where there are some already), so that the
formatted text can be read back too.  Segment lengths are summed up to places, and
the mask is the running sum of +1 at the start and -1 at the end of each learned text.

Most conversations lie whole in one input partition and are formatted there; only
those that span several are moved, ordered by (conv_id, turn) over all tasks, so
that a conversation of any size is dealt out too.  The output is written as pieces
of whole turns, closed once they have ``PIECE_IDS`` ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline.llm.common import arrow_map, scratch_path, store

PIECE_IDS = 65_536
#: Conversation ids that are sent to all tasks at once at most; beyond that they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
LONG_SPACE = re.compile(r"(?<=\s{10000})(?=\s)")
WRITTEN = "conv_id long, piece long, whole boolean, n_turns long, ids array<int>, loss_mask array<tinyint>"


@dataclass(frozen=True)
class Template:
    """Controls by role; any other role is written out between ``named``.  Texts of ``learned`` roles are under the mask."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "[ANS]", "</s>"))
    named: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        c = self.controls
        if len(set(c)) < len(c) or any(len(x) < 2 or "\\" in x or set(x[1:]) & {y[0] for y in c} for x in c):
            raise ValueError("controls must differ, have no backslash, and none may hold another's first character after its own")

    @property
    def controls(self) -> list[str]:
        return [c for _, *pair in self.roles for c in pair] + list(self.named)

    def escape(self, text: str) -> str:
        return self._pattern(r"\\*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\+").sub(lambda m: m[0][0] + m[0][2:], text)

    def _pattern(self, between: str) -> re.Pattern:
        return re.compile("|".join(re.escape(c[0]) + between + re.escape(c[1:]) for c in self.controls))


class Segments:
    """Segments of text to ids of a rank file and back, without loss; reserved ids start after the last rank."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.reserved = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < 10_000:
            return self.encoding.encode_ordinary(text)
        # The pattern can't take a million blanks at once: such a run is cut.
        return [i for part in LONG_SPACE.split(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")


def _in_order() -> list:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]


def _assemble(df: DataFrame, path: str, pattern: str, template: Template, alone: bool) -> DataFrame:
    """Pieces of sorted turns.  With ``alone`` no conversation goes on in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Segments(path, pattern)
        code = {c: coder.reserved + k for k, c in enumerate(template.controls)}
        around = {role: (code[a], code[b]) for role, a, b in template.roles}
        r_open, r_text, r_close = (code[c] for c in template.named)
        number = TaskContext.get().partitionId() << 32
        segments: list[list[int]] = []
        learned: list[bool] = []
        ready: list[tuple] = []
        conv, n_turns, n_ids, whole, begun = None, 0, 0, alone, False

        def close(is_whole: bool) -> None:
            nonlocal number, segments, learned, n_turns, n_ids
            ends = np.cumsum([len(s) for s in segments])
            starts = np.concatenate([[0], ends[:-1]])
            steps = np.zeros(ends[-1] + 1, np.int8)
            for at, sign in ((starts, 1), (ends, -1)):
                np.add.at(steps, at[learned], sign)
            ids = np.concatenate([np.asarray(s, np.int32) for s in segments])
            ready.append((conv, number, is_whole, n_turns, ids, np.cumsum(steps[:-1], dtype=np.int8)))
            number, segments, learned, n_turns, n_ids = number + 1, [], [], 0, 0

        def written() -> pa.RecordBatch:
            convs, numbers, wholes, counts, ids, masks = zip(*ready)
            ready.clear()
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
            values = [pa.array(convs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(wholes), pa.array(counts, pa.int64())]
            values += [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (ids, masks)]
            return pa.RecordBatch.from_arrays(values, ["conv_id", "piece", "whole", "n_turns", "ids", "loss_mask"])

        for batch in batches:
            known: dict[str, list[int]] = {}
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if begun and (c != conv or n_ids >= PIECE_IDS):
                    whole = whole and c != conv
                    close(whole)
                    if c != conv:
                        whole = alone
                    if sum(len(r[4]) for r in ready) >= PIECE_IDS:
                        yield written()
                conv, begun = c, True
                role, text = role or "", text or ""
                ids = known.get(text)
                if ids is None:
                    ids = known[text] = coder.encode(template.escape(text))
                if role in around:
                    a, b = around[role]
                    parts = [[a], ids, [b]]
                else:
                    parts = [[r_open], coder.encode(template.escape(role)), [r_text], ids, [r_close]]
                segments += parts
                learned += [False] * (len(parts) - 2) + [role in template.learned, False]
                n_turns, n_ids = n_turns + 1, n_ids + sum(map(len, parts))
        if segments:
            close(whole)
        if ready:
            yield written()

    return arrow_map(df, run, WRITTEN)


def format_conversations(turns: DataFrame, tokenizer_path: str, pattern: str, out: str, template: Template = Template()) -> None:
    """Write ``turns`` (conv_id, turn, role, text; others are left out) as pieces below ``out``.

    Turns go by (turn, role, text), nulls first; repeated rows are turns of their own.  A null
    role or text is empty, rows without conv_id are one conversation.  Texts of any length are
    whole.  No turns: no pieces.  Pieces: conv_id, piece (ascending within a conversation),
    whole (the conversation has no other piece), n_turns, ids, loss_mask (1 under the mask).
    """
    spark = turns.sparkSession
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role"), F.col("text"))
    places = turns.select("conv_id", F.spark_partition_id().alias("place"))
    spread = store(places.groupBy("conv_id").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select(F.col("conv_id").alias("spread")), "spread")
    small = spread.count() <= MAX_BROADCAST
    on = F.col("conv_id").eqNullSafe(F.col("spread"))
    here = turns.join(F.broadcast(spread) if small else spread, on, "left_anti")
    moved = turns.join(F.broadcast(spread) if small else spread, on, "left_semi")
    if small:
        _write(_assemble(here.sortWithinPartitions(*_in_order()), tokenizer_path, pattern, template, True), f"{out}/moved=0")
    else:
        moved = turns
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not small or not spread.isEmpty():
        moved = moved.repartitionByRange(n, *_in_order()).sortWithinPartitions(*_in_order())
        _write(_assemble(moved, tokenizer_path, pattern, template, False), f"{out}/moved=1")
    pieces = spark.read.parquet(out)
    if not pieces.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or("whole").alias("whole")).where("whole AND n > 1").isEmpty():
        raise RuntimeError("a conversation was found in two partitions: the input's partitions changed between two runs")


def _write(pieces: DataFrame, path: str) -> None:
    pieces.write.option("compression", "zstd").parquet(path)


def read_pieces(spark: SparkSession, out: str) -> DataFrame:
    """The written pieces, and start: the number of the conversation's ids before the piece."""
    pieces = spark.read.parquet(out).drop("moved")
    sizes = pieces.where("NOT whole").select("conv_id", "piece", F.size("ids").cast("long").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("piece").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # Numbers of pieces that are whole and of others may meet: only the others are joined.
    split = pieces.where("NOT whole").join(starts, F.col("piece") == F.col("p")).drop("p")
    return pieces.where("whole").withColumn("start", F.lit(0).cast("long")).unionByName(split)


READ = "conv_id long, piece long, whole boolean, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"


def read_turns(pieces: DataFrame, tokenizer_path: str, pattern: str, template: Template = Template()) -> DataFrame:
    """Texts from written pieces, a row each: turns (role, line end, text, line end of each),
    loss (all text under the mask), both without escapes as UTF-8, loss_chars and formatted_chars
    (characters of the text with controls and escapes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Segments(tokenizer_path, pattern)
        opens = {coder.reserved + 2 * k: role for k, (role, _, _) in enumerate(template.roles)}
        first_named = coder.reserved + 2 * len(template.roles)
        length = np.array([len(c) for c in template.controls])
        for batch in batches:
            rows = []
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("ids", "loss_mask")]
            for row in range(batch.num_rows):
                ids, mask = (a[row].values.to_numpy(zero_copy_only=False) for a in lists)
                at = np.flatnonzero(ids >= coder.reserved)
                controls = ids[at]
                texts = [coder.decode(ids[a + 1 : b].tolist()) for a, b in zip(at, at[1:])]
                chars = int(length[controls - coder.reserved].sum()) + sum(map(len, texts))
                turns, role = [], ""
                for control, text in zip(controls.tolist(), texts):
                    if control in opens:
                        turns.append(f"{opens[control]}\n{template.unescape(text)}\n")
                    elif control == first_named:
                        role = template.unescape(text)
                    elif control == first_named + 1:
                        turns.append(f"{role}\n{template.unescape(text)}\n")
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
                loss = "".join([template.unescape(coder.decode(ids[a:b].tolist())) for a, b in zip(edges[::2], edges[1::2])])
                rows.append(("".join(turns).encode(), loss.encode(), len(loss), chars))
            names = ["conv_id", "piece", "whole", "n_turns"]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            made = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(kept + made, names + ["turns", "loss", "loss_chars", "formatted_chars"])

    return arrow_map(pieces.select("conv_id", "piece", "whole", "n_turns", "ids", "loss_mask"), run, READ)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(spark: SparkSession, out: str, tokenizer_path: str, pattern: str, template: Template = Template()) -> DataFrame:
    """A row a conversation, from the written files: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation of one piece is summed where it was read.  Pieces of others meet by conv_id
    and are hashed one after the other: a sum over a conversation has to see it in order, but
    never holds more than a piece."""
    pieces = spark.read.parquet(out)
    whole = read_turns(pieces.where("whole"), tokenizer_path, pattern, template).select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), "loss_chars", F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in DIGEST.split(", ")]

        def row(s) -> pa.RecordBatch:
            values = [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if state is not None and state[0] != r["conv_id"]:
                    yield row(state)
                    state = None
                state = state or [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += r["n_turns"]
                state[2].update(r["turns"])
                state[3] += r["loss_chars"]
                state[4].update(r["loss"])
                state[5] += r["formatted_chars"]
        if state is not None:
            yield row(state)

    parts = read_turns(pieces.where("NOT whole"), tokenizer_path, pattern, template).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(arrow_map(parts, run, DIGEST))
