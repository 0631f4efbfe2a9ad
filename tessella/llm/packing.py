"""Vector bin packing with the dot-product heuristic.

Examples have three sizes: tokens, segments (one a piece) and loss-bearing tokens. A sequence is a bin with a limit on
each. Into the open bin goes, of the pieces that fit whole, the one with the largest dot product of its sizes and the
bin's remaining room (both scaled by the limits); where none fits, one is cut to fill the bin. Every task packs the rows
it has read, in windows, and nothing is shuffled; a task's last ids are laid into sequences of power-of-two lengths,
which aren't padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tessella.llm.tokens import default_path, encoded

#: Pieces from which a bin chooses at a time.
POOL = 512


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


class Packer:
    """Places examples (key, tokens, loss) one after another; placed pieces come out as (key, start, length, sequence, offset).

    An example's loss-bearing tokens are its last ones. cut: whether an example may be cut; if not, one that exceeds a
    limit alone is refused with ValueError.
    """

    def __init__(self, limits: Limits = Limits(), cut: bool = True, pool: int = POOL):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.key: list = []
        self.start: list[int] = []
        self.size: list[int] = []
        self.loss: list[int] = []
        self.sequence = 0
        self.out: list[tuple] = []

    def add(self, key, tokens: int, loss: int) -> None:
        most = self.limits
        if not self.cut and (tokens > most.tokens or loss > most.loss):
            raise ValueError(f"example {key!r} has {tokens} tokens, {loss} loss-bearing: over the limits")
        start = 0
        while self.cut and tokens - start >= most.tokens and self._loss(tokens, loss, start, most.tokens) <= most.loss:
            self.out.append((key, start, most.tokens, self.sequence, 0))
            self.sequence += 1
            start += most.tokens
        if tokens > start:
            self.key.append(key)
            self.start.append(start)
            self.size.append(tokens - start)
            self.loss.append(min(loss, tokens - start))
        if len(self.key) >= self.pool:
            self.fill(self.pool // 2)

    @staticmethod
    def _loss(tokens: int, loss: int, start: int, length: int) -> int:
        """Loss-bearing tokens in a part, if the last loss tokens bear loss."""
        return max(0, min(start + length, tokens) - max(start, tokens - loss))

    def fill(self, leave: int) -> None:
        """Close bins until at most leave pieces wait, or (leave 0) all are placed."""
        most = self.limits
        size, loss = np.array(self.size, np.int64), np.array(self.loss, np.int64)
        start, waits = np.array(self.start, np.int64), np.ones(len(size), bool)
        n = len(size)
        while n > leave:
            room_t, room_s, room_l, offset = most.tokens, most.segments, most.loss, 0
            if self.cut and not leave and n and size[waits].sum() < most.tokens:
                # the last ids: the largest power of two that they fill
                room_t = 1 << int(size[waits].sum()).bit_length() - 1
            while room_t and room_s and n:
                fits = waits & (size <= room_t) & (loss <= room_l)
                if fits.any():
                    gain = size * (room_t / most.tokens**2) + loss * (room_l / most.loss**2)
                    gain[~fits] = -1.0
                    i = int(gain.argmax())
                    take = int(size[i])
                    waits[i] = False
                    n -= 1
                    room_l -= int(loss[i])
                elif self.cut:
                    # a cut piece's head has the tokens before its loss-bearing ones
                    head = np.minimum(room_t, size - loss + np.minimum(loss, room_l))
                    head[~waits] = 0
                    i = int(head.argmax())
                    take = int(head[i])
                    if not take:
                        break
                    used = max(0, take - int(size[i] - loss[i]))
                    room_l -= used
                    loss[i] -= used
                else:
                    break
                self.out.append((self.key[i], int(start[i]), take, self.sequence, offset))
                start[i] += take
                size[i] -= take
                offset += take
                room_t -= take
                room_s -= 1
            self.sequence += 1
        keep = np.flatnonzero(waits)
        self.key = [self.key[i] for i in keep]
        self.start, self.size, self.loss = start[keep].tolist(), size[keep].tolist(), loss[keep].tolist()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def padded(length: int, limit: int) -> int:
    """The length at which a sequence is stored: its own if a power of two, else the limit."""
    return length if length & (length - 1) == 0 else limit


def _base() -> int:
    """Sequence numbers of a task: its partition's number and 2**32 of its own."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def counted_turns(conversations: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """example_id (conv_id), tokens, loss_tokens of whole conversations (conv_id, role, text): every turn's ids and an
    end id; the turns of role assistant bear loss.

    Null texts count as empty; rows that repeat a turn are turns of their own; turns without conv_id are one conversation;
    an empty table gives none. Counts combine map-side, so a hot conversation makes no large group.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(at) for _, _, at in encoded(batch.column(0), batch.column(2), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) + 1 if sizes else [], pa.int64())], names=["example_id", "bears", "tokens"])

    turns = conversations.select(F.col("conv_id").cast("long"), F.coalesce(F.col("role") == "assistant", F.lit(False)), F.col("text").cast("string"))
    counted = turns.mapInArrow(run, "example_id long, bears boolean, tokens long")
    return counted.groupBy("example_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("tokens")).otherwise(0)).alias("loss_tokens"))


def pack_examples(examples: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Pack rows (example_id, tokens, loss_tokens) of instruction data: example_id, start, length, sequence_id, offset.

    Null counts are 0; an example without tokens is placed nowhere and gives no row; loss_tokens is at most tokens. An
    example over the limits is cut if cut, else refused. Equal or repeated rows are packed one by one. An empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits, cut), _base()
        for batch in batches:
            for key, tokens, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                packer.add(key, tokens, min(loss, tokens))
            yield _placed(packer.drain(), base)
        packer.fill(0)
        yield _placed(packer.drain(), base)

    zero = F.lit(0).cast("long")
    rows = examples.select(F.col("example_id").cast("long"), F.coalesce(F.col("tokens").cast("long"), zero), F.coalesce(F.col("loss_tokens").cast("long"), zero))
    return rows.mapInArrow(run, "example_id long, start long, length long, sequence_id long, offset long")


def _placed(rows: list[tuple], base: int) -> pa.RecordBatch:
    key, start, length, sequence, offset = zip(*rows, strict=True) if rows else ([],) * 5
    arrays = [pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["example_id", "start", "length", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Encode whole texts of docs (doc_id, text), append end_id and pack; every token bears loss.

    One row per piece: doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A null text counts as empty; a null doc_id is packed like any
    other. An empty table gives no rows.
    """
    path = tokenizer or default_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits), _base()
        live: dict[int, tuple] = {}  # by running number: doc_id, the ids not yet placed of, their number left
        count = 0

        def placed() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for key, start, length, sequence, offset in packer.drain():
                doc, ids, left = live[key]
                row = (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + sequence, offset)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                if left == length:
                    del live[key]
                else:
                    live[key] = (doc, ids, left - length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for own, flat, at in encoded(batch.column(0), batch.column(1), path):
                for k, doc in enumerate(own):
                    ids = np.append(flat[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    live[count] = (doc, ids, len(ids))
                    packer.add(count, len(ids), len(ids))
                    count += 1
                yield placed()
        packer.fill(0)
        yield placed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
