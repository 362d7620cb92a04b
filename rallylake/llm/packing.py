"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention looks within a document).
Documents longer than a sequence give whole sequences first. What remains is packed in blocks of
``block`` sequences: documents in descending order of cost go to the sequence of lowest cost that has
room for them; documents that fit nowhere whole are cut to fill the gaps exactly, and what is left
over starts the next block. The last tokens of a partition, fewer than one sequence, form sequences
of power-of-two lengths, which need no padding either.

Each partition packs its own documents, so nothing is shuffled: the ids never leave the task that
made them, and a task holds one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, portions
from rallylake.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def place(lengths: list[int], sequences: int, capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Pack items of the given lengths (each at most ``capacity``) so that all sequences are full.

    The items hold at least ``sequences * capacity`` tokens together. Returns per sequence its pieces
    (item, start, length), and the left-over tokens as (item, start).
    """
    room, cost = np.full(sequences, capacity), np.zeros(sequences)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(sequences)]
    unplaced = []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[item]
        # the lowest-cost sequence of all with room; of equal ones the first
        s = int(np.argmin(np.where(room >= n, cost, np.inf))) if sequences else 0
        if sequences and room[s] >= n:
            out[s].append((item, 0, n))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
        else:
            unplaced.append(item)
    room = room.tolist()
    gaps, left = sorted((s for s in range(sequences) if room[s]), key=lambda s: (-room[s], s)), []
    at = 0
    for item in unplaced:
        start = 0
        while start < lengths[item] and at < len(gaps):
            s = gaps[at]
            n = min(room[s], lengths[item] - start)
            out[s].append((item, start, n))
            room[s] -= n
            start += n
            at += not room[s]
        if start < lengths[item]:
            left.append((item, start))
    return out, left


class Packer:
    """Packs (doc_id, ids) as they come; ``take`` returns the rows that are final."""

    def __init__(self, first_id: int, capacity: int, block: int, linear: float, quadratic: float):
        self.next_id, self.capacity, self.block, self.linear, self.quadratic = first_id, capacity, block, linear, quadratic
        self.held: list[tuple[int | None, np.ndarray, int, int]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Whole sequences of a long document at once, the rest to the block."""
        n = len(ids)
        whole = n // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._sequence([(doc_id, ids[start : start + self.capacity], start, n)])
        if whole < n:
            self.held.append((doc_id, ids[whole:], whole, n))
            self.tokens += n - whole
        if self.tokens >= self.block * self.capacity:
            self._pack(self.block)

    def _sequence(self, pieces: list[tuple]) -> None:
        offset, cost = 0, sum(self.linear * len(p[1]) + self.quadratic * len(p[1]) ** 2 for p in pieces)
        for doc_id, ids, start, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next_id, offset, cost))
            offset += len(ids)
        self.next_id += 1

    def _pack(self, sequences: int) -> None:
        placed, left = place([len(x[1]) for x in self.held], sequences, self.capacity, self.linear, self.quadratic)
        for pieces in placed:
            self._sequence([(self.held[k][0], self.held[k][1][a : a + n], self.held[k][2] + a, self.held[k][3]) for k, a, n in pieces])
        self.held = [(self.held[k][0], self.held[k][1][a:], self.held[k][2] + a, self.held[k][3]) for k, a in left]
        self.tokens = sum(len(x[1]) for x in self.held)

    def finish(self) -> None:
        if self.tokens >= self.capacity:
            self._pack(self.tokens // self.capacity)
        while self.tokens:
            want, pieces = 1 << (self.tokens.bit_length() - 1), []
            self.tokens -= want
            while want:
                doc_id, ids, start, n = self.held.pop()
                pieces.append((doc_id, ids[:want], start, n))
                if len(ids) > want:
                    self.held.append((doc_id, ids[want:], start + want, n))
                want -= min(want, len(ids))
            self._sequence(pieces)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2, block: int = 256, linear: float = 1.0, quadratic: float = 1 / 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, where the piece starts in it, its length and CRC, and
    its sequence and offset there; ``sequence_cost`` is the estimated cost of the sequence.

    ``tokenizer`` is the path of a vocabulary file (default: the public word BPE). Every id of every
    document, with ``end_id`` appended, lies in exactly one piece. Null and empty texts are one token.
    Rows with equal ids or texts are packed each for itself. An empty table gives no rows. A lost
    task packs the same rows of its partition again and gives the same ids.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kinds = [pa.int64()] * 7 + [pa.float64()]
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, block, linear, quadratic)
        encode, end = encoder(path).encode, np.array([end_id], "<u4")

        def rows():
            cols = zip(*packer.take(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for part in portions(batch, 1, 1 << 21):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    packer.add(doc_id, np.append(ids, end).astype("<u4", copy=False))
                if packer.rows:
                    yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, PIECE, "tokens")
