"""Best-fit-decreasing packing of token ids into rows of fixed length (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.tokens import encoder

SCHEMA = "bin_id long, n_tokens int, n_segments int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{id}>, chunk_nos array<int>"


class CapacityTree:
    """A segment tree over the room left in a bin, 0 to capacity: each node holds how many open bins its range has. The tightest bin that fits is found in log2(capacity) steps."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(bin, room) of the open bin with the least room that is at least need; it is taken out."""
        count, i = self.count, need + self.width
        if not count[i]:
            while True:  # up to the first right neighbour with a bin, then down to its leftmost leaf
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.width
        b = self.bins[room].pop()
        self._add(room, -1)
        return b, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions. Lengths are 1 to capacity; the longest goes first, ties in order."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if n == capacity:
            bins.append([i])
            continue
        found = tree.take(n)
        if found is None:
            bins.append([i])
            tree.put(capacity - n, len(bins) - 1)
        else:
            b, room = found
            bins[b].append(i)
            tree.put(room - n, b)
    return bins


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, pad_id: int = 0, block_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``capacity`` token ids that hold the whole texts of docs.

    A text of more than capacity tokens is split into chunks of capacity tokens and a rest; chunk c starts at token c * capacity, so nothing is lost or cut. Chunks are
    packed best-fit-decreasing within blocks of about block_tokens tokens of a partition: memory is bounded, nothing is shuffled, and a block ends with few unfilled rows.
    input_ids and position_ids are little-endian unsigned numbers of 2 bytes (4 if the vocabulary or the capacity needs them), capacity of each: ids padded with pad_id, and positions that start anew with
    each segment (0 in the padding). cu_seqlens are the bounds of the segments, 0 first and n_tokens last; doc_ids and chunk_nos tell whose they are.
    Null, empty and token-less texts have no segment; rows that repeat are packed each; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        top = max([*e.m.ids.values(), *e.m.special.values(), pad_id])
        id_type, pos_type = ("<u2" if top < 1 << 16 else "<u4"), ("<u2" if capacity <= 1 << 16 else "<u4")
        serial = TaskContext.get().partitionId() << 33
        steps = np.arange(capacity, dtype=pos_type)
        schema = None
        held: list[tuple[object, int, np.ndarray]] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            bins = best_fit_decreasing([len(x) for _, _, x in held], capacity)
            for at in range(0, len(bins), 128):
                cols: list[list] = [[] for _ in range(8)]
                for b in bins[at : at + 128]:
                    parts = [held[i] for i in b]
                    bounds = np.concatenate(([0], np.cumsum([len(x) for _, _, x in parts]))).astype(np.int32)
                    n = int(bounds[-1])
                    ids, pos = np.full(capacity, pad_id, id_type), np.zeros(capacity, pos_type)
                    ids[:n] = np.concatenate([x for _, _, x in parts])
                    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        pos[i:j] = steps[: j - i]
                    for c, v in zip(cols, (serial, n, len(parts), ids.tobytes(), pos.tobytes(), bounds, [d for d, _, _ in parts], [c for _, c, _ in parts]), strict=True):
                        c.append(v)
                    serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            held.clear()

        for b in batches:
            if schema is None:
                schema = pa.schema([("bin_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(b.column(0).type)), ("chunk_nos", pa.list_(pa.int32()))])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = e.encode(text.as_py()).astype(id_type)
                for c, at in enumerate(range(0, len(ids), capacity)):
                    held.append((doc, c, ids[at : at + capacity]))
                size += len(ids)
                if size >= block_tokens:
                    yield from packed()
                    size = 0
        if held:
            yield from packed()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA.format(id=kind))


def unpack(row, id_bytes: int = 2) -> Iterator[tuple[object, int, list[int]]]:
    """(doc_id, chunk_no, ids) of each segment of a packed row."""
    ids = np.frombuffer(row["input_ids"], f"<u{id_bytes}")
    for k, (doc, c) in enumerate(zip(row["doc_ids"], row["chunk_nos"], strict=True)):
        yield doc, c, ids[row["cu_seqlens"][k] : row["cu_seqlens"][k + 1]].tolist()


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet at any path Spark can write; the ids of a file's rows, laid end to end, are a matrix of capacity columns."""
    packed.write.mode("errorifexists").parquet(path)
