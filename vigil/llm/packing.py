"""Packing of documents into training sequences by minimum bin slack.

A document longer than a sequence fills whole sequences from its start; its rest, and every shorter
document, is an item. Items are packed in windows of bounded size: the longest item left opens a sequence,
a subset-sum dynamic program over the lengths left (a bitset of reachable sums, with the counts of each
length) finds the selection that comes closest to the room, and backtracking reads it off. Windows are
formed inside the tasks that tokenize, so nothing is shuffled and no task holds more than a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.tokens import ByteLevelIds, loaded
from vigil.llm.words import slices, texts_of

CAPACITY = 2048
END = 1
#: Items that are packed together.
WINDOW = 4096
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset of lengths whose sum is the largest up to `room`; counts: how many there are.

    Longer lengths are tried first and the search ends as soon as the room can be filled exactly. Of equal
    sums the one found first is taken.
    """
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4 ... copies at a time reach every count up to all
            take = min(block, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return list(used.items())


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of `lengths` (each 1 to capacity) by sequence; every index once."""
    by_length: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        by_length.setdefault(n, []).append(k)
    counts = {n: len(v) for n, v in by_length.items()}
    out = []
    for longest in sorted(counts, reverse=True):
        while counts.get(longest):
            counts[longest] -= 1
            pattern = [(longest, 1), *closest({n: c for n, c in counts.items() if c}, capacity - longest)]
            for n, c in pattern[1:]:
                counts[n] -= c
            out.append([by_length[n].pop() for n, c in pattern for _ in range(c)])
    return out


def laid_out(items: list[tuple], capacity: int, slack: float = 1 / 16) -> list[tuple[tuple, int, int]]:
    """(piece, sequence from 0, offset) of the items (doc_id, start, ids, doc_tokens) chosen for one sequence.

    If more than `slack` of it would be padding, the items are cut into sequences whose lengths are powers
    of two, which need none.
    """
    total = sum(len(i[2]) // 4 for i in items)
    sizes = [total] if total >= capacity * (1 - slack) else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    out, number, offset = [], 0, 0
    for name, start, ids, n in items:
        at, length = 0, len(ids) // 4
        while at < length:
            take = min(length - at, sizes[number] - offset)
            out.append(((name, start + at, ids[4 * at : 4 * (at + take)], n), number, offset))
            at, offset = at + take, offset + take
            if offset == sizes[number]:
                number, offset = number + 1, 0
    return out


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of documents with their place: doc_id, start, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A document is its ids under the tokenizer file and `end`; a null or empty text is `end` alone. Pieces of
    a document cover it once, in order; pieces of a sequence follow each other from offset 0 and never
    exceed `capacity`. Rows without doc_id are packed too; rows that repeat are packed as often as they
    come. Where a sixteenth or more of a sequence (the last of a
    window) would be padding, its items are cut into sequences of powers of two instead. An empty table gives no rows; other columns are
    not read. Sequence ids depend on the input's splits, which a retried task sees unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = loaded(ByteLevelIds, tokenizer)
        tail, last = np.uint32(end).tobytes(), TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def place(items: list[tuple]) -> list[tuple]:
            nonlocal last
            rows = []
            for chosen in pack_lengths([len(i[2]) // 4 for i in items], capacity):
                for piece, number, offset in laid_out([items[k] for k in chosen], capacity):
                    rows.append((*piece, last + number, offset))
                last = rows[-1][4] + 1
            return rows

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for begin, stop in slices(texts):
                rows = []
                for name, ids in zip(names[begin:stop], ids_of(texts[begin:stop]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n - n % capacity, capacity):
                        rows.append((name, start, ids[4 * start : 4 * (start + capacity)], n, last, 0))
                        last += 1
                    if n % capacity:
                        waiting.append((name, n - n % capacity, ids[4 * (n - n % capacity) :], n))
                while len(waiting) >= window:
                    rows += place(waiting[:window])
                    waiting = waiting[window:]
                if rows:
                    yield emit(rows)
        if waiting:
            yield emit(place(waiting))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
