"""Token counts by a compiled finite-state transducer.

The transducer reads bytes. From the root it follows the letters of a stretch without white space; the
transition on white space leads back to the root and is annotated with the number of tokens that the
tokenizer emits for the stretch just read (a tokenizer that drops white space never joins two of them).
It is compiled as stretches occur: one that leaves the known states is counted by the tokenizer library
and its path is added, until the table is full. Counts of stretches that did not fit are remembered apart.

A buffer is run as chunks of equal length, all side by side. The state map of a chunk with white space in
it is constant after the first such byte; a scan over the chunks hands each one's exit state to the next
and only the bytes before its first white space are run again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm.tokens import loaded
from vigil.llm.words import slices, texts_of

#: Counts remembered for stretches that are not in the table.
REMEMBERED = 1_000_000
#: States and byte classes of the table at most (4 bytes each), and the longest stretch that is compiled.
STATES, CLASSES, LONGEST = 300_000, 96, 40
CHUNK = 256
_DEAD, _ROOT = 0, 1
_GAP, _OTHER = 0, 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class CountingTransducer:
    def __init__(self, path: str, states: int = STATES, chunk: int = CHUNK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.chunk = states, chunk
        self.classes = np.where(_SPACE, _GAP, _OTHER).astype(np.int32)
        self.used = 2
        self.table = np.zeros(states * CLASSES, np.int32)
        self.table[:: CLASSES] = _ROOT  # white space leads back to the root
        self.emitted = np.full(states, -1, np.int32)
        self.size = 2
        self.apart: dict[bytes, int] = {}

    def count_tokens(self, stretches: list[bytes]) -> list[int]:
        found = self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in stretches], add_special_tokens=False)
        return [len(e) for e in found]

    def compile(self, stretch: bytes, tokens: int) -> bool:
        """Adds the path of a stretch (folded to lower case); false if the table has no room for it."""
        if len(stretch) > LONGEST or self.size + len(stretch) > self.limit:
            return False
        table, state = self.table, _ROOT
        for b in stretch.translate(_FOLD):
            c = int(self.classes[b])
            if c == _OTHER:
                if self.used == CLASSES:
                    return False
                c = self.classes[b] = self.used
                if 97 <= b <= 122:
                    self.classes[b - 32] = c
                self.used += 1
            to = int(table[state * CLASSES + c])
            if to == _DEAD:
                to = table[state * CLASSES + c] = self.size
                self.size += 1
            state = to
        self.emitted[state] = tokens
        return True

    def trace(self, codes: np.ndarray) -> np.ndarray:
        """The state after each byte. codes: byte classes, as many as whole chunks, white space last."""
        n = self.chunk
        columns = np.ascontiguousarray(codes.reshape(-1, n).T)
        lanes = columns.shape[1]
        out = np.empty((n, lanes), np.int32)
        state = np.full(lanes, _ROOT, np.int32)
        at = np.empty(lanes, np.int32)
        for k in range(n):
            np.multiply(state, CLASSES, out=at)
            at += columns[k]
            np.take(self.table, at, out=out[k])
            state = out[k]
        gap = columns == _GAP
        head = np.where(gap.any(0), gap.argmax(0), n)  # bytes whose states depend on the chunk before
        todo = np.flatnonzero(head[1:] > 0) + 1
        while len(todo):  # a chunk is ready once the one before it has its final states
            ready = np.ones(len(todo), bool)
            ready[1:] = (np.diff(todo) > 1) | (head[todo[:-1]] < n)
            now = todo[ready]
            state = out[n - 1, now - 1].copy()
            for k in range(int(head[now].max())):
                on = head[now] > k
                state[on] = self.table[state[on] * CLASSES + columns[k, now[on]]]
                out[k, now[on]] = state[on]
            todo = todo[~ready]
        return out.T.ravel()

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        joined = b" ".join(texts) + b" "
        joined += b" " * (-len(joined) % self.chunk)
        buffer = np.frombuffer(joined, np.uint8)
        gap = _SPACE[buffer]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        states = self.trace(self.classes[buffer])[ends - 1]
        tokens = np.where(states == _DEAD, -1, self.emitted[states]).astype(np.int64)
        lost = np.flatnonzero(tokens < 0)
        if any(s in joined for s in self.special):  # such strings are found before letters are folded
            odd = [k for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if any(s.lower() in joined[a:b].lower() for s in self.special)]
            lost = np.union1d(lost, odd).astype(int)
        if len(lost):
            words = [joined[a:b] for a, b in zip(starts[lost].tolist(), ends[lost].tolist(), strict=True)]
            fresh = list(set(filterfalse(self.apart.__contains__, words)))
            found = dict(zip(fresh, self.count_tokens(fresh), strict=True))
            tokens[lost] = [found[w] if w in found else self.apart[w] for w in words]
            for w, n in found.items():
                special = any(s.lower() in w.lower() for s in self.special)
                if (special or not self.compile(w, n)) and len(self.apart) < REMEMBERED:
                    self.apart[w] = n
        sums = np.concatenate([[0], np.cumsum(tokens)])
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        return np.diff(sums[bounds])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), one row per row of `docs`.

    The tokenizer must drop white space and fold case, as word-level BPE files with such a normaliser do.
    Null texts count as empty: 0 bytes, 0 tokens. Special strings inside a text count as the library has
    them. Null and repeated ids pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(CountingTransducer, tokenizer)
        for batch in batches:
            texts = texts_of(batch.column(1))
            if texts:
                n = np.concatenate([counter(texts[a:b]) for a, b in slices(texts)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
