"""Alignment of two tokenizers: an associative monoid of fragments.

A and B cut the same bytes into tokens; offsets where tokens of both end cut them into groups. A fragment
stands for the tokens that end in a range of bytes: an open head (up to the first common end, its group may
begin before the range), closed groups, and an open tail after the last common end. Two neighbouring
fragments compose: the left one's tail and the right one's head make one closed group. Composition is
associative, so a text may be cut at any byte and put together in any grouping.

Short texts are one range each; the tokens of many texts are aligned in one numpy pass. Long texts are cut
every CHUNK bytes, each range is encoded by a task of its own, and a tree of tasks composes FAN neighbours
at a time. A range's task also gets the units that the range's ends cut through: a unit begins at white
space after a character that is none, and neither tokenizer joins across that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.tokens import ByteLevelIds, byte_letters, loaded
from vigil.llm.words import slices
from vigil.settings import cut

#: Bytes of a range of a long text, and how far from a range's end a unit's end is looked for before the range is moved there.
CHUNK, REACH = 1 << 16, 1 << 12
#: Neighbouring fragments that one step of the tree composes.
FAN = 8
#: Bytes of short texts that are aligned in one numpy pass, about.
PIECE = 1 << 18
#: Pairs that are counted in one numpy pass.
PASS = 1 << 20
#: Pairs with at least this share of all links (1 / COMMON) are looked up in the tasks; there are COMMON such pairs at most.
COMMON = 1 << 18


class Fragment(NamedTuple):
    """Ids are decimal, joined by commas; `closed` tells whether there is a common end. n_a < 0: bytes are lost in the tokens."""

    n_a: int
    n_b: int
    closed: bool
    head_a: bytes
    head_b: bytes
    body: bytes  # groups after the head: a1,a2|b1;a3|b2
    tail_a: bytes
    tail_b: bytes
    links: bytes  # uint64 a << 32 | b for every common end


EMPTY = Fragment(0, 0, False, b"", b"", b"", b"", b"", b"")
LOST = EMPTY._replace(n_a=-1)


def _join(by: bytes, *parts: bytes) -> bytes:
    return by.join(p for p in parts if p)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; EMPTY is neutral, LOST absorbs."""
    if x.n_a < 0 or y.n_a < 0:
        return LOST
    n_a, n_b, links = x.n_a + y.n_a, x.n_b + y.n_b, x.links + y.links
    if not x.closed:
        return y._replace(n_a=n_a, n_b=n_b, links=links, head_a=_join(b",", x.head_a, y.head_a), head_b=_join(b",", x.head_b, y.head_b))
    tail_a, tail_b = _join(b",", x.tail_a, y.head_a), _join(b",", x.tail_b, y.head_b)
    if not y.closed:
        return x._replace(n_a=n_a, n_b=n_b, links=links, tail_a=tail_a, tail_b=tail_b)
    return Fragment(n_a, n_b, True, x.head_a, x.head_b, _join(b";", x.body, tail_a + b"|" + tail_b, y.body), y.tail_a, y.tail_b, links)


class Aligner:
    """Fragments of texts under a byte-level BPE file (A) and a SentencePiece file that adds a space in front (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevelIds(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.tokenizer.encode_special_tokens = True
        byte_of = {chr(letter): k for k, letter in byte_letters().items()}
        words = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for t, k in words.items():
            self.bytes_a[k] = bytes(byte_of[c] for c in t) if set(t) <= byte_of.keys() else t.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        # an id of A and what follows it inside its group and at its end, then the same for B
        self.names = [b"%d%s" % (k, end) for k in range(len(self.bytes_a)) for end in (b",", b"|")]
        self.names += [b"%d%s" % (k, end) for k in range(len(self.bytes_b)) for end in (b",", b";")]
        # white space that no piece holds after another character begins a unit; all other white space is part of one
        inside = {y for p in pieces for x, y in zip(p, p[1:], strict=False) if not (x.isspace() or x == "▁")}
        begins = "".join(c for c in " \t\n\v\f" if ("▁" if c == " " else c) not in inside)
        if " " not in begins:
            raise ValueError("a piece crosses a space")
        self.edges = re.compile(rf"(?<=\S)[{begins}]")

    def tokens(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B of each text that begins with a unit; None where they do not spell its bytes."""
        # B puts a space in front of what is not empty; other units follow a letter, whose tokens are taken off again
        own = [u[0] != " " or u == " " for u in units]
        coded_b = self.b.encode(["a" + u if o else u[1:] for u, o in zip(units, own, strict=True)], num_threads=1)
        texts, found = [u.encode() for u in units], []
        for text, after, in_a, b in zip(texts, own, self.a(texts), coded_b, strict=True):
            extra = 2 if after else 0
            while extra > 0:
                extra -= len(self.bytes_b[b[0]])
                b = b[1:]
            a = np.frombuffer(in_a, np.uint32).astype(np.int64)
            spelled = extra == 0 and b"".join(map(self.bytes_b.__getitem__, b)) == text == b"".join(map(self.bytes_a.__getitem__, a.tolist()))
            found.append((a, np.array(b, np.int64)) if spelled else None)
        return found

    def groups(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> list[bytes]:
        """The ids of A and B by group, each with the sign that follows it (`;` after the last of a group)."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        items = np.concatenate([a * 2 + last_a, (len(self.bytes_a) + b) * 2 + last_b])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        return [self.names[k] for k in items[order].tolist()]

    def fragment(self, a: np.ndarray, b: np.ndarray, low: int, high: int) -> Fragment:
        """Of the tokens a and b of some text: the fragment of those that end after byte `low` and not after `high`."""
        a_ends, b_ends = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        of_a, of_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
        a, a_ends, b, b_ends = a[of_a], a_ends[of_a], b[of_b], b_ends[of_b]
        both, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        group_a, group_b = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        # names end with `|` or `;` at the end of what a group has here, and the tail is a group of its own
        parts = b"".join(self.groups(a, group_a, b, group_b))
        links = (a[at_a].astype(np.uint64) << np.uint64(32) | b[at_b].astype(np.uint64)).tobytes()
        tail_a, tail_b = (b",".join(b"%d" % k for k in ids[g == len(both)].tolist()) for ids, g in ((a, group_a), (b, group_b)))
        if not len(both):
            return Fragment(len(a), len(b), False, tail_a, tail_b, b"", b"", b"", b"")
        closed = parts.split(b";")[: len(both)]
        head_a, _, head_b = closed[0].partition(b"|")
        return Fragment(len(a), len(b), True, head_a, head_b, b";".join(closed[1:]), tail_a, tail_b, links)

    def wholes(self, texts: list[str | None]) -> list[tuple[int, int, bytes, np.ndarray]]:
        """Of each whole text: numbers of tokens, groups and links; all texts are aligned as one stream."""
        found = self.tokens([" " + t for t in texts if t])
        kept = iter(found)
        each = [next(kept) if t else None for t in texts]
        counts = np.array([(0, 0) if t is None else (len(t[0]), len(t[1])) for t in each], np.int64).reshape(-1, 2)
        some = [t for t in each if t is not None]
        if not some:
            return [(0, 0, b"", np.empty(0, np.uint64))] * len(texts)
        a, b = (np.concatenate([t[k] for t in some]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        both, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        names = self.groups(a, np.searchsorted(both, a_ends), b, np.searchsorted(both, b_ends))
        links = a[at_a].astype(np.uint64) << np.uint64(32) | b[at_b].astype(np.uint64)
        stop = np.cumsum(counts.sum(1)).tolist()
        # a text's last token of A is at one of its common ends, so its links are those up to that token
        to = np.searchsorted(at_a, np.cumsum(counts[:, 0])).tolist()
        return [
            (n_a, n_b, b"".join(names[s0:s1])[:-1], links[l0:l1])
            for (n_a, n_b), s0, s1, l0, l1 in zip(counts.tolist(), [0, *stop], stop, [0, *to], to, strict=False)
        ]

    def ranges(self, text: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
        """(begin, low, high, end) of each range (low, high] and the units (from begin to end) that it meets.

        Ranges end every `chunk` bytes, in the middle of a unit or character; where the unit there has no
        end within REACH on both sides, at the unit's end.
        """
        low = begin = 0
        while low < len(text):
            high = low + chunk
            if high >= len(text):
                yield begin, low, len(text), len(text)
                return
            at = max(low, high - REACH)
            around = [at + len(w) for w in self._cuts(text[at : high + REACH])]
            before, after = [p for p in around if begin < p <= high], [p for p in around if p > high]
            if before and after:
                yield begin, low, high, after[0]
                begin = before[-1]
            else:
                reach = REACH
                while not after and high + reach < len(text):
                    reach *= 2
                    after = [p for p in (high - 8 + len(w) for w in self._cuts(text[max(0, high - 8) : high + reach])) if p > high]
                high = after[0] if after else len(text)
                yield begin, low, high, high
                begin = high
            low = high

    def _cuts(self, window: bytes) -> list[bytes]:
        """The parts of `window` before each place in it where a unit begins."""
        # characters cut off at its ends are no white space that begins units, nor are their bytes (as Latin-1 marks)
        seen = window.decode("utf-8", "surrogateescape")
        return [seen[: m.start()].encode("utf-8", "surrogateescape") for m in self.edges.finditer(seen) if not "\udc80" <= seen[m.start() - 1] <= "\udcff"]

    def part(self, units: bytes, low: int, high: int) -> Fragment:
        """The fragment of bytes (low, high] of some units."""
        found = self.tokens([units.decode()])[0]
        return LOST if found is None else self.fragment(*found, low, high)


_DONE = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"
_OPEN = "row long, doc_id long, part long, parts long, n_a long, n_b long, closed boolean, head_a binary, head_b binary, body binary, tail_a binary, tail_b binary, links binary"
_OPEN_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("closed", pa.bool_()), *((c, pa.binary()) for c in ("head_a", "head_b", "body", "tail_a", "tail_b", "links"))])


def _finished(rows: list[tuple[int, int, int, int, bytes, np.ndarray]]) -> pa.RecordBatch:
    out = {name: [] for name in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times")}
    for row, doc_id, n_a, n_b, groups, links in rows:
        pairs, times = np.unique(links, return_counts=True)
        for name, value in zip(out, (row, doc_id, n_a, n_b, len(links), groups.decode(), pairs.tobytes(), times.astype(np.uint32).tobytes()), strict=True):
            out[name].append(value)
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _whole_texts(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    aligner = loaded(Aligner, *paths)
    for batch in batches:
        rows, ids, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
        for begin, end in slices([t or "" for t in texts], PIECE):
            found = aligner.wholes(texts[begin:end])
            yield _finished([(r, i, *f) for r, i, f in zip(rows[begin:end], ids[begin:end], found, strict=True)])


def _cut_texts(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], chunk: int) -> Iterator[pa.RecordBatch]:
    aligner = loaded(Aligner, *paths)
    names = ["row", "doc_id", "part", "parts", "units", "low", "high"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            data = b" " + text.encode()
            ranges = list(aligner.ranges(data, chunk))
            for k in range(0, len(ranges), 64):
                some = [(row, doc_id, k + i, len(ranges), data[b:e], lo - b, hi - b) for i, (b, lo, hi, e) in enumerate(ranges[k : k + 64])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some, strict=True), kinds, strict=True)], names)


def _open(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _OPEN_ARROW, strict=True)], schema=_OPEN_ARROW)


def _parts(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    aligner = loaded(Aligner, *paths)
    for batch in batches:
        for r in batch.to_pylist():
            yield _open([(r["row"], r["doc_id"], r["part"], r["parts"], *aligner.part(r["units"], r["low"], r["high"]))])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Fragment]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield (row["row"], row["doc_id"], row["part"], row["parts"]), Fragment(*(row[c] for c in Fragment._fields))


def _composed(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, part); up to `fan` neighbours become one."""
    of, held = None, []
    for (row, doc_id, part, parts), f in _fragments(batches):
        key = (row, doc_id, part // fan, -(-parts // fan))
        if key != of and held:
            yield _open([(*of, *reduce(compose, held))])
            held = []
        of = key
        held.append(f)
    if held:
        yield _open([(*of, *reduce(compose, held))])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (row, doc_id, _, _), f in _fragments(batches):
        f = f if f.n_a >= 0 else EMPTY
        groups = _join(b";", f.head_a + b"|" + f.head_b, f.body) if f.closed else b""
        yield _finished([(row, doc_id, f.n_a, f.n_b, groups, np.frombuffer(f.links, np.uint64))])


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per row of `docs` (doc_id, text): row, doc_id, n_a, n_b, n_groups, groups, pairs, times.

    `groups` is a1,a2|b1;a3|b2,b3: ids of A and B of each group in order. `pairs` are the distinct pairs of
    tokens that end together (uint64 a << 32 | b, little-endian, ascending) and `times` (uint32) how often each occurs. The bytes are
    a space and the text; special strings are plain text. Null and empty texts, and texts whose tokens do not spell these bytes, have no
    tokens: zeros and empty columns. `row` numbers the rows; ids may be null or repeated. Other columns are
    not read. A unit (text without white space that both tokenizers respect) is encoded by one task, however long it is.
    """
    paths = (path_a, path_b)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    long = F.octet_length("text") > chunk
    short = rows.where(~F.coalesce(long, F.lit(False))).withColumn("row", F.col("row") * 2)
    done = [short.mapInArrow(lambda b: _whole_texts(b, paths), _DONE)]
    cuts = rows.where(long).withColumn("row", F.col("row") * 2 + 1).mapInArrow(lambda b: _cut_texts(b, paths, chunk), "row long, doc_id long, part long, parts long, units binary, low long, high long")
    state = cut(cut(cuts, "ranges").repartition("row", "part").mapInArrow(lambda b: _parts(b, paths), _OPEN), "fragments")
    most = state.agg(F.max("parts")).first()[0] or 0
    while most > 0:
        done.append(state.where("parts = 1").mapInArrow(_ended, _DONE))
        if most == 1:
            break
        dealt = state.where("parts > 1").withColumn("_to", F.expr(f"part div {fan}")).repartition("row", "_to").sortWithinPartitions("row", "part").drop("_to")
        state, most = cut(dealt.mapInArrow(lambda b: _composed(b, fan), _OPEN), "composed"), -(-most // fan)
    return reduce(DataFrame.unionByName, done)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([t for _, t in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["pair", "n"])

    for batch in batches:
        for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            held.append((np.frombuffer(p, np.uint64), np.frombuffer(t, np.uint32)))
            size += len(held[-1][0])
            if size >= PASS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links hold each pair, over all rows of `align`; pairs of one pass are added up before the shuffle."""
    return aligned.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs of the table; the others are handed on."""
    keys, counts, best = table.value
    for batch in batches:
        out = []
        for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            pair, times = np.frombuffer(p, np.uint64).view(np.int64), np.frombuffer(t, np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            out.append((int(times.sum()), int((times * best[at])[hit].sum()) if len(keys) else 0, int((times * counts[at])[hit].sum()) if len(keys) else 0, pair[~hit].tolist(), times[~hit].tolist()))
        kept = [batch.column(k) for k in range(batch.num_columns - 2)]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-2], "n_links", "n_best", "count_sum", "rare", "rare_times"])


def score_links(aligned: DataFrame, common: int = COMMON) -> DataFrame:
    """`aligned` (a stored result of `align`) with n_links, n_best, count_sum in place of pairs and times.

    A pair's count is the number of links that hold it in all rows. n_best: links whose count is the highest
    among the pairs with their id of B; count_sum: the counts of all links added up. Pairs with 1 / `common`
    of all links or more are looked up in a table of at most `common` rows; all others, none of which is
    frequent, meet their counts in a join. An empty table gives no rows.
    """
    spark = aligned.sparkSession
    counts = cut(count_pairs(aligned).withColumn("b", F.expr("pair & 4294967295")), "pairs")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row an id of B
    judged = counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = judged.where(F.col("n") * common >= total).toPandas().sort_values("pair")
    table = spark.sparkContext.broadcast(tuple(often[c].to_numpy(np.int64) for c in ("pair", "n", "best")))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    ordered = aligned.select(*(c for c in aligned.columns if c not in ("pairs", "times")), "pairs", "times")
    known = cut(ordered.mapInArrow(lambda b: _scored(b, table), ", ".join(kept) + ", n_links long, n_best long, count_sum long, rare array<bigint>, rare_times array<bigint>"), "scored")
    each = known.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select(F.col("row").alias("_row"), F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("times"))
    more = each.join(judged, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    joined = known.join(more, F.col("row") == F.col("_row"), "left")
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    return joined.select(*names, "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
