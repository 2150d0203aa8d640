"""TF-IDF retrieval over chunks, batch answering with checked citations, and refusal tuning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions import text as X
from vigil.operators.nearest import Best
from vigil.settings import cut, scratch_path, trim

QUESTIONS, TEXTS = 2048, 2048  # rows in a block of either side of a search
PARTS = 32  # parts of the texts, of which each gives k rows a question
DENSE = 0.01  # share of all pairs from which a term is multiplied as a dense column
SIEVE = 1 << 23  # bits that mark the terms of all questions, or the ids of all texts found
POSTINGS = 1 << 20  # occurrences of terms in a block of the index
ENTRIES = 1 << 21  # distinct terms of blocks that a task counts at once, about
ROWS, SLICE = 1 << 15, 1 << 11  # rows of a batch that leaves a block: occurrences of terms, texts
BATCH = "8m"  # bytes of a batch of rows that goes to Python
TURN = 21  # bits by which the hash of a pair's second word is turned
PAIRS = 1 << 20  # products of weights that a search lists at once


@dataclass
class TextIndex:
    """Texts in blocks of `stored`, each of which holds its words once: the texts' ids, where their occurrences start (`starts`),
    numbers of terms (`at`, as differences) and `tfs`, the `words`, the pairs of them that are terms as well, in how many
    texts of the block every term is (`ns`), and in how many of all `n` texts (`dfs`, twice the number, in the order of the
    terms' hashes; odd where the block gives the term to the vocabulary)."""

    stored: DataFrame
    n: int

    @property
    def blocks(self) -> DataFrame:
        """ids and terms of every block."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row in _each(batches):
                yield pa.RecordBatch.from_arrays([_listed(batch.column("ids")[row].values), _listed(_terms(batch, row))], ["ids", "terms"])

        return _hashed(self).mapInArrow(rows, f"ids array<{_id_type(self)}>, terms array<string>")

    @property
    def idf(self) -> DataFrame:
        """term, idf, common of all terms."""
        return vocabulary(self)


def term_counts(texts: DataFrame, keys: list[str], text: Column, stop_words: list[str] = K.STOP_WORDS) -> DataFrame:
    """keys, term, tf, counted inside each row: the terms of a row are sorted and runs of equal ones measured, so neither
    texts nor terms are shuffled. Rows without terms drop out."""
    words = texts.select(*keys, X.tokens(text, stop_words).alias("words"))
    terms = words.select(*keys, F.sort_array(X.ngrams(F.col("words"))).alias("g")).filter(F.size("g") > 0)
    new = lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1))
    runs = terms.withColumn("s", F.filter(F.sequence(F.lit(0), F.size("g") - 1), new))
    run = lambda i, j: F.struct(F.get("g", i).alias("term"), (F.coalesce(F.get("s", j + 1), F.size("g")) - i).cast("long").alias("tf"))
    return runs.select(*keys, F.inline(F.transform("s", run)))


def term_hash(term: Column) -> Column:
    """64 bits for a word or a pair of words, which blocks make from the hashes of their words."""
    first, second = F.xxhash64(F.substring_index(term, " ", 1)), F.xxhash64(F.substring_index(term, " ", -1))
    turned = F.shiftleft(second, TURN).bitwiseOR(F.shiftrightunsigned(second, 64 - TURN))
    return F.when(F.instr(term, " ") > 0, first.bitwiseXOR(turned)).otherwise(F.xxhash64(term))


def build_index(texts: DataFrame, text: Column, stop_words: list[str] = K.STOP_WORDS, postings: int = POSTINGS, entries: int = ENTRIES) -> TextIndex:
    """texts(id, ...) -> index. The text is tokenised once and stored in blocks that hold each of their words once.

    The vocabulary is counted by hash: a block sends the hashes of its distinct terms to tasks that take a range of all
    hashes, about `entries` numbers, and gets a number back for each; blocks and their numbers are stored in the same
    buckets, so they meet without a shuffle. Rows that share an id are one text.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)  # blocks are large rows, which a task holds one at a time
    shared = cut(texts.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("id").alias("same")), "shared-ids")
    words = lambda rows: rows.select("id", F.coalesce(X.tokens(text, stop_words), F.array().cast("array<string>")).alias("words"))
    if shared.count():  # read from the footers
        once = words(texts.join(shared, texts["id"].eqNullSafe(shared["same"]), "left_anti")).withColumn("words", F.array("words"))
        more = words(texts.join(shared, texts["id"].eqNullSafe(shared["same"]), "left_semi"))
        rows = once.unionByName(more.groupBy("id").agg(F.collect_list("words").alias("words")))
    else:
        rows = words(texts).withColumn("words", F.array("words"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _in_buckets(_text_blocks(rows, postings).withColumn("block", F.monotonically_increasing_id()), buckets)
    total = blocks.agg(F.sum("size").alias("size"), F.sum("texts").alias("texts")).first()
    dfs = _in_buckets(_document_counts(blocks, max(1, -(-(total["size"] or 0) // entries))), buckets)
    return TextIndex(blocks.hint("merge").join(dfs, "block"), total["texts"] or 0)


def _in_buckets(rows: DataFrame, n: int) -> DataFrame:
    """The rows stored in n buckets by `block`: tables stored so are joined on it without a shuffle."""
    spark = rows.sparkSession
    path = scratch_path(spark, "blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


def _listed(values: np.ndarray | pa.Array) -> pa.Array:
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _bytes(values: np.ndarray, kind: type) -> pa.Array:
    """One binary value, the numbers' first bytes before their second ones, so that small numbers take little room."""
    return pa.array([values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()], pa.binary())


def _numbers(batch: pa.RecordBatch, column: str, row: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(batch.column(column)[row].as_buffer(), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _text_blocks(rows: DataFrame, postings: int) -> DataFrame:
    """Rows (id, words: a list for each row of the text) of a task in blocks of about `postings` occurrences of terms, one text at least."""
    kind = dict(rows.dtypes)["id"]

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        per_text = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        lists = batch.column(1).flatten()
        per_list = lists.value_lengths().to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.repeat(np.arange(len(per_list)), per_list)
        left = np.flatnonzero(own[1:] == own[:-1])  # words that are followed by another
        pairs, at = _by_appearance(codes[left] * len(words) + codes[left + 1])
        size = len(words) + len(pairs)
        held, tfs = np.unique(np.concatenate([own * size + codes, own[left] * size + len(words) + at]), return_counts=True)
        at, per_list = held % size, np.bincount(held // size, minlength=len(per_list))
        starts = np.append(0, np.cumsum(per_list))[np.append(0, np.cumsum(per_text))]
        kept = np.flatnonzero(np.diff(starts))  # texts without terms drop out
        parts = [
            _listed(batch.column(0).take(pa.array(kept))), _bytes(np.append(starts[kept], len(at)), np.int32), _bytes(np.diff(at, prepend=0), np.int32), _bytes(tfs, np.int32),
            _listed(words), _bytes(pairs // max(len(words), 1), np.int32), _bytes(pairs % max(len(words), 1), np.int32), _bytes(np.bincount(at, minlength=size), np.int32),
            pa.array([size], pa.int64()), pa.array([len(lists)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(parts, ["ids", "starts", "at", "tfs", "words", "first", "second", "ns", "size", "texts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            lists = batch.column(1)
            inside = np.append(0, np.cumsum(lists.flatten().value_lengths().to_numpy(zero_copy_only=False)))
            sizes = 2 * np.diff(inside[np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))])
            start = 0
            for stop, more in enumerate(sizes):
                if held and held + more > postings:
                    yield block(_joined([*waiting, batch.slice(start, stop - start)]))
                    trim()
                    waiting, held, start = [], 0, stop
                held += more
            waiting.append(batch.slice(start))
        if any(b.num_rows for b in waiting):
            yield block(_joined(waiting))

    schema = f"ids array<{kind}>, starts binary, at binary, tfs binary, words array<string>, first binary, second binary, ns binary, size long, texts long"
    return rows.mapInArrow(pack, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if any(b.num_rows for b in batches) else batches[0]


def _by_appearance(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in the order in which they first appear, and the number of each value among them."""
    distinct, first, at = np.unique(values, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return distinct[order], number[at]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Blocks one after the other; what one has left in the worker goes back to the system before the next."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch, row
            trim()


def _hashes(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """The hash of every term of a block, as `term_hash` gives it."""
    words = batch.column("hashes")[row].values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    first, second = (words[_numbers(batch, c, row, np.int32)].view(np.uint64) for c in ("first", "second"))
    turned = (second << np.uint64(TURN)) | (second >> np.uint64(64 - TURN))
    return np.append(words, (first ^ turned).view(np.int64))


def _terms(batch: pa.RecordBatch, row: int) -> pa.Array:
    words = batch.column("words")[row].values
    first, second = (words.take(pa.array(_numbers(batch, c, row, np.int32))) for c in ("first", "second"))
    return pa.concat_arrays([words, pc.binary_join_element_wise(first, second, " ")])


def _hashed(index: TextIndex) -> DataFrame:
    """The blocks with the hashes of their words."""
    return index.stored.drop("block", "size", "texts").withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _document_counts(blocks: DataFrame, ranges: int) -> DataFrame:
    """(block, dfs): the texts of all blocks that hold each term of a block, by the order of the hashes; see TextIndex."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            tids = _hashes(batch, row).view(np.uint64)
            order = np.argsort(tids, kind="stable")
            tids, ns = tids[order], _numbers(batch, "ns", row, np.int32)[order]
            ends = np.searchsorted((tids >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            for part, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if b > a:
                    lists = [_bytes(np.diff(tids[a:b], prepend=np.uint64(0)), np.uint64), _bytes(ns[a:b], np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), batch.column("block").slice(row, 1), *lists], ["part", "block", "tids", "ns"])

    def count(table: pa.Table) -> pa.Table:
        batch = table.sort_by("block").combine_chunks().to_batches()[0]
        tids = [np.cumsum(_numbers(batch, "tids", row, np.uint64), dtype=np.uint64) for row in range(batch.num_rows)]
        ns = np.concatenate([_numbers(batch, "ns", row, np.int32) for row in range(batch.num_rows)])
        ends = np.cumsum([len(t) for t in tids])
        _, first, at = np.unique(np.concatenate(tids), return_index=True, return_inverse=True)
        df = np.bincount(at, ns).astype(np.int64)[at]
        given = np.zeros(len(at), dtype=bool)
        given[first] = True
        out = [_bytes(part, np.int32) for part in np.split(2 * df + given, ends[:-1])]
        return pa.table({"part": batch.column("part"), "block": batch.column("block"), "dfs": pa.concat_arrays(out)})

    def gather(table: pa.Table) -> pa.Table:
        batch = table.sort_by("part").combine_chunks().to_batches()[0]
        dfs = np.concatenate([_numbers(batch, "dfs", row, np.int32) for row in range(batch.num_rows)])
        return pa.table({"block": batch.column("block").slice(0, 1), "dfs": _bytes(dfs, np.int32)})

    dealt = blocks.select("block", "first", "second", "ns", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).mapInArrow(deal, "part int, block long, tids binary, ns binary")
    counted = dealt.groupBy("part").applyInArrow(count, "part int, block long, dfs binary")
    return counted.groupBy("block").applyInArrow(gather, "block long, dfs binary")


def _found_in(batch: pa.RecordBatch, row: int, tids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many of all texts every term of a block is, and whether the block gives it to the vocabulary."""
    out = np.empty(len(tids), np.int64)
    out[np.argsort(tids.view(np.uint64), kind="stable")] = _numbers(batch, "dfs", row, np.int32)
    return out // 2, out % 2 == 1


def _weighted(batch: pa.RecordBatch, row: int, n: int, dfs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the texts of a block start, and term (its place in the block) and unit weight of every occurrence."""
    starts, at, tfs = (_numbers(batch, c, row, np.int32) for c in ("starts", "at", "tfs"))
    at = np.cumsum(at)
    w = (1.0 + np.log(tfs)) * (np.log((1 + n) / (1 + dfs)) + 1.0)[at]
    sizes = np.diff(starts)
    norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), w * w, len(sizes)))
    return starts.astype(np.int64), at, w / np.repeat(norms, sizes)


def vocabulary(index: TextIndex, marks: np.ndarray | None = None) -> DataFrame:
    """term, idf and whether a hundredth of all texts has the term, of all terms or of those that the sieve takes for asked ones."""
    n = index.n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            tids = _hashes(batch, row)
            dfs, given = _found_in(batch, row, tids)
            mine = np.flatnonzero(given & (True if marks is None else sieved(marks, tids)))
            terms, dfs = _terms(batch, row).take(pa.array(mine)), dfs[mine]
            for k in range(0, len(mine), ROWS):
                df = dfs[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([terms.slice(k, ROWS), pa.array(np.log((1 + n) / (1 + df)) + 1.0), pa.array(df * 100 >= n)], ["term", "idf", "common"])

    return _hashed(index).mapInArrow(rows, "term string, idf double, common boolean")


def vocabulary_of(index: TextIndex, counts: DataFrame) -> DataFrame:
    """Stored `vocabulary` of rows (term), with few others."""
    return cut(vocabulary(index, sieve(counts, term_hash(F.col("term")))), "vocabulary")


def weigh(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, w, common with w = (1 + ln tf) * idf; terms outside the vocabulary drop out.

    A term found in a hundredth of all texts would bring its postings to one task. There are at most
    100 such terms per term of an average text, whatever the corpus, so they are broadcast; the rest
    meet the vocabulary in a join on the term.
    """
    common = F.broadcast(idf.filter("common").select("term", "idf"))
    marked = counts.join(common, "term", "left")
    rare = marked.filter("idf IS NULL").drop("idf").join(idf.filter("NOT common").select("term", "idf"), "term")
    both = marked.filter("idf IS NOT NULL").withColumn("common", F.lit(True)).unionByName(rare.withColumn("common", F.lit(False)))
    return both.select(*keys, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"), "common")


def normalise(weights: DataFrame, keys: list[str]) -> DataFrame:
    """L2-normalised weights; a window holds the terms of one text."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return weights.select(*keys, "term", (F.col("w") / norm).alias("w"))


def tfidf(index: TextIndex) -> DataFrame:
    """id, term, w of all texts at unit length."""
    n = index.n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            starts, at, w = _weighted(batch, row, n, _found_in(batch, row, _hashes(batch, row))[0])
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            ids, terms = batch.column("ids")[row].values, _terms(batch, row)
            for k in range(0, len(at), ROWS):
                part = slice(k, k + ROWS)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[part])), terms.take(pa.array(at[part])), pa.array(w[part])], ["id", "term", "w"])

    return _hashed(index).mapInArrow(rows, f"id {_id_type(index)}, term string, w double")


def weighted_schema(kind: str) -> str:
    return f"ids array<{kind}>, starts array<long>, at array<int>, ws array<double>, tids array<long>, dfs array<double>"


def weighted_blocks(index: TextIndex) -> DataFrame:
    """The blocks with unit weights (`ws`), hashes of the terms (`tids`) and the number of texts that hold them (`dfs`)."""
    n = index.n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            tids = _hashes(batch, row)
            dfs, _ = _found_in(batch, row, tids)
            starts, at, w = _weighted(batch, row, n, dfs)
            parts = [batch.column("ids")[row].values, starts, at.astype(np.int32), w, tids, dfs.astype(float)]
            yield pa.RecordBatch.from_arrays([_listed(p) for p in parts], ["ids", "starts", "at", "ws", "tids", "dfs"])

    return _hashed(index).mapInArrow(rows, weighted_schema(_id_type(index)))


def _id_type(index: TextIndex) -> str:
    return dict(index.stored.dtypes)["ids"][len("array<") : -1]


def sieved(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the sieve takes for values of its column."""
    return ((marks[(hashes >> 6) & (len(marks) - 1)] >> (hashes & 63)) & 1).astype(bool)


def _asked_terms(index: TextIndex, marks: np.ndarray) -> DataFrame:
    """id, tids, ws: every text with the unit weights of those terms that the sieve takes for terms of a question."""
    n, kind = index.n, _id_type(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            tids = _hashes(batch, row)
            starts, at, w = _weighted(batch, row, n, _found_in(batch, row, tids)[0])
            kept = sieved(marks, tids)[at]
            offsets = np.append(0, np.cumsum(kept))[starts]
            ids, tids, w = batch.column("ids")[row].values, tids[at[kept]], w[kept]
            for k in range(0, len(ids), SLICE):
                some = offsets[k : k + SLICE + 1]
                lists = [pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(v[some[0] : some[-1]])) for v in (tids, w)]
                yield pa.RecordBatch.from_arrays([ids.slice(k, SLICE), *lists], ["id", "tids", "ws"])

    return _hashed(index).mapInArrow(rows, f"id {kind}, tids array<long>, ws array<double>")


def query_vectors(index: TextIndex, queries: DataFrame, text: str = "question") -> DataFrame:
    """id, term, w of questions in the vocabulary of the index."""
    counts = term_counts(queries, ["id"], F.col(text))
    return normalise(weigh(counts, vocabulary_of(index, counts), ["id"]), ["id"])


def topk(
    index: TextIndex, query_terms: DataFrame, k: int, latent: tuple[DataFrame, DataFrame] | None = None, blend: float = 0.5,
    questions: int = QUESTIONS, texts: int = TEXTS,
) -> DataFrame:
    """k best texts per question: query_id, item_id, score, rank (texts sharing no term are left out).

    With `latent`, the (id, vec) tables of texts and questions, the score is
    blend * lexical + (1 - blend) * dot(vec, vec) and every text takes part; a row without a vector
    counts as 0 there.

    Both sides are stored in blocks of at most `questions` and `texts` rows, one row per block, and every task
    reads a part of the texts and a part of the questions and scores their blocks pair by pair. Nothing but k
    rows per question and part of the texts (at most PARTS) is shuffled. Of the texts' terms only those leave the index
    that the sieve takes for terms of a question; what it takes wrongly finds no partner.
    """
    tid = lambda t: F.struct(term_hash(t["term"]).alias("tid"), t["w"].alias("w"))
    rows = query_terms.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("terms")).select("id", F.transform("terms", tid).alias("p"))
    items = _asked_terms(index, sieve(query_terms, term_hash(F.col("term"))))
    share = 1.0 if latent is None else blend
    if latent is not None:
        items, rows = items.join(latent[0], "id", "left"), rows.join(latent[1], "id", "left")
    rows = cut(rows.select("id", F.col("p.tid").alias("tids"), F.col("p.w").alias("ws"), *(["vec"] if latent is not None else [])), "queries")
    n = -(-rows.count() // questions)  # read from the footers
    q = _packed(rows.repartition(max(n, 1), "id"), questions, "q")
    x = _packed(items, texts, "x")
    pairs = cut(x, "text-blocks").coalesce(PARTS).crossJoin(cut(q, "question-blocks").hint("shuffle_replicate_nl"))
    schema = f"query_id {dict(rows.dtypes)['id']}, item_id {dict(items.dtypes)['id']}, score double"
    dense = latent is not None
    found = pairs.mapInArrow(lambda batches: _search(batches, k, share, dense), schema)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def sieve(rows: DataFrame, h: Column) -> np.ndarray:
    """SIEVE bits, in words of 64, of which every hash of a row sets one: a table of fixed size."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(h, 6).bitwiseAND(F.lit(SIEVE // 64 - 1))
    out = np.zeros(SIEVE // 64, dtype=np.int64)
    for r in rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out


def _packed(df: DataFrame, size: int, side: str) -> DataFrame:
    """Rows (id, tids, ws and maybe vec) of a task in blocks of at most `size`: ids in order, distinct terms with the
    places where their weights start, positions and weights sorted by term, vectors and which rows have one."""
    dense = "vec" in df.columns
    names = [f"{side}_{c}" for c in ("ids", "terms", "starts", "pos", "ws", *(("vecs", "has") if dense else ()))]

    def block(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("id")
        sizes = [len(t) for t in pdf["tids"]]
        tids, ws, pos = np.concatenate(pdf["tids"].to_list()), np.concatenate(pdf["ws"].to_list()), np.repeat(np.arange(len(pdf), dtype=np.int32), sizes)
        order = np.lexsort((pos, tids))  # a term that rows of one id repeat counts once
        last = np.append((np.diff(tids[order]) != 0) | (np.diff(pos[order]) != 0), True)[: len(order)]
        tids, pos, ws = tids[order][last], pos[order][last], ws[order][last]
        terms, starts = np.unique(tids, return_index=True)
        parts = [terms.astype(np.int64), np.append(starts, len(tids)).astype(np.int64), pos, ws.astype(float)]
        if dense:
            has = np.array([v is not None for v in pdf["vec"]])
            vecs = np.stack(pdf["vec"][has].to_numpy()).astype(float) if has.any() else np.zeros((0, 0))
            parts += [vecs, has]
        return dict(zip(names, [pdf["id"].to_list(), *(p.tobytes() for p in parts)]))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), size):
                yield pd.DataFrame([block(pdf.iloc[start : start + size])])

    return df.mapInPandas(pack, f"{names[0]} array<{dict(df.dtypes)['id']}>, " + ", ".join(f"{c} binary" for c in names[1:]))


def _search(batches: Iterator[pa.RecordBatch], k: int, share: float, dense: bool) -> Iterator[pa.RecordBatch]:
    """k best texts of the task's part of the texts for every question of its part of the questions."""
    found: dict = {}  # by the first id of a block of questions: its ids and their best texts
    types = None

    def side(batch: pa.RecordBatch, name: str, row: int) -> tuple:
        ids = batch.column(f"{name}_ids")[row].values
        kinds = (("terms", np.int64), ("starts", np.int64), ("pos", np.int32), ("ws", float), *((("vecs", float), ("has", bool)) if dense else ()))
        return ids, *(np.frombuffer(batch.column(f"{name}_{c}")[row].as_buffer(), dtype=t) for c, t in kinds)

    for batch in batches:
        types = [batch.schema.field(f"{s}_ids").type.value_type for s in "qx"]
        for row in range(batch.num_rows):
            q, x = side(batch, "q", row), side(batch, "x", row)
            key = q[0][0].as_py()
            if key not in found:
                found[key] = (q[0].to_numpy(zero_copy_only=False), Best(len(q[0]), k))
            scores = _lexical(q, x)
            if dense:
                scores *= share
                scores += (1 - share) * _dots(q[5], q[6], x[5], x[6])
            found[key][1].add(scores, x[0].to_numpy(zero_copy_only=False), positive=not dense)
    for ids, best in found.values():
        hits = best.hits(ids)
        columns = [pa.array(hits[c].to_list(), t) for c, t in zip(("query_id", "item_id", "score"), (*types, pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "item_id", "score"])


def _lexical(q: tuple, x: tuple) -> np.ndarray:
    """Scores of a block of questions with a block of texts over the terms they share: a product of matrices for terms
    of many pairs, one block of pairs after the other for others, all pairs at once for terms of few."""
    (ids, terms, starts, pos, ws), (items, seen, begins, place, weights) = q[:5], x[:5]
    shape = (len(ids), len(items))
    at = np.minimum(np.searchsorted(terms, seen), max(len(terms) - 1, 0))
    both = np.flatnonzero(terms[at] == seen) if len(terms) else np.array([], dtype=int)
    at = at[both] if len(both) else both
    a, b, c, d = starts[at], starts[at + 1], begins[both], begins[both + 1]
    pairs = (b - a) * (d - c)
    often, some = pairs >= DENSE * shape[0] * shape[1], pairs >= 256
    few = np.flatnonzero(~some & ~often)
    scores = np.zeros(shape)
    ends = np.cumsum(pairs[few])
    for lot in np.split(few, np.flatnonzero(np.diff(ends // PAIRS)) + 1):  # so many pairs, about, are listed at once
        # every pair of the rare terms: a question's place is repeated for each text that has the term
        lead = np.repeat(a[lot], (b - a)[lot]) + _ranges((b - a)[lot])
        width = np.repeat((d - c)[lot], (b - a)[lot])
        left, right = np.repeat(lead, width), np.repeat(np.repeat(c[lot], (b - a)[lot]), width) + _ranges(width)
        scores += np.bincount(pos[left].astype(np.int64) * shape[1] + place[right], ws[left] * weights[right], shape[0] * shape[1]).reshape(shape)
    for i in np.flatnonzero(some & ~often):
        p, r = pos[a[i] : b[i]], place[c[i] : d[i]]
        scores[p[:, None], r[None, :]] += ws[a[i] : b[i], None] * weights[None, c[i] : d[i]]
    dense = np.flatnonzero(often)
    if len(dense):
        one, two = np.zeros((shape[0], len(dense))), np.zeros((len(dense), shape[1]))
        for j, i in enumerate(dense):
            one[pos[a[i] : b[i]], j] = ws[a[i] : b[i]]
            two[j, place[c[i] : d[i]]] = weights[c[i] : d[i]]
        scores += one @ two
    return scores


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for every n of `sizes`, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _dots(left: np.ndarray, has_left: np.ndarray, right: np.ndarray, has_right: np.ndarray) -> np.ndarray:
    """Dot products of vectors, which only the marked rows have; 0 where either is missing."""
    out = np.zeros((len(has_left), len(has_right)))
    if has_left.any() and has_right.any():
        out[np.ix_(has_left, has_right)] = left.reshape(has_left.sum(), -1) @ right.reshape(has_right.sum(), -1).T
    return out


# ------------------------------------------------------------------ evaluation of retrieval


def expected_pairs(questions: DataFrame) -> DataFrame:
    """(id, doc_id) of questions that list their documents in an array."""
    return questions.select("id", F.explode("expected_docs").alias("doc_id"))


def retrieval_metrics(hits: DataFrame, questions: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k over answerable questions, median top score of both kinds.

    hits: query_id, doc_id, score, rank; expected: id, doc_id, as a table because a passage copied
    into many documents has no bounded list.
    """
    found = (
        hits.join(expected.withColumnRenamed("id", "query_id").withColumn("right", F.lit(True)), ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg(F.max("score").alias("top"), F.min(F.when(F.col("right"), F.col("rank"))).alias("first_right"))
    )
    facts = questions.join(found, questions["id"] == found["query_id"], "left").withColumn("top", F.round(F.coalesce("top", F.lit(0.0)), 6))
    hit = lambda k: F.when(F.col("answerable"), F.coalesce(F.col("first_right") <= k, F.lit(False)).cast("double"))
    middle = lambda c: F.percentile(F.when(c, F.col("top")), 0.5)  # noqa: E731  six digits: at most a million distinct values
    return facts.agg(
        *[F.avg(hit(k)).alias(f"hit_at_{k}") for k in ks],
        middle(F.col("answerable")).alias("top_score_answerable_median"),
        middle(~F.col("answerable")).alias("top_score_unanswerable_median"),
    )


# ------------------------------------------------------------------ answering


def found_texts(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks that hits name, with some others: a bitmap of fixed size sieves them before they are shuffled, so what
    travels is bounded by the hits."""
    marks, names = sieve(hits, F.xxhash64("item_id")), chunks.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(len(names)).to_numpy()
            yield batch.select(range(len(names))).filter(pa.array(sieved(marks, h)))

    return chunks.withColumn("_h", F.xxhash64("chunk_id")).mapInArrow(kept, chunks.schema)


def question_facts(chunks: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question: words, retrieved chunks, top score and coverage of its words by their text."""
    words = questions.select("id", "question", X.content_words(F.col("question")).alias("words"))
    texts = found_texts(chunks.select("chunk_id", "doc_id", "title", "section", "text"), hits).withColumnRenamed("chunk_id", "item_id")
    seen = (
        hits.join(texts, "item_id")
        .withColumn("w", X.content_words(F.concat_ws(" ", "title", "section", "text")))
        .groupBy("query_id")
        .agg(
            F.flatten(F.collect_list("w")).alias("seen"),
            F.max("score").alias("top_score"),
            F.sort_array(F.collect_list(F.struct("rank", "item_id", "score"))).alias("retrieved"),
        )
    )
    covered = F.size(F.array_intersect("words", "seen")) / F.size("words")
    return words.join(seen, words["id"] == seen["query_id"], "left").select(
        "id", "question", "words", F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.coalesce(F.when(F.size("words") > 0, covered), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.transform("retrieved", lambda r: r["item_id"]), F.array().cast("array<string>")).alias("retrieved"),
    )


def candidate_sentences(index: TextIndex, chunks: DataFrame, questions: DataFrame, hits: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Every sentence of the retrieved chunks with its word overlap and score.

    score = similarity to the question + 0.05 * overlap + 0.25 * score of the chunk.
    """
    words = questions.select(F.col("id").alias("query_id"), X.content_words(F.col("question")).alias("words"))
    texts = found_texts(chunks.select("chunk_id", "doc_id", "section", "text"), hits).withColumnRenamed("chunk_id", "item_id")
    rows = (
        hits.join(texts, "item_id")
        .join(words, "query_id")
        .withColumn("heading", X.content_words(F.col("section")))
        .select("query_id", "item_id", "doc_id", F.col("score").alias("hit_score"), "rank", "words", "heading",
                F.posexplode(X.chunk_sentences(F.col("text"))).alias("position", "sentence"))
    )
    overlap = F.size(F.array_intersect("words", F.array_union(X.content_words(F.col("sentence")), F.col("heading"))))
    rows = cut(rows.withColumn("overlap", overlap).filter(F.col("overlap") >= 1).drop("words", "heading"), "sentences")
    key = ["query_id", "rank", "position"]
    counts = term_counts(rows, key, F.col("sentence"))
    vectors = normalise(weigh(counts, vocabulary_of(index, counts), key), key)
    asked = query_terms.select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw"))
    similar = vectors.join(asked, ["query_id", "term"]).groupBy(*key).agg(F.sum(F.col("w") * F.col("qw")).alias("similarity"))
    value = F.coalesce("similarity", F.lit(0.0)) + 0.05 * F.col("overlap") + 0.25 * F.col("hit_score")
    return rows.join(similar, key, "left").withColumn("value", F.round(value, 9))


def select_sentences(candidates: DataFrame, min_overlap: int | Column, keep: int = 3, near: float = 0.75) -> DataFrame:
    """Best sentences per question, back in document order, each citing its chunk."""
    fit = candidates.filter(F.col("overlap") >= min_overlap)
    line = Window.partitionBy("query_id")  # sentences of k chunks
    top = (
        fit.withColumn("best", F.max("value").over(line))
        .filter(F.col("value") >= near * F.col("best"))
        .withColumn("r", F.row_number().over(line.orderBy(F.desc("value"), "rank", "position")))
        .filter(F.col("r") <= keep)
    )
    item = F.struct("rank", "position", X.end_sentence(F.col("sentence")).alias("text"), F.array("item_id").alias("citations"), "doc_id")
    ordered = top.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    return ordered.select(
        "query_id",
        F.transform("s", lambda s: F.struct(s["text"].alias("text"), s["citations"].alias("citations"))).alias("sentences"),
        F.array_distinct(F.transform("s", lambda s: s["doc_id"])).alias("cited_docs"),
    )


def answer(facts: DataFrame, selected: DataFrame, min_score: float | Column, min_coverage: float | Column) -> DataFrame:
    """One answer per question: refused or cited sentences, with the reason for a refusal.

    Thresholds may be scalars of a stored choice (choose_refusal).
    """
    rows = facts.join(selected, facts["id"] == selected["query_id"], "left").drop("query_id")
    problem = X.verify_citations(F.col("sentences"), F.col("retrieved"))
    percent = F.format_string("%.0f%%", F.bround(F.col("coverage") * 100, 0))
    # ---- fixed values: the notes of a refusal
    note = (
        F.when((F.size("retrieved") == 0) | (F.col("top_score") < min_score), "retrieval score below threshold")
        .when(F.col("coverage") < min_coverage, F.concat(F.lit("only "), percent, F.lit(" of the question's key terms appear in the retrieved text")))
        .when(F.col("sentences").isNull(), "no retrieved sentence supports an answer")
        .when(problem.isNotNull(), F.concat(F.lit("answer rejected by citation check ("), problem, F.lit(")")))
    )
    out = rows.withColumn("note", F.coalesce(note, F.lit(""))).withColumn("refused", F.col("note") != "")
    text = F.when(F.col("refused"), K.REFUSAL).otherwise(F.array_join(F.transform("sentences", lambda s: s["text"]), " "))
    return out.select(
        "id", "question", "refused", text.alias("answer"), F.when(~F.col("refused"), F.col("sentences")).alias("sentences"),
        F.when(~F.col("refused"), F.col("cited_docs")).alias("cited_docs"), "retrieved", "note",
    )


def with_context(questions: DataFrame) -> DataFrame:
    """What is searched for: the question, followed by the context of its incident where there is one."""
    return questions.withColumn("question", F.concat_ws(" ", "question", "context"))


def answer_incidents(index: TextIndex, chunks: DataFrame, questions: DataFrame, k: int, min_score: float, min_overlap: int, min_coverage: float) -> DataFrame:
    """Answers to questions (id, question, context) about incidents.

    Chunks are retrieved for question and context; coverage and sentences go by the question alone, so an
    incident steers what is read and not what counts as an answer. A null context changes nothing.
    """
    hits = cut(topk(index, cut(query_vectors(index, with_context(questions)), "qvec"), k), "hits")
    candidates = cut(candidate_sentences(index, chunks, questions, hits, cut(query_vectors(index, questions), "qvec")), "candidates")
    return answer(question_facts(chunks, questions, hits), select_sentences(candidates, min_overlap), min_score, min_coverage)


def answer_metrics(answers: DataFrame, questions: DataFrame, expected: DataFrame) -> DataFrame:
    """Refusal and citation rates; null when there is nothing to average."""
    cited = (
        answers.select("id", F.explode("cited_docs").alias("doc_id"))
        .join(expected.withColumn("right", F.lit(1)), ["id", "doc_id"], "left")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("cited"), F.count("right").alias("right"))
    )
    rows = answers.select("id", "refused").join(questions.select("id", "answerable"), "id").join(cited, "id", "left")
    answered = F.col("answerable") & ~F.col("refused")
    rate = lambda where, flag: F.avg(F.when(where, flag.cast("double")))
    return rows.agg(
        rate(~F.col("answerable"), F.col("refused")).alias("correct_refusal_rate"),
        rate(F.col("answerable"), F.col("refused")).alias("false_refusal_rate"),
        rate(answered, F.col("right") == F.col("cited")).alias("citation_accuracy"),
        rate(answered, F.col("right") > 0).alias("cites_expected_doc"),
        F.count(F.when(answered, 1)).alias("answered"),
    )


def number_by(df: DataFrame, key: str) -> DataFrame:
    """0-based `position` of every row in the order of a unique key.

    A range partitioning sorts the keys in parallel; the pieces are stored so that they stay as they
    are, and their sizes (one number per piece) give the offsets.
    """
    pieces = df.select(key).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = cut(pieces.select(key, F.spark_partition_id().alias("piece"), local.alias("local")), "positions")
    sizes = stored.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    offsets = sizes.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = stored.join(offsets, "piece").select(key, (F.col("offset") + F.col("local")).alias("position"))
    return df.join(placed, key)


def alternate_halves(questions: DataFrame) -> DataFrame:
    """Every other question in id order: `dev` tunes thresholds, `test` reports them."""
    return number_by(questions, "id").withColumn("half", F.when(F.col("position") % 2 == 0, "dev").otherwise("test"))


def tune_refusal(
    facts: DataFrame, candidates: DataFrame, questions: DataFrame, overlaps: tuple[int, ...] = (1, 2),
    coverages: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7),
) -> DataFrame:
    """Balance of correct and false refusals for every (score, overlap, coverage) threshold.

    Score thresholds are the observed top scores less 1e-4, on a grid of 1e-4. Questions are counted
    per grid cell and a threshold refuses the cells below it, so its effect is a running sum over at
    most ten thousand cells and not a copy of the questions per threshold.
    """
    supported = None
    for o in overlaps:
        has = select_sentences(candidates, o).select("query_id", F.lit(o).alias("min_overlap"))
        supported = has if supported is None else supported.unionByName(has)
    rows = (
        facts.join(questions.select("id", "answerable"), "id")
        .withColumn("min_overlap", F.explode(F.array(*[F.lit(o) for o in overlaps])))
        .join(supported.withColumnRenamed("query_id", "id").withColumn("has", F.lit(True)), ["id", "min_overlap"], "left")
        .withColumn("min_coverage", F.explode(F.array(*[F.lit(c) for c in coverages])))
    )
    cell = F.floor(F.col("top_score") * 10_000).cast("long")
    gone = F.col("has").isNull() | (F.col("coverage") < F.col("min_coverage"))
    setting = ["min_overlap", "min_coverage"]
    counts = rows.select(*setting, "answerable", cell.alias("cell"), gone.alias("gone")).groupBy(*setting, "cell").agg(
        *[
            F.count(F.when(who & state, 1)).alias(name)
            for name, who, state in (
                ("bad_gone", ~F.col("answerable"), F.col("gone")), ("bad_open", ~F.col("answerable"), ~F.col("gone")),
                ("good_gone", F.col("answerable"), F.col("gone")), ("good_open", F.col("answerable"), ~F.col("gone")),
            )
        ]
    )
    # a threshold m refuses cells < m; thresholds are 0 and round(score - 1e-4, 4) of every question
    marks = facts.select(F.round((F.col("top_score") - 1e-4) * 10_000, 0).cast("long").alias("cell")).distinct()
    marks = marks.unionByName(facts.select(F.lit(0).cast("long").alias("cell")).limit(1)).distinct()
    grid = marks.withColumn("min_overlap", F.explode(F.array(*[F.lit(o) for o in overlaps]))).withColumn(
        "min_coverage", F.explode(F.array(*[F.lit(c) for c in coverages]))
    )
    names = ["bad_gone", "bad_open", "good_gone", "good_open"]
    both = counts.withColumn("mark", F.lit(False)).unionByName(grid.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    line = Window.partitionBy(*setting).orderBy("cell")
    below, everything = line.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy(*setting)
    sums = {f"{n}_all": F.sum(n).over(everything) for n in names} | {
        f"{n}_below": F.coalesce(F.sum(n).over(below), F.lit(0)) for n in ("bad_open", "good_open")
    }
    at = both.withColumns(sums).filter("mark")
    bad, good = F.col("bad_gone_all") + F.col("bad_open_all"), F.col("good_gone_all") + F.col("good_open_all")
    correct = F.when(bad > 0, (F.col("bad_gone_all") + F.col("bad_open_below")) / bad)
    false = F.when(good > 0, (F.col("good_gone_all") + F.col("good_open_below")) / good)
    return at.select(
        (F.col("cell") / 10_000.0).alias("min_score"), *setting, correct.alias("correct_refusal_rate"), false.alias("false_refusal_rate"),
        (F.coalesce(correct, F.lit(0.0)) + (1.0 - F.coalesce(false, F.lit(0.0)))).alias("balanced"),
    )


def choose_refusal(tuning: DataFrame) -> DataFrame:
    """Best balance; ties go to the least aggressive settings."""
    order = F.struct(F.round("balanced", 9), -F.col("min_score"), -F.col("min_coverage"), -F.col("min_overlap"))
    return tuning.agg(F.max_by(F.struct(*tuning.columns), order).alias("t")).select("t.*")


def held_out_refusal(facts: DataFrame, candidates: DataFrame, questions: DataFrame, expected: DataFrame, chosen: DataFrame) -> DataFrame:
    """answer_metrics of the half `test` and of all questions at the thresholds chosen on the half `dev`.

    questions: id, answerable, half; chosen: one stored row with min_score, min_overlap, min_coverage.
    Result: scope, the thresholds, and the metrics.
    """
    at = {c: chosen.select(c).scalar() for c in ("min_score", "min_overlap", "min_coverage")}
    answers = cut(answer(facts, select_sentences(candidates, at["min_overlap"]), at["min_score"], at["min_coverage"]), "answers")
    test = questions.filter("half = 'test'")
    parts = [
        answer_metrics(answers.join(test.select("id"), "id", "left_semi"), test, expected).withColumn("scope", F.lit("test")),
        answer_metrics(answers, questions, expected).withColumn("scope", F.lit("all")),
    ]
    return parts[0].unionByName(parts[1]).withColumns(at)
