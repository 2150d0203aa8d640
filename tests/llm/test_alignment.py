"""Alignment against whole-text encodings of both libraries, and the laws of the monoid."""

import hashlib
import random
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce
from itertools import accumulate

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm.alignment import EMPTY, LOST, Aligner, align, compose, score_links
from vigil.llm.tokens import byte_letters
from vigil.settings import cut

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", "\n", "\n\n", "\r\n", "\r", "\t", " \n ", " ", "　", "\x1d", "\x85", "a", "Bee", "'s", "'LL", "7", "123", "é", "×", "!!", "();", "<|endoftext|>", "<s>", "<unk>", "日本語", "🙂", "word", " the", "unbelievable", "\x00"]


def texts(seed, count, more=()):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "x▁y", "▁", *more, *("".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(count))]


def expected(texts):
    """Every row as the contract says it, from encodings of the whole text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(v): k for k, v in byte_letters().items()}
    rows = []
    for text in texts:
        links, groups, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
            tb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ends_a, ends_b = list(accumulate(map(len, ta))), list(accumulate(map(len, tb)))
                both = [0, *sorted(set(ends_a) & set(ends_b))]
                within = lambda ids, ends, lo, hi: ",".join(map(str, ids[bisect_right(ends, lo) : bisect_right(ends, hi)]))
                groups = [within(ids_a, ends_a, lo, hi) + "|" + within(ids_b, ends_b, lo, hi) for lo, hi in zip(both, both[1:], strict=False)]
                links = [(x, ids_b[k]) for x, e in zip(ids_a, ends_a, strict=True) for k in range(bisect_left(ends_b, e), bisect_right(ends_b, e))]
            else:
                ids_a = ids_b = []
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    counts = Counter(pair for r in rows for pair in r[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(n_a, n_b, n, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), groups and hashlib.sha256(groups.encode()).hexdigest()) for n_a, n_b, n, links, groups in rows]


def aligned(spark, texts, common=1 << 18, **sizes):
    docs = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string, row string")
    found = align(docs, A, B, **sizes).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    rows = score_links(cut(found, "aligned"), common).collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_texts_in_one_task(spark):
    given = texts(1, 300) + ["same text twice"] * 5
    assert aligned(spark, given) == expected(given)
    assert aligned(spark, []) == []


def test_texts_over_many_tasks_and_rare_pairs(spark):
    rng = random.Random(5)
    long = ["".join(rng.choices(PARTS, k=3000)), "the quick brown fox jumps " * 700, "x" * 9000, "日本語" * 3000 + " end", "a " * 3000, " " * 9000, "word " + "y" * 12000 + " word " * 400]
    given = texts(2, 40, long)
    assert aligned(spark, given, common=40, chunk=512, fan=3) == expected(given)


def test_any_cut_and_any_grouping():
    aligner, rng = Aligner(A, B), random.Random(3)
    for text in texts(4, 60)[6:]:
        t = aligner.tokens([" " + text])[0]
        if t is None:
            continue
        size = len((" " + text).encode())
        cuts = sorted({0, size, *(rng.randint(0, size) for _ in range(6))})
        parts = [aligner.fragment(*t, lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        whole = aligner.fragment(*t, 0, size)
        assert reduce(compose, parts, EMPTY) == whole == reduce(lambda y, x: compose(x, y), reversed(parts), EMPTY)
        assert compose(LOST, whole) == compose(whole, LOST) == LOST


def test_ranges_cover_every_byte_once():
    aligner, rng = Aligner(A, B), random.Random(9)
    for text in ["".join(rng.choices(PARTS, k=4000)), "x" * 20000, "ab cd " * 4000, "日本語\n" * 2000]:
        data = b" " + text.encode()
        found = list(aligner.ranges(data, 700))
        assert [f[1] for f in found] == [0, *(f[2] for f in found[:-1])] and found[-1][2] == len(data)
        whole = aligner.part(data, 0, len(data))
        assert reduce(compose, (aligner.part(data[b:e], lo - b, hi - b) for b, lo, hi, e in found), EMPTY) == whole
