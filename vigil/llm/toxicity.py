"""Toxicity: a noisy-channel decoder restores disguised words, then learned evidence scores the text.

A span is suspicious if it mixes letters with look-alikes (1d10t), spells a word with separators
(i.d.i.o.t) or repeats letters (idiooot). Its characters open a lattice: a look-alike may be one of several
letters, a separator or a repeated letter may vanish, each at a channel cost. The Viterbi path under a
character trigram model, counted over all texts of the corpus, is the restored word. Evidence is a
lexicon of words and word beginnings that training documents marked toxic hold more often than others; the
log odds of all evidence in a text add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import NormalDist

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vigil.llm.tokens import release
from vigil.llm.words import shingle_sets, slices, texts_of
from vigil.settings import cut

#: Training documents of each class at most, and the longest beginning of a word that is learned.
PER_CLASS, LONGEST, SHORTEST = 3000, 9, 4
#: Toxic training documents (weighted) that evidence must be found in, and the chance that any evidence at all passes by accident.
LEAST, CHANCE = 2.5, 1e-3
THRESHOLD = 0.7
#: Letters that a character may stand for (fixed values).
ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h",
}
ANY = "*"
SEPARATORS = ".-_ ·*'​‌‍­"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGE = 26
_ALIKE = re.escape("".join(ALIKE) + ANY)
#: Look-alikes that at the end of a word may as well be punctuation.
PUNCTUATION = "!|+(#*"
#: Mixed, spelled out, and stretched spans.
SPANS = re.compile(
    rf"(?<![\w{_ALIKE}])(?=[{_ALIKE}]*[a-z])(?=[a-z]*[{_ALIKE}])[a-z{_ALIKE}]{{3,24}}(?![\w{_ALIKE}])"
    rf"|(?<![\w.\-])(?:[a-z{_ALIKE}][.\-_ ·*]{{1,2}}){{3,14}}[a-z](?![\w])"
    rf"|(?<!\w)(?=[a-z]*([a-z])\1\1)[a-z]{{4,40}}(?!\w)"
    rf"|(?<!\w)[a-z]+(?:[​‌‍­][a-z]*)+(?!\w)"
)
_CODE = np.full(256, _EDGE, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)


def letter_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the letter trigrams (26 letters and an edge) of all texts: 27 ** 3 sums, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                c = _CODE[np.frombuffer(b"  " + b" ".join(texts[a:b]) + b" ", np.uint8)]
                total += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 27 ** 3 rows at most
    out = np.zeros(27**3)
    for row in rows:
        out[row["gram"]] = row["n"]
    return out


class Decoder:
    """The cheapest letters behind a disguised span."""

    def __init__(self, trigrams: np.ndarray, known: int = 200_000):
        n = trigrams.reshape(27, 27, 27) + 0.1
        pair = n.sum(0)
        smooth = 0.8 * n / n.sum(2, keepdims=True) + 0.2 * (pair / pair.sum(1, keepdims=True))[None]
        self.cost = (-np.log(smooth)).tolist()
        self.seen: dict[tuple[str, bool], str] = {}
        self.known = known

    def options(self, c: str, before: str, last: bool) -> list[tuple[str, float]]:
        """(letter or nothing, channel cost) of one character; `last`: it may be punctuation after the word."""
        out = []
        if c in LETTERS:
            out.append((c, 0.0 if c != before else 0.7))
            if c == before:
                out.append(("", 0.5))
        out += [(x, 0.7) for x in ALIKE.get(c, "")]
        if c == ANY:
            out += [(x, 2.0) for x in LETTERS]
        if c in SEPARATORS or (c not in LETTERS and last):
            out.append(("", 0.3))
        return out or [("", 1.0)]

    def _read(self, span: str, word_ends: int, limit: float, any_letter: bool) -> tuple[float, str]:
        """Cost and word of the cheapest path below `limit`; ANY only vanishes unless `any_letter`."""
        beams = {(_EDGE, _EDGE): (0.0, "")}
        for k, c in enumerate(span):
            moved: dict = {}
            options = self.options(c, span[k - 1] if k else "", k >= word_ends) if c != ANY or any_letter else [("", 0.3)]
            for letter, channel in options:
                code = ord(letter) - 97 if letter else -1
                for (a, b), (cost, word) in beams.items():
                    price = cost + channel + (self.cost[a][b][code] if letter else 0.0)
                    if price < limit:
                        key = (b, code) if letter else (a, b)
                        if key not in moved or price < moved[key][0]:
                            moved[key] = (price, word + letter)
            beams = moved
        return min(((cost + self.cost[a][b][_EDGE], word) for (a, b), (cost, word) in beams.items()), default=(limit, ""))

    def __call__(self, span: str, whole: bool = False) -> str:
        """The best reading; if `whole`, the best one in which look-alikes at the end are letters too."""
        if (span, whole) in self.seen:
            return self.seen[span, whole]
        word_ends = len(span) if whole else min(len(span) - 1, len(span.rstrip(PUNCTUATION)))
        best = self._read(span, word_ends, np.inf, False)
        if ANY in span:  # costs only grow, so no path that is dearer already can win
            best = min(best, self._read(span, word_ends, best[0], True))
        if len(self.seen) < self.known:
            self.seen[span, whole] = best[1]
        return best[1]


#: Kinds of characters: 1 letter, 2 look-alike, 4 separator, 6 both of the latter; what lies above the table is none of them.
_KIND = np.zeros(0x2100, np.uint8)
_KIND[97:123] = 1
_KIND[[ord(c) for c in [*ALIKE, ANY]]] |= 2
_KIND[[ord(c) for c in SEPARATORS]] |= 4
_JOINERS = [ord(c) for c in SEPARATORS if ord(c) > 0xB7 or c == "\xad"]
#: Characters around a suspicious place that are searched for spans; longer than any span with spaces.
REACH = 64


def suspicious(lowered: str) -> list[str]:
    """The stretches of a text that hold all its spans: near a letter beside a look-alike or an invisible separator, three spelled letters in a row, or a letter three times."""
    if len(lowered) < 3:
        return []
    if lowered.isascii():
        c = np.frombuffer(lowered.encode(), np.uint8)
        kind = _KIND[c]
    else:
        c = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(c, len(_KIND) - 1)]
    letter, alike, separator = kind == 1, (kind & 2) > 0, (kind & 4) > 0
    found = np.zeros(len(c), bool)
    found[:-1] |= (letter[:-1] & alike[1:]) | (alike[:-1] & letter[1:])
    found[:-2] |= letter[:-2] & (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:])
    if c.dtype != np.uint8:
        found[:-1] |= letter[:-1] & np.isin(c[1:], _JOINERS)
    single = letter | alike
    single[1:] &= ~letter[:-1]
    single[:-1] &= ~letter[1:]
    near, far = np.zeros(len(c) + 3, bool), np.zeros(len(c) + 3, bool)  # the next single comes after one separator, after two
    near[: len(c) - 2] = single[:-2] & separator[1:-1] & single[2:]
    far[: len(c) - 3] = single[:-3] & separator[1:-2] & separator[2:-1] & single[3:]
    step = near | far
    found |= (near[:-3] & step[2:-1]) | (far[:-3] & step[3:])
    at = np.flatnonzero(found)
    if not len(at):
        return []
    split = np.flatnonzero(np.diff(at) > REACH)
    out: list[list[int]] = []
    for lo, hi in zip(at[np.append(0, split + 1)].tolist(), at[np.append(split, len(at) - 1)].tolist(), strict=True):
        lo, hi = max(0, lo - REACH), min(len(lowered), hi + REACH)
        while lo > 0 and lowered[lo - 1] not in " \n\t":
            lo -= 1
        while hi < len(lowered) and lowered[hi] not in " \n\t":
            hi += 1
        if out and lo <= out[-1][1]:  # a span is cut by no border
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [lowered[lo:hi] for lo, hi in out]


def restored_spans(lowered: str, decoder: Decoder) -> Iterator[str]:
    """The words behind the spans; where the best reading takes look-alikes at the end as punctuation, also the one as letters."""
    for part in suspicious(lowered):
        for found in SPANS.finditer(part):
            span = found.group()
            best = decoder(span)
            yield best
            if span.rstrip(ANY)[-1:] not in LETTERS and (whole := decoder(span, True)) != best:
                yield whole


_WORDS = re.compile(r"[^\W\d_]+")


def evidence_of(lowered: str, decoder: Decoder) -> set[str]:
    """Beginnings of the words of a text and of its restored spans; whole words end in `$`."""
    words = {*_WORDS.findall(lowered), *restored_spans(lowered, decoder)}
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + "$" for w in words if 2 < len(w) <= 30}


def learn(labelled: DataFrame, trigrams: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict[str, float]:
    """Evidence -> probability that a text which holds it is toxic, from at most PER_CLASS documents a class; "" -> share of the toxic ones.

    A document weighs 1 / the number of training documents with its least shingle, so that copies of one
    text count about once. Evidence must be found in LEAST of the toxic documents and its odds ratio must be
    significant among all that are tested (CHANCE that any passes by accident); of beginnings with the same support the longest is kept. Rows without text or label are left out.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    held = labelled.sparkSession.sparkContext.broadcast(trigrams)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        decoder = Decoder(held.value)
        for batch in batches:
            texts = texts_of(batch.column(0))
            least = [int(s[0].astype(np.int64)) if len(s) else 0 for s in shingle_sets(texts)]
            found = [sorted(evidence_of(t.decode("utf-8", "replace").lower(), decoder)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(least, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["y", "least", "found"])

    drawn = rows.mapInArrow(features, "y int, least long, found array<string>")
    weighed = drawn.withColumn("w", 1 / F.count("*").over(W.partitionBy("least", "y")))
    toxic, clean = (F.sum(F.when(F.col("y") == v, F.col("w")).otherwise(0.0)) for v in (1, 0))
    totals = weighed.agg(toxic.alias("a"), clean.alias("b")).first()
    if not totals["a"] or not totals["b"]:
        return {}
    a, b, A, B = F.col("a"), F.col("b"), totals["a"], totals["b"]
    share = (a + b) / (A + B)
    cells = [(a, A * share), (b, B * share), (A - a, A * (1 - share)), (B - b, B * (1 - share))]
    g = 2 * sum(F.when(seen > 1e-9, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells)
    counted = cut(weighed.withColumn("e", F.explode("found")).groupBy("e").agg(toxic.alias("a"), clean.alias("b")), "evidence")
    # so many pieces of evidence are tested that some would pass any fixed limit; the limit of the G statistic grows with their number
    tested = max(1, counted.where(a + b >= LEAST).count())
    significant = NormalDist().inv_cdf(1 - CHANCE / (2 * tested)) ** 2
    passed = counted.where((a >= LEAST) & (a / A > b / B) & (g >= significant))
    kept = {r["e"]: (r["a"], r["b"]) for r in passed.collect()}  # at most the words of the training documents / LEAST
    longer: dict[str, float] = {}
    for e, (n, _) in kept.items():
        for k in range(SHORTEST, len(e)):
            longer[e[:k]] = max(n, longer.get(e[:k], 0.0))
    prior = A / (A + B)
    out = {"": prior}
    for e, (n, m) in kept.items():
        if longer.get(e, 0.0) < 0.95 * n:
            hit, miss = prior * n / A, (1 - prior) * (m + 0.5) / (B + 1)
            out[e] = hit / (hit + miss)
    return out


def _logit(p: float) -> float:
    return float(np.log(p) - np.log1p(-p))


def score_texts(docs: DataFrame, lexicon: dict[str, float], trigrams: np.ndarray, text: str = "text", base: float = 0.02) -> DataFrame:
    """`docs` with `score`, the probability by the added log odds of the evidence (`base` without any, as for null and empty texts); a column of that name is replaced.

    Evidence with the same first SHORTEST letters, as of a word and its beginnings, counts once, by the strongest.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast((lexicon, trigrams))
    rows = docs.drop("score")
    columns = rows.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        learned, counts = held.value
        decoder = Decoder(counts)
        prior = _logit(learned.get("", base))
        evidence: dict[str, list[float]] = {}  # log odds as a whole word and as a beginning
        for e, p in learned.items():
            if e:
                evidence.setdefault(e.rstrip("$"), [0.0, 0.0])[not e.endswith("$")] = _logit(p) - prior
        finder = ahocorasick.Automaton()
        for e, (whole, begin) in evidence.items():
            finder.add_word(e, (len(e), e[:SHORTEST], whole, begin))
        if evidence:
            finder.make_automaton()

        def add(lowered: str, odds: dict[str, float]) -> None:
            for end, (n, root, whole, begin) in finder.iter(lowered):
                if end >= n and lowered[end - n].isalpha():
                    continue
                ends = end + 1 == len(lowered) or not lowered[end + 1].isalpha()
                best = max(begin, whole if ends else 0.0)
                if best > odds.get(root, 0.0):
                    odds[root] = best

        for batch in batches:
            scores = []
            for raw in texts_of(batch.column(at)):
                odds: dict[str, float] = {}
                if evidence:
                    lowered = raw.decode("utf-8", "replace").lower()
                    add(lowered, odds)
                    for word in restored_spans(lowered, decoder):
                        add(word, odds)
                scores.append(max(base, float(1 / (1 + np.exp(-prior - sum(odds.values()))))) if odds else base)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def training_rows(docs: DataFrame, labels: DataFrame, fold: str, per_class: int = PER_CLASS, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Up to `per_class` labelled documents of each class and `fold`, those with the least hash of the id.

    The labels are cut down first, so that a table of bounded size meets the documents. Of several labels
    of a document the highest counts.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).where(fold).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias(label))
    salted = known.withColumns({"h": F.xxhash64("_id"), "salt": F.pmod(F.xxhash64("_id"), F.lit(16))})
    some = salted.withColumn("k", F.row_number().over(W.partitionBy(label, "salt").orderBy("h"))).where(F.col("k") <= -(-per_class // 16)).select("_id", label)
    rows = docs.drop(label)
    return rows.join(F.broadcast(some), rows[doc_id] == some["_id"]).drop("_id")  # 2 * (per_class + 16) rows at most


