"""Language identification by cross-parsing entropy.

For each language a suffix automaton over a bounded sample of its labelled text knows every substring of
that sample. A text is cut greedily into phrases: each phrase is the longest match with the sample. The
fewer phrases a text needs per character, scaled by the logarithm of the sample's length, the closer it
is to the language (Ziv-Merhav cross entropy in bits a character). All pieces of a batch are parsed side
by side, one character a step, through the automata's transition tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vigil.llm.tokens import release
from vigil.llm.words import slices, texts_of

#: Characters of labelled text taken for each language. A text adds up to PER_TEXT of them.
SAMPLE = 24_000
PER_TEXT = 400
#: Long texts are parsed in pieces of so many characters.
PIECE = 2_000
#: Languages whose tables one worker holds at a time.
GROUP = 8
UNKNOWN = "und"
#: Characters that Python counts as word characters though their category is not L (such as ², ½ or Ⅷ).
_SIGNS = {c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_LETTER = re.compile(r"[^\W\d_]")
_RUNS = re.compile(r"[\W\d_]+")


def training_split(doc_id: str = "doc_id") -> str:
    """SQL: true for rows that a model may learn from (two of three, by a checksum of the id)."""
    return f"crc32(cast({doc_id} as string)) % 3 <> 1"


def language_samples(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE) -> dict[str, str]:
    """Up to `size` characters per language: the first PER_TEXT letters and spaces of the labelled texts that come first by hash of the id.

    Rows without text, language or letters are left out. The ranking keeps size / PER_TEXT * 4 rows per
    language at most before anything is collected.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.substring(text, 1, PER_TEXT).alias("text"), F.xxhash64(doc_id).alias("h"))
    keep = -(-size // PER_TEXT) * 4
    salted = rows.withColumn("salt", F.expr("pmod(h, 32)"))
    some = salted.withColumn("k", F.row_number().over(W.partitionBy("lang", "salt").orderBy("h", "text"))).where(F.col("k") <= -(-keep // 32))
    out: dict[str, str] = {}
    for row in some.orderBy("lang", "h", "text").select("lang", "text").collect():  # bounded per language
        kept = plain(row["text"])
        if _LETTER.search(kept):
            out[row["lang"]] = (out.get(row["lang"], "") + " " + kept)[:size]
    return out


def plain(text: str) -> str:
    """Lower-case letters (categories L), other runs as one space."""
    text = text.lower()
    for c in () if text.isascii() else _SIGNS.intersection(text):
        text = text.replace(c, " ")
    return _RUNS.sub(" ", text)


class Automaton:
    """The suffix automaton of one string as a table: state, symbol -> next state; where no match goes on, that of a match begun anew."""

    def __init__(self, codes: np.ndarray, symbols: int):
        length, link, follow, last = [0], [-1], [{}], 0
        for c in codes.tolist():
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = cur
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    follow.append(dict(follow[q]))
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        # entry: where the next state's row begins, doubled, and 1 if a phrase ends before the symbol; row 0 is the root
        table = np.full((len(length), symbols), -1, np.int64)
        for state, arcs in enumerate(follow):
            table[state, list(arcs)] = list(arcs.values())
        fresh = np.maximum(table[0], 0)
        kind = np.int32 if table.size < 1 << 30 else np.int64
        self.flat = np.where(table < 0, fresh * (2 * symbols) + 1, table * (2 * symbols)).astype(kind).ravel()
        self.bits = np.log2(max(len(codes), 2))

    def phrases(self, columns: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases that each lane needs. columns: step, lane -> symbol; active: lanes still running at each step (longest first)."""
        row = np.zeros(columns.shape[1], self.flat.dtype)
        out = np.zeros(columns.shape[1], self.flat.dtype)
        for k, n in enumerate(active.tolist()):
            entry = self.flat.take(row[:n] + columns[k, :n])
            out[:n] += entry & 1
            np.right_shift(entry, 1, out=row[:n])
        return out + 1


class Model:
    """Automata of all learned languages over one alphabet; characters of no sample share the last symbol."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted(set("".join(samples.values())))
        self.symbols = len(letters) + 1
        self.code = np.full(0x110000, len(letters), np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(len(letters))
        self.samples = samples

    def automata(self) -> list[Automaton]:
        return [Automaton(self.encode(self.samples[x]), self.symbols) for x in self.languages]

    def encode(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def cross_entropies(texts: list[str], model: Model, automata: list[Automaton]) -> np.ndarray:
    """text, language -> bits a character."""
    codes = [model.encode(t) for t in texts]
    pieces = [(k, c[i : i + PIECE]) for k, c in enumerate(codes) for i in range(0, len(c), PIECE)]
    pieces.sort(key=lambda p: -len(p[1]))
    owner = np.array([k for k, _ in pieces], int)
    sizes = np.array([len(c) for _, c in pieces], int)
    steps = int(sizes.max(initial=0))
    columns = np.zeros((steps, len(pieces)), np.uint16)
    for j, (_, c) in enumerate(pieces):
        columns[: len(c), j] = c
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    out = np.zeros((len(texts), len(automata)))
    total = np.maximum(1, np.bincount(owner, sizes, minlength=len(texts)))
    for j, a in enumerate(automata):
        out[:, j] = np.bincount(owner, a.phrases(columns, active), minlength=len(texts)) * a.bits / total
    return out


def predict_languages(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1: the best language's share when each weighs 2 ** (-4 * bits a character)).

    Null texts and texts without a letter are `und` with score 0; so are all texts if nothing was learned.
    Equal entropies go to the language that comes first. Columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(samples)
    base = docs.drop("lang_pred", "score")
    columns = base.columns
    at = columns.index(text)
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = sorted(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        built = Model(held.value)
        groups = [built.languages[i : i + GROUP] for i in range(0, len(names), GROUP)]
        automata: dict[str, Automaton] = {}
        for batch in batches:
            raw = texts_of(batch.column(at))
            best, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
            for begin, end in slices(raw):
                kept = [plain(t.decode("utf-8", "replace")) for t in raw[begin:end]]
                lettered = [k for k, t in enumerate(kept) if _LETTER.search(t)]
                if not lettered or not names:
                    continue
                bits = []
                for group in groups:
                    if len(groups) > 1 or not automata:
                        automata = {x: Automaton(built.encode(built.samples[x]), built.symbols) for x in group}
                    bits.append(cross_entropies([kept[k] for k in lettered], built, list(automata.values())))
                h = np.concatenate(bits, 1)
                weight = 2.0 ** (-4 * (h - h.min(1, keepdims=True)))
                for k, j, w in zip(lettered, h.argmin(1).tolist(), (1 / weight.sum(1)).tolist(), strict=True):
                    best[begin + k], score[begin + k] = names[j], w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
