"""SentencePiece models on the tokenizers library.

The model file is read field by field from its protobuf. Its normaliser becomes a marker for spaces (with
the dummy prefix), its pieces a unigram model with their scores or, for models of that kind, a BPE model
whose merges are ordered by the scores of what they make; byte pieces give the fallback. Only `identity`
normalisation is supported, and no piece may hold the marker after another character: then words are
encoded apart, each distinct one once.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from vigil.llm.tokens import Units, loaded
from vigil.llm.words import slices, texts_of

MARK = "▁"
#: Kinds of pieces and of models, as the format numbers them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """What a model file says: pieces as (text, score, kind), the kind of model, and its normaliser's switches."""

    def __init__(self, data: bytes):
        self.pieces, self.kind, self.normaliser = [], UNIGRAM, "nmt_nfkc"
        self.dummy_prefix, self.remove_extra_spaces, self.byte_fallback = True, True, False
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.normaliser = spec.get(1, b"identity").decode()
                self.dummy_prefix, self.remove_extra_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.normaliser != "identity":
            raise ValueError(f"normaliser {self.normaliser} is not supported")
        if any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL):
            raise ValueError("a piece crosses a space")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which the model joins them: by score, then leftmost.

        Pieces of equal score are runs of the marker. The leftmost pair wins there: the run on the left grows
        as far as pieces allow before the next one does, so longer results and longer left parts come first.
        """
        score = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        out = []
        for p, s in score.items():
            if p.strip(MARK) == "":
                out += [(-s, -len(p) - 1 / (1 + k), MARK * (len(p) - k), MARK * k) for k in range(1, len(p) // 2 + 1) if MARK * k in score and MARK * (len(p) - k) in score]
                continue
            out += [(-s, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        return [(a, b) for _, _, a, b in sorted(out)]

    def tokenizer(self) -> Tokenizer:
        unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            name = None if unknown is None else self.pieces[unknown][0]
            model = models.BPE({p: k for k, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=name, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind} is not supported")
        out = Tokenizer(model)
        spaces = [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()] if self.remove_extra_spaces else []
        out.normalizer = normalizers.Sequence([*spaces, normalizers.Replace(" ", MARK)])
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out


class SentencePieces:
    """uint32 ids, as bytes, of whole texts; with the library at hand, whether it agrees on every word."""

    def __init__(self, path: str, data: bytes, threads: int, verify: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model(data)
        self.tokenizer = self.model.tokenizer()
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        line = not any("\n" in p for p, _, kind in self.model.pieces if kind == NORMAL)
        self.units = Units(rb" *[^ \n]+| +|\n" if line else rb" *[^ ]+| +", self._encode)
        self.lost: set[bytes] = set()
        self.odd: set[bytes] = set()
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """ids of each word; words that do not come back, or that the library splits otherwise, are noted."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        table = self.bytes
        for t, ids in zip(texts, found, strict=True):
            if b"".join([table[k] for k in ids]) != t.encode():
                self.lost.add(t.encode())
        if self.reference is not None:  # the library adds a space of its own in front
            want = self.reference.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
            lead = len(self.reference.encode("\n"))
            for t, ids, w in zip(texts, found, want, strict=True):
                if ids != (w if t[0] == " " else w[lead:]) and t != " ":  # alone, the library's own space has nothing to stand before
                    self.odd.add(t.encode())
        return [array("I", ids).tobytes() for ids in found]

    def __call__(self, texts: list[bytes]) -> list[tuple[bytes, bool, bool]]:
        """(ids, decoding gives the text back, the library agrees on each word) of each text."""
        front = b" " if self.model.dummy_prefix else b""
        marked = [t.replace(MARK.encode(), b" ") for t in texts]
        if self.model.remove_extra_spaces:
            marked = [re.sub(rb" +", b" ", t).strip(b" ") for t in marked]
        spaced = [front + t if t else t for t in marked]
        out = []
        for raw, text, full, parts in zip(texts, marked, spaced, self.units(spaced), strict=True):
            words = set(self.units.find(full)) if self.lost or self.odd else set()
            out.append((b"".join(parts), raw == text and self.lost.isdisjoint(words), self.odd.isdisjoint(words)))
        return out


def model_bytes(path: str) -> bytes:
    """The model file, read once by the driver: its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: str, text: str = "text", threads: int = 2, verify: bool = True) -> DataFrame:
    """`docs` with ids (little-endian uint32), round_trip and parity; columns of these names are replaced.

    round_trip: decoding the ids gives the text back. parity: for every distinct word of the text the
    sentencepiece library gives the same ids (always true if not verified). Null and empty texts have no
    ids and true flags. A marker character in a text counts as a space, as in the library, and is not given
    back. `threads` is for one task; give it what spark.task.cpus grants.
    """
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    base = docs.drop("ids", "round_trip", "parity")
    columns = base.columns
    at = columns.index(text)
    schema = StructType([*base.schema.fields, StructField("ids", BinaryType()), StructField("round_trip", BooleanType()), StructField("parity", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(SentencePieces, model, held.value, threads, verify)
        for batch in batches:
            texts = texts_of(batch.column(at))
            for begin, end in slices(texts):
                ids, back, same = zip(*pieces(texts[begin:end]), strict=True)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back), pa.array(same)], [*columns, "ids", "round_trip", "parity"])

    return base.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """`coded` with the column `decoded`: the text of its ids; null ids give null. Ids outside the vocabulary raise."""
    held = coded.sparkSession.sparkContext.broadcast(model_bytes(model))
    base = coded.drop("decoded")
    columns = base.columns
    at = columns.index(ids)
    schema = StructType([*base.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(SentencePieces, model, held.value, 1, False)
        size, front = len(pieces.model.pieces), pieces.model.dummy_prefix
        for batch in batches:
            rows = [None if b is None else array("I", b).tolist() for b in batch.column(at).to_pylist()]
            if any(max(r, default=0) >= size for r in rows if r):
                raise ValueError("an id is outside the vocabulary")
            texts = iter(pieces.tokenizer.decode_batch([r for r in rows if r is not None], skip_special_tokens=False))
            out = [None if r is None else next(texts) for r in rows]
            out = [t.removeprefix(" ") if t and front else t for t in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*columns, "decoded"])

    return base.mapInArrow(run, schema)
