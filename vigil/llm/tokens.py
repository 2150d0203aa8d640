"""Token ids of many texts through a bounded cache of units.

A unit is a stretch of text that a tokenizer never joins with its neighbours, such as a word and the space
before it. Distinct units go to the tokenizer library in batches; a text's ids are those of its units.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Callable

import pyarrow as pa
from tokenizers import Tokenizer

#: Units that a cache holds at most (about 200 bytes each); those met first stay.
LIMIT = 700_000
#: The same for byte-level stretches, whose workers also serve other stages.
STRETCHES = 250_000


class Units:
    """bytes of a unit -> what `encode` makes of it, over all texts that a worker sees."""

    def __init__(self, pattern: bytes, encode: Callable[[list[str]], list], limit: int = LIMIT):
        self.find = re.compile(pattern).findall
        self.encode, self.limit, self.known = encode, limit, {}

    def __call__(self, texts: list[bytes]) -> list[list]:
        parts = [self.find(t) for t in texts]
        values = [list(map(self.known.get, p)) for p in parts]
        gaps = [(k, [j for j, v in enumerate(row) if v is None]) for k, row in enumerate(values) if None in row]
        missing = list({parts[k][j] for k, at in gaps for j in at})
        found = dict(zip(missing, self.encode([m.decode("utf-8", "replace") for m in missing]), strict=True))
        for k, at in gaps:
            for j in at:
                values[k][j] = found[parts[k][j]]
        if len(self.known) + len(found) <= self.limit:
            self.known.update(found)
        return values


#: The stretches that byte-level BPE never joins, for texts whose letters beyond ASCII are Latin-1 letters: contractions,
#: letters, digits and others with the one space before them; a longer run of white space leaves its last character.
BYTE_LEVEL = rb"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9\x80-\xff]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Bytes of such texts: ASCII without the separators 0x1C-0x1F, and UTF-8 that begins with 0xC3.
_PLAIN = bytes(k for k in range(256) if not 28 <= k <= 31 and (k < 192 or k == 195))
_SIGNS = re.compile(rb"\xc3[\x97\xb7]")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [k for k in range(256) if k not in set(kept)]
    return {k: k for k in kept} | {k: 256 + i for i, k in enumerate(others)}


class _Known(dict):
    """unit -> its ids; a unit that is not known is encoded and, up to STRETCHES, remembered."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, unit: bytes) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(unit.decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) < STRETCHES:
            self[unit] = ids
        return ids


class ByteLevelIds:
    """uint32 ids, as bytes, of whole texts under a byte-level BPE file of the tokenizers library.

    Texts with other letters, odd white space or special strings are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or rb"(?!)")
        self.units = _Known(self.tokenizer.model)
        self.find = re.compile(BYTE_LEVEL).findall

    def _whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        get = self.units.__getitem__
        odd = [bool(t.translate(None, _PLAIN) or _SIGNS.search(t) or self.special.search(t)) for t in texts]
        return [self._whole(t) if o else b"".join(map(get, self.find(t))) for t, o in zip(texts, odd, strict=True)]


_loaded: dict[tuple, object] = {}


def loaded(kind: Callable, *args):
    """One instance for each worker process: reused workers keep what they have learned, for one kind at a time.

    Workers serve all stages of a job, so what an earlier stage has built is let go when another one begins.
    """
    key = (kind.__name__, *args)
    if key not in _loaded:
        release()
        _loaded[key] = kind(*args)
    return _loaded[key]


def release() -> None:
    """Gives back to the system what earlier tasks have left in this worker: instances, Arrow's pool and free heap."""
    _loaded.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
