"""Token ids of whole texts, by way of the distinct words in them.

A tokenizer that drops white space and never merges across it gives a text the ids of its white-space-separated words in turn. Words come from the
tokenizers library once and are then looked up. ``by_words`` tells from a vocabulary's file whether this holds; texts go to the library whole where it doesn't. ``tests/llm`` holds this
against the library over whole texts.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# str.split() also cuts at these, some of which are no white space to the tokenizer
ODD_SPACE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
KEPT = 400_000  # about 100 MB; a task may have several Python workers
TAIL = string.punctuation.replace("'", "")
ID = np.dtype("<u4")
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and up, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


#: The steps of a tokenizer that the lookup of words holds for.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}


@cache
def by_words(path: str) -> bool:
    """Whether the vocabulary's tokenizer has just the steps that looking up words and cutting texts rely on."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    whole = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"])) for t in found["added_tokens"])
    return whole and all(found[k] == v for k, v in STEPS.items()) and all(model.get(k) == v for k, v in plain.items())


def words_of(text: str) -> list[str]:
    """The words between runs of ASCII white space."""
    odd = ODD_SPACE[:4] if text.isascii() else ODD_SPACE
    return WORD.findall(text) if any(c in text for c in odd) else text.split()


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, in order, with about ``size`` bytes in ``column`` or one row."""
    for batch in batches:
        start, held = 0, 0
        for k, n in enumerate(pa.compute.binary_length(batch[column]).to_pylist()):
            if held and held + (n or 0) > size:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


class _Known(dict):
    """A bounded table that asks ``learn`` for what it lacks; emptied when it is full."""

    def __init__(self, learn: Callable[[str], bytes], limit: int):
        super().__init__()
        self.learn, self.limit = learn, limit

    def __missing__(self, key: str) -> bytes:
        value = self.learn(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes texts to little-endian 32-bit ids. limit bounds the words kept, not the results."""

    def __init__(self, path: str, limit: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = by_words(path)
        self._tokenize = self.tokenizer.model.tokenize
        self.words = _Known(self._word, limit)

    def _word(self, w: str) -> bytes:
        """Ids by the library: by its BPE model alone where the steps before it are plain.

        A word of letters is one pre-token, and normalisation only lower-cases it if it is
        composed already; what is left is the byte-level alphabet. Letters and the punctuation after them are separate
        pre-tokens, so 'word,' is 'word' and ','; not where a letter's lower case ends in a mark, which then belongs to the punctuation.
        """
        low = w.lower()
        if w.isalpha():
            if w.isascii():
                return array("I", [t.id for t in self._tokenize(low)]).tobytes()
            if len(low) == len(w) and low.isalpha() and "\u03a3" not in w and is_normalized("NFC", w) and is_normalized("NFC", low):
                return array("I", [t.id for t in self._tokenize(low.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        else:
            core = w.rstrip(TAIL)
            if len(core) < len(w) and core.isalpha() and core.lower().isalpha():
                return self.words[core] + self.words[w[len(core) :]]
        return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        get = self.words.__getitem__
        return [b"".join(map(get, words_of(text))) for text in texts]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words hold no white space."""
        return list(map(self.words.__getitem__, words))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, limit: int = KEPT) -> WordEncoder:
    """One encoder per Python worker, vocabulary and number of words kept."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = WordEncoder(path, limit)
    return _encoders[path, limit]
