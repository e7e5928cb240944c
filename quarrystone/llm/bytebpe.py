"""Exact, fast encoding and decoding with a byte-level BPE vocabulary file of the ``tokenizers`` library.

The file's pre-tokeniser cuts a text into words that are encoded one by one.  Texts of plain Latin-1
characters are cut here by one expression, each distinct word is encoded by the library once and kept
in a bounded table; every other text goes to the library whole.  Both ways give the library's ids.
Special strings in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import claim

FILE = "byte_bpe_50k.json"
#: Words kept by an encoder; the table starts anew when full.
KEPT_WORDS = 200_000
#: Longer words are not kept.
KEPT_LENGTH = 64
#: The file's pre-tokeniser for texts of plain characters, fixed by its format.
PLAIN = bytes(c for c in range(256) if not (c < 9 or 13 < c < 32 or 126 < c < 161 or c in (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE)))
WORD = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t-\rA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def plain_words(text: str) -> list[str] | None:
    """The pre-tokeniser's words, if all characters are plain ones of Latin-1."""
    try:
        return None if text.encode("latin-1").translate(None, PLAIN) else WORD.findall(text)
    except UnicodeEncodeError:
        return None


def alphabet() -> dict[str, int]:
    """The byte for each character of the vocabulary's strings: printable ones stand for themselves, the others follow from 256."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str) -> "ByteEncoder":
    return ByteEncoder(path)


class ByteEncoder:
    """Ids as little-endian numbers of two bytes, or of four for vocabularies beyond 65,536."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        n, of = self.library.get_vocab_size(with_added_tokens=True), alphabet()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.bytes = [bytes(of[c] for c in self.library.id_to_token(k) or "") for k in range(n)]
        self.kept: dict[str, bytes] = {}

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.kept.clear()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        split = [plain_words(t) for t in texts]
        whole = iter(self.library_ids([t for t, w in zip(texts, split) if w is None]))
        claim(self)
        kept = self.kept
        new = list({w for words in split if words for w in words if w not in kept})
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = list({w for words in split if words for w in words})
        kept.update(zip(new, self.library_ids(new)))
        out = [next(whole) if words is None else b"".join(map(kept.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, self.kind).tolist())).decode()
