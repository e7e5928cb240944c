"""Exact, fast encoding with a word-end BPE vocabulary file of the ``tokenizers`` library.

The file's normaliser lower-cases and its pre-tokeniser cuts a text into words that are encoded
one by one.  Texts whose characters all lie in a range where lower-casing, normal form C, white
space and letter classes are plain (``PLAIN``) are cut here by one expression; each distinct word
is encoded by the library once and kept in a bounded table.  Every other text, and every text that
may hold one of the file's special strings, goes to the library whole.  Both ways give the
library's ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .common import claim

FILE = "word_bpe_49k.json"
#: Words kept by an encoder; the table starts anew when full.
KEPT_WORDS = 450_000
#: Longer words are not kept.
KEPT_LENGTH = 64

#: Letters and digits below U+0250, as the file's pre-tokeniser sees them.
LETTER = "a-zªµºß-öø-ɏ"
DIGIT = "0-9²³¹¼-¾"
#: A character outside the plain range; tab to carriage return are plain, U+0130 changes length.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0À-Þİɐ-\U0010ffff]|<\\|")
#: The plain characters of one byte in Latin-1, lower-cased.
PLAIN_BYTES = bytes(c for c in range(256) if not ODD.search(chr(c)))
WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{DIGIT}]|[^ \t-\r{LETTER}{DIGIT}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


@lru_cache(maxsize=2)
def encoder(path: str) -> "WordEncoder":
    return WordEncoder(path)


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept: dict[str, bytes] = {}
        n = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [self.library.id_to_token(i) or "" for i in range(n)]
        # The same model without the normaliser, for words that are lower-cased and cut already.
        plain = json.loads(self.library.to_str())
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.by_word = Tokenizer.from_str(json.dumps(plain))
        self.ends = np.array([x.endswith("</w>") for x in self.strings])

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words of plain texts: encoded in one go, spaces between, and cut where words end."""
        ids = np.array(self.by_word.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        raw, stops = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(stops) != len(words):
            # A file whose words do not all end by their mark: each word alone, by the library.
            return {w: self.whole(w) for w in words}
        return {w: raw[a:b] for w, a, b in zip(words, [0, *stops], stops)}

    def whole(self, text: str) -> bytes:
        """The library's ids, as little-endian unsigned 32-bit integers."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """The pre-tokeniser's words of a plain text, None for others."""
        low = text.lower()
        try:
            odd = low.encode("latin-1").translate(None, PLAIN_BYTES) or "<|" in low
        except UnicodeEncodeError:
            odd = ODD.search(low)
        return None if odd else WORD.findall(low)

    def forget(self) -> None:
        self.kept.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; the words that are not kept yet are encoded together."""
        claim(self)
        kept, out, open_, missing = self.kept, [], [], set()
        for k, text in enumerate(texts):
            words = self.words(text)
            if words is None:
                out.append(self.whole(text))
                continue
            ids = list(map(kept.get, words))
            if None in ids:
                missing.update(w for w, x in zip(words, ids) if x is None)
                open_.append((k, words, ids))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if missing:
            new = self.fresh(list(missing))
            for k, words, ids in open_:
                out[k] = b"".join([new[w] if x is None else x for w, x in zip(words, ids)])
            if len(kept) + len(new) > KEPT_WORDS:
                kept.clear()
            kept.update((w, x) for w, x in new.items() if len(w) <= KEPT_LENGTH)
        return out

    def marked(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library, and for each twice the character where it ends, plus one if it is the last with a part of that."""
        e = self.library.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        # Tokens of one character in parts all have its whole place.
        last = np.append(spans[1:, 0] >= spans[:-1, 1], [True] * min(1, len(spans)))
        return np.array(e.ids, "<u4"), np.maximum.accumulate(spans[:, 1]) * 2 + last if len(spans) else np.zeros(0, np.int64)

    def decode(self, ids: bytes) -> str:
        """As the library decodes with a file that names no decoder: the tokens' strings, spaced."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
