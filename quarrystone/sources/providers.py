"""Providers: model, search and fetch calls behind one protocol, disabled by default."""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Provider(ABC):
    """Answers prompts in batches, inside the executors."""

    @abstractmethod
    def answer(self, prompts: list[str]) -> list[str | None]: ...

    def timed(self, prompts: list[str]) -> list[tuple[str | None, float]]:
        """Answers and the seconds that each took, by its share of the call's time."""
        start = time.perf_counter()
        got = self.answer(prompts)
        each = (time.perf_counter() - start) / max(1, len(prompts))
        return [(a, each) for a in got]

    def apply(self, rows: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
        """Adds answers; each distinct prompt is asked once."""
        provider = self

        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(**{answer: provider.answer(b[prompt].tolist())})

        asked = rows.select(prompt).distinct().mapInPandas(f, f"`{prompt}` string, `{answer}` string")
        return rows.join(asked, prompt, "left")


class Disabled(Provider):
    """Says nothing, so that results do not depend on a model."""

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [None] * len(prompts)


class Seeded(Provider):
    """Stands in for a model in tests and queries: answers, failures and times follow from digests of the prompts.

    Of 256 prompts ``fails`` have no answer and ``slow`` take a minute; prompts beyond ``most`` characters have none.
    """

    def __init__(self, name: str, fails: int = 0, slow: int = 0, most: int = 1 << 30):
        self.name, self.fails, self.slow, self.most = name, fails, slow, most

    def timed(self, prompts: list[str]) -> list[tuple[str | None, float]]:
        out = []
        for p in prompts:
            own = hashlib.md5((self.name + p).encode()).digest()
            answer = json.dumps({"value": hashlib.md5(p.encode()).hexdigest()[:8], "confidence": 0.9})
            out.append((None if own[0] < self.fails or len(p) > self.most else answer, 60.0 if own[1] < self.slow else 0.1))
        return out

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [a for a, _ in self.timed(prompts)]


class Embedder(ABC):
    """Vectors of texts, inside the executors."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def ready(self) -> bool:
        """Whether it can be used here."""
        return True

    def apply(self, rows: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        """Adds vectors; each distinct text is embedded once, null and blank ones have none."""
        embedder = self

        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(**{vector: embedder.embed(b[text].tolist())})

        asked = rows.select(text).filter(F.trim(text) != "").distinct().mapInPandas(f, f"`{text}` string, `{vector}` array<float>")
        return rows.join(asked, text, "left")


class HashedWords(Embedder):
    """Counts of a text's words in hashed places with hashed signs, of length one; it needs no model."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % self.size] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).tolist()


def first_ready(candidates: Sequence[Embedder]) -> Embedder:
    """The first of several embedders that can be used here."""
    found = next((c for c in candidates if c.ready()), None)
    if found is None:
        raise LookupError("no embedder is ready")
    return found


class Harvester(ABC):
    """A source of catalog records."""

    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame: ...
