"""Models that operators call: their interfaces, offline defaults, and a client for services over HTTP.

A provider is pickled to the workers and gets whole batches; what it loads it loads there, once.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa

from lectern.functions.tokens import NO_TERM, Tokens


class Embedder(Protocol):
    name: str
    version: str
    width: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """float[texts, width]."""


class Scorer(Protocol):
    def score(self, question: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Describer(Protocol):
    def describe(self, images: list[str]) -> list[str]:
        """Of data URLs."""


class Tokenizer(Protocol):
    def count(self, texts: list[str]) -> list[int]: ...


class Hashing:
    """Signed feature hashing of terms to unit vectors: an embedder without a model."""

    name, version = "hashing", "1"

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        t = Tokens(pa.array([x.lower() for x in texts], pa.large_string()), NO_TERM)
        digest = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in t.words.to_pylist()]
        h = np.array(digest or [0], np.int64)
        out = np.zeros((len(texts), self.width))
        np.add.at(out, (t.row, h[t.code] // 2 % self.width), np.where(h[t.code] % 2, 1.0, -1.0))
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0)


class Overlap:
    """Share of the question's terms that a text has: a reranker without a model."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        terms = {t for t in re.split(NO_TERM, question.lower()) if t}
        if not terms:
            return [0.0] * len(texts)
        t = Tokens(pa.array([x.lower() for x in texts], pa.large_string()), NO_TERM)
        return (sum((t.of(w) > 0).astype(float) for w in sorted(terms)) / len(terms)).round(6).tolist()


class Words:
    """White-space words: a tokenizer without a vocabulary."""

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.split()) for x in texts]


class Canned:
    """A generator that answers by a function of the prompt: for tests and dry runs."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


class HttpGenerator:
    """A generator behind HTTP: posts {model, prompt, stream: false} and takes ``response`` from the reply.

    A prompt that fails ``tries`` times gives an empty answer; between tries it waits 1, 2, 4, at
    most 8 seconds and a tenth more for each try.
    """

    def __init__(self, url: str, model: str, tries: int = 3, timeout: float = 300, wait: Callable[[float], None] = time.sleep):
        self.url, self.model, self.tries, self.timeout, self.wait = url, model, tries, timeout, wait

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False}, ensure_ascii=False).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Accept": "application/json"})
        for attempt in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.loads(reply.read().decode("utf-8", "replace")).get("response") or ""
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
                if attempt < self.tries:
                    self.wait(min(2 ** (attempt - 1), 8) + 0.1 * attempt)
        return ""


def embedded_each(embed: Callable[[list[str]], np.ndarray], texts: list[str]) -> np.ndarray:
    """A batch's vectors; if the batch fails each text by itself, and a space in place of a text that fails.

    Texts go with line ends as spaces, stripped, and a space for nothing.
    """
    texts = [t.replace("\r", " ").replace("\n", " ").strip() or " " for t in texts]
    try:
        return np.asarray(embed(texts))
    except Exception:  # noqa: BLE001  whatever a service raises
        rows = []
        for t in texts:
            try:
                rows.append(np.asarray(embed([t]))[0])
            except Exception:  # noqa: BLE001
                rows.append(np.asarray(embed([" "]))[0])
        return np.stack(rows)
