"""Models are injected functions; these are the deterministic defaults that need no network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.terms import Md5, Terms

Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[str], str]
PairScorer = Callable[[list[tuple[str, str]]], list[float]]

_held: dict[str, Md5] = {}


def hash_embedder(dims: int = 64) -> Embedder:
    """Signed feature hashing of distinct words, normalised to length 1; a text without words is all zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        digest = _held.setdefault("words", Md5(1 << 18))  # one a process
        t = Terms(texts, ascii=True)
        names, word = np.unique(t.hashes, return_inverse=True)
        first = np.unique(t.rows * max(1, len(names)) + word, return_index=True)[1]  # each word of a text once
        h = digest(t)[first]
        out = np.bincount(t.rows[first] * dims + h % dims, weights=(h >> 16 & 1) * 2 - 1, minlength=len(texts) * dims).reshape(len(texts), dims)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)

    return embed


def embed_column(embedder: Embedder, batch: int = 256, shrink_to: int = 100):
    """A column function; a batch that fails is halved, a single text that fails is cut down to ``shrink_to`` characters, then given up (null)."""

    def resilient(texts: list[str]) -> list:
        try:
            return list(embedder(texts))
        except Exception:
            if len(texts) > 1:
                half = len(texts) // 2
                return resilient(texts[:half]) + resilient(texts[half:])
            if len(texts[0]) > shrink_to:
                return resilient([texts[0][: max(shrink_to, len(texts[0]) // 2)]])
            return [None]

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        rows = [t or "" for t in texts.to_pylist()]
        out: list = []
        for lo in range(0, len(rows), batch):
            out.extend(resilient(rows[lo : lo + batch]))
        return pa.array([None if v is None else v.tolist() for v in out], pa.list_(pa.float32()))

    return embed


def generate_column(generator: Generator):
    @F.arrow_udf("string")
    def generate(prompts: pa.Array) -> pa.Array:
        return pa.array([None if p is None else generator(p) for p in prompts.to_pylist()], pa.string())

    return generate


def echo_queries(prompt: str) -> str:
    """Stands in for a model that splits or rewrites a question: its halves, as a JSON array."""
    words = prompt.split()
    half = max(1, len(words) // 2)
    return json.dumps([" ".join(words[:half]), " ".join(words[half:])], ensure_ascii=False)


def first_sentence(prompt: str) -> str:
    """Stands in for a model that summarises or answers."""
    return re.split(r"(?<=[.!?])\s", prompt.strip(), maxsplit=1)[0]
