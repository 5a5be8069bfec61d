"""Seams for models: detector, segmenter, captioner, embedder and taggers are functions that a user registers; the
built-in ones are deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

MODELS: dict[str, tuple[str, Callable[[pd.Series], pd.Series]]] = {}


def register(name: str, schema: str, f: Callable[[pd.Series], pd.Series]) -> None:
    """`f` maps a column in batches; `schema` is the type of its result."""
    MODELS[name] = (schema, f)


def apply(name: str, col: Column) -> Column:
    schema, f = MODELS[name]

    @pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return run(col)


def hashed_vector(text: str, dim: int = 16) -> list[float]:
    v = np.frombuffer(hashlib.sha512((text or "").encode()).digest()[:dim], np.uint8) / 127.5 - 1
    return (v / np.linalg.norm(v)).tolist()


register("embed_text", "array<double>", lambda s: s.map(hashed_vector))
register("embed_image", "array<double>", lambda s: s.map(lambda b: hashed_vector(b.hex() if b is not None else "")))
register("caption", "string", lambda s: s.map(lambda b: f"an image of {len(b)} bytes" if b is not None else None))
register("detect", "array<struct<name:string,score:double>>", lambda s: s.map(lambda t: [{"name": w, "score": 1 / (k + 1)} for k, w in enumerate((t or "").split())]))
register("segment", "array<int>", lambda s: s.map(lambda b: [int(b is not None), len(b or b"")]))
register("entities", "array<string>", lambda s: s.map(lambda t: [w for w in (t or "").split() if w[:1].isupper()]))
register("nouns", "array<string>", lambda s: s.map(lambda t: [w for w in (t or "").lower().split() if w.isalpha() and len(w) > 3]))
