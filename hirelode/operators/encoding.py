"""Texts as vectors: what an encoder must do, and one that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shipped


class Encoder(Protocol):
    """Vectors of texts, row by row; a blank text is a zero vector, others have length 1."""

    size: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """Words and their three-letter parts hashed into ``size`` signed places; deterministic, and near for texts that share them."""

    def __init__(self, size: int = 128):
        self.size = size

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        known: dict[str, tuple[int, float]] = {}
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                for part in {w, *(f"#{w}#"[k : k + 3] for k in range(len(w)))}:
                    if part not in known:
                        h = zlib.crc32(part.encode())
                        known[part] = h % self.size, 1.0 if h >> 31 else -1.0
                    at, sign = known[part]
                    out[i, at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def encoded(df: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """``id, vec, tag`` of each row with a key, as ``retrieval.nearest`` takes them; texts go through in batches."""
    shipped(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vec = encoder.encode([x if isinstance(x, str) else "" for x in f["text"]])
            yield pd.DataFrame({"id": f["id"], "vec": list(vec), "tag": np.zeros(len(f), np.int32)})

    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, vec array<float>, tag int")


def has_vectors(df: DataFrame, column: str) -> bool:
    """Whether the column is there and any row has a vector."""
    return column in df.columns and not df.where(F.col(column).isNotNull()).isEmpty()


def _parts(*parts: Column) -> Column:
    return F.concat_ws(". ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def job_text(title: Column, tags: Column, skills: Column, specialisations: Column, requirements: Column) -> Column:
    """The text of an advert that is encoded: five fields, the last one's first 500 letters, blank ones left out."""
    return F.concat_ws(". ", *[F.nullif(F.trim(p), F.lit("")) for p in (title, tags, skills, specialisations)], F.nullif(F.substring(F.trim(requirements), 1, 500), F.lit("")))


def cv_text(skills: Column, profile: Column) -> Column:
    return _parts(skills, profile)


def retrieval_text(skills: Column, extras: Sequence[Column], categories: Column) -> Column:
    """Skills, what else the profile says, and the categories it suggests, joined by commas; blank ones left out."""
    trimmed = [F.nullif(F.trim(x), F.lit("")) for x in (skills, *extras)]
    return F.concat_ws(", ", *trimmed, F.nullif(F.array_join(categories, ", "), F.lit("")))
