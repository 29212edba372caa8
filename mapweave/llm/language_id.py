"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of -1 and 1, made from its code point.  A trigram's vector
binds the letters' vectors, each shifted by its place: shift(shift(a)) * shift(b) * c.  A document's vector is the sum over its trigrams, and a language's
prototype the sum of its documents' unit vectors (in whole ten-thousandths, so that any order of adding gives
the same).  A document has the language of the prototype with the largest cosine; equal cosines go to the first name.

Defined cases: ``und`` with score 0 for a text that is null or has no letter, and for every text if nothing could be
learned; rows whose language is null are not learned from; repeated rows count as often as they occur; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import remainder
from mapweave.llm.words import pieces

DIMENSIONS = 1024
UNKNOWN = "und"
_UNIT = 10_000
_GAP = 32
_LETTER: np.ndarray | None = None
_VECTOR: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    for p in points.tolist():
        if p not in _VECTOR or len(_VECTOR[p]) != dimensions:
            _VECTOR[p] = np.random.default_rng([p, dimensions]).choice(np.array([-1, 1], np.int8), dimensions)
    return np.stack([_VECTOR[p] for p in points.tolist()])


def _numbered(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the number of each value among them; by a table where that is small."""
    if below > 1 << 23:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, np.int32)
    seen[values] = 1
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[values].astype(np.int64)


def document_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row per text, all zero where there is no letter."""
    low = [(t or "").lower() for t in texts]
    out = np.zeros((len(low), dimensions), np.float32)
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) == 0:
        return out
    doc = np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])
    letter = _letters()[points]
    points[~letter] = _GAP
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    keep[0] = True
    points, doc = points[keep], doc[keep]
    alphabet, symbol = _numbered(points, 0x110000)
    n = len(alphabet)
    whole = doc[2:] == doc[:-2]
    gram = ((symbol[:-2] * n + symbol[1:-1]) * n + symbol[2:])[whole]
    if len(gram) == 0:
        return out
    grams, gram = _numbered(gram, n**3)
    pair, count = np.unique(doc[2:][whole] * len(grams) + gram, return_counts=True)
    first = np.searchsorted(pair, np.arange(len(low) + 1) * len(grams))
    letters = _vectors(alphabet, dimensions)
    a, b, c = grams // n // n, grams // n % n, grams % n
    bound = (np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]).astype(np.float32)
    which, weight = pair % len(grams), count.astype(np.float32)
    for i in range(len(low)):
        span = slice(first[i], first[i + 1])
        if first[i] < first[i + 1]:
            out[i] = weight[span] @ bound[which[span]]
    return out


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes of the languages of docs (text, lang).  One row per task, language and dimension is
    shuffled; the driver gets one prototype per language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                vectors = document_vectors(piece.column("text").to_pylist(), dimensions)
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                units = np.rint(vectors / np.maximum(size, 1e-9) * _UNIT).astype(np.int64)
                names = piece.column("lang").to_pylist()
                for name in set(names):
                    here = np.array([x == name for x in names])
                    sums[name] = sums.get(name, 0) + units[here].sum(0)
        for name, vector in sums.items():
            yield pa.record_batch({"lang": [name] * dimensions, "place": pa.array(np.arange(dimensions), pa.int32()), "total": vector})

    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = known.mapInArrow(bundle, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    rows = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("v")).orderBy("lang").collect()
    profiles = np.array([[x["total"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), dimensions)
    size = np.linalg.norm(profiles, axis=1, keepdims=True)
    return [r["lang"] for r in rows], profiles / np.maximum(size, 1e-9)


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 if negative)."""
    dimensions = profiles.shape[1] if len(names) else DIMENSIONS
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*kept)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                vectors = document_vectors(piece.column("text").to_pylist(), dimensions).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                found, score = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
                if names:
                    cosine = vectors @ profiles.T / np.maximum(size, 1e-9)[:, None]
                    best = cosine.argmax(1)
                    score = np.where(size > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
                    found = [names[k] if s > 0 else UNKNOWN for k, s in zip(best.tolist(), size.tolist())]
                yield pa.record_batch([*piece.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*piece.schema.names, "lang_pred", "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(compare, f"{kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Prediction for each of docs (doc_id, text, lang), learned from those whose crc32(doc_id) mod 4 is not 2."""
    names, profiles = learn(docs.where(remainder("doc_id", 4) != 2))
    found = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), names, profiles)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
