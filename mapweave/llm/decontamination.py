"""Benchmark passages in training texts, also where some words were exchanged: spaced-seed hashing.

A mask is laid over a window of words; the words at its zeros are ignored, the others are hashed.  Windows of a training text and of a
benchmark item with equal hashes give a diagonal (place in the text minus place in the item).  Along each diagonal the
longest stretch in which at least ``PERCENT`` of the words agree is measured; it is an overlap from ``TOKENS`` words on, or
from the item's length where that is less.  Every pattern of exchanged words that this rule accepts is hit by at least
one mask: a stretch of 26 words or more that holds it splits in two of 13 or more of which one holds it, so lengths up to 25
decide, and ``tests/llm`` lists them.  Words are runs of letters, digits and bytes beyond ASCII; A-Z and the capitals
of Latin-1 are lower-cased.

A bit table of the benchmark's hashes (2 MB, whatever the benchmark's size) spares the join those windows of training
texts that cannot match; what passes is joined exactly.

Defined cases: a null or empty text or item overlaps nothing; an item of less than five words is looked
for word for word (one exchanged word is more than 20 % of it); rows with the same doc_id and text are found alike, each is one row of the result per item; an
empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import in_slots, row_key, slots_of, stored
from mapweave.llm.words import bounds, buffer_of, hashes, mix, pieces

# Found by greedy covering of all accepted patterns, as heavy as few masks allow.
MASKS = ("11101111", "11010010111", "111110011", "1100100010111", "1110101001001", "1111111")
SHORT = {5: ("1111", "11011", "10111", "11101")}  # by the number of an item's words
SHORT |= dict.fromkeys(range(6, 10), ("110111", "11111", "111011", "101111", "111101"))
SHORT |= dict.fromkeys(range(10, 13), ("1110111", "110100111", "1111101", "10011111", "1101010011"))
TOKENS = 13
PERCENT = 80
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffer_of(texts)
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data = np.concatenate([data[:1], data[1:] + (upper.astype(np.uint8) << 5)])
    begins, ends, first = bounds(data, at, _WORD)
    return hashes(data, begins, ends), first


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash per window; the mask's own shape is part of it."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * _STEP + words[k : k + n]
    return mix(out)


def masks_of(size: int) -> tuple[str, ...]:
    """The masks laid over an item of so many words."""
    return SHORT.get(size, MASKS) if size > 4 else ("1" * size,) if size else ()


def windows(words: np.ndarray, first: np.ndarray, masks: list[str], bits: np.ndarray | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Mask, hash, text number and place within the text of all windows, or of those that may be in the bit table."""
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for mask in masks:
        h = masked(words, mask)
        at = np.arange(len(h)) if bits is None else np.flatnonzero(in_slots(bits, h))
        at = at[at + len(mask) <= first[doc_of[at] + 1]]
        doc = doc_of[at]
        yield mask, h[at], doc, at - first[doc]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words, first = tokens(piece.column("text"))
            size = np.diff(first)
            sizes = set(size.tolist())
            for mask, h, doc, place in windows(words, first, sorted({m for n in sizes for m in masks_of(n)})):
                use = np.isin(size[doc], [n for n in sizes if mask in masks_of(n)])
                doc, h, place = doc[use], h[use], place[use]
                yield pa.record_batch({"item_id": piece.column("item_id").take(pa.array(doc)), "hash": h.view(np.int64), "item_at": place, "mask": pa.array([mask] * len(h), pa.string())})


def _hits(batches: Iterator[pa.RecordBatch], bits: np.ndarray, masks: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words, first = tokens(piece.column("text"))
            for _, h, doc, place in windows(words, first, masks, bits):
                if len(h):
                    yield pa.record_batch({"row": piece.column("row").take(pa.array(doc)), "hash": h.view(np.int64), "doc_at": place})


def _token_bytes(batches: Iterator[pa.RecordBatch], key: str, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if wanted is not None:
            batch = batch.filter(pa.array(in_slots(wanted, batch.column(key).to_numpy())))
        for piece in pieces(batch):
            words, first = tokens(piece.column("text"))
            raw = words.tobytes()
            yield pa.record_batch([piece.column(key), pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())], names=[key, "words" if wanted is not None else "item_words"])


def longest_stretch(same: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """Begin and end of the longest stretch of agreeing words with at least this share (the first of equals)."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    low = np.minimum.accumulate(total)
    begin = np.searchsorted(-low, -total, "left")  # first place with a total not above this one's
    length = np.arange(len(total)) - begin
    end = int(length.argmax())
    return int(begin[end]), end


def _measured(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, start, size, agree = [], [], [], []
        for x, y, d in zip(batch.column("words"), batch.column("item_words"), batch.column("diagonal").to_pylist()):
            doc, item = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            lo, hi = max(0, -d), min(len(item), len(doc) - d)
            same = item[lo:hi] == doc[lo + d : hi + d]
            a, b = longest_stretch(same, percent)
            keep.append(b - a >= min(least, len(item)))
            start.append(lo + d + a)
            size.append(b - a)
            agree.append(int(same[a:b].sum()))
        out = pa.record_batch([batch.column("row"), batch.column("item_id"), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(agree, pa.int64())], names=["row", "item_id", "doc_start", "n_tokens", "n_equal"])
        yield out.filter(pa.array(keep, pa.bool_()))


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = TOKENS, percent: int = PERCENT) -> DataFrame:
    """A row per training row and item that overlap: row (xxhash64 of doc_id and text), item_id, and the longest overlap's
    doc_start, n_tokens, n_equal."""
    texts = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    seeds = stored(items.mapInArrow(_item_windows, "item_id long, hash long, item_at long, mask string"), "seeds")
    masks = [r["mask"] for r in seeds.select("mask").distinct().orderBy("mask").collect()]
    hits = texts.mapInArrow(partial(_hits, bits=slots_of(seeds, "hash"), masks=masks), "row long, hash long, doc_at long")
    met = stored(hits.join(seeds, "hash").selectExpr("row", "item_id", "doc_at - item_at as diagonal").distinct(), "diagonals")
    words = texts.mapInArrow(partial(_token_bytes, key="row", wanted=slots_of(met, "row")), "row long, words binary").groupBy("row").agg(F.first("words").alias("words"))
    item_words = items.mapInArrow(partial(_token_bytes, key="item_id"), "item_id long, item_words binary").distinct()
    both = met.join(words, "row").join(item_words, met["item_id"].eqNullSafe(item_words["item_id"])).select("row", met["item_id"], "diagonal", "words", "item_words")
    kind = "row long, item_id long, doc_start long, n_tokens long, n_equal long"
    found = both.mapInArrow(partial(_measured, least=least, percent=percent), kind)
    best = found.groupBy("row", "item_id").agg(F.min(F.struct((-F.col("n_tokens")).alias("less"), "doc_start", "n_tokens", "n_equal")).alias("v"))
    return best.select("row", "item_id", "v.doc_start", "v.n_tokens", "v.n_equal")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per training row and benchmark item that overlap: doc_id, item_id, doc_start, n_tokens, n_equal."""
    found = stored(overlaps(docs, benchmark), "overlaps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"))
    return rows.join(found, "row").select("doc_id", "item_id", "doc_start", "n_tokens", "n_equal")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap any item; all columns stay."""
    found = stored(overlaps(docs, benchmark).select(F.col("row").alias("_leak")).distinct(), "leaks")
    return docs.join(found, row_key() == found["_leak"], "left_anti")
