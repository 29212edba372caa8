"""The best documents for each query, over sketches that bound every document's score from above.

1. Index: a row per document with its distinct terms (64-bit hashes) and counts, and a sketch: four rows of two to four
   cells per distinct term, into which the terms' impacts fold as maxima, rounded up to 8 bits.
2. Queries are looked up in blocks.  The bound of a document is the weighted sum, over the query's terms, of the smallest of
   the term's four cells, so it is never below the score.
3. A task takes its documents in slices.  For each query it scores exactly those whose bound reaches the tenth best score
   found so far, by descending bound, until the next bound is below.  Each task hands on its best ten per query, and the
   best of all tasks are the answer.

Terms are compared by 64-bit hashes: two different terms count as one with a chance of about 1 in 10**19 per pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import discard, written
from mapweave.llm.words import FOLDED, bounds, buffer_of, hashes, mix, pieces

TOP = 10
SCALE = 10**9  # of impacts
SATURATION = 1000  # of a count
LENGTH_SHARE = 75  # in 100, of a document's length in its damping
DAMPING = 8
QUERIES = 256  # in a block
ROWS = 4  # of cells in a sketch
CELL = 4096  # impacts are below 10**6, so a cell of 8 bits holds them in steps of 4096
LOOKS = 1 << 20  # cells looked up at a time
SLICE = 1024  # documents whose sketches are opened at a time

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct term hashes of each text, and how often each occurs."""
    data, at = buffer_of(texts)
    begins, ends, first = bounds(data, at, _TERM)
    h = hashes(data, begins, ends, FOLDED)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(h[a:b], return_counts=True)


def impacts(counts: np.ndarray, damping: int) -> np.ndarray:
    return (SCALE * counts) // (SATURATION * counts + DAMPING * damping)


def damping_of(n: int, documents: int, all_terms: int) -> int:
    """By a document's length n, given the number of documents with terms and of all their terms."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // all_terms


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The places of each term in the rows of a sketch, one row after the other; width is a power of two."""
    return [((mix(h + np.uint64(j)) & np.uint64(width - 1)) + np.uint64(j * width)).astype(np.int64) for j in range(ROWS)]


def fold(h: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """A document's sketch: coordinatewise maxima, rounded up."""
    width = max(16, 1 << (4 * len(h) - 1).bit_length() >> 1)
    out = np.zeros(ROWS * width, np.uint8)
    up = (-(-impact // CELL)).astype(np.uint8)
    order = np.argsort(up, kind="stable")  # of terms in one cell the largest is written last
    for places in cells(h[order], width):
        out[places] = up[order]
    return out


@dataclass(frozen=True)
class Index:
    """``rows``: doc_id, key (unique), damping, hashes, counts, sketch; only documents with a term."""

    rows: DataFrame
    documents: int


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            n = np.diff(bounds(*buffer_of(piece.column("text")), _TERM)[2])
            yield pa.record_batch({"documents": pa.array([int((n > 0).sum())]), "terms": pa.array([int(n.sum())])})


def _indexed(batches: Iterator[pa.RecordBatch], documents: int, all_terms: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            keep, damping, h, c, s = [], [], [], [], []
            for i, (one, counts) in enumerate(terms(piece.column("text"))):
                if len(one) == 0:
                    continue
                keep.append(i)
                damping.append(damping_of(int(counts.sum()), documents, all_terms))
                h.append(one.tobytes())
                c.append(counts.astype(np.uint32).tobytes())
                s.append(fold(one, impacts(counts, damping[-1])).tobytes())
            if keep:
                of = piece.select(["doc_id", "key"]).take(pa.array(keep))
                yield pa.record_batch([*of.columns, pa.array(damping, pa.int64()), pa.array(h, pa.binary()), pa.array(c, pa.binary()), pa.array(s, pa.binary())], names=["doc_id", "key", "damping", "hashes", "counts", "sketch"])


def index(docs: DataFrame) -> Index:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents").alias("d"), F.sum("terms").alias("t")).first()
    kind = "doc_id long, key long, damping long, hashes binary, counts binary, sketch binary"
    keyed = texts.withColumn("key", F.monotonically_increasing_id())
    rows = keyed.mapInArrow(partial(_indexed, documents=total["d"] or 0, all_terms=total["t"] or 0), kind)
    return Index(written(rows, "index"), total["d"] or 0)


def _holding(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many documents hold each wanted term (sorted hashes)."""
    n = np.zeros(len(wanted) + 1, np.int64)
    for batch in batches:
        h = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
        at = np.searchsorted(wanted, h)
        at[at < len(wanted)] = np.where(wanted[at[at < len(wanted)]] == h[at < len(wanted)], at[at < len(wanted)], len(wanted))
        n += np.bincount(at, minlength=len(n))
    used = np.flatnonzero(n[:-1])
    yield pa.record_batch({"term": pa.array(wanted[used].view(np.int64)), "n": pa.array(n[used])})


@dataclass(frozen=True)
class Block:
    """Queries as sparse rows: for query q the terms ``hashes[first[q]:first[q + 1]]`` with weight times occurrences."""

    keys: list
    first: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray


def _bounds(block: Block, sketches: np.ndarray) -> np.ndarray:
    """Bound of each document (row, sketches of one width) for each query."""
    places = cells(block.hashes, sketches.shape[1] // ROWS)
    out = np.zeros((len(sketches), len(block.keys)), np.int64)
    used = np.flatnonzero(np.diff(block.first))
    step = max(1, LOOKS // max(1, len(block.hashes)))
    for i in range(0, len(sketches), step):
        few = sketches[i : i + step]
        look = reduce(np.minimum, (np.take(few, p, axis=1) for p in places)) * block.weights
        out[i : i + step, used] = np.add.reduceat(look, block.first[:-1][used], axis=1) * CELL
    return out


def _score(h: np.ndarray, counts: np.ndarray, damping: int, terms: np.ndarray, weights: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(h, terms), len(h) - 1)
    hit = h[at] == terms
    return int((weights[hit] * impacts(counts[at[hit]].astype(np.int64), damping)).sum())


def _search(batches: Iterator[pa.RecordBatch], block: Block, top: int) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple[int, int, int, int | None]]] = [[] for _ in block.keys]  # (-score, id, key, id or None), ascending
    no_id = np.iinfo(np.int64).max
    if len(block.hashes) == 0:
        batches = iter(())
    for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("sketch")]
        widths = np.array([len(x) for x in raw])
        bound = np.zeros((len(raw), len(block.keys)), np.int64)
        for w in np.unique(widths).tolist():
            here = np.flatnonzero(widths == w)
            for some in np.array_split(here, max(1, len(here) * w // LOOKS)):
                bound[some] = _bounds(block, np.stack([raw[i] for i in some]))
        h, c, damping = batch.column("hashes"), batch.column("counts"), batch.column("damping").to_pylist()
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q, mine in enumerate(best):
            lo, hi = block.first[q], block.first[q + 1]
            least = -mine[top - 1][0] if len(mine) >= top else 1
            some = np.flatnonzero(bound[:, q] >= least)
            for i in some[np.argsort(-bound[some, q], kind="stable")].tolist():
                if bound[i, q] < (-mine[top - 1][0] if len(mine) >= top else 1):
                    break
                if i not in read:
                    read[i] = np.frombuffer(h[i].as_buffer(), np.uint64), np.frombuffer(c[i].as_buffer(), np.uint32)
                score = _score(*read[i], damping[i], block.hashes[lo:hi], block.weights[lo:hi])
                if score > 0:
                    mine.append((-score, no_id if ids[i] is None else ids[i], keys[i], ids[i]))
                    mine.sort(key=lambda x: x[:3])
                    del mine[top:]
    rows = [(q, x[3], x[2], -x[0]) for q, mine in enumerate(best) for x in mine]
    q, ids, keys, scores = zip(*rows) if rows else ((), (), (), ())
    yield pa.record_batch({"query": pa.array(q, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "score": pa.array(scores, pa.int64())})


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """Rows of the query set, ``size`` at a time; the driver never holds more than a block and a partition's batch."""
    now: list = []
    for row in queries.toLocalIterator():
        now.append(row)
        if len(now) == size:
            yield now
            now = []
    if now:
        yield now


def _ranked(index: Index, rows: list, top: int) -> DataFrame:
    """item_id, rank, doc_id, score of one block of queries."""
    spark = index.rows.sparkSession
    asked = [Counter(np.repeat(h, c).tolist()) for h, c in terms(pa.array([r["text"] for r in rows], pa.string()))]
    wanted = np.array(sorted({t for a in asked for t in a}), np.uint64)
    found = index.rows.select("hashes").mapInArrow(partial(_holding, wanted=wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    holding = {int(np.int64(r["term"]).view(np.uint64)): r["n"] for r in found}
    # A term that no document holds adds nothing.
    known = [[(t, weight(index.documents, holding[t]) * n) for t, n in sorted(a.items()) if t in holding] for a in asked]
    first = np.cumsum([0, *map(len, known)])
    flat = [x for k in known for x in k]
    block = Block([r["item_id"] for r in rows], first, np.array([t for t, _ in flat], np.uint64), np.array([w for _, w in flat], np.int64))
    best = index.rows.mapInArrow(partial(_search, block=block, top=top), "query int, doc_id long, key long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(block.keys)), f"query int, item_id {index_type(rows)}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def index_type(rows: list) -> str:
    """The type of the queries' ids: text if any id is one, else whole numbers."""
    return "string" if any(isinstance(r["item_id"], str) for r in rows) else "long"


def search(index: Index, queries: DataFrame, top: int = TOP, size: int = QUERIES) -> DataFrame:
    """Per row of queries (item_id, text) its ``top`` documents with a score above 0: item_id, rank (from 1), doc_id, score;
    equal scores by ascending doc_id, null ids last.

    Defined cases: a query or document without terms (null texts are) is in no result; each row of the documents and of
    the queries counts by itself, also where ids repeat; empty tables give no rows; other columns are ignored."""
    asked = queries.select("item_id", F.col("text").cast("string").alias("text"))
    parts = [written(_ranked(index, rows, top), "ranked") for rows in _blocks(asked, size)]
    none = queries.sparkSession.createDataFrame([], f"item_id {dict(queries.dtypes)['item_id']}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts, none)


def search_documents(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    made = index(docs)
    found = search(made, queries, top)
    discard(made.rows)
    return found
