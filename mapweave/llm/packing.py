"""Best-fit packing of token counts into sequences of fixed capacity by linear grouping.

Only the number of pieces per length (at most ``capacity`` rows, whatever the data) is needed to decide, so the driver
plans on that histogram, and tasks look their pieces up in the plan:

1. Lengths above a share of the capacity are large.  Sorted down, they fall in groups of equal cardinality; each is
   rounded up to the largest of its group.
2. Few sizes are left.  Fill patterns of them by an exact bounded knapsack, largest group first, as often as stock lasts.
3. Actual pieces take the places of the rounded ones in order of length, which frees what rounding had added.
4. Small pieces go, longest first, to the fullest sequence that still takes them, and open new ones when none does.

All counts are run-length coded, so the work follows the number of lengths and not the number of pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.arrow_sequences import with_end
from mapweave.llm.bpe import WordEncoder
from mapweave.llm.common import stored, tokenizer_path
from mapweave.llm.words import pieces as text_pieces

CAPACITY = 2048
GROUPS = 128
SMALL = 0.3

# A run of equal places: pieces of ``length`` with ranks from ``first`` on; ``per`` of them in each sequence from
# ``sequence`` on, the first of them at ``offset``.
Run = tuple[int, int, int, int, int, int]  # length, first, count, sequence, per, offset


def _patterns(sizes: list[int], stock: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of group sizes (largest first) with the number of times each is used, until nothing is left."""
    out = []
    left = list(stock)
    for g in range(len(sizes)):
        while left[g]:
            room = capacity - sizes[g]
            # best[r]: least unused room when r is open; one pass per group with at most room // size copies.
            reach = np.full(room + 1, -1, np.int64)  # last group used to fill exactly this much
            reach[0] = g
            made: list[tuple[int, int] | None] = [None] * (room + 1)
            for j in range(g, len(sizes)):
                have = left[j] - (j == g)
                size = sizes[j]
                if have <= 0 or size > room:
                    continue
                copies = np.zeros(room + 1, np.int64)
                for r in range(size, room + 1):
                    if reach[r] < 0 and reach[r - size] >= 0 and copies[r - size] < have:
                        copies[r] = copies[r - size] + 1
                        reach[r], made[r] = j, (j, r - size)
            best = int(np.flatnonzero(reach >= 0)[-1])
            used = [0] * len(sizes)
            used[g] = 1
            while best:
                j, best = made[best]
                used[j] += 1
            times = min(left[j] // used[j] for j in range(len(sizes)) if used[j])
            left = [a - b * times for a, b in zip(left, used)]
            out.append((used, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[Run]:
    """Runs that place every piece of the histogram (length to count); lengths are from 1 to the capacity."""
    large = sorted((n for n in histogram if n > small * capacity), reverse=True)
    runs: list[Run] = []
    rank = dict.fromkeys(histogram, 0)
    total = sum(histogram[n] for n in large)
    each = max(1, -(-total // groups))
    stocks: list[list[list[int]]] = []  # per group: [length, count] from the longest down
    for n in large:
        count = histogram[n]
        while count:
            if not stocks or sum(c for _, c in stocks[-1]) == each:
                stocks.append([])
            take = min(count, each - sum(c for _, c in stocks[-1]))
            stocks[-1].append([n, take])
            count -= take
    sequence = 0
    gaps: dict[int, list[list[int]]] = {}  # free room to [first sequence, count, filled]
    for used, times in _patterns([s[0][0] for s in stocks], [sum(c for _, c in s) for s in stocks], capacity):
        slots = [g for g, k in enumerate(used) for _ in range(k)]
        # Each slot takes ``times`` pieces of its group in order of length; cut where any slot's length changes.
        parts = []
        for g in slots:
            got, need = [], times
            while need:
                n, c = stocks[g][0]
                take = min(c, need)
                got.append((n, take))
                need -= take
                stocks[g][0][1] -= take
                if not stocks[g][0][1]:
                    stocks[g].pop(0)
            parts.append(got)
        cuts = sorted({0, *(int(x) for got in parts for x in np.cumsum([c for _, c in got]))})
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for got in parts:
                n = got[int(np.searchsorted(np.cumsum([c for _, c in got]), a, "right"))][0]
                runs.append((n, rank[n], b - a, sequence + a, 1, offset))
                rank[n] += b - a
                offset += n
            if offset < capacity:
                gaps.setdefault(capacity - offset, []).append([sequence + a, b - a, offset])
        sequence += times
    rooms = sorted(gaps)
    for n in sorted((n for n in histogram if n <= small * capacity), reverse=True):
        count = histogram[n]
        while count:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                per = capacity // n
                whole = -(-count // per)
                gaps.setdefault(capacity, []).append([sequence, whole, 0])
                insort(rooms, capacity)
                sequence += whole
                continue
            room = rooms[i]
            first, have, filled = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(i)
            per = room // n
            full, over = divmod(count, per)
            uses = min(have, full)
            placed = []
            if uses:
                placed.append((first, uses, per))
            if uses < have and uses == full and over:
                placed.append((first + uses, 1, over))
            for at, number, k in placed:
                runs.append((n, rank[n], number * k, at, k, filled))
                rank[n] += number * k
                count -= number * k
                free = room - k * n
                if free:
                    if free not in gaps:
                        insort(rooms, free)
                    gaps.setdefault(free, []).append([at, number, filled + k * n])
            done = sum(number for _, number, _ in placed)
            if done < have:
                if room not in gaps:
                    insort(rooms, room)
                gaps.setdefault(room, []).append([first + done, have - done, filled])
    return runs


def _cutter(path: str, spaced: bool, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = WordEncoder(path, spaced), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in text_pieces(batch):
                ids, at = with_end(*encode.encode(piece.column("text")))
                total = np.diff(at)
                number = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), number)
                index = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = index * capacity
                length = np.minimum(capacity, total[doc] - start)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                begin = at[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                local = np.empty(len(length), np.int64)  # how many of this length this task had before
                order = np.argsort(length, kind="stable")
                s = length[order]
                new = np.flatnonzero(np.diff(s, prepend=-1))
                local[order] = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s)))) + seen[s]
                np.add.at(seen, length, 1)
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id").take(pa.array(doc)), "piece": pa.array(index, pa.int32()), "start": start,
                    "length": length, "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(doc), task), pa.int32()), "local": local,
                })

    return cut


def cut_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document (doc_id, text), with the ids' crc32, written to the shared folder.

    ``task`` and ``local`` number the pieces of one length without bringing them together."""
    path = tokenizer_path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
    return stored(rows.mapInArrow(_cutter(path, spaced, capacity), kind), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """``pieces`` (as of cut_documents) with sequence_id and offset.

    A piece's rank among its length is its number in its task plus what earlier tasks have, so a length that a third of
    all pieces share is spread over tasks.  The driver sees one row per length; each length's runs join by broadcast
    (bounded: the runs follow the lengths, not the pieces)."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = stored(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity, groups, small) or [(0, 0, 0, 0, 1, 0)]
    spark = pieces.sparkSession
    before = "sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding)"
    bases = counts.selectExpr("length", "task", f"coalesce({before}, 0) as base")
    table = np.array(sorted(runs), np.int64)
    span = 1 + int(max(histogram.values(), default=1))
    keys = table[:, 0] * span + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, length * span + rank, "right") - 1]
            step, within = np.divmod(rank - run[:, 1], run[:, 4])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([batch.column(x) for x in names] + [pa.array(run[:, 3] + step), pa.array(run[:, 5] + within * length)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "task"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "base + local as rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is one piece of one id (the end id); only documents longer than the capacity
    are cut; rows with one doc_id are packed each by itself; an empty table gives no rows; other columns are ignored."""
    return pack(cut_documents(docs, tokenizer, spaced, capacity), capacity)
