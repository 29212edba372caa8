"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, evaluated over all texts.

Words are hashed; an n-gram's hash is made of its history's (all words but the last) and its lower one's (all but the
first).  A text's tokens are its words and one end; its first token follows a begin sign, which no history goes beyond.

Counting.  Words are counted by key.  n-grams from 2 on are sent only where history and lower one are counted twice or more
(others occur once, and n-grams seen once count as unseen, as Katz proposed; their number still enters the discounts).
Model.  P1(w) = d n / Z, the rest of the mass is one unknown word.  For more words, P(w | h) = d n / Z(h) where (h, w) is
counted, else bow(h) P(w | h'), with bow(h) = (1 - sum of P(w | h)) / (1 - sum of P(w | h')) over the counted w.  Z(h) is the count
of h, or 0.5 more than the discounted counts if nothing else were left, so every distribution sums to one.
Evaluation.  The recursion unrolls: log P(w | h) = log P1(w) + sum over orders of [bow(h) + gain(h, w) if counted], where
gain = log P(w | h) - bow(h) - log P(w | h').  So a text's score is a sum over its distinct n-grams, and tables and
n-grams meet by buckets of the hash: no history, word or text is brought together in one task.  The n-grams counted most
often (FREQUENT at most) are known to every task and are added up where the text is read; only others are sent.
Texts are scored in SLICES, one after the other: what one has sent is deleted before the next is read.

Tables (lm order=1, 2, ...) are written to the shared folder, one folder per order.

Defined cases: a null or empty text is its end alone; without training texts the base and the model give every token the same
unknown word's mass; repeated rows are counted and scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from mapweave.llm.common import discard, in_slots, remainder, row_key, slots_of, stored, written
from mapweave.llm.words import mix, pieces, word_hashes

ORDER = 3
KATZ = 5  # counts above it are not discounted
LEAST = 2  # n-grams of two words and more that are seen less often count as unseen
FLUSH = 1 << 19  # tokens a task gathers before it sends
PER_BUCKET = 2 << 20  # tokens per bucket, about
CARRIED = 1 << 19  # n-grams met more than once that a task keeps back while it counts
FREQUENT = 1 << 18  # entries that every task knows
SLICES = 2  # parts of the texts that are scored one after the other
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xDA942042E4DD58B5)
SLOTS = 1 << 27  # bits of a table at most; a small table gets eight to sixteen per row, as each executor keeps its copy on disk too


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text with BEGIN before and END behind, and where each text begins (one more at the end)."""
    words, first = word_hashes(texts)
    n = len(first) - 1
    at = first + 2 * np.arange(n + 1)
    out = np.empty(len(words) + 2 * n, np.uint64)
    inside = np.ones(len(out), bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    out[inside] = words
    out[at[:-1]], out[at[1:] - 1] = BEGIN, END
    return out, at


def higher(history: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return mix(history * _STEP + lower)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(_join(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(n) if n else [], minlength=len(k)).astype(np.int64)


def _bits(grams: DataFrame) -> np.ndarray:
    """A bit per slot that a gram falls in."""
    return slots_of(grams, "gram", min(SLOTS, max(1 << 20, 1 << (8 * grams.count()).bit_length())))


def _may(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return in_slots(bits, grams, 8 * len(bits))


def count_words(training: DataFrame) -> DataFrame:
    """gram, n of words, END and BEGIN."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, held = [], [], 0

        def send() -> pa.RecordBatch:
            k, n = _summed(keys, numbers)
            keys.clear(), numbers.clear()
            return pa.record_batch({"gram": k.view(np.int64), "n": n})

        for batch in batches:
            for piece in pieces(batch):
                k, n = np.unique(tokens(piece.column("text"))[0], return_counts=True)
                keys.append(k), numbers.append(n)
                held += len(k)
                if held > FLUSH:
                    yield send()
                    held = 0
        yield send()

    return training.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _orders(token: np.ndarray, at: np.ndarray, order: int, kept: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders 2 to ``order``: history, lower and whole hashes at the places (of their last token) where both may be counted, and these places."""
    text = np.searchsorted(at, np.arange(len(token)), "right") - 1
    here, place = token, np.arange(len(token))  # (m-1)-grams by the place of their last token
    whole = np.ones(len(token), bool)
    for m in range(2, order + 1):
        ok = whole.copy()
        ok[1:] &= whole[:-1]
        ok[0] = False
        ok &= place - at[text] >= m - 1
        places = np.flatnonzero(ok)
        history, lower = here[places - 1], here[places]
        if kept:
            may = _may(kept[m - 2], history) & _may(kept[m - 2], lower)
            ok[places[~may]] = False
            places, history, lower = places[may], history[may], lower[may]
        new = np.zeros(len(token), np.uint64)
        new[places] = higher(history, lower)
        yield m, history, lower, new[places], places
        here, whole = new, ok


def count_grams(training: DataFrame, order: int, kept: Broadcast, buckets: int) -> DataFrame:
    """history, lower, n of the n-grams of ``order`` words, and one row (null, null, n) per n up to KATZ + 1: how many n-grams were seen n
    times (these rows are to be added up)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, lower, numbers, held, left_out = [], [], [], 0, 0

        def send(last: bool = False) -> Iterator[pa.RecordBatch]:
            h, w, n = _join(history), _join(lower), np.concatenate(numbers) if numbers else np.empty(0, np.int64)
            history.clear(), lower.clear(), numbers.clear()
            h, w, n = _pairs(h, w, n)
            # What was met more than once will be met again: it is sent at the end, unless it is too much.
            back = n > 1
            if not last and back.sum() <= CARRIED:
                history.append(h[back]), lower.append(w[back]), numbers.append(n[back])
                h, w, n = h[~back], w[~back], n[~back]
            bucket = (higher(h, w) % np.uint64(buckets)).astype(np.int64)
            sort = np.argsort(bucket, kind="stable")
            h, w, n = h[sort], w[sort], n[sort]
            cut = np.searchsorted(bucket[sort], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[b], cut[b + 1])
                yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "history": [h[s].tobytes()], "lower": [w[s].tobytes()], "n": [n[s].astype("<u4").tobytes()], "once": pa.array([0], pa.int64())})

        for batch in batches:
            for piece in pieces(batch):
                token, at = tokens(piece.column("text"))
                possible = int(np.maximum(np.diff(at) - (order - 1), 0).sum())
                for m, h, w, _, _ in _orders(token, at, order, kept.value):
                    if m == order:
                        left_out += possible - len(h)
                        h, w, n = _pairs(h, w, np.ones(len(h), np.int64))
                        history.append(h), lower.append(w), numbers.append(n)
                        held += len(h)
                if held > FLUSH:
                    yield from send()
                    held = 0
        yield from send(last=True)
        yield pa.record_batch({"bucket": pa.array([TaskContext.get().partitionId() % buckets], pa.int32()), "history": [b""], "lower": [b""], "n": [b""], "once": pa.array([left_out], pa.int64())})

    def merge(table):
        h, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("history", "lower"))
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4").astype(np.int64)
        h, w, n = _pairs(h, w, n)
        seen = np.bincount(np.minimum(n, KATZ + 2), minlength=KATZ + 3)[: KATZ + 2]
        seen[1] += sum(table.column("once").to_pylist())
        use = n >= LEAST
        empty = pa.nulls(KATZ + 1, pa.int64())
        return pa.table({
            "history": pa.chunked_array([pa.array(h[use].view(np.int64)), empty]), "lower": pa.chunked_array([pa.array(w[use].view(np.int64)), empty]),
            "n": np.concatenate([n[use], np.arange(1, KATZ + 2)]), "grams": np.concatenate([np.ones(use.sum(), np.int64), seen[1:]]),
        })

    sent = training.select("text").mapInArrow(count, "bucket int, history binary, lower binary, n binary, once long")
    return sent.groupBy("bucket").applyInArrow(lambda table: merge(table), "history long, lower long, n long, grams long")


def _pairs(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, w), sorted by h and w, with their n added up."""
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(h) else np.empty(0, np.int64)
    return h[new], w[new], np.add.reduceat(n, new) if len(new) else n


def discounts(seen: dict[int, int], least: int) -> list[float]:
    """Katz' discounts for counts 1 to KATZ from the numbers of n-grams by count; counts below ``least`` get 0.  Where the
    estimate is not between 0 and 1 (counts of counts can be uneven), half a count is taken off."""
    n = [0] + [seen.get(r, 0) for r in range(1, KATZ + 2)]
    out = []
    cut = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else 0.0
        out.append(0.0 if r < least else d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(d: list[float]) -> F.Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in d], F.lit(1.0)), F.least(F.col("n"), F.lit(KATZ + 1)).cast("int")) * F.col("n")


@dataclass
class Katz:
    tables: list[DataFrame]  # per order: gram, n, lp (its own log10 probability), gain
    weights: list[DataFrame]  # per order from 2 on: gram (a history), bow
    total: int  # training tokens N
    distinct: int  # of them different, V
    unknown: float  # log10 probability of the unknown word
    kept: list[np.ndarray]  # per order below the last: bits of the n-grams that longer ones are made of


def train(training: DataFrame, order: int = ORDER) -> Katz:
    """From texts (text)."""
    begin, end = int(BEGIN.view(np.int64)), int(END.view(np.int64))
    words = written(count_words(training), "lm_words")
    real = words.where(f"gram <> {begin}")
    stats = real.groupBy(F.least("n", F.lit(KATZ + 1)).alias("r")).agg(F.count("*").alias("grams"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") == KATZ + 1, 1).otherwise(0)).alias("last")).collect()
    total, distinct = sum(r["n"] for r in stats), sum(r["grams"] for r in stats)
    seen = {r["r"]: r["grams"] if r["r"] <= KATZ else r["last"] for r in stats}
    d = discounts(seen, 1)
    mass = sum(r["n"] * (d[r["r"] - 1] if r["r"] <= KATZ else 1.0) for r in stats)
    z = max(float(total), mass + 0.5)
    unknown = math.log10(1 - mass / z)
    first = real.withColumn("lp", F.log10(_discounted(d) / F.lit(z))).select("gram", "n", "lp", F.col("lp").alias("gain"))
    tables, weights, counts = [stored(first, "lm/order=1")], [], words
    kept: list[np.ndarray] = []
    buckets = max(64, -(-total // PER_BUCKET))
    for m in range(2, order + 1):
        kept.append(_bits(counts.where(f"n >= {LEAST}")))
        sent = training.sparkSession.sparkContext.broadcast(kept)
        found = written(count_grams(training, m, sent, buckets), f"lm_counts{m}")
        sent.unpersist(blocking=True)
        seen = {r["n"]: r["grams"] for r in found.where("history is null").groupBy("n").agg(F.sum("grams").alias("grams")).collect()}
        taken = _discounted(discounts(seen, LEAST))
        grams = found.where("history is not null").join(tables[-1].selectExpr("gram as lower", "lp as low"), "lower")
        grams = written(grams.select("history", "lower", "n", "low", taken.alias("taken")), f"lm_grams{m}")
        discard(found)
        sums = grams.groupBy("history").agg(F.sum("taken").alias("taken"), F.sum(F.pow(F.lit(10.0), "low")).alias("low"))
        z = "greatest(cast(n as double), taken + 0.5)"
        bows = sums.join(counts.select(F.col("gram").alias("history"), "n"), "history").selectExpr("history", f"{z} as z", f"log10((1 - taken / {z}) / greatest(1 - low, 1e-12)) as bow")
        bows = written(bows, f"lm_bow{m}")
        # The same mixing as higher() would need wrapping products; the hash is made in numpy.
        joined = grams.join(bows, "history").selectExpr("history", "lower", "n", "log10(taken / z) as lp", "log10(taken / z) - bow - low as gain")
        tables.append(written(joined.mapInArrow(_whole, "gram long, n long, lp double, gain double"), f"lm/order={m}"))
        weights.append(bows.select(F.col("history").alias("gram"), "bow"))
        discard(grams)
        counts = tables[-1].select("gram", "n")
    if order > 1:
        discard(words)  # the first table has them too; histories have been met with their counts
    return Katz(tables, weights, total, distinct, unknown, kept)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("history", "lower"))
        yield pa.record_batch([pa.array(higher(h, w).view(np.int64)), batch.column("n"), batch.column("lp"), batch.column("gain")], names=["gram", "n", "lp", "gain"])


def _narrow(numbers: np.ndarray) -> bytes:
    """One byte each if they fit, else two or four; _wide() tells by the length."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 2: "<u2", 4: "<u4"}[len(data) // count if count else 4]).astype(np.int64)


@dataclass
class Known:
    """The most frequent entries, sorted by gram."""

    gram: np.ndarray
    gain: np.ndarray
    bow: np.ndarray
    word: np.ndarray  # 1 for a word, 0 for a longer n-gram
    base: np.ndarray  # of a word

    def take(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of g are known, and where those are."""
        at = np.minimum(np.searchsorted(self.gram, g), max(0, len(self.gram) - 1))
        hit = self.gram[at] == g if len(self.gram) else np.zeros(len(g), bool)
        return hit, at[hit]


def _known(rows: pa.Table, total: int, distinct: int) -> Known:
    g = rows.column("gram").to_numpy().view(np.uint64)
    sort = np.argsort(g, kind="stable")
    gain, bow, n, word = (rows.column(c).to_numpy()[sort] for c in ("gain", "bow", "n", "word"))
    return Known(g[sort], gain, bow, word, np.where(word > 0, np.log10((n + 0.1) / (total + 0.1 * (distinct + 1))), 0.0))


def _requests(order: int, known: Broadcast, buckets: int):
    """Per flush and bucket the distinct n-grams that may be in the tables and are not frequent, with the texts they are in,
    and per flush its texts with the sums over their frequent n-grams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, frequent = known.value
        part, flush = TaskContext.get().partitionId(), 0
        grams, docs, kinds, ids, sizes, held = [], [], [], [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal flush, held
            key = (part << 24) + flush
            names = pa.concat_arrays(ids)
            g, doc, kind = _join(grams), np.concatenate(docs), np.concatenate(kinds)
            grams.clear(), docs.clear(), kinds.clear()
            # One number per (n-gram, text, kind): sort by n-gram, then text.
            order_ = np.lexsort((doc, g))
            g, doc, kind = g[order_], doc[order_], kind[order_]
            new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]) if len(g) else np.empty(0, np.int64)
            own, hist = (np.add.reduceat((kind >> k) & 1, new, dtype=np.int32) if len(new) else new for k in (0, 1))
            g, doc = g[new], doc[new]
            hit, at = frequent.take(g)
            d, o, h = doc[hit], own[hit], hist[hit]
            sums = [np.bincount(d, x, minlength=len(names)) for x in (o * frequent.gain[at] + h * frequent.bow[at], o * frequent.base[at], o * frequent.word[at])]
            yield pa.record_batch({
                "flush": pa.array([key], pa.int64()), "bucket": pa.array([key % buckets], pa.int32()), "grams": [np.stack(sums).astype("<f8").tobytes()], "many": [b""],
                "docs": [names.fill_null(0).to_numpy().astype("<i8").tobytes()], "own": [np.concatenate(sizes).astype("<i8").tobytes()],
                "history": [names.is_valid().cast(pa.uint8()).to_numpy().tobytes()], "head": pa.array([True]),
            })
            g, doc, own, hist = g[~hit], doc[~hit], own[~hit], hist[~hit]
            bucket = (g % np.uint64(buckets)).astype(np.int64)
            sort = np.argsort(bucket, kind="stable")
            g, doc, own, hist = g[sort], doc[sort], own[sort], hist[sort]
            cut = np.searchsorted(bucket[sort], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[b], cut[b + 1])
                first = np.flatnonzero(np.r_[True, g[s][1:] != g[s][:-1]])
                yield pa.record_batch({
                    "flush": pa.array([key], pa.int64()), "bucket": pa.array([b], pa.int32()), "grams": [g[s][first].tobytes()], "many": [_narrow(np.diff(np.append(first, s.stop - s.start)))],
                    "docs": [_narrow(doc[s])], "own": [_narrow(own[s])], "history": [_narrow(hist[s])], "head": pa.array([False]),
                })
            for x in (grams, docs, kinds, ids, sizes):
                x.clear()
            flush, held = flush + 1, 0

        for batch in batches:
            for piece in pieces(batch):
                token, at = tokens(piece.column("text"))
                text = np.searchsorted(at, np.arange(len(token)), "right") - 1
                base = sum(len(x) for x in ids)
                ids.append(piece.column("doc_id"))
                sizes.append(np.diff(at) - 1)
                last = np.zeros(len(token), bool)
                last[at[1:] - 1] = True
                begins = np.zeros(len(token), bool)
                begins[at[:-1]] = True
                levels = [(1, token, np.arange(len(token)))] + [(m, g, p) for m, _, _, g, p in _orders(token, at, order, kept[: order - 1])]
                for m, g, place in levels:
                    # Bit 0: it ends at a token (not at BEGIN); bit 1: it is the history of a next order's token.
                    kind = (~begins[place]).astype(np.uint8) + 2 * (~last[place] & (m < order)).astype(np.uint8)
                    use = _may(kept[order - 1], g) & (kind > 0)
                    grams.append(g[use]), docs.append((text[place[use]] + base).astype(np.int32)), kinds.append(kind[use])
                held += len(token)
                if held > FLUSH:
                    yield from send()
        if ids:
            yield from send()

    return ask


def _answers(left, right, total: int, distinct: int):
    """Partial sums per text of one bucket."""
    table = _known(right, total, distinct)
    flush, doc, score, plain, known, ids, valid, sizes = [], [], [], [], [], [], [], []
    for row in left.to_pylist():
        if row["head"]:
            own = np.frombuffer(row["own"], "<i8")
            flush.append(np.full(len(own), row["flush"])), doc.append(np.arange(len(own)))
            ids.append(np.frombuffer(row["docs"], "<i8")), valid.append(np.frombuffer(row["history"], np.uint8).astype(bool)), sizes.append(own)
            for x, part in zip((score, plain, known), np.frombuffer(row["grams"], "<f8").reshape(3, len(own))):
                x.append(part)
            continue
        keys = np.frombuffer(row["grams"], np.uint64)
        many = _wide(row["many"], len(keys))
        hit, at = table.take(keys)
        there = np.repeat(hit, many)
        where = np.repeat(at, many[hit])
        d, own, hist = (_wide(row[c], int(many.sum()))[there] for c in ("docs", "own", "history"))
        texts, back = np.unique(d, return_inverse=True)
        flush.append(np.full(len(texts), row["flush"])), doc.append(texts.astype(np.int64))
        score.append(np.bincount(back, own * table.gain[where] + hist * table.bow[where], minlength=len(texts)))
        plain.append(np.bincount(back, own * table.base[where], minlength=len(texts)))
        known.append(np.bincount(back, own * table.word[where], minlength=len(texts)))
        ids.append(np.zeros(len(texts), np.int64)), valid.append(np.zeros(len(texts), bool)), sizes.append(np.full(len(texts), -1))
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return pa.table({
        "flush": cat(flush, np.int64), "doc": cat(doc, np.int64), "score": cat(score, float), "base": cat(plain, float), "known": cat(known, np.int64),
        "doc_id": pa.array(cat(ids, np.int64), mask=~cat(valid, bool)), "tokens": cat(sizes, np.int64),
    })


def score(docs: DataFrame, model: Katz, spend: bool = False) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    With ``spend`` the model's tables are deleted as soon as what the scores need is made of them."""
    order = len(model.tables)
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    entries = model.tables[0].select("gram", "gain", zero.alias("bow"), "n", F.lit(1).alias("word"))
    for t in model.tables[1:]:
        entries = entries.union(t.select("gram", "gain", zero, "n", F.lit(0)))
    for t in model.weights:
        entries = entries.union(t.select("gram", zero, "bow", none, F.lit(0)))
    # A gram may have a probability and a weight: one row each, so they are added here.
    entries = entries.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("gain", "bow", "n")), F.max("word").alias("word"))
    entries = written(entries, "lm_entries")
    kept = [*model.kept, _bits(entries)]
    if spend:
        for t in [*model.tables, *model.weights]:
            discard(t)
    often = (F.col("n") >= _frequent_from(entries)) | (F.col("gram") == int(BEGIN.view(np.int64)))
    frequent = _known(entries.where(often).toArrow(), model.total, model.distinct)
    buckets = max(64, -(-model.total // PER_BUCKET))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = (batch.column("gram").to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "bucket"])

    right = entries.where(~often).mapInArrow(bucketed, "gram long, gain double, bow double, n long, word int, bucket int").groupBy("bucket")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast((kept, frequent))
    if not spend:
        return _scored(texts, right, known, model, buckets)
    # Each row falls in one slice; the shuffle files of a slice are gone when its scores are written.
    slices = [written(_scored(texts.where(F.pmod(row_key(), F.lit(SLICES)) == i), right, known, model, buckets), f"lm_scores{i}") for i in range(SLICES)]
    known.unpersist(blocking=True)
    discard(entries)
    return reduce(DataFrame.union, slices)


def _scored(texts: DataFrame, right: GroupedData, known: Broadcast, model: Katz, buckets: int) -> DataFrame:
    """The rows of score() for these texts."""
    asked = texts.mapInArrow(_requests(len(model.tables), known, buckets), "flush long, bucket int, grams binary, many binary, docs binary, own binary, history binary, head boolean")
    total, distinct = model.total, model.distinct
    parts = asked.groupBy("bucket").cogroup(right).applyInArrow(lambda a, b: _answers(a, b, total, distinct), "flush long, doc long, score double, base double, known long, doc_id long, tokens long")
    sums = parts.groupBy("flush", "doc").agg(F.max("doc_id").alias("doc_id"), F.max("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    lost = F.col("n_tokens") - F.col("n_known")
    nothing = math.log10(0.1 / (total + 0.1 * (distinct + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + lost * nothing).alias("base_score"), (F.col("score") + lost * model.unknown).alias("score"))


def _frequent_from(entries: DataFrame) -> int:
    """The least power of two that at most FREQUENT entries are counted as often as."""
    rows = entries.where("n > 0").groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("grams")).collect()
    held, least = 0, 64
    for r in sorted(rows, key=lambda r: -r["p"]):
        held += r["grams"]
        if held > FREQUENT:
            break
        least = r["p"]
    return 1 << min(least, 62)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all docs by what those whose crc32(doc_id) mod 10 is not 0 teach."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = score(texts, train(texts.where(remainder("doc_id", 10) != 0), order), spend=True)
    return found.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
