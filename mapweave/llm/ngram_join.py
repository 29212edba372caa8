"""Documents whose sets of word n-grams are alike: exact Jaccard join, and the classes it makes.

1. Sets: distinct n-grams of a text as sorted 64-bit hashes.  Equal sets are one node from here on.
2. Order: by document frequency, in half octaves as a fixed-size count table tells it, then by hash.  Any order common to
   all documents is exact; this one puts an n-gram behind all rarer ones, so passages that many documents share stay out
   of the beginnings of their lists unless a document holds little else.
3. Two sets with similarity t or more share one of the first ``n - ceil(t * n) + 1`` n-grams.  N-grams that occur there
   in two documents or more are the keys of tiles; a tile holds the nodes of one key and one size band (sizes differ by 1 / t
   at most within two neighbouring bands).  Of keys that occur in the very same nodes one is enough.
4. In each tile all nodes meet its smallest node, and the smallest nodes of neighbouring bands meet.  Bitmaps of
   parities, four bits per element or more, bound the overlap: each differing element turns one bit, so |A & B| <= (|A| + |B| - bits that differ) / 2.  Pairs that
   pass are checked exactly on sorted arrays.
5. Pairs of one key that are not yet in one class meet too.  That join itself bounds the overlap, by the places of the key
   in both lists, by bitmaps of about a bit per element (512 to 4096) and, where more than a few share the key, by the wide
   ones (8192 bits at most), so pairs that cannot be alike are not made; then the same check.  A pair is made at the least key
   of those that both nodes carry as their smallest ones, or, where these lists have none in common, at each key it shares.  So no link between classes is lost, while a group of copies is not expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import discard, in_slots, row_key, slots_of, written
from mapweave.llm.components import components
from mapweave.llm.words import mix, pieces, word_hashes

WORDS = 5
PERCENT = 80
SLOTS = 1 << 22
BLOCK = 1 << 16
SHORT, LONGER, WIDE = 8, 64, 128  # 64-bit words of the bitmaps that the last join carries: least, most, and of wide ones at most
HEADS = 16  # smallest keys of a node that its rows carry, so that a pair is made at one key only
FEW = 8  # nodes of a key that meet without the wide bitmaps
BITS = 1024  # in a bitmap at least, and four times as many as the set has elements, in powers of two
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, one without words has none."""
    h, first = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(words):
        gram = gram * _STEP + h[k : k + n]
    gram = mix(gram)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in h[a:b]:
                short = short * _STEP + x
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams % np.uint64(SLOTS)).astype(np.int64)


def frequency_levels(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """A byte per slot of a count table: 0 where the n-grams of a slot are no more than chance puts there, else half octaves
    of how many more documents they are in: 4 MB, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for piece in pieces(batch, size=4 << 20):  # each adds a whole table
                total += np.bincount(_slot(np.concatenate([np.empty(0, np.uint64), *shingles(piece.column("text"), words)])), minlength=SLOTS).astype(np.uint32)
        for i in range(0, SLOTS, BLOCK):
            if total[i : i + BLOCK].any():
                yield pa.record_batch({"block": pa.array([i], pa.int32()), "counts": pa.array([np.minimum(total[i : i + BLOCK], 65535).astype("<u2").tobytes()], pa.binary())})

    def merge(key, rows):
        total = np.zeros(BLOCK, np.int64)
        for raw in rows.column("counts"):
            total += np.frombuffer(raw.as_py(), "<u2")
        mean = np.median(total)
        more = np.maximum(total - mean, 1.0)
        level = np.where(more > 3 * np.sqrt(mean) + 2, np.floor(2 * np.log2(more)), 0).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(SLOTS, np.uint8)
    blocks = texts.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(merge, "block int, levels binary")
    for r in blocks.collect():
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["levels"], np.uint8)
    return out


def node_of(grams: np.ndarray) -> int:
    """One number per set; equal sets have equal numbers."""
    parts = np.array([grams.sum(dtype=np.uint64), len(grams), mix(grams ^ _STEP).sum(dtype=np.uint64)], np.uint64)
    return int(mix(np.cumsum(parts * np.array([_STEP, 1, 1], np.uint64))[-1:]).view(np.int64)[0])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(batches: Iterator[pa.RecordBatch], levels: np.ndarray, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            nodes, sizes, bits, sigs, firsts = [], [], [], [], []
            for s in shingles(piece.column("text"), words):
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                width = max(BITS, 1 << (4 * max(1, len(s)) - 1).bit_length())
                bits.append(np.packbits(np.bincount((s >> np.uint64(24)).astype(np.int64) & (width - 1), minlength=width) & 1).view(np.int64))
                sigs.append(np.bitwise_xor.reduce(bits[-1].reshape(-1, min(LONGER, max(SHORT, width // 256))), axis=0))
                need = len(s) - (-(-percent * len(s) // 100)) + 1 if len(s) else 0
                firsts.append(s[np.argsort(levels[_slot(s)], kind="stable")][:need].view(np.int64))
            yield pa.record_batch({
                "doc_id": piece.column("doc_id"), "row": piece.column("row"), "node": pa.array(nodes, pa.int64()), "size": pa.array(sizes, pa.int64()), "bits": _lists(bits), "sig": _lists(sigs),
                "firsts": _lists(firsts),
            })


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow the overlap that the similarity needs."""
    for batch in batches:
        raw = [[x.values.to_numpy() for x in batch.column(c)] for c in ("bits_a", "bits_b")]
        size = np.array([[len(x) for x in r] for r in raw]).reshape(2, -1)
        total = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
        differ = np.zeros(len(total), np.int64)
        for key in {(x, y) for x, y in size.T.tolist()}:
            here = np.flatnonzero((size.T == key).all(1))
            # A wider bitmap folds to a narrower one.
            few = [np.bitwise_xor.reduce(np.stack([r[i] for i in here.tolist()]).reshape(len(here), -1, min(key)), axis=1) for r in raw]
            differ[here] = np.bitwise_count((few[0] ^ few[1]).view(np.uint64)).sum(1)
        most = (total - differ) // 2
        keep = (100 + percent) * most >= percent * total
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _gram_bytes(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose ids may be wanted."""
    for batch in batches:
        maybe = in_slots(wanted, pc.fill_null(batch.column("doc_id"), -1).to_numpy())
        for piece in pieces(batch.filter(pa.array(maybe))):
            sets = [s for s in shingles(piece.column("text"), words) if len(s)]
            yield pa.record_batch({"node": pa.array([node_of(s) for s in sets], pa.int64()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar enough, by exact intersection of sorted arrays."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one key that are in different classes and may be alike, by the bounds that a row of ``rest`` holds."""
    other = rest.selectExpr("key", "node as b", *[f"{c} as {c}_b" for c in ("place", "size", "component", "sig", "wide", "heads")])
    # Before the key's places the lists share what the shorter beginning holds at most, behind them what the shorter end does.
    most = "least(place, place_b) + least(size - place, size_b - place_b)"

    def differ(bits: str) -> str:
        """Bits in which two bitmaps differ; one twice as wide folds to the other's width."""
        words = f"least(size({bits}), size({bits}_b))"
        folded = [f"get({c}, i) ^ coalesce(get({c}, i + {words}), 0)" for c in (bits, f"{bits}_b")]
        return f"aggregate(sequence(0, {words} - 1), 0, (s, i) -> s + bit_count({folded[0]} ^ {folded[1]}))"

    enough = f"{100 + percent} * ({{}}) >= {percent} * (size + size_b)"
    bounds = [enough.format(most), *[enough.format(f"(size + size_b - {d}) div 2") for d in (differ("sig"), f"if(wide is null or wide_b is null, 0, {differ('wide')})")]]
    # All shared keys below the least common one would be common too, so this is the first; the bounds hold at any key.
    bounds.append("coalesce(array_min(array_intersect(heads, heads_b)), key) >= key")
    return rest.join(other, "key").where(f"component <> component_b and node < b and 100 * least(size, size_b) >= {percent} * greatest(size, size_b) and " + " and ".join(bounds))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_shingles, component_id, class_id (of the sets alone; null for the
    empty set) and row (xxhash64 of doc_id and text).

    Defined cases: a null text, or one without words, is linked with nothing and is its own class; rows with equal sets,
    repeated rows and repeated ids among them, are in one class; a class is named by its smallest doc_id that is not
    null; an empty table gives no rows; other columns are ignored."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    levels = frequency_levels(texts.select("text"), words)
    kind = "doc_id long, row long, node long, size long, bits array<long>, sig array<long>, firsts array<long>"
    sets = written(texts.mapInArrow(partial(_sets, levels=levels, words=words, percent=percent), kind), "sets")
    nodes = written(sets.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id")), "nodes")

    postings = sets.where("size > 0").select(F.posexplode("firsts").alias("place", "key"), "node")
    often = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(postings.join(often, "key").groupBy("key", "node").agg(F.first("place").alias("place")), "shared")
    # Keys of the same nodes would only bring the same nodes together again: one of them stays.
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    per_key = shared.groupBy("key").agg(F.count("*").alias("n"), *marks).where("n > 1")
    one_key = per_key.groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key")).select("key")
    band = F.floor(F.log("size") / F.log(F.lit(100 / percent)) + 1e-9)
    tiles = written(shared.join(one_key, "key").join(nodes.select("node", "size"), "node").withColumn("band", band), "tiles")

    def links(pairs: DataFrame) -> DataFrame:
        few = nodes.select("node", "size", "bits")
        a = few.selectExpr("node as a", "size as size_a", "bits as bits_a")
        b = few.selectExpr("node as b", "size as size_b", "bits as bits_b")
        close = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
        met = pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
        likely = written(met.join(a, "a").join(b, "b").where(close).mapInArrow(partial(_near, percent=percent), "a long, b long"), "pairs")
        used = likely.selectExpr("a as node").union(likely.selectExpr("b as node")).distinct()
        wanted = slots_of(used.join(nodes, "node").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")), "doc_id")
        grams = texts.mapInArrow(partial(_gram_bytes, wanted=wanted, words=words), "node long, grams binary")
        grams = written(grams.join(used, "node").groupBy("node").agg(F.first("grams").alias("grams")), "grams")
        both = likely.join(grams.selectExpr("node as a", "grams as grams_a"), "a").join(grams.selectExpr("node as b", "grams as grams_b"), "b")
        found = written(both.mapInArrow(partial(_linked, percent=percent), "a long, b long"), "links")
        discard(likely)
        discard(grams)
        return found

    discard(shared)
    centres = written(tiles.groupBy("key", "band").agg(F.min("node").alias("centre")), "centres")
    inside = tiles.join(centres, ["key", "band"]).where("node <> centre").selectExpr("node as a", "centre as b")
    across = centres.join(centres.selectExpr("key", "band - 1 as band", "centre as other"), ["key", "band"]).selectExpr("centre as a", "other as b")
    found = links(inside.union(across))
    classes = written(components(found), "classes")

    named = tiles.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    opened = written(named.join(open_keys, "key").select("key", "node", "place", "size", "component", "n"), "opened")
    heads = opened.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, HEADS).alias("heads"))
    rest = opened.join(nodes.select("node", "sig", "bits"), "node").join(heads, "node")
    narrowed = f"transform(sequence(0, {WIDE - 1}), i -> aggregate(sequence(0, size(bits) div {WIDE} - 1), 0L, (s, j) -> s ^ get(bits, i + {WIDE} * j)))"
    wide = F.expr(f"case when n > {FEW} and size(bits) <= {WIDE} then bits when n > {FEW} then {narrowed} end").alias("wide")
    rest = written(rest.select("key", "node", "place", "size", "component", "sig", wide, "heads"), "rest")
    discard(opened)
    discard(tiles)
    discard(centres)
    apart = _apart(rest, percent)
    more = links(apart.selectExpr("node as a", "b"))
    final = components(found.union(more))

    labels = nodes.select("node", "doc_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = final.join(least, "component").select("node", "component_id", "component")
    named_nodes = nodes.select("node", "doc_id").join(of_node, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("class_id"))
    out = sets.select("doc_id", F.col("size").alias("n_shingles"), "node", "row").join(named_nodes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", "row")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; rows with an empty set all stay."""
    key = "row of the class"  # no column of docs is called so
    found = written(join(docs, words, percent), "classes")
    kept = found.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("v")).select(F.col("v.row").alias(key))
    keyed = docs.withColumn(key, row_key())
    empty = found.where("class_id is null").select(F.col("row").alias(key)).distinct()
    # Only rows that repeat have to be brought together.
    often = found.where("class_id is not null").groupBy(F.col("row").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    single = keyed.join(kept.join(often, key, "left_anti"), key, "left_semi")
    one = single.union(keyed.join(kept.join(often, key, "left_semi"), key, "left_semi").dropDuplicates([key]))
    return one.union(keyed.join(empty, key, "left_semi")).select(*docs.columns)
