"""Near copies among embeddings by a robust-pruned flat graph.

Vectors are compared by cosine in double precision, and only with vectors of the same label and length.

1. Shards: centroids of a bounded sample, about one per TARGET vectors; each vector goes to its OVERLAP nearest
   centroids of its label.  A label of few vectors is one shard.  A shard of more than BLOCK vectors is dealt into
   blocks by hash, and every pair of its blocks is searched, so no group is too large for a task and none is cut short.
2. Graphs: in each block every vector gets at most DEGREE neighbours by robust pruning: the nearest is taken, and those
   that are ALPHA times nearer to it than to the vector are dropped, and so on.  The lists of a vector from its shards
   are united.
3. Search: all vectors of a block walk the graph greedily from its medoid (and from themselves) with a beam, then widen
   the range: neighbours of everything found above the threshold are looked at until nothing new is above it.
4. A link counts in the first shard that its two vectors share.  Tasks send a count and a local class per vector, never
   pairs.
5. Audit: for SAMPLE_AUDIT vectors the links found are held against a comparison with all rows; below ``least_recall``
   the search is repeated with more overlap.

Defined cases: a vector that is null, empty, zero, or has null or non-finite components, or a null label, links with
nothing; rows that repeat vec_id, label and embedding are one vector and share one result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import stored
from mapweave.llm.components import components

THRESHOLD = 0.93
TARGET = 700
BLOCK = 1500
OVERLAP = 2
DEGREE = 24
BEAM = 24
ALPHA = 1.2
SAMPLE_BYTES = 32 << 20  # of vectors the centroids are fitted on
CENTROIDS = 4096
SAMPLE_AUDIT = 200


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length from the bytes of a binary column; all have one length."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(raw) == 0:
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)


def _to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column("v"):
            x = v.values.to_numpy(zero_copy_only=False)
            x = x / np.abs(x).max()  # so that squares neither vanish nor overflow
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.record_batch([batch.column("key"), batch.column("vec_id"), batch.column("kind"), pa.array(out, pa.binary())], names=["key", "vec_id", "kind", "unit"])


def prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a key per (vec_id, label, embedding), and the vectors that can be linked: key, vec_id, kind, unit."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("key", F.xxhash64("vec_id", "label", "v"))
    fit = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    usable = rows.where(fit).select("key", "vec_id", F.xxhash64("label", F.size("v")).alias("kind"), "v").dropDuplicates(["key"])
    return rows.select("vec_id", "key"), stored(usable.mapInArrow(_to_units, "key long, vec_id long, kind long, unit binary"), "vectors")


def centroids(usable: DataFrame, target: int = TARGET) -> dict[int, np.ndarray]:
    """Unit centroids for each kind of more than ``target`` vectors, fitted on a sample of SAMPLE_BYTES at most."""
    sizes = usable.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.length("unit")).alias("bytes")).where(f"n > {target}").orderBy(F.desc("n"), "kind").limit(CENTROIDS).collect()
    if not sizes:
        return {}
    total, wide = sum(r["n"] for r in sizes), max(r["bytes"] for r in sizes)
    share = min(1.0, SAMPLE_BYTES / wide / total)
    wanted = usable.where(F.col("kind").isin([r["kind"] for r in sizes]))
    if share < 1:
        wanted = wanted.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_BYTES // wide)
    rows = wanted.orderBy("key").select("kind", "unit").toArrow()
    kinds = rows.column("kind").to_numpy()
    out = {}
    for r in sizes:
        k = max(1, min(-(-r["n"] // target), CENTROIDS * r["n"] // total))
        sample = _units(rows.column("unit").filter(pa.array(kinds == r["kind"])))
        k = min(k, len(sample))
        if k < 2:
            continue
        centre = sample[np.random.default_rng(7).choice(len(sample), k, replace=False)]
        for _ in range(6):
            near = (sample @ centre.T).argmax(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, near, sample)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centre = np.where(size > 0, sums / np.maximum(size, 1e-300), centre)
        out[r["kind"]] = centre
    return out


def _assigned(batches: Iterator[pa.RecordBatch], centre: dict[int, np.ndarray], overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        shards: list[list[int]] = [[0]] * len(kinds)
        for kind in np.unique(kinds).tolist():
            here = np.flatnonzero(kinds == kind)
            if kind in centre:
                near = _units(batch.column("unit").take(pa.array(here))) @ centre[kind].T
                for i, best in zip(here.tolist(), np.argsort(-near, 1)[:, :overlap]):
                    shards[i] = sorted(best.tolist())
        yield pa.record_batch([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"])


def robust_prune(units: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every row (-1 where there are fewer), by distances on the unit sphere."""
    near = units @ units.T
    far = np.sqrt(np.maximum(2 - 2 * near, 0))
    np.fill_diagonal(far, np.inf)
    n = len(units)
    out = np.full((n, degree), -1, np.int64)
    left = far.copy()  # what may still be taken
    every = np.arange(n)
    for k in range(min(degree, n - 1)):
        best = left.argmin(1)
        open_ = np.isfinite(left[every, best])
        if not open_.any():
            break
        out[open_, k] = best[open_]
        left[every, best] = np.inf
        left[(alpha * far[best] <= far) & open_[:, None]] = np.inf
    return out


def _graph(table: pa.Table) -> pa.Table:
    units, keys = _units(table.column("unit")), table.column("key").to_numpy()
    links = robust_prune(units)
    lists = [keys[x[x >= 0]].tolist() for x in links]
    return pa.table({"key": table.column("key"), "near": pa.array(lists, pa.list_(pa.int64()))})


def range_search(query: np.ndarray, units: np.ndarray, adjacent: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
    """Which of ``units`` each query finds at the threshold or above, over the graph of boolean ``adjacent``.

    ``own`` is the query's own place among the units, -1 if it is none of them."""
    n, m = len(query), len(units)
    seen, done = np.zeros((n, m), bool), np.zeros((n, m), bool)
    score = np.full((n, m), -2.0)
    every = np.arange(n)

    def look(new: np.ndarray) -> None:
        q, u = np.nonzero(new & ~seen)
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], u[i : i + (1 << 16)]
            score[a, b] = np.einsum("ij,ij->i", query[a], units[b])
        seen[q, u] = True

    start = np.zeros((n, m), bool)
    start[:, int((units @ units.sum(0)).argmax())] = True  # the medoid
    start[every[own >= 0], own[own >= 0]] = True
    look(start)
    width = min(beam, m)
    while True:
        # The best place not yet left from, if it is among the best ``width`` seen.
        edge = np.partition(score, m - width, 1)[:, m - width]
        next_ = np.where(done | ~seen, -3.0, score)
        best = next_.argmax(1)
        go = np.flatnonzero((next_[every, best] > -3) & (next_[every, best] >= edge))
        if len(go) == 0:
            break
        done[go, best[go]] = True
        new = np.zeros((n, m), bool)
        new[go] = adjacent[best[go]]
        look(new)
    reach = adjacent.astype(np.float32)
    while True:
        front = seen & ~done & (score >= threshold)
        if not front.any():
            break
        done |= front
        look(front.astype(np.float32) @ reach > 0)
    return seen & (score >= threshold)


def _search(key, table: pa.Table, threshold: float) -> pa.Table:
    shard, i, j = (x.as_py() for x in key[1:])
    block = table.column("block").to_numpy()
    keys = table.column("key").to_numpy()
    order = np.lexsort((keys, block))
    keys, block, units = keys[order], block[order], _units(table.column("unit"))[order]
    first = table.column("shards").combine_chunks().take(pa.array(order)).to_pylist()
    near = table.column("near").combine_chunks().take(pa.array(order)).to_pylist()
    q, u = np.flatnonzero(block == i), np.flatnonzero(block == j)
    empty = pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if len(q) == 0 or len(u) == 0:
        return empty
    place = {k: n for n, k in enumerate(keys[u].tolist())}
    adjacent = np.zeros((len(u), len(u)), bool)
    for n, x in enumerate(u.tolist()):
        to = [place[k] for k in near[x] if k in place]
        adjacent[n, to] = True
    adjacent |= adjacent.T
    own = np.arange(len(q)) if i == j else np.full(len(q), -1)
    found = range_search(units[q], units[u], adjacent, own, threshold)
    a, b = np.nonzero(found)
    a, b = q[a], u[b]
    if i == j:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])  # what only one of two has found
        pair = np.unique(a * len(keys) + b)
        a, b = np.divmod(pair, len(keys))
        a, b = a[a < b], b[a < b]
    # An exact check: the cosine itself, and the first shard both are in.
    keep = np.einsum("ij,ij->i", units[a], units[b]) >= threshold if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    counted = np.array([min(set(first[x]) & set(first[y])) == shard for x, y in zip(a.tolist(), b.tolist())], bool)
    n = np.bincount(np.concatenate([a[counted], b[counted]]).astype(np.int64), minlength=len(keys))
    root = np.arange(len(keys))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    used = np.unique(np.concatenate([a, b])).astype(np.int64)
    return pa.table({"key": keys[used], "n": n[used], "root": keys[root[used]]})


def links(usable: DataFrame, overlap: int = OVERLAP, threshold: float = THRESHOLD) -> DataFrame:
    """key, n and root of every vector that is linked with another in some block pair."""
    spread = stored(usable.mapInArrow(partial(_assigned, centre=centroids(usable), overlap=overlap), "key long, vec_id long, kind long, unit binary, shards array<int>"), "shards")
    placed = spread.select("key", "kind", "unit", "shards", F.explode("shards").alias("shard"))
    sizes = placed.groupBy("kind", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = stored(placed.join(sizes, ["kind", "shard"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "blocks")

    graphs = dealt.groupBy("kind", "shard", "block").applyInArrow(lambda table: _graph(table), "key long, near array<long>")
    graph = graphs.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    pairs = "explode(transform(sequence(0, blocks - 1), x -> struct(least(block, x) as i, greatest(block, x) as j))) as p"
    work = dealt.join(graph, "key").selectExpr("key", "kind", "shard", "block", "unit", "shards", "near", pairs).selectExpr("*", "p.i as i", "p.j as j").drop("p")

    def search(key, table):
        return _search(key, table, threshold)

    return stored(work.groupBy("kind", "shard", "i", "j").applyInArrow(search, "key long, n long, root long"), "links")


def audit(usable: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> float:
    """Recall of the links of SAMPLE_AUDIT vectors, against a comparison with all rows.  Half of the sample is taken from
    those that have links, if any, as most vectors have none."""
    by = F.xxhash64("key", F.lit(1))
    some = usable.orderBy(by, "key").limit(SAMPLE_AUDIT // 2).select("key")
    linked = found.select("key").distinct().orderBy(by, "key").limit(SAMPLE_AUDIT // 2)
    sample = usable.join(some.union(linked).distinct(), "key").orderBy("key").toArrow()
    units, kinds, keys = [u.as_py() for u in sample.column("unit")], sample.column("kind").to_numpy(), sample.column("key").to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            their, kind = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
            for k in np.unique(kinds).tolist():
                mine, here = np.flatnonzero(kinds == k), np.flatnonzero(kind == k)
                if len(here):
                    mates = _units(pa.array([units[x] for x in mine], pa.binary())) @ _units(batch.column("unit").take(pa.array(here))).T >= threshold
                    mates &= keys[mine][:, None] != their[here][None, :]
                    total[mine] += mates.sum(1)
        yield pa.record_batch({"key": keys, "n": total})

    if not len(keys):
        return 1.0
    true = usable.select("key", "kind", "unit").mapInArrow(compare, "key long, n long").groupBy("key").agg(F.sum("n").alias("true"))
    got = found.groupBy("key").agg(F.sum("n").alias("got"))
    row = true.join(got, "key", "left").agg(F.sum("true").alias("true"), F.sum(F.coalesce("got", F.lit(0))).alias("got")).first()
    return row["got"] / row["true"] if row["true"] else 1.0


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, least_recall: float = 0.98) -> DataFrame:
    """A row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows, usable = prepared(vectors)
    for overlap in range(OVERLAP, OVERLAP + 3):
        found = links(usable, overlap, threshold)
        if audit(usable, found, threshold) >= least_recall:
            break
    classes = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("n").alias("n_links"))
    named = usable.select("key", "vec_id").join(classes, usable["key"] == classes["node"], "left").withColumn("class", F.coalesce("component", "key"))
    least = named.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    known = named.join(least, "class").select("key", "component_id").join(counts, "key", "left")
    out = rows.join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
