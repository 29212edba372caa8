"""Token ids as Arrow stream files of equal-length sequences.

Ids of all documents, in ascending ``doc_id`` order and each followed by an end id, form one long line that is cut into
rows of ``seq_len`` ids.  A file holds the rows of one range of documents as record batches of two fixed-size lists,
``ids`` and ``mask`` (False only behind the last id of a file), so the k-th sequence of a mapped file is a slice without
copying.  Beside it lies a stream file with a row per document: ``doc_id, start, n_tokens`` (start within the file).

Files are written by tasks under names of their own; only the files that a finished task has reported in the manifest
count, so a lost executor or a task run twice leaves at most files that nothing refers to.  The folder may be a local
path, ``file:`` or any address that pyarrow's file systems open; all executors must reach it.

Defined cases: a null or empty text is its end id alone; rows with the same ``doc_id`` are all kept, ordered by text;
a null ``doc_id`` comes first; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.bpe import WordEncoder
from mapweave.llm.common import stored, tokenizer_path
from mapweave.llm.words import pieces

END_ID = 0
SEQ_LEN = 2048
READERS = 4096  # tasks that read files back at most
ROWS = 64
MANIFEST = "part int, path string, n_docs long, n_tokens long, bytes_per_id int"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("/"):
        return fs.LocalFileSystem(), address
    return fs.FileSystem.from_uri(address)


def schema(seq_len: int, bytes_per_id: int) -> pa.Schema:
    kind = pa.uint16() if bytes_per_id == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def with_end(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with END_ID behind each document, and where each document then begins (one more at the end)."""
    docs = len(at) - 1
    places = at + np.arange(docs + 1)
    out = np.full(len(ids) + docs, END_ID, np.uint32)
    keep = np.ones(len(out), bool)
    keep[places[1:] - 1] = False
    out[keep] = ids
    return out, places


def _writer(folder: str, encoder: Callable[[], WordEncoder], seq_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, encode = TaskContext.get().partitionId(), uuid.uuid4().hex, None
        rest, docs, total = np.empty(0, np.uint32), 0, 0
        sequences = index = None
        for batch in batches:
            for piece in pieces(batch):
                if sequences is None:
                    encode = encoder()
                    size = 2 if encode.whole.get_vocab_size() <= 1 << 16 else 4
                    kind = schema(seq_len, size)
                    system, root = open_folder(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{root.rstrip('/')}/{part:06d}-{name}"
                    out = [system.open_output_stream(f"{path}.{x}") for x in ("sequences", "index")]
                    sequences, index = pa.ipc.new_stream(out[0], kind), pa.ipc.new_stream(out[1], INDEX)

                def put(ids: np.ndarray, real: int) -> None:
                    values = pa.array(ids.astype(kind.field("ids").type.value_type.to_pandas_dtype()))
                    mask = pa.array(np.arange(len(ids)) < real)
                    sequences.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((values, mask), kind)], schema=kind))

                ids, at = with_end(*encode.encode(piece.column("text")))
                index.write_batch(pa.record_batch([piece.column("doc_id"), pa.array(at[:-1] + total), pa.array(np.diff(at))], schema=INDEX))
                docs, total = docs + piece.num_rows, total + len(ids)
                rest = np.concatenate([rest, ids])
                step = seq_len * ROWS
                for i in range(0, len(rest) - step + 1, step):
                    put(rest[i : i + step], step)
                rest = rest[len(rest) // step * step :]
        if sequences is not None:
            if len(rest):
                put(np.concatenate([rest, np.zeros(-len(rest) % seq_len, np.uint32)]), len(rest))
            for x in (sequences, index, *out):
                x.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [docs], "n_tokens": [total], "bytes_per_id": pa.array([size], pa.int32())})

    return write


def write_sequences(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text); the manifest has a row per file with ``start``, the ids of all files before it."""
    path = tokenizer_path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(_writer(folder, lambda: WordEncoder(path, spaced), seq_len), MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, not per document.
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def sequence(data: pa.Table, k: int) -> tuple[np.ndarray, pa.Array]:
    """The k-th ids and mask of a mapped file, without copying the ids."""
    ids, mask = data.column("ids"), data.column("mask")
    for a, b in zip(ids.chunks, mask.chunks):
        if k < len(a):
            size = a.type.list_size
            return a.values.slice((a.offset + k) * size, size).to_numpy(zero_copy_only=True), b[k].values
        k -= len(a)
    raise IndexError(k)


def _stream(system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
    with system.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
        yield from reader


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                ids, first, rows = np.empty(0, np.uint32), 0, _stream(system, f"{path}.sequences")
                for entry in _stream(system, f"{path}.index"):
                    start, count = entry.column("start").to_numpy(), entry.column("n_tokens").to_numpy()
                    ids, first = ids[int(start[0]) - first :], int(start[0])
                    more, have, need = [ids], len(ids), int(start[-1] + count[-1]) - first
                    while have < need:
                        values = next(rows).column("ids").flatten().to_numpy().astype(np.uint32)
                        more.append(values)
                        have += len(values)
                    ids = np.concatenate(more)
                    raw = memoryview(ids.astype("<u4").view(np.uint8))
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((start - first).tolist(), (start - first + count).tolist())]
                    yield pa.record_batch([entry.column("doc_id"), pa.array(start + base), pa.array(count), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32.

    The files are dealt out evenly, a task per file up to ``READERS`` tasks; a stated number is never coalesced, though the
    manifest is small."""
    spread = manifest.select("path", "start").repartition(max(1, min(READERS, manifest.count())))
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
