"""Word hashes, token ids, Arrow files and packing against plain Python."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import arrow_sequences, packing
from mapweave.llm.bpe import WordEncoder
from mapweave.llm.common import tokenizer_path
from mapweave.llm.words import word_hashes
from mapweave.session import scratch_path

tokenizers = pytest.importorskip("tokenizers")
FILES = {True: "byte_bpe_50k.json", False: "word_bpe_49k.json"}
signs = st.text(st.sampled_from(list("aBsStdmreLlvV'  \n\t12!(-_éÉßÿ×’ſ中\x1c ")), max_size=25)


def plain(name: str):
    t = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.lists(signs, max_size=6))
def test_words_are_those_of_bytes_split(rows):
    h, first = word_hashes(pa.array(rows, pa.string()))
    want = [t.encode().lower().split() for t in rows]
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


@pytest.fixture(scope="module", params=[True, False])
def coder(request):
    path = tokenizer_path(FILES[request.param])
    return WordEncoder(path, request.param), plain(FILES[request.param])


def test_ids_are_the_library_s(coder):
    fast, whole = coder

    @settings(max_examples=300, deadline=None)
    @given(st.lists(signs, max_size=5))
    def check(rows):
        ids, at = fast.encode(pa.array(rows, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in rows]

    check()


def ids_of(whole, text):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_arrow_files_round_trip(spark):
    folder = scratch_path(spark, "test-sequences")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few texts are one file
    manifest = arrow_sequences.write_sequences(documents(spark), folder, seq_len=64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.count()
    assert files > 1 and arrow_sequences.read_documents(manifest, folder).rdd.getNumPartitions() == files
    got = [tuple(r) for r in arrow_sequences.read_documents(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    whole, want, start = plain(FILES[True]), [], 0
    for i, t, _ in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(whole, t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    # Random access to the k-th sequence of a mapped file.
    line = np.concatenate([ids_of(whole, t) for _, t, _ in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))])
    for r in manifest.collect():
        with pa.memory_map(f"{r['path']}.sequences") as source:
            data = pa.ipc.open_stream(source).read_all()
            ids, mask = arrow_sequences.sequence(data, 0)
            n = min(64, r["n_tokens"])
            assert ids[:n].tolist() == line[r["start"] : r["start"] + n].tolist() and mask.to_pylist() == [k < n for k in range(64)]


def test_arrow_files_of_nothing(spark):
    folder = scratch_path(spark, "test-sequences")
    assert arrow_sequences.read_documents(arrow_sequences.write_sequences(empty(spark), folder), folder).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_whole_and_gapless(spark, capacity):
    got = packing.pack_documents(documents(spark), capacity=capacity).toPandas()
    whole = plain(FILES[False])
    want = sorted((-1 if i is None else i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()))
                  for i, ids in ((i, ids_of(whole, t)) for i, t, _ in texts()) for k in range(0, len(ids), capacity))
    rows = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, rows.to_numpy().tolist())) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= capacity


def test_packing_of_nothing(spark):
    assert packing.pack_documents(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=12))))
def test_plan_places_every_piece_once(case):
    capacity, histogram = case
    bins, ranks = {}, {}
    for length, first, count, sequence, per, offset in packing.plan(histogram, capacity):
        for i in range(count):
            bins.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
            ranks.setdefault(length, []).append(first + i)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    length = np.minimum(rng.lognormal(6.3, 1.0, 20_000).astype(int) + 1, 2048)
    histogram = dict(zip(*(x.tolist() for x in np.unique(length, return_counts=True))))
    used = max(s + (c - 1) // p for _, _, c, s, p, _ in packing.plan(histogram)) + 1
    assert used <= 1.02 * -(-length.sum() // 2048)
