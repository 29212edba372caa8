"""Cases that shorter forms of the operators left out."""

import itertools
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import decontamination, licenses, toxicity
from mapweave.llm.bpe import WordEncoder
from mapweave.llm.common import tokenizer_path


@pytest.mark.parametrize("size", range(5, 26))
def test_masks_hit_every_pattern_of_the_rule(size):
    """Longer stretches hold a shorter one of at least 13 words with the same share; more equal words only add hits."""
    exchanged = size * (100 - decontamination.PERCENT) // 100
    hidden = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(size), exchanged)])
    hit = np.zeros(len(hidden), bool)
    for mask in decontamination.masks_of(size):
        for at in range(size - len(mask) + 1):
            hit |= hidden & (int(mask, 2) << at) == 0
    assert hit.all()


def test_masks_of_longer_stretches_are_those_of_13_words():
    assert all(decontamination.masks_of(n) == decontamination.MASKS for n in (*range(13, 60), 1000))
    assert [decontamination.masks_of(n) for n in range(3)] == [(), ("1",), ("11",)]


def test_passages_with_exchanged_words_are_found(spark):
    rng = random.Random(12)
    sizes = [4, 5, 7, 9, 10, 12, 13, 15, 20, 50, 200]
    items = [(k, words(rng, "en", n)) for k, n in enumerate(sizes)]

    def hidden(item, places):
        w = items[item][1].split()
        for p in places:
            w[p] = "changed"
        return f"{words(rng, 'fr', 20)} {' '.join(w)} {words(rng, 'fr', 20)}"

    cases = [(1, [2]), (2, [3]), (3, [4]), (4, [3, 7]), (5, [2, 5]), (6, [4, 8]), (6, [3, 6]), (7, [3, 7, 11]), (8, [4, 8, 12, 16])]
    cases += [(k, range(phase, sizes[k], 6)) for k in (9, 10) for phase in range(6)]
    rows = [(k, hidden(item, places), "en") for k, (item, places) in enumerate(cases)]
    # One word too many, or one of four.
    rows += [(100, hidden(1, [1, 2]), "en"), (101, hidden(4, [2, 4, 7]), "en"), (102, hidden(0, [1]), "en")]
    found = decontamination.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, item) for k, (item, _) in enumerate(cases)]


def test_licences_in_wrapped_notices_are_found(spark):
    rng = random.Random(7)
    long = [(f, t) for f, of in licenses.TEMPLATES.items() for t in of if len(t) > 72]
    rows, want = [], {}
    for f, t in long:
        for sign in ("", "# ", " * ", "// ", "dnl "):
            notice = "\n".join(sign + line for line in textwrap.wrap(t, 72 - len(sign)))
            for shown in (notice, f"{words(rng, 'en', 40)}\n\n{notice}\n{sign.rstrip()}\n{words(rng, 'en', 40)}", f"{textwrap.fill(words(rng, 'en', 47), 72)}\n{notice}\n{textwrap.fill(words(rng, 'en', 60), 72)}"):
                want[len(rows)] = f
                rows.append((len(rows), shown, "en"))
    apart = [(1000 + i, "\n\n".join(textwrap.wrap(words(rng, "en", 90), 72)), "en") for i in range(60)]
    got = {r["doc_id"]: r for r in licenses.scan_documents(documents(spark, rows + apart)).collect()}
    assert {i: got[i]["license"] for i in want} == want
    assert all(got[i]["n_paragraphs"] == 1 for i in range(0, len(rows), 15))
    assert all(got[i]["license"] == "none" for i, _, _ in apart)


def test_paragraphs_join_lines_of_one_text():
    lines = licenses.paragraphs(pa.array(["a b\n# c\n#\nd", "e", None, "f\n\ng h\ni\n"]))
    whole, start, owner, of = licenses.joined(*lines)
    assert start.tolist() == [0, 3, 6] and owner.tolist() == [0, 3]
    assert of[np.diff(lines[1]) > 0].tolist() == [0, 0, -1, -1, -1, 1, 1]
    assert whole.tolist() == lines[0][[0, 1, 2, 6, 7, 8]].tolist()


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_added_tokens_are_the_library_s(name, spaced):
    tokenizers = pytest.importorskip("tokenizers")
    whole, fast = tokenizers.Tokenizer.from_file(tokenizer_path(name)), WordEncoder(tokenizer_path(name), spaced)
    part = st.sampled_from(["a", " b", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext", "|>", " ", "\n", "é", "中", "it's"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(part, max_size=6).map("".join) | st.none(), max_size=5))
    def check(rows):
        ids, at = fast.encode(pa.array(rows, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in rows]

    check()
    if spaced:
        assert fast.encode(pa.array(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275]


DISGUISES = ["idio7", "idi07", "idi0+", "1diot", "id1ot", "patheti(", "p@thetic", "a$$", "@ss", "a5s", "d13", "stuupid", "sstupid", "stupidd", "i d i o t", "i  d  i  o  t", "i . d . i . o . t", "1 d 1 0 7", "a s s", "id.iot", "i.diot", "idio.t", "id--iot", "£00ser"]
MEANT = ["idiot"] * 5 + ["pathetic"] * 2 + ["ass"] * 3 + ["die"] + ["stupid"] * 3 + ["idiot"] * 4 + ["ass"] + ["idiot"] * 4 + ["looser"]


def test_disguises_at_every_letter_are_restored():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for w in ["idiot", "stupid", "pathetic", "ass", "die", "looser", "the", "cat", "sat"] * 20:
        s = [0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * 28 + b) * 28 + c] += 1
    m = toxicity.letter_model(counts)
    got = toxicity.restored_texts(pa.array([*(f"the cat {d} sat" for d in DISGUISES), "the cat sat", None, "", "12 $$"]), m, {}).to_pylist()
    assert [w for w, g in zip(MEANT, got) if w not in g.split()] == []
    assert got[len(MEANT) :] == [""] * 4


def test_texts_with_a_disguised_word_alone_are_toxic(spark):
    rng = random.Random(14)
    bad = sorted({*MEANT} - {"looser"})
    rows, labels = [], []
    for i in range(400):
        w = words(rng, "en", 40).split()
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000 + k, f"the an {d} her", "en") for k, d in enumerate(DISGUISES[:-1])] + [(2000, "the an her", "en")]
    found = toxicity.score_documents(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    got = {r["doc_id"]: r["predicted"] for r in found}
    assert [d for k, d in enumerate(DISGUISES[:-1]) if not got[1000 + k]] == [] and got[2000] == 0


def all_paths(span, model, separators, stray, double):
    """Each path through the lattice of a span, with its price and its text."""
    runs = {i for m in re.finditer(r"(.)\1\1+", span) for i in range(*m.span())}

    def go(i, a, b, last, value, text):
        if i == len(span):
            yield value + (model[a, b, 0] if b else 0.0), text.strip()
            return
        c = span[i]
        if c in separators:
            yield from go(i + 1, a, b, last, value + toxicity.DROP, text)
            return
        if c == last:
            yield from go(i + 1, a, b, last, value + (toxicity.REPEAT if i in runs else double), text)
        k = toxicity._symbol(c)
        if k:
            yield from go(i + 1, b, k, c, value + toxicity.KEEP + model[a, b, k], text + c)
            return
        for x in toxicity.LOOKALIKES.get(c, ""):
            k = toxicity._symbol(x)
            yield from go(i + 1, b, k, c, value + toxicity.SWAP + model[a, b, k], text + x)
        price = stray if c in toxicity.LOOKALIKES else toxicity.GAP
        yield from go(i + 1, b or a, 0, c, value + price + (model[a, b, 0] if b else 0.0), text + " " if b else text)

    return list(go(0, 0, 0, "", 0.0, ""))


def random_letters(seed):
    return toxicity.letter_model(np.random.default_rng(seed).integers(0, 2000, toxicity.SYMBOLS**3).astype(float) ** 2)


@pytest.mark.parametrize("seed", range(3))
def test_restored_spans_are_the_best_of_all_paths(seed):
    rng, m = random.Random(seed), random_letters(seed)
    for _ in range(300):
        signs = rng.choice(["abeelt", "a1l!i", "ab.0_", "aé;b3", "aab"])
        span = "".join(rng.choice(signs) * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 5)))
        for separators in ("", toxicity.SEPARATORS):
            for stray, double in ((toxicity.STRAY, toxicity.DOUBLE), (-50.0, 50.0)):
                paths = all_paths(span, m, separators, stray, double)
                best = max(v for v, _ in paths)
                assert toxicity.restore(span, m, separators, stray, double) in {t for v, t in paths if v > best - 1e-9}, span


def test_plain_words_read_at_once_are_read_as_one_by_one():
    rng, m = random.Random(8), random_letters(9)
    flat, shown = m.ravel().tolist(), lambda x: set(toxicity._LETTERS.findall(x))
    for again in (True, False):
        spans = set()
        for _ in range(6000):
            signs = rng.choice(["abtel", "aÖéßb", "ab'.", "a1b!"])
            spans.add("".join(rng.choice(signs) * rng.choice([1, 1, 2, 2, 3]) for _ in range(rng.randint(1, 5))))
        spans = sorted(spans)
        data = np.frombuffer("".join(spans).encode(), np.uint8)
        ends = np.cumsum([len(x.encode()) for x in spans])
        plain, read = toxicity._plain_readings(data, np.concatenate([[0], ends[:-1]]), ends, m, (toxicity.DOUBLE, toxicity.REPEAT, 50.0) if again else (toxicity.DOUBLE,))
        assert 300 < plain.sum() < len(spans)
        for x, y in ((x, y) for x, y, p in zip(spans, read, plain) if p and any(map(str.isalpha, x))):
            own = shown(x.translate(toxicity._ASCII_LOWER))
            want = set().union(*(shown(toxicity._restored(k, flat, {}, again)) for k in toxicity.word_spans(x)))
            assert shown(y) | own == want | own, x


def test_very_long_words_are_read_whole():
    m, rng = random_letters(3), random.Random(4)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+", k=300_000))
    assert len(toxicity.restore(word, m)) > 200_000
    assert set(toxicity.restore("a" + "|" * 100_000, m)) <= set("ail ")
    got = toxicity.restored_texts(pa.array(["b" * 500_000 + " " + word]), m, {}).to_pylist()
    assert len(got[0]) > 200_000
