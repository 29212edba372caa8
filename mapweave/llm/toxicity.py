"""Toxicity of texts whose writers disguise words.

A disguised word is a noisy channel's output: a letter may have become a look-alike sign, have been repeated, or have
got separators behind it.  Spans where that can have happened (words with a letter and a look-alike sign anywhere, a letter
twice in a row or a separator inside, and rows of three or more single signs, however far apart) become lattices of
letters, and Viterbi finds the likeliest path under a trigram model of the corpus' letters.  Other spans have one path
only, themselves.  Words whose double letters are all that they may hide are read a batch at a time; of others tasks
remember distinct spans, so the work follows the vocabulary.

Features of a text are its words (runs of letters and bytes beyond ASCII, A-Z lower-cased) and the words' beginnings of
4 to 8 bytes, of the text as it is and of its restored spans.  Document counts per feature and label come from all
training rows; the features that point to label 1 most clearly are kept, and a logistic regression weighs them on a
bounded sample of the training rows.

Defined cases: a null or empty text has the score of a text without features, repeated rows and ties each get their own
equal score, labels of null or without a document teach nothing, with no label at all the score is 0.5 or below, an empty
table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import in_slots, remainder, slots_of, stored
from mapweave.llm.words import FOLDED, VALUE, bounds, buffer_of, hashes, mix, pieces

MAX_FEATURES = 4000
SAMPLE = 20_000  # training rows the regression is fitted on, about; those with the smallest hashes of their ids
MIN_DOCS = 3
BEGINNINGS = (4, 5, 6, 7, 8)
SYMBOLS = 28  # gap, a-z, any other letter

#: Look-alike signs and the letters they stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
KEEP, SWAP, DROP = math.log(0.9), math.log(0.05), math.log(0.2)
REPEAT, DOUBLE = math.log(0.3), math.log(0.002)  # a letter said again, in a run of three or more and in a double letter
GAP, STRAY = math.log(0.5), math.log(0.0003)  # a gap shown by a sign like no letter, and by a look-alike sign

_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[65:91] = _PLAIN[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xC2:] = 27
_SKIP = np.zeros(256, bool)
_SKIP[128:0xC0] = True
SEPARATORS = " \t\n\r.-_*"
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS]] = True
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in SEPARATORS if not c.isspace()]] = True
_SIGNS = "".join(map(re.escape, LOOKALIKES))
_SPACED = re.compile(rf"(?<![^\W_])(?:[A-Za-z0-9{_SIGNS}][ \t\n\r.\-_*]+){{2,}}[A-Za-z0-9{_SIGNS}](?![^\W_])")
_RUN, _THRICE = re.compile(r"(.)\1*", re.DOTALL), re.compile(r"(.)\1\1+", re.DOTALL)
_TWICE = re.compile(r"([A-Za-z])\1", re.IGNORECASE)
_HIDDEN = re.compile(f"[{_SIGNS}]")
_INNER = re.compile(rf"(?:[^\W_]|[{_SIGNS}])[.\-_*]+(?:[^\W_]|[{_SIGNS}])")
_LETTERS = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


# Letter model


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams of all texts; tasks send one row per trigram and batch group, at most SYMBOLS ** 3."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                data, _ = buffer_of(piece.column("text"))
                data = data[~_SKIP[data]]
                s = _SYMBOL[data]
                keep = s > 0
                keep[1:] |= s[:-1] > 0
                s = np.concatenate([[0], s[keep], [0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(found, pa.int32()), "n": total[found]})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram int, n long")
    out = np.zeros(SYMBOLS**3)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the third symbol after two, mixed with shorter contexts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3)


@lru_cache(1 << 16)
def _symbol(c: str) -> int:
    k = ord(c.lower()) - 96 if len(c.lower()) == 1 else 0
    return k if 1 <= k <= 26 else 27 if c.isalpha() else 0


def _of_letters(low: str, model: list[float], double: float) -> str | None:
    """restore() where no sign looks like a letter: how often the letter of a run is said is the only choice, and no other
    depends on it, as the letter behind it is followed by the same two letters either way.  None where two counts tie."""
    runs = [(m[0][0], len(m[0])) for m in _RUN.finditer(low)]
    symbols = [0, *[_symbol(c) for c, _ in runs], 0]
    out: list[str] = []
    for k, (c, n) in enumerate(runs):
        p, b, f = symbols[k : k + 3]
        if not b:
            out.append(" " if p else "")
            continue
        said = 1
        if n > 1:
            again, twice = REPEAT if n > 2 else double, (b * SYMBOLS + b) * SYMBOLS
            one, two = (p * SYMBOLS + b) * SYMBOLS, KEEP + model[(p * SYMBOLS + b) * SYMBOLS + b] + model[twice + f]
            # From two on each further letter adds the same, so the best count is 1, 2 or all.
            scores = sorted((two + (j - 2) * (KEEP + model[twice + b]) + (n - j) * again if j > 1 else model[one + f] + (n - 1) * again, j) for j in {1, 2, n})
            if scores[-1][0] - scores[-2][0] < 1e-9:
                return None
            said = scores[-1][1]
        out.append(c * said)
    return "".join(out).strip()


# A text so far is a chain (text before, letter, length), so paths share what they have in common.
_START: tuple = (None, "", 0)


def _text(chain: tuple) -> str:
    out = []
    while chain[2]:
        out.append(chain[1])
        chain = chain[0]
    return "".join(reversed(out))


def _behind(x: tuple, y: tuple) -> bool:
    """Whether the first text sorts behind the second; only what differs is looked at."""
    a, b = [], []
    while x is not y:
        n, m = x[2], y[2]
        if n >= m:
            a.append(x[1])
            x = x[0]
        if m >= n:
            b.append(y[1])
            y = y[0]
    return a[::-1] > b[::-1]


def restore(span: str, model: np.ndarray | list[float], separators: str = "", stray: float = STRAY, double: float = DOUBLE) -> str:
    """The likeliest letters behind one span: Viterbi over the lattice, a state being the last two letters.  ``model`` is
    letter_model() or the list of its values.  Time grows with the span's length."""
    flat = model if isinstance(model, list) else model.ravel().tolist()
    low = span.lower()
    if not separators and not _HIDDEN.search(low):
        text = _of_letters(low, flat, double)
        if text is not None:
            return text
    # state: (symbol before last, last symbol, last seen sign) -> (log probability, text so far)
    states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, _START)}
    done: list[str] = []
    runs = {i for m in _THRICE.finditer(low) for i in range(*m.span())}
    for i, sign in enumerate(low):
        if sign in separators:
            states = {key: (value + DROP, text) for key, (value, text) in states.items()}
            continue
        own, again, letters = _symbol(sign), REPEAT if i in runs else double, LOOKALIKES.get(sign, "")
        own_gap = stray if letters else GAP
        ways: list[tuple[tuple[int, int, str], float, tuple]] = []
        for (a, b, last), (value, text) in states.items():
            at = (a * SYMBOLS + b) * SYMBOLS
            if sign == last:
                ways.append(((a, b, last), value + again, text))
            if own:
                ways.append(((b, own, sign), value + KEEP + flat[at + own], (text, sign, text[2] + 1)))
                continue
            for letter in letters:
                k = _symbol(letter)
                ways.append(((b, k, sign), value + SWAP + flat[at + k], (text, letter, text[2] + 1)))
            # The sign means itself: a gap between words.
            ways.append(((b or a, 0, sign), value + own_gap + (flat[at] if b else 0.0), (text, " ", text[2] + 1) if b else text))
        states = {}
        for key, value, text in ways:
            best = states.get(key)
            if best is None or value > best[0] or value == best[0] and _behind(text, best[1]):
                states[key] = (value, text)
        if len(states) == 1 and text[2] > 64:
            # All paths meet here, so what lies before is settled.
            [(key, (value, text))] = states.items()
            done.append(_text(text))
            states = {key: (value, _START)}
    ends = [(value + (flat[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0), text) for (a, b, _), (value, text) in states.items()]
    best = ends[0]
    for end in ends[1:]:
        if end[0] > best[0] or end[0] == best[0] and _behind(end[1], best[1]):
            best = end
    return ("".join(done) + _text(best[1])).strip()


def word_spans(word: str) -> list[tuple[str, str]]:
    """The ways to read a word that may be disguised, each with the separators that may have been put in."""
    if not any(map(str.isalpha, word)):
        return []
    found = [(word, "")] if _HIDDEN.search(word) or _TWICE.search(word) else []
    return found + ([(word, SEPARATORS)] if _INNER.search(word) else [])


def _restored(key: tuple[str, str], model: list[float], memory: dict[tuple[str, str], str], again: bool = True) -> str:
    """What a span restores to beyond the words that it shows."""
    if key not in memory:
        if len(memory) > 200_000:
            memory.clear()
        # Also with every look-alike sign read as a letter, where a rare beginning speaks against it, and with double
        # letters said once, where the texts have such doubles themselves.
        strays = (STRAY, -50.0) if _HIDDEN.search(key[0]) else (STRAY,)
        doubles = (DOUBLE, REPEAT, 50.0) if again and _TWICE.search(key[0]) else (DOUBLE,)
        shown = set(_LETTERS.findall(key[0].translate(_ASCII_LOWER)))
        memory[key] = " ".join(x for x in dict.fromkeys(restore(key[0], model, key[1], x, y) for x in strays for y in doubles) if not shown.issuperset(_LETTERS.findall(x)))
    return memory[key]


def _plain_readings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, model: np.ndarray, prices: tuple[float, ...]) -> tuple[np.ndarray, list[str]]:
    """What _restored() gives for the plain ones of some words, all at once, and which are plain: of ASCII and Latin-1
    letters with no look-alike sign, no inner separator and no letter three times.  There each double letter is a choice of
    its own, as in _of_letters().  Readings keep the word's other signs, which are in no feature."""
    n, sizes = len(begins), ends - begins
    word = np.repeat(np.arange(n), sizes)
    low = data[np.arange(len(word)) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)]
    low = np.where(_PLAIN[low], low | 32, low)
    after = np.zeros(len(low), bool)
    after[1:] = low[:-1] == 0xC3
    capital = after & (low < 0x9F)
    low = np.where(capital, low + 32, low).astype(np.uint8)
    # Signs at the word's characters; what lies beyond the word is none.
    char = np.flatnonzero(~_SKIP[low])
    sign, of = low[char].astype(np.int64), word[char]
    sign[sign == 0xC3] = low[np.minimum(char[sign == 0xC3] + 1, len(low) - 1)].astype(np.int64) + 256
    same = lambda k: np.concatenate([(sign[k:] == sign[:-k]) & (of[k:] == of[:-k]), np.zeros(min(k, len(of)), bool)])
    pair, cut, letter = same(1), _CUT[low[char]], (sign >= 256) | _PLAIN[sign & 255] & (sign < 128)
    odd = _SIGN[low] | (low >= 0x80) & ~_SKIP[low] & (low != 0xC3) | after & ((low == 0xB7) | (low == 0x97))
    strange = np.zeros(n, bool)
    strange[word[odd]] = True
    strange[of[letter & pair & np.append(pair[1:], False)]] = True
    strange[of[pair & (sign >= 256)]] = True
    strange[of[:-1][cut[:-1] & ~cut[1:] & (of[1:] == of[:-1])]] = True
    symbol = np.where(sign >= 256, 27, _SYMBOL[sign & 255] * (sign < 128))
    at = np.flatnonzero(pair & letter & ~strange[of])

    def beside(k: int) -> np.ndarray:
        i = np.clip(at + k, 0, max(0, len(of) - 1))
        return np.where((at + k >= 0) & (at + k < len(of)) & (of[i] == of[at]), symbol[i], 0)

    before, own, behind = beside(-1), symbol[at], beside(2)
    twice, once = KEEP + model[before, own, own] + model[own, own, behind], model[before, own, behind]
    read: list[list[str]] = []
    earlier = np.zeros(n, np.int64)
    earlier[np.intersect1d(word[capital], of[at])] = -1  # a reading is in small letters, beyond ASCII too
    for price in prices:
        strange[of[at[np.abs(once + price - twice) < 1e-9]]] = True
        gone = at[once + price > twice]
        count = np.bincount(of[gone], minlength=n)
        keep = (count > earlier)[word]  # a dearer price drops what a cheaper one does, and more
        keep[char[gone + 1]] = False
        places = np.concatenate([[0], np.cumsum(np.bincount(word[keep], minlength=n))]).astype(np.int32)
        read.append(pa.StringArray.from_buffers(n, pa.py_buffer(places), pa.py_buffer(low[keep].tobytes())).to_pylist())
        earlier = np.maximum(earlier, count)
    return ~strange, [" ".join(filter(None, x)) for x in zip(*read)]


def _rows_of_signs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the texts that may hold three single signs in a row."""
    begins, ends, first = bounds(data, at, ~_APART)
    alone = (ends - begins == 1) | (ends - begins <= 3) & (data[begins] >= 0x80) if len(begins) else np.empty(0, bool)
    doc = np.searchsorted(first, np.flatnonzero(alone[:-2] & alone[1:-1] & alone[2:]) + 2, "right") - 1 if len(alone) > 2 else np.empty(0, np.int64)
    return np.unique(doc)


def restored_texts(texts: pa.Array, model: np.ndarray, memory: dict[tuple[str, str], str], again: bool = True) -> pa.Array:
    """For each text its restored spans as one text, empty where nothing is hidden; ``again``: also with double letters
    said once at any price."""
    data, at = buffer_of(texts)
    flat = model.ravel().tolist()
    got: list[list[str]] = [[] for _ in range(len(texts))]
    for i in _rows_of_signs(data, at).tolist():
        got[i] += [_restored((m[0], SEPARATORS), flat, memory, again) for m in _SPACED.finditer(texts[i].as_py() or "")]
    # Words with a look-alike sign, a letter twice or a separator between others, found on the bytes; each is read once.
    begins, ends, first = bounds(data, at)
    if len(begins):
        low, plain = data | 32, _PLAIN[data]
        hit = _SIGN[data] | (data == 0xC2) | (data == 0xE2)  # the euro and pound signs begin so
        hit[1:] |= plain[1:] & (low[1:] == low[:-1])
        hit[1:] |= _APART[data[1:]] & ~_APART[data[:-1]]
        hits, letters = (np.concatenate([[0], np.cumsum(x)]) for x in (hit, plain | (data >= 0x80)))
        use = np.flatnonzero((hits[ends] > hits[begins]) & (letters[ends] > letters[begins]))
        kinds, one, of = np.unique(hashes(data, begins[use], ends[use], VALUE), return_index=True, return_inverse=True)
        raw, b, e = data.tobytes(), begins[use[one]], ends[use[one]]
        plain, read = _plain_readings(data, b, e, model, (DOUBLE, REPEAT, 50.0) if again else (DOUBLE,))
        for i in np.flatnonzero(~plain).tolist():
            read[i] = " ".join(filter(None, (_restored(k, flat, memory, again) for k in word_spans(raw[b[i] : e[i]].decode()))))
        some = np.array([bool(x) for x in read], bool)[of] if len(read) else np.empty(0, bool)
        doc = np.searchsorted(first, use[some], "right") - 1
        for d, k in zip(*(x.tolist() for x in np.divmod(np.unique(doc * max(1, len(kinds)) + of[some]), max(1, len(kinds))))):
            got[d].append(read[k])
    return pa.array([" ".join(filter(None, x)) for x in got], pa.string())


# Features


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every feature occurrence."""
    data, at = buffer_of(texts)
    begins, ends, first = bounds(data, at, _LETTER_BYTE)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    found, docs = [mix(hashes(data, begins, ends, FOLDED))], [doc]
    for k in BEGINNINGS:
        long = ends - begins > k
        found.append(mix(hashes(data, begins[long], begins[long] + k, FOLDED) + np.uint64(k)))
        docs.append(doc[long])
    return np.concatenate(found), np.concatenate(docs)


def document_features(texts: pa.Array, model: np.ndarray, memory: dict, again: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield features(texts)
    more = restored_texts(texts, model, memory, again)
    yield features(more)


def feature_counts(labelled: DataFrame, model: np.ndarray) -> DataFrame:
    """feature, and the documents of each label that have it.  Tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for piece in pieces(batch, size=2 << 20):  # each sends its features
                toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                # A word said with its double letters once would share its own weight.
                both = list(document_features(piece.column("text"), model, memory, again=False))
                f, d = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
                f, number = np.unique(f, return_inverse=True)
                pair = np.unique(number.astype(np.int64) * piece.num_rows + d)
                number, bad = pair // piece.num_rows, toxic[pair % piece.num_rows]
                ones = np.bincount(number, bad, minlength=len(f)).astype(np.int64)
                yield pa.record_batch({"feature": f.view(np.int64), "ones": ones, "docs": np.bincount(number, minlength=len(f)).astype(np.int64)})

    rows = labelled.select("text", "toxic").mapInArrow(count, "feature long, ones long, docs long")
    return rows.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("docs").alias("docs"))


@dataclass
class Model:
    letters: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0

    def hits(self, texts: pa.Array, memory: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, known feature number) pairs."""
        pairs = [np.empty(0, np.int64)]
        for f, d in document_features(texts, self.letters, memory) if len(self.keys) else ():
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            here = self.keys[at] == f
            pairs.append(d[here] * len(self.keys) + at[here])
        pair = np.unique(np.concatenate(pairs))
        return np.divmod(pair, max(1, len(self.keys)))


def _fit(rows: list[list[int]], toxic: np.ndarray, n: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by accelerated gradient steps from the log odds of all rows."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([x for r in rows for x in r], np.int64)
    base = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    w, bias = np.zeros(n), math.log(base / (1 - base))
    ahead, ahead_bias, ridge, step = w.copy(), bias, 0.2 / max(1, len(rows)), 2.0
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, ahead[col], minlength=len(rows)) + ahead_bias, -30, 30)))
        error = (p - toxic) / len(rows)
        grow = np.bincount(col, error[doc], minlength=n) + ridge * ahead
        w_new = np.maximum(ahead - step * grow, 0.0)  # kept features point to label 1 by choice
        b_new = ahead_bias - step * error.sum()
        k = t / (t + 3)
        ahead, ahead_bias = w_new + k * (w_new - w), b_new + k * (b_new - bias)
        w, bias = w_new, b_new
    return w, bias


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the labelled documents.  A bit table of their ids, 2 MB whatever their number, keeps most
    other texts out of the shuffle; the join is exact."""
    bits = slots_of(known, "doc_id")

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_slots(bits, batch.column("doc_id").to_numpy())))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(maybe, "doc_id long, text string").join(known.hint("merge"), "doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Letters from all docs (doc_id, text); labels (doc_id, toxic) only where crc32(doc_id) mod 5 is not 0."""
    model = Model(letter_model(letter_counts(docs)))
    known = labels.where("toxic is not null and doc_id is not null").where(remainder("doc_id", 5) != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = stored(_labelled(docs, known), "labelled")
    counts = stored(feature_counts(labelled, model.letters).where(f"ones >= {MIN_DOCS}"), "features")
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    if not total["ones"] or total["ones"] == total["n"]:
        model.bias = math.log(0.5 / max(1, total["n"])) if total["n"] and not total["ones"] else 0.0
        return model
    share = total["ones"] / total["n"]
    # Twice the log likelihood ratio of the feature's documents having label 1 more often than others.
    rate = "(ones / docs)"
    strength = f"2 * (ones * ln({rate} / {share}) + if(docs > ones, (docs - ones) * ln((1 - {rate}) / (1 - {share})), 0))"
    best = counts.where(f"{rate} > {share} * 2").withColumn("strength", F.expr(strength)).where("strength > 12").orderBy(F.desc("strength"), "feature").limit(MAX_FEATURES)
    model.keys = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for piece in pieces(batch):
                d, k = model.hits(piece.column("text"), memory)
                at = np.searchsorted(d, np.arange(piece.num_rows + 1))
                yield pa.record_batch({"toxic": piece.column("toxic"), "hits": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(k, pa.int32()))})

    share = min(1.0, SAMPLE / total["n"])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sample.select("text", "toxic").mapInArrow(seen, "toxic int, hits array<int>").collect()
    if rows:
        model.weights, model.bias = _fit([r["hits"] for r in rows], np.array([r["toxic"] for r in rows], float), len(model.keys))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    source = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for piece in pieces(batch):
                d, k = model.hits(piece.column("text"), memory)
                z = np.bincount(d, model.weights[k], minlength=piece.num_rows) + model.bias
                p = 1 / (1 + np.exp(-z))
                yield pa.record_batch([*piece.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*piece.schema.names, "score", "predicted"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(judge, f"{kind}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels)
    found = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
