"""Language model, language identification, toxicity, licences and roles."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SYLLABLES, documents, empty, texts, words

from mapweave.llm import chat_format, katz, language_id, licenses, toxicity

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), b"</s>"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def discounts(seen, least):
    n = [0] + [seen.get(r, 0) for r in range(1, katz.KATZ + 2)]
    cut = (katz.KATZ + 1) * n[katz.KATZ + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, katz.KATZ + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else 0.0
        out[r] = 0.0 if r < least else d if 0 < d < 1 else (r - 0.5) / r
    return out


class Plain:
    """The same model, in the recursive form of its definition."""

    def __init__(self, rows, order):
        self.grams = [Counter() for _ in range(order + 1)]
        self.follow = Counter()
        for t in rows:
            line = [b"<s>", *t]
            for k in range(1, len(line)):
                for m in range(1, order + 1):
                    if k - m + 1 >= 0 and (m == 1 or k - m + 1 >= 0):
                        g = tuple(line[k - m + 1 : k + 1])
                        self.grams[m][g] += 1
                        self.follow[g[:-1]] += 1
        one = self.grams[1]
        self.total = sum(one.values())
        d = discounts(Counter(one.values()), 1)
        mass = {g: d.get(n, 1.0) * n for g, n in one.items()}
        z = max(self.total, sum(mass.values()) + 0.5)
        self.p1 = {g[0]: v / z for g, v in mass.items()}
        self.unknown = 1 - sum(mass.values()) / z
        self.p, self.bow = {}, {}
        for m in range(2, order + 1):
            d = discounts(Counter(self.grams[m].values()), 2)
            by = {}
            for g, n in self.grams[m].items():
                if n >= 2:
                    by.setdefault(g[:-1], {})[g[-1]] = d.get(n, 1.0) * n
            for h, found in by.items():
                z = max(self.follow[h], sum(found.values()) + 0.5)
                low = sum(self.prob(h[1:], w) for w in found)
                self.bow[h] = (1 - sum(found.values()) / z) / (1 - low)
            for h, found in by.items():
                z = max(self.follow[h], sum(found.values()) + 0.5)
                self.p.update({(*h, w): v / z for w, v in found.items()})

    def prob(self, h, w):
        if not h:
            return self.p1.get(w, self.unknown)
        return self.p[(*h, w)] if (*h, w) in self.p else self.bow.get(h, 1.0) * self.prob(h[1:], w)

    def score(self, t, order):
        line = [b"<s>", *t]
        return sum(math.log10(self.prob(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_its_recursive_form(spark, order):
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["held_out"], r["train_tokens"]) for r in katz.score_documents(documents(spark), order).collect()))
    train = [tokens(t) for i, t, _ in texts() if not held(i)]
    m, c = Plain(train, order), Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t)), m.score(tokens(t), order), held(i), total) for i, t, _ in texts())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[5:] == b[5:] and a[3:5] == pytest.approx(b[3:5], rel=1e-9, abs=1e-6)
    # Every distribution sums to one over the words and the unknown word.
    for h in [(), *list(m.bow)[:40]]:
        assert sum(m.prob(h, w) for w in m.p1) + m.prob(h, b"never seen") == pytest.approx(1, abs=1e-9)


def test_katz_sends_or_knows_its_entries(spark, monkeypatch):
    """The registered order looks back two words; scores are the same whether entries are known to all tasks or asked for by bucket."""
    assert katz.ORDER >= 3
    rows = lambda: sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in katz.score_documents(documents(spark)).collect()))
    known = rows()
    for name, value in (("FREQUENT", 0), ("CARRIED", 40), ("FLUSH", 100)):
        monkeypatch.setattr(katz, name, value)
    sent = rows()
    assert len(known) == len(sent) > 0
    for a, b in zip(known, sent):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-6)


def test_katz_scores_slice_by_slice(spark, monkeypatch):
    """Every row falls in one slice, each slice is written before the next, and the scores are those of one slice."""
    rows = lambda: sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in katz.score_documents(documents(spark)).collect()))
    names, write = [], katz.written
    monkeypatch.setattr(katz, "written", lambda df, name, *by: names.append(name) or write(df, name, *by))
    monkeypatch.setattr(katz, "SLICES", 1)
    whole = rows()
    monkeypatch.setattr(katz, "SLICES", 3)
    parts = rows()
    assert [n for n in names if n.startswith("lm_scores")] == ["lm_scores0", "lm_scores0", "lm_scores1", "lm_scores2"]
    assert len(whole) == len(parts) == documents(spark).count()
    for a, b in zip(whole, parts):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-6)


def test_katz_of_nothing(spark):
    assert katz.score_documents(empty(spark)).count() == 0


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, lang, 60), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 + 3", "fr"), (1003, rows[0][1], None), (None, rows[1][1], None)]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang in rows[:180])
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] == rows[0][2] and got[1003]["score"] == got[0]["score"]
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2}


def test_language_vectors_are_sums_of_bound_letters():
    got = language_id.document_vectors(["Ab cab"], 64)[0]
    line, want = " ab cab ", np.zeros(64)
    vector = lambda c: np.random.default_rng([ord(c), 64]).choice(np.array([-1, 1], np.int8), 64)
    for a, b, c in zip(line, line[1:], line[2:]):
        want += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    assert (got == want).all()


def test_language_of_nothing(spark):
    assert language_id.identify(empty(spark)).count() == 0
    assert [r["lang_pred"] for r in language_id.identify(documents(spark, [(1, "words", None)])).collect()] == ["und"]


def test_disguised_words_are_restored():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for w in ["idiot", "stupid", "trash", "worthless", "the", "cat", "sat"] * 20:
        s = [0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * 28 + b) * 28 + c] += 1
    m = toxicity.letter_model(counts)
    for shown, separators, word in (("1d10t", "", "idiot"), ("stuuupid", "", "stupid"), ("tr@$h", "", "trash"), ("i d i o t", " .-_*", "idiot"), ("t.r.a.s.h", " .-_*", "trash"), ("w0rthless", "", "worthless"), ("cat", "", "cat")):
        assert toxicity.restore(shown, m, separators) == word
    got = toxicity.restored_texts(pa.array(["the c.a.t.s 1d10t", None, "plain words", ""]), m, {}).to_pylist()
    assert "idiot" in got[0] and got[1:] == ["", "", ""]


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        w, bad = words(rng, "en", 40).split(), i % 4 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["idiot", "stupid", "moron"])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(bad), 1))
    rows += [(1000, "the an stupid her", "en"), (1001, "the an s t u p i d her", "en"), (1002, "the 5tup1d her", "en"), (1003, None, "en"), (1004, "", "en"), (None, "an her", "en")]
    labels += [(5000, 1, 1), (1003, None, 0), (None, 1, 0)]
    given = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, rows), given).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(300) if got[i]["held_out"])
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 1, 0, 0, 0]
    assert got[1003]["score"] == got[1004]["score"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(empty(spark), none).count() == 0
    assert [r["predicted"] for r in toxicity.score_documents(documents(spark, [(1, "a text", "en")]), none).collect() if r["score"] < 0.5] in ([], [0])


def test_licences_are_found_and_confirmed(spark):
    rng = random.Random(6)
    plain = lambda n: words(rng, "en", n)
    rows = [(i, f"{plain(30)}\n{t[0]}\n{plain(30)}", "en") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(100 + i, f"{plain(150)} {' '.join(t[-1].upper().split())} {plain(150)}", "en") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(200 + i, plain(80), "en") for i in range(60)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "license of the software in the version", "en"), (303, rows[1][1], "fr"), (303, rows[1][1], "fr")]
    got = {}
    for r in licenses.scan_documents(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    names = list(licenses.TEMPLATES)
    assert [got[i][0]["license"] for i in range(len(names))] == names
    assert [got[100 + i][0]["license"] for i in range(len(names))] == names
    assert all(got[i][0]["license"] == "none" for i in [*range(200, 260), 300, 301, 302])
    assert len(got[303]) == 2 and got[303][0] == got[303][1] and got[303][0]["license"] == got[1][0]["license"]


def test_licences_of_nothing(spark):
    assert licenses.scan_documents(empty(spark)).count() == 0


def talk(rng, n):
    roles = ["user", "assistant"] * n
    return [(r, words(rng, "en", rng.randint(5, 12) if r == "user" else rng.randint(60, 90))) for r in roles][: rng.randint(2, 2 * n)]


def test_roles_of_held_out_conversations(spark):
    rng = random.Random(8)
    rows = [(c, k, r, t) for c in range(80) for k, (r, t) in enumerate(talk(rng, 3))]
    rows += [(None, 0, "user", "alone without an id"), (None, 1, "assistant", words(rng, "en", 80)), (200, None, "user", None), (200, 1, "other", ""), (201, 0, "user", "twice"), (201, 0, "user", "twice")]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, key string, chunk int")
    got = chat_format.format_conversations(frame).collect()
    assert len(got) == len(rows)
    want = {(c, k): r for c, k, r, _ in rows if c is not None and c < 80}
    assert all(r["role_pred"] == want[r["conv_id"], r["turn"]] for r in got if (r["conv_id"], r["turn"]) in want and r["held_out"])
    assert all(r["rendered"].startswith(f"<|{r['role_pred']}|>\n") and r["rendered"].endswith("<|end|>") for r in got)
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(nothing).count() == 0


def test_chunks_give_the_path_of_the_whole():
    rng = np.random.default_rng(3)
    step = np.log(rng.dirichlet(np.ones(6), 6))
    start, e = np.log(rng.dirichlet(np.ones(6))), np.log(rng.random((50, 6)))
    whole = chat_format.viterbi(e, step, start)
    cuts, path = [0, 7, 20, 21, 50], []
    first = (start + e[0])[:, None] + chat_format.transfer(e[1:7], step)
    tables = [np.repeat(first.max(0)[None], 6, 0), *(chat_format.transfer(e[a:b], step) for a, b in zip(cuts[1:], cuts[2:]))]
    ends = chat_format._ends(pa.table({"conv": [1] * 4, "single": [False] * 4, "chunk": [0, 1, 2, 3], "t": [t.ravel().tolist() for t in tables]}))
    for a, b, before, end in zip(cuts, cuts[1:], ends.column("before").to_pylist(), ends.column("end").to_pylist()):
        path += chat_format.viterbi(e[a:b], step, start if before < 0 else step[before], end)
    assert path == whole


def test_markers_name_the_speaker():
    m = chat_format.model({(4, 0, 2): 1, (4, 2, 4): 9, (4, 4, 2): 9, (4, 2, 3): 5, (4, 4, 5): 5, (5, 2, 0): 5})
    text = "User: What is it?\nAssistant: It is this.\nAnd that.\n\nHuman: Why?\n### Assistant\nBecause."
    turns = chat_format.parse(text, m)
    assert [r for r, _ in turns] == ["user", "assistant", "user", "assistant"] and turns[1][1] == "It is this.\nAnd that."
    assert chat_format.render(turns[:1]) == "<|user|>\nWhat is it?\n<|end|>"
