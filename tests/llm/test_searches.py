"""URL rules, ranked search and spelling variants against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, texts, words
from pyspark.sql import functions as F

from mapweave.llm import lexical_search, spelling_variants, url_filters
from mapweave.llm.queries import URL_RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# URL rules


def judged(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def urls():
    rng = random.Random(4)
    hosts = ["com", "example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "net", "b.net", "a..net", ".com", "com.", "", "example.com:80", "de", "u@b.net", "ü.net"]
    paths = ["", "/", "/en/", "/EN/", "/en", "/en/x/y", "/es/", "/fr/a?b", "/fr#t", "?x=/en/", "#/es/", "/e\nn/", "/é/"]
    rows = [f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return [*rows, None, "", "no address", "://", ":///en/", "http://a://b.net/es/", "http://net/es/" + "x" * 100_000, *["http://b.net/fr/"] * 5]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "k", "r", 1) for i, u in enumerate(rows)], "page_id long, url string, host string, key string, rule string, best int").repartition(3)


def rule_table(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_contract_rules_equal_plain_python(spark):
    given = re.findall(r"\('([^']*)', '([^']*)', '([^']*)'\)", URL_RULES)
    rows = urls()
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge(pages(spark, rows), rule_table(spark, given)).collect()}
    assert got == {i: judged(u, given) for i, u in enumerate(rows)}


@pytest.mark.parametrize("rate", [None, 0.9])
def test_many_rules_equal_plain_python(spark, rate):
    """A first level that lets nearly everything through leaves the rest to the levels above it."""
    rng = random.Random(8)
    names = [f"{a}{b}.{t}" for a in "abcdefgh" for b in "xyz" for t in ("com", "net", "co.uk")]
    given = sorted({(rng.choice(names), rng.choice(["", "/", "/a/", "/b", "/a/c/"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    given = [(h, p, v) for (h, p), v in given]
    rows = [f"http://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(names)}{rng.choice(['', '/', '/a/', '/a/c/d', '/bb', '/q'])}" for _ in range(1500)]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge(pages(spark, rows), rule_table(spark, given), start_rate=rate).collect()}
    assert got == {i: judged(u, given) for i, u in enumerate(rows)}


def test_cascade_is_exact_over_its_keys(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = keys.where("key % 10 = 3")
    first = url_filters.bloom(listed, 300, 0.5, 0)
    passed = keys.where(first.may_hold(F.col("key")))
    levels = url_filters.cascade(first, listed, passed)
    assert passed.count() > 600 and len(levels) > 2
    found = keys.where(url_filters.is_listed(levels, F.col("key")))
    assert {r["key"] for r in found.collect()} == {str(i) for i in range(3, 3000, 10)}


def test_rules_of_odd_kinds(spark):
    given = [("Com", "/", "block"), ("com", "/", "allow"), ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "/", "other"), ("org", "", "allow")]
    rows = ["http://a.com/", "http://a.net/", "http://org", None]
    got = [tuple(r)[3:] for r in url_filters.judge(pages(spark, rows), rule_table(spark, given), default="block").orderBy("page_id").collect()]
    assert got == [("com/", "block"), (None, "block"), ("org", "allow"), (None, "block")]
    assert [r["verdict"] for r in url_filters.judge(pages(spark, rows), rule_table(spark, [])).collect()] == ["allow"] * 4
    assert url_filters.judge(pages(spark, rows).limit(0), rule_table(spark, given)).collect() == []


def test_lists_beyond_the_bound_are_refused(spark):
    with pytest.raises(ValueError, match="divide the list"):
        url_filters.bloom(spark.range(10).selectExpr("cast(id as string) as key"), 10_000, 1e-3, 0, largest=1000)


def test_judging_has_no_join_and_no_python(spark):
    plan = url_filters.judge(pages(spark, urls()).select("page_id", "url"), rule_table(spark, [("com", "/", "block")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


# Ranked search


def terms_of(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, top=10):
    bags = [Counter(terms_of(t)) for _, t, _ in docs]
    n = [sum(b.values()) for b in bags]
    big_n, big_l = sum(map(bool, n)), sum(n)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for (i, _, _), b, size in zip(docs, bags, n):
            m = 100 - 75 + (75 * size * big_n) // big_l if size else 0
            s = sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, k in asked.items() if b[t])
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def questions(spark, items):
    return spark.createDataFrame([(*x, -1, "h") for x in items], "item_id long, text string, score long, hashes string")


def test_search_equals_brute_force(spark):
    docs, rng = texts(), random.Random(3)
    items = [(k, " ".join(rng.choice(docs[:60])[1].split()[:12]) + " the THE über") for k in range(25)]
    items += [(100, None), (101, ""), (102, "!?"), (103, "neverseenword"), (104, docs[60][1]), (104, docs[60][1]), (105, "the " * 500), (106, docs[81][1])]
    got = [tuple(r) for r in lexical_search.search_documents(documents(spark, docs), questions(spark, items)).orderBy("item_id", "rank").collect()]
    want = ranked(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_of_queries_and_fewer_results(spark):
    docs = texts()[:40]
    items = [(k, docs[k][1]) for k in range(9)]
    found = lexical_search.search(lexical_search.index(documents(spark, docs)), questions(spark, items), top=3, size=4)
    assert sorted(map(tuple, found.collect())) == sorted(ranked(docs, items, 3))


def test_bounds_are_never_below_the_score():
    rng = random.Random(6)
    bags = list(lexical_search.terms(pa.array([words(rng, "en", rng.randint(1, 3000)) for _ in range(40)])))
    h = bags[3][0][:50]
    block = lexical_search.Block([1], np.array([0, len(h)]), h, np.arange(1, len(h) + 1))
    for one, counts in bags:
        damping = rng.randint(25, 5000)
        sketch = lexical_search.fold(one, lexical_search.impacts(counts, damping))
        exact = lexical_search._score(one, counts, damping, h, block.weights)
        assert exact <= lexical_search._bounds(block, sketch[None])[0, 0]


def test_search_in_nothing(spark):
    items = [(1, "the")]
    assert lexical_search.search_documents(empty(spark), questions(spark, items)).collect() == []
    assert lexical_search.search_documents(documents(spark), questions(spark, []).limit(0)).collect() == []
    assert lexical_search.search_documents(documents(spark, [(1, None, None), (2, " ", None)]), questions(spark, items)).collect() == []


# Spelling variants


def counted(docs):
    out = Counter()
    for i, text, _ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + (len(a) > len(b)) :] == b[p + (len(b) > len(a)) :]


def grouped(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    best = {w: min(v, key=lambda x: (-count[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if count[b] >= 10 * count[w]}
    out = {}
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, count[w], len(near[w]), count[form[w]] if w in form else None)
    return out


def variant_texts():
    rng = random.Random(9)
    base = ["grünlich", "vorstellung", "mississippi", "banananana", "aaaaaaa", "aaaaaaaa", "abababababab", "x" * 39, "x" * 40, "x" * 41, "y" * 60 + "z" * 60, "straßenbahn"]
    pool = {w: rng.choice([2, 3, 30, 400]) for w in base}
    for w in base:
        for _ in range(6):
            p, c = rng.randrange(len(w)), rng.choice("abxé")
            pool[rng.choice([w[:p] + c + w[p + 1 :], w[:p] + c + w[p:], w[:p] + w[p + 1 :], w + c])] = rng.choice([1, 2, 3, 25, 700])
    runs = [w if k % 3 else w.upper().replace("SS", "ss") for w, n in pool.items() for k in range(n)]
    rng.shuffle(runs)
    return [(k, " ".join(runs[k::50]) + " short 12", "en") for k in range(50)]


def test_variants_equal_brute_force(spark):
    rows = [*texts(), *variant_texts()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.spelling_variants(documents(spark, rows)).collect()}
    want = grouped(counted(rows))
    assert got == want
    assert sum(f is not None and f != r for f, r, *_ in want.values()) > 0


def test_trie_and_gaps_find_the_same(spark):
    rng = random.Random(2)
    found = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(250)} | {"ä", "aä"}
    table = spark.createDataFrame([(w,) for w in sorted(found)], "word string")
    want = sorted((a, b) for a in found for b in found if one_edit(a, b))
    for make in (spelling_variants.near_in_trie, spelling_variants.near_by_gap):
        assert sorted(map(tuple, make(table).distinct().collect())) == want
    assert sorted(map(tuple, spelling_variants.near_pairs(table, long=5).collect())) == want


def test_roots_follow_long_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(21)] + [("a", "w20"), ("b", "c")]
    got = dict(map(tuple, spelling_variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {**{w: "w21" for w, _ in forms}, "b": "c"}


def test_no_words(spark):
    assert spelling_variants.spelling_variants(empty(spark)).collect() == []
    assert spelling_variants.spelling_variants(documents(spark, [(1, None, None), (2, "few short ones", None)])).collect() == []
