"""Allow and block rules for addresses, kept in cascades of Bloom filters.

A rule is a host and the beginning of a path; it fits its host and all subdomains.  A key is a host suffix of as many
labels as some rule has, with a path beginning as long as that rule's.  For each verdict a cascade tells which of the
corpus's keys are listed: level 0 holds the listed keys, level 1 those other keys of the corpus that level 0 lets
through, level 2 the listed keys that level 1 lets through, and so on until nothing is let through wrongly.  Every key
of the corpus takes part, so the answer is exact for the pages the cascade was made for, and judging them is one narrow
pass without a join.  All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
DEFAULT = "allow"  # of an address that no rule fits
RATE = 1 / 16  # of keys that a level above 0 lets through wrongly
LARGEST = 64 << 20  # bytes of one level at most
SHAPES = 256  # pairs of (labels of the host, length of the path) in the rules at most


@dataclass(frozen=True)
class Level:
    """A Bloom filter whose bits of one key all lie in one 64-bit word, so a key costs one look.  The words are a table of
    one row, which every task gets as a scalar."""

    words: DataFrame
    n_words: int
    hashes: int
    seed: int

    def may_hold(self, key: Column) -> Column:
        mask = _mask(key, self.hashes, self.seed)
        return F.get(self.words.scalar(), _word(key, self.n_words, self.seed).cast("int")).bitwiseAND(mask) == mask


def _word(key: Column, n_words: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(n_words))


def _mask(key: Column, hashes: int, seed: int) -> Column:
    h = F.xxhash64(key, F.lit(2 * seed + 1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(hashes)]
    return reduce(Column.bitwiseOR, bits)


def passing(load: float, hashes: int) -> float:
    """Share of other keys let through by words that hold ``load`` keys each on average."""
    out, chance = 0.0, math.exp(-load)
    for j in range(1, 200):
        chance *= load / j
        out += chance * (1 - (1 - 1 / 64) ** (hashes * j)) ** hashes
    return out


def bloom(keys: DataFrame, n: int, rate: float, seed: int, largest: int = LARGEST) -> Level:
    """A filter of the n keys (column ``key``) that lets other keys through at about this rate."""
    load = 16.0
    while min(passing(load, k) for k in range(1, 11)) > rate:
        load /= 1.25
    hashes = min(range(1, 11), key=partial(passing, load))
    n_words = math.ceil(n / load)
    if 8 * n_words > largest:
        raise ValueError(f"a filter of {n} keys takes {8 * n_words} bytes, more than {largest}; divide the list")
    some = keys.select(_word(F.col("key"), n_words, seed).alias("word"), _mask(F.col("key"), hashes, seed).alias("bits"))
    none = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("words"))
    return Level(written(row, "bloom"), n_words, hashes, seed)


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for the keys that the levels were made with."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].may_hold(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def cascade(first: Level, listed: DataFrame, passed: DataFrame, largest: int = LARGEST) -> list[Level]:
    """All levels: ``first`` holds the listed keys, ``passed`` are all keys of the corpus that it lets through (each once)."""
    levels = [first]
    inside = listed.select("key", F.lit(1).alias("listed"))
    tagged = inside.unionByName(passed.select("key", F.lit(0).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    sides = written(tagged, "sides")
    now = {1: sides.where("listed = 1"), 0: sides.where("listed = 0")}
    for level in count(1):
        wrong = now[level % 2 ^ 1]  # those that the level before lets through and should not
        n = wrong.count()
        if n == 0:
            discard(sides)
            return levels
        levels.append(bloom(wrong.select("key"), n, RATE, levels[-1].seed + 1, largest))
        now[level % 2] = now[level % 2].where(levels[-1].may_hold(F.col("key")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _suffix(host: Column, labels: int) -> Column:
    """The last labels of a host that has as many."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return F.when(dots >= labels - 1, F.substring_index(host, ".", -labels))


def _beginning(path: Column, length: int) -> Column:
    return F.when(F.length(path) >= length, F.substring(path, 1, length))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, start_rate: float | None = None, largest: int = LARGEST) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule (host and path of the longest rule that fits, or null)
    and verdict (that rule's, else ``default``).  rules: host, path, verdict (allow or block).

    Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule fits; rules with a null,
    an empty host or another verdict are left out, and hosts are lower-cased; of a rule listed under both verdicts
    ``block`` counts; among fitting rules of equal length the longer host wins; repeated rows stay; an empty table gives
    no rows; other columns are ignored."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path"), F.col("verdict"))
    rules = rules.where(F.col("verdict").isin(*VERDICTS) & (F.length("host") > 0) & F.col("path").isNotNull())
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = written(rules.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "host", "verdict"), "rules")
    shapes = [(r["labels"], r["length"]) for r in rules.select("labels", "length").distinct().orderBy("labels", "length").limit(SHAPES + 1).collect()]
    if len(shapes) > SHAPES:
        raise ValueError(f"the rules have more than {SHAPES} pairs of labels and path length; divide the list")

    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    # A zero byte parts host and path: nothing else keeps (a.b, c) and (a, .bc) apart.
    hosts = [_suffix(F.col("host"), a) for a, _ in shapes]
    begins = [_beginning(F.col("path"), b) for _, b in shapes]
    keys = [F.concat(h, F.lit("\0"), b) for h, b in zip(hosts, begins)]
    listed = {v: rules.where(F.col("verdict") == v).select(F.concat("host", F.lit("\0"), F.expr("substring(key, length(host) + 1)")).alias("key")) for v in VERDICTS}
    sizes = {v: n for v in VERDICTS if (n := listed[v].count())}
    universe = max(1, pages.count() * len(shapes))
    first = {v: bloom(listed[v], n, start_rate or min(RATE, n / universe), 1000 * i, largest) for i, (v, n) in enumerate(sizes.items())}
    levels = {v: [] for v in VERDICTS}
    if first:
        every = parts.select(F.explode(F.array_compact(F.array(*keys))).alias("key"))
        through = {v: level.may_hold(F.col("key")) for v, level in first.items()}
        some = every.select("key", *[t.alias(v) for v, t in through.items()]).where(" or ".join(first))
        passed = written(some.distinct(), "passed")
        levels |= {v: cascade(level, listed[v], passed.where(v), largest) for v, level in first.items()}
        discard(passed)

    fits = [
        F.when(is_listed(levels[v], k), F.struct(F.length(h) + F.length(b), F.length(h), F.lit(v).alias("verdict"), F.concat(h, b).alias("rule")))
        for k, h, b in zip(keys, hosts, begins) for v in sizes
    ]
    empty = F.lit(None).cast("struct<a:int,b:int,verdict:string,rule:string>")
    best = F.array_max(F.array(*fits)) if fits else empty
    out = parts.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
