"""Words that differ from another word by one letter, and the far more frequent form each of them stands for.

1. Words are counted with a partial aggregation before the one shuffle.
2. Near words are looked for in a trie kept as a table by depth: a row per node with the next two letters of the words
   that pass it, each pair as a number.  A state (word, position, node, edits) stands for a word read up to a position while the trie was followed to a
   node.  The trie is gone through level by level: all states of a depth meet its nodes in one equi-join, and each moves on
   by the letter it has, or uses the one edit to replace, insert or delete one; two letters are looked at, so most states that
   lead nowhere are never made.  A state that has used its edit and ends where a word ends is a pair.
3. The edit lies in the first or in the second half of a word.  Words are read forwards and, in a second trie, backwards,
   each from its middle on, so the crowded nodes near the root are never met: with the first half equal, few letters go on.
4. Words longer than ``LONG`` would need as many rounds; they are few and meet by their forms with one letter left out,
   which is exact as well.
5. Forms are followed to their roots by doubling; each step multiplies the count by ten, so chains are short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7
LEAST_OCCURRENCES = 2
TIMES = 10  # as frequent as the word its form is, at least
ONE_IN = 31  # runs of letters loses one
LONG = 40
FOUND = 2  # "edits" of a finished pair


def counted_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_OCCURRENCES) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, of which one in 31 has lost a letter."""
    # Shorter runs give no word, and a run is still matched as a whole.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([A-Za-zÀ-ÿ]{{{least_letters},}})"), F.lit(1))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    each = each.select(F.when(F.col("h") % ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))
    return each.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letter(at: Column) -> Column:
    """The word's letter at a place from 0; empty beyond its end."""
    return F.substring(F.col("word"), at + 1, F.lit(1))


def _pair(at: Column) -> Column:
    """The letters at a place and after it as a number; those beyond the end count 0.  All letters are below U+0100."""
    return F.ascii(_letter(at)) * 256 + F.ascii(_letter(at + 1))


def _sides(words: DataFrame) -> DataFrame:
    """Each word as it is and backwards, with its length and the place where reading begins."""
    n = F.length("word")
    ahead = words.select("word", F.lit("<").alias("side"), n.alias("length"), F.floor(n / 2).cast("int").alias("start"))
    back = words.select(F.reverse("word").alias("word"), F.lit(">").alias("side"), n.alias("length"), F.ceil(n / 2).cast("int").alias("start"))
    return ahead.unionByName(back)


def trie(sides: DataFrame) -> DataFrame:
    """node, next (pairs of letters that follow in some word, 0 where a word ends) and depth, kept by depth: the beginnings
    that some word's state can stand on."""
    # A word is met by words of its length or one letter less or more.
    place = F.explode(F.sequence(F.expr("if(side = '<', (length - 1) div 2, length div 2)"), F.col("length"))).alias("depth")
    steps = sides.select("word", "side", place).select("depth", F.concat("side", F.substring(F.col("word"), F.lit(1), F.col("depth"))).alias("node"), _pair(F.col("depth")).alias("next"))
    return written(steps.groupBy("depth", "node").agg(F.collect_set("next").alias("next")), "trie", "depth")


def _moves() -> Column:
    """What a state leads to, given its node: array of (position, node, edits)."""
    position, node, last = F.col("position"), F.col("node"), F.length("word")

    def to(at: Column, onto: Column) -> Column:
        return F.struct(at.cast("int").alias("position"), onto.alias("node"), F.when(at >= last, FOUND).otherwise(1).alias("edits"))

    def follow(at: Column) -> Column:
        """The word's letters from a place on, where the trie has them."""
        return F.when((at <= last) & F.array_contains("next", _pair(at)), to(at + 1, F.concat(node, _letter(at))))

    def others(w: Column) -> Column:
        """Another letter than the word's, inserted before it or in its stead, and then the word from there on."""
        first, second = lambda s: F.shiftright(s, 8), lambda s: s.bitwiseAND(255)
        inserted = lambda s: second(s) == w["here"]
        replaced = lambda s: w["inside"] & (second(s) == w["after"])
        fits = F.filter("next", lambda s: (s > 0) & (first(s) != w["here"]) & (inserted(s) | replaced(s)))
        onto = lambda s: F.concat(node, F.char(first(s)))
        return F.flatten(F.transform(fits, lambda s: F.array_compact(F.array(F.when(inserted(s), to(position, onto(s))), F.when(replaced(s), to(position + 1, onto(s)))))))

    # A one-element array works the word's letters out once per state, not once per pair.
    word = F.array(F.struct(F.ascii(_letter(position)).alias("here"), F.ascii(_letter(position + 1)).alias("after"), (position < last).alias("inside")))
    deleted = F.array_compact(F.array(F.when(position < last, follow(position + 1))))
    return F.when(F.col("edits") == 0, F.concat(F.flatten(F.transform(word, others)), deleted)).otherwise(F.array_compact(F.array(follow(position))))


def near_in_trie(words: DataFrame) -> DataFrame:
    """word, near: ordered pairs of the words that differ by one letter; a pair may come twice."""
    sides = written(_sides(words), "sides")
    nodes = trie(sides)
    first, last = sides.agg(F.min("start"), F.max("length")).first()
    if first is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    rounds: list[DataFrame] = []
    for depth in range(first, last + 1):
        here = F.concat("side", F.expr(f"substring(word, 1, {depth})"))
        states = sides.where(F.lit(depth).between(F.col("start"), F.col("length"))).select("word", F.lit(depth).alias("position"), here.alias("node"), F.lit(0).alias("edits"))
        if rounds:
            states = states.unionByName(rounds[-1].where(F.col("edits") < FOUND))
        met = states.join(nodes.where(F.col("depth") == depth).select("node", "next"), "node")
        rounds.append(written(met.select("word", F.explode(_moves()).alias("to")).select("word", "to.*"), "states"))
    found = reduce(DataFrame.unionByName, rounds).where(F.col("edits") == FOUND)
    ahead = F.substring("node", 1, 1) == "<"
    other = F.expr("substring(node, 2)")
    pairs = written(found.select(*[F.when(ahead, c).otherwise(F.reverse(c)).alias(a) for c, a in ((F.col("word"), "word"), (other, "near"))]), "pairs")
    for used in (sides, nodes, *rounds):
        discard(used)
    return pairs


def near_by_gap(words: DataFrame) -> DataFrame:
    """The same pairs by the words' forms with one letter left out: words that share a form and its gap differ by a
    replaced letter, a form that is a word itself differs by an inserted one.  A form and gap is shared by as many words as
    there are letters at most."""
    gap = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("gap"))
    gap = gap.select("word", "gap", F.concat(F.expr("substring(word, 1, gap)"), F.expr("substring(word, gap + 2)")).alias("rest"))
    one = gap.select("gap", "rest", F.col("word").alias("near"))
    replaced = gap.join(one, ["gap", "rest"]).where("word <> near").select("word", "near")
    shorter = words.select(F.col("word").alias("near")).join(gap.select("word", F.col("rest").alias("near")).distinct(), "near").select("word", "near")
    return replaced.unionByName(shorter).unionByName(shorter.select(F.col("near").alias("word"), F.col("word").alias("near")))


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """word, near: all ordered pairs of words that differ by exactly one inserted, deleted or replaced letter, each once."""
    pairs = near_in_trie(words.where(F.length("word") <= long))
    if not (rest := words.where(F.length("word") > long)).isEmpty():
        # A long word's near words may be one letter shorter.
        pairs = pairs.unionByName(near_by_gap(words.where(F.length("word") >= long)))
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for a table (word, form) without circles: forms are followed to the last."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """Per row of words (word, n; each word once): word, n, n_near, form, form_n, root.  The form is the near word of largest
    n (ties: the smallest) if that n is at least ``times`` the word's; root follows forms to the last."""
    pairs = near_pairs(words, long)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    often = F.col("n_near").isNotNull() & (-F.col("best.minus") >= times * F.col("n"))
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.minus")).cast("long").alias("form_n")
    )
    formed = written(formed, "forms")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text).

    Defined cases: null and empty texts have no words; a null id counts as an empty text in the hash; rows that repeat
    count each time; an empty table gives no rows; other columns are ignored; texts and words may be of any length."""
    words = written(counted_words(docs), "words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
