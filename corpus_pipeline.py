"""From raw documents to packed sequences: toxicity, language, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  The first four return the columns of
``documents``; the last returns the packing.  Models are learned from the tables in sf_dir.

Defined cases: a document with a null or letterless text goes at the language stage, a text of no words is no near copy of
anything; of rows that repeat one stays (near copies); a null doc_id is a document like any other; stages see columns of
other names unchanged; without documents the packing is empty, provided the models have rows to learn from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontamination, language_id, ngram_join, packing, toxicity
from mapweave.llm.common import remainder, stored, table

# A document whose best cosine with any language is below this is of no known language.
LEAST_LANGUAGE = 0.05


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``judge`` keeps, with the columns of docs; judge sees ``text`` under its name and all others under
    names that cannot clash with what it adds."""
    names = ["text" if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)]
    found = judge(docs.toDF(*names))
    return found.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _judged(docs, lambda d: toxicity.score(d, model).where("predicted = 0"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no learned language go."""
    names, profiles = language_id.learn(table(spark, sf_dir, "documents").where(remainder("doc_id", 4) != 2))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)
    return _judged(docs, lambda d: language_id.predict(d, names, profiles).where(known))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, each with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near_copies", one_of_each),
    ("benchmark", no_benchmark),
    ("packing", packed),
]

# Trained models and token ids are beyond SQL; tests/llm runs small tables through all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
