"""A training-data pipeline over the table ``documents``; counted as part of the subpackage ``llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All stages but
the last return the columns of ``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontaminate, langid, mixing, neardup, token_output
from scriptorium.llm.common import discard, stored
from scriptorium.llm.queries import table, vocabulary


#: The session's setting of where the token files go.
TOKENS_DIR = "spark.scriptorium.tokens.dir"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one language has half of the words at least."""
    return langid.identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicated(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of ``benchmark``."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by Poisson counts towards weights that grow with the root of a source's bytes."""
    return mixing.mixed(docs, power=0.5, seed=7).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids and returns what the files hold of each document; a repeated document has a row for each copy.

    The files are a new folder under the session's TOKENS_DIR setting, or in the scratch folder where it is unset.
    """
    folder = spark.conf.get(TOKENS_DIR, None)
    return token_output.token_output(docs, vocabulary(), path=f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}" if folder else None)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token ids", write_tokens),
]

#: SQL can't express the language model and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder before the next, and deleted after it.

    The last stage has written its files when it returns, so it reads nothing of the stage before any more.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(written)
        written = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    if written is not None:
        discard(written)
    return out
