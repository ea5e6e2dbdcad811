"""Inputs for structural operators, derived from the driver's tables: a Spark form and its DuckDB form side by side.

The driver's documents have no blank lines, headings, citations or tables, so queries derive them by these rules; no text is cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import spread, table

MARKDOWN = r"""array_join(transform(split(text, '\n'), (l, i) -> concat(
    CASE WHEN i % 5 = 1 THEN concat(repeat('#', CAST(1 + (i DIV 5) % 3 AS INT)), ' ', substr(l, 1, 40), CASE WHEN length(l) > 40 THEN concat('\n', substr(l, 41)) ELSE '' END) ELSE l END,
    CASE WHEN i % 7 = 6 THEN '\n---\n' ELSE '' END)), '\n\n')"""
MARKDOWN_SQL = """array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE WHEN (i-1) % 5 = 1 THEN repeat('#', CAST(1 + ((i-1)//5) % 3 AS INT)) || ' ' || substr(l, 1, 40) || CASE WHEN length(l) > 40 THEN chr(10) || substr(l, 41) ELSE '' END ELSE l END
    || CASE WHEN (i-1) % 7 = 6 THEN chr(10) || '---' || chr(10) ELSE '' END), chr(10) || chr(10))"""
PARAGRAPHS = r"replace(text, '\n', '\n\n')"
PARAGRAPHS_SQL = "replace(text, chr(10), chr(10) || chr(10))"
CITED = "replace(replace(replace(text, ' the ', ' [1] '), ' de ', ' (2) '), ' and ', ' $^{3}$ ')"
CITED_SQL = CITED

#: Chunk sizes at which short documents give several chunks.
SIZES = {"coarse_max": 600, "fine_max": 150}

# A nested work for each order, as JSON fields, with nulls, repeated addresses and addresses that aren't http.
WORK = """named_struct(
 'id', concat('https://works.example.org/W', o_orderkey), 'doi', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('https://doi.org/10.1/', o_orderkey) END,
 'title', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Title ', o_orderkey) END, 'display_name', concat('Name ', o_orderkey),
 'publication_year', year(o_orderdate), 'publication_date', date_format(o_orderdate, 'yyyy-MM-dd'), 'type', o_orderpriority,
 'open_access', named_struct('is_oa', o_orderkey % 2 = 0, 'oa_status', CASE o_orderstatus WHEN 'F' THEN 'gold' WHEN 'O' THEN 'green' ELSE 'closed' END),
 'best_oa_location', CASE WHEN o_orderkey % 4 = 1 THEN named_struct('is_oa', true, 'pdf_url', concat('http://a.example.org/', o_orderkey, '.pdf'), 'source', named_struct('display_name', concat('S', o_custkey % 7), 'type', 'journal')) END,
 'primary_location', CASE WHEN o_orderkey % 4 >= 2 THEN named_struct('is_oa', false, 'pdf_url', CASE WHEN o_orderkey % 8 = 2 THEN 'ftp://b.example.org/x.pdf' ELSE concat('https://b.example.org/', o_orderkey) END, 'source', named_struct('display_name', concat('P', o_custkey % 5), 'type', 'repository')) END,
 'locations', transform(sequence(0, CAST(o_orderkey % 4 AS INT)), i -> named_struct('is_oa', i % 2 = 1, 'pdf_url', CASE WHEN i = 0 THEN NULL ELSE concat('https://c.example.org/', o_orderkey, '/', i % 2) END)),
 'authorships', transform(sequence(0, CAST(o_orderkey % 3 AS INT)), i -> named_struct('author', named_struct('display_name', CASE WHEN i = 1 THEN '' ELSE concat('Author ', o_custkey, ' ', i) END))),
 'concepts', transform(sequence(0, CAST(o_orderkey % 5 AS INT)), i -> named_struct('display_name', concat('C', i), 'score', CAST(1.0 / (i + 1) AS DOUBLE))),
 'keywords', transform(sequence(1, CAST(1 + o_orderkey % 2 AS INT)), i -> named_struct('display_name', concat('k', i))),
 'cited_by_count', CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS INT) END)"""


class LetterCounts:
    """An embedder that SQL can state: a text's numbers of a, e and n, and 1."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count("a"), t.count("e"), t.count("n"), 1] for t in texts], float).reshape(-1, 4)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).selectExpr("CAST(doc_id AS STRING) AS paper_id", "concat('Paper ', doc_id) AS paper_title", f"{MARKDOWN} AS markdown", "source")


def documents(spark: SparkSession, folder: str, expression: str = "text") -> DataFrame:
    return spread(table(spark, folder, "documents")).selectExpr("doc_id", f"{expression} AS text", "source", "lang")


def works(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.works import parse_works

    records = spread(table(spark, folder, "orders")).selectExpr(f"to_json({WORK}) AS json")
    return parse_works(records).where("NOT rejected").select("work")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a query."""
    return table(spark, folder, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
