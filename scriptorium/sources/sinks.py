"""Writing: Parquet and JSON tables, chunk envelopes, the index, documents, failures and reports.

Every sink is a Spark write to a path that the cluster's file system resolves; none goes through the driver but the
HTML report, whose rows are those of a few strategies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..functions.names import is_pdf


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_json(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """One JSON object a row; with ``partition``, a folder for each of its values."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).json(path)


def envelopes(chunks: DataFrame) -> DataFrame:
    """(paper_id, paper_title, chunk_type, total_chunks, chunks) with chunks in order. A paper's chunks must fit into a task."""
    fields = [c for c in chunks.columns if c != "parent_chunk_id"]
    grouped = chunks.groupBy("paper_id", "paper_title", "chunk_type").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.struct(*fields).alias("c"))), lambda a, b: a["chunk_index"] - b["chunk_index"]).alias("_c"))
    return grouped.select("paper_id", "paper_title", "chunk_type", F.size("_c").alias("total_chunks"), F.transform("_c", lambda x: x["c"]).alias("chunks"))


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Envelopes by chunk type, the one layout that :func:`..sources.files.chunks` reads."""
    write_json(envelopes(chunks), path, "chunk_type", mode)


def write_index(embedded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The searchable table by chunk type; a vector and its chunk are one row, so positions never come apart."""
    embedded.write.mode(mode).partitionBy("chunk_type").parquet(path)


def write_works(works: DataFrame, path: str, mode: str = "overwrite", buckets: int = 64) -> None:
    """(key, work as JSON) rows in ``buckets`` folders by the key's hash; :func:`export_works` makes a folder for each work."""
    out = works.select(F.substring_index("work.id", "/", -1).alias("key"), F.to_json("work").alias("json"))
    _bucketed(out, "key", path, mode, buckets)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite", buckets: int = 64) -> None:
    """(paper_id, markdown) rows in ``buckets`` folders by the id's hash; :func:`export_documents` makes a folder for each paper."""
    _bucketed(docs.select("paper_id", "markdown"), "paper_id", path, mode, buckets)


def _bucketed(df: DataFrame, key: str, path: str, mode: str, buckets: int) -> None:
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket")
    dealt.write.mode(mode).partitionBy("bucket").parquet(path)


def export_works(works: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``path/key=<key>`` with a work's JSON: a folder and a file for each, so for thousands of works, not for a whole corpus."""
    works.select(F.substring_index("work.id", "/", -1).alias("key"), F.to_json("work").alias("value")).write.mode(mode).partitionBy("key").text(path)


def export_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``path/paper_id=<id>`` with a paper's Markdown: for thousands of papers, as :func:`export_works`."""
    docs.select("paper_id", F.col("markdown").alias("value")).write.mode(mode).partitionBy("paper_id").option("lineSep", "\n").text(path)


def write_figures(figures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(source_file, figure_path, crop) rows: PNG files as values of a Parquet table, by document's hash."""
    _bucketed(figures, "source_file", path, mode, 64)


def write_failures(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Failures by worker."""
    write_json(rows, path, "worker_id", mode)


def sample_papers(papers: DataFrame, n: int) -> DataFrame:
    """The first ``n`` papers by id."""
    return papers.orderBy("paper_id").limit(n)


def fetched(urls: DataFrame, fetch, url_col: str = "url") -> DataFrame:
    """Adds status, bytes and error for each address by ``fetch(url) -> (content type, bytes)``, in parallel and without waiting.

    The status is ``ok`` for a PDF that isn't empty (by content type or address), ``no_url`` without an address, else ``failed``.
    """
    import pandas as pd

    schema = StructType([*urls.schema.fields, StructField("status", StringType()), StructField("bytes", BinaryType()), StructField("error", StringType())])

    def one(url: str | None) -> tuple[str, bytes | None, str | None]:
        if not url:
            return "no_url", None, None
        try:
            kind, data = fetch(url)
        except Exception as error:
            return "failed", None, f"{type(error).__name__}: {error}"
        return ("ok", data, kind) if data else ("failed", None, "empty")

    def run(frames):
        for frame in frames:
            got = pd.DataFrame([one(u) for u in frame[url_col]], columns=["status", "bytes", "error"], index=frame.index)
            yield pd.concat([frame, got], axis=1)

    got = urls.mapInPandas(run, schema)
    wrong = (F.col("status") == "ok") & ~is_pdf("error", url_col)
    return got.withColumns({
        "status": F.when(wrong, "failed").otherwise(F.col("status")), "bytes": F.when(~wrong, F.col("bytes")),
        "error": F.when(wrong, F.concat(F.lit("content type "), F.coalesce("error", F.lit("unknown")))).when(F.col("status") != "ok", F.col("error")),
    })


def url_outcomes(works: DataFrame, url: Column, existing: DataFrame, fetch) -> DataFrame:
    """(id, status) of works: ``skipped`` where the id exists, else as :func:`fetched`."""
    rows = works.select(F.col("work.id").alias("id"), url.alias("url"))
    known = existing.select("id").distinct()
    skipped = rows.join(known, "id", "left_semi").select("id", F.lit("skipped").alias("status"))
    return skipped.unionByName(fetched(rows.join(known, "id", "left_anti"), fetch).select("id", "status"))


def write_html(spark, page: str, path: str) -> None:
    """A page as one text file on the cluster's file system."""
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
