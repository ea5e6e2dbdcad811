"""Reading: object listings, Markdown with metadata, saved works pages, chunk envelopes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import pdf_id
from ..operators.assembly import DOCUMENT_SCHEMA
from ..operators.works import WORK_SCHEMA

CHUNK = "struct<text:string,chunk_id:string,chunk_type:string,paper_id:string,paper_title:string,section_hierarchy:array<string>,char_start:int,char_end:int,chunk_index:int,total_chunks:int,overlap_with_previous:boolean>"
ENVELOPE = f"paper_id string, paper_title string, chunk_type string, total_chunks int, chunks array<{CHUNK}>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly where files give fewer tasks than there are cores; a large input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df._jdf.rdd().getNumPartitions() < cores else df


def objects(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files, without reading them; all pages of a listing, however many."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "modificationTime", "length")


def pdfs(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """PDF objects with ``doc_id``."""
    return objects(spark, folder, "*.pdf", recursive).withColumn("doc_id", pdf_id("path"))


def pdf_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of PDFs, for a page renderer."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def pdf_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, bytes) of the PDFs that the command ``download`` wrote under ``path``."""
    return spark.read.parquet(f"{path}/pdfs").where("status = 'ok'").select("id", "url", "bytes")


def folders(listing: DataFrame, prefix: str) -> DataFrame:
    """Distinct names of the folders right under a prefix."""
    tail = F.when(F.contains("path", F.lit(prefix)), F.substring_index("path", prefix, -1))
    return listing.select(tail.alias("_t")).where(F.contains("_t", F.lit("/"))).select(F.substring_index("_t", "/", 1).alias("folder")).distinct()


def find_object(listing: DataFrame, prefix: str) -> DataFrame:
    """The first object by path whose file name starts with ``prefix``."""
    return listing.where(F.startswith(F.substring_index("path", "/", -1), F.lit(prefix))).orderBy("path").limit(1)


def bytes_of(listing: DataFrame) -> DataFrame:
    """(path, content) of listed files, each read by its own task, so files that aren't listed are never opened.

    Paths are what the file system's library takes (local, HDFS, object stores); a file that can't be read has no content.
    """

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    store, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                    with store.open_input_stream(place) as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return listing.select("path").mapInArrow(read, "path string, content binary")


def markdown_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``*.md`` right in a folder: source_file, document_id (its stem), text."""
    read = spark.read.text(f"{folder}/*.md", wholetext=True)
    name = F.col("_metadata.file_name")
    return read.select(name.alias("source_file"), F.regexp_replace(name, r"\.md$", "").alias("document_id"), F.col("value").alias("text"))


def _paper(depth: int = -2):
    return F.element_at(F.split("_metadata.file_path", "/"), depth).alias("paper_id")


def paper_texts(spark: SparkSession, prefix: str) -> DataFrame:
    """(paper_id, markdown) from ``prefix/<paper_id>/document.md``; papers without one have no row."""
    return spark.read.text(f"{prefix}/*/document.md", wholetext=True).select(_paper(), F.col("value").alias("markdown"))


def paper_metadata(spark: SparkSession, prefix: str) -> DataFrame:
    """(paper_id, metadata) from ``prefix/<paper_id>/metadata.json``; broken JSON gives null fields."""
    raw = spark.read.text(f"{prefix}/*/metadata.json", wholetext=True).select(_paper(), "value")
    return raw.select("paper_id", F.from_json("value", DOCUMENT_SCHEMA).alias("metadata"))


def saved_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of saved result pages, one JSON page a line: ``work`` and ``rejected``."""
    pages = spark.read.text(path).select(F.from_json("value", "results array<string>").alias("p"))
    from ..operators.works import parse_works

    return parse_works(pages.select(F.explode("p.results").alias("json"))).drop("json")


def flat_works(spark: SparkSession, path: str) -> DataFrame:
    """The flat works that :func:`..sources.sinks.write_parquet` wrote."""
    return spark.read.parquet(path)


def works_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested works, one JSON record a line."""
    return spark.read.text(path).select(F.from_json("value", WORK_SCHEMA).alias("work"))


def chunks(spark: SparkSession, folder: str, chunk_type: str) -> DataFrame:
    """Chunks of a type from the envelopes that :func:`..sources.sinks.write_chunks` wrote."""
    read = spark.read.schema(ENVELOPE.replace("chunk_type string, ", "")).json(f"{folder}/chunk_type={chunk_type}")
    return read.select(F.explode("chunks").alias("c")).select("c.*")


def index(spark: SparkSession, folder: str, chunk_type: str) -> DataFrame:
    """The searchable table of a chunk type."""
    return spark.read.parquet(f"{folder}/chunk_type={chunk_type}").withColumn("chunk_type", F.lit(chunk_type))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A saved evaluation."""
    return spark.read.json(path, multiLine=True)
