"""From parsed pages to Markdown documents: layout, elements, titles, joins of texts and metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.layout import page_boxes, parse_layout
from ..functions.markdown import elements_markdown
from ..functions.models import PageModel
from ..functions.text import col, strip

# What the page model is asked, for layout and by label of an element.
LAYOUT_PROMPT = "Parse the reading order of this document."
PROMPTS = {"tab": "Parse the table in the image.", "equ": "Read formula in the image.", "code": "Read code in the image.", "text": "Read text in the image."}

ELEMENT = "struct<bbox:array<int>,label:string,reading_order:int,text:string,figure_path:string>"
DOCUMENT_SCHEMA = f"struct<source_file:string,total_pages:int,pages:array<struct<page_number:int,elements:array<{ELEMENT}>>>,metadata:map<string,string>>"


def layout_elements(pages: DataFrame, layout_col: str = "layout", dims_col: str = "dims") -> DataFrame:
    """Pages (with keys, a layout string and image sizes) to one row for each element: boxes, label, reading_order."""
    keys = [c for c in pages.columns if c not in (layout_col, dims_col)]
    placed = page_boxes(parse_layout(layout_col), dims_col)
    return pages.select(*keys, F.explode(placed).alias("e")).select(*keys, "e.*")


def page_model(pages: DataFrame, model: Callable[[], PageModel], image_col: str, prompt: Column, out: str, batch: int = 32) -> DataFrame:
    """Adds ``out``: the model's string for each image and prompt, in batches; an error gives null and its text in ``error``."""
    keep = pages.withColumn("_prompt", prompt)
    schema = StructType([*pages.schema.fields, StructField(out, StringType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for frame in frames:
            texts, errors = [], []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    got = call([bytes(x) for x in part[image_col]], part["_prompt"].tolist())
                    texts, errors = texts + list(got), errors + [None] * len(part)
                except Exception as error:  # a failed batch is reported in its rows
                    texts, errors = texts + [None] * len(part), errors + [f"{type(error).__name__}: {error}"] * len(part)
            yield frame.drop(columns="_prompt").assign(**{out: texts, "error": errors})

    return keep.mapInPandas(run, schema)


def element_prompt(label: Column | str) -> Column:
    prompts = F.create_map(*[F.lit(x) for item in PROMPTS.items() for x in item])
    return F.coalesce(F.try_element_at(prompts, col(label)), F.lit(PROMPTS["text"]))


def failures(rows: DataFrame, key: str, worker: str = "all") -> DataFrame:
    """(worker_id, doc_id, error) of the rows with an error."""
    return rows.where(F.col("error").isNotNull()).select(F.lit(worker).alias("worker_id"), F.col(key).alias("doc_id"), "error")


def figure_link(elements: DataFrame) -> DataFrame:
    """Text and path of figures that were saved as images; the page is in the name, so pages don't meet."""
    name = F.format_string("figures/figure_%03d_%03d.png", "page_number", "reading_order")
    is_figure = F.col("label") == "fig"
    return elements.withColumn("figure_path", F.when(is_figure, name)).withColumn("text", F.when(is_figure, F.concat(F.lit("![Figure]("), name, F.lit(")"))).otherwise(F.col("text")))


def documents(elements: DataFrame) -> DataFrame:
    """Element rows (source_file, page_number, bbox, label, reading_order, text, figure_path) to nested documents."""
    inner = F.struct("reading_order", F.struct("bbox", "label", "reading_order", "text", "figure_path").alias("e"))
    pages = elements.groupBy("source_file", "page_number").agg(F.transform(F.array_sort(F.collect_list(inner), lambda a, b: a["reading_order"] - b["reading_order"]), lambda x: x["e"]).alias("elements"))
    whole = pages.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("page_number", "elements")), lambda a, b: a["page_number"] - b["page_number"]).alias("pages"))
    return whole.select("source_file", F.size("pages").alias("total_pages"), "pages")


def all_elements(docs: DataFrame) -> DataFrame:
    """Nested documents back to element rows."""
    pages = docs.select("source_file", F.explode("pages").alias("p"))
    return pages.select("source_file", "p.page_number", F.explode("p.elements").alias("e")).select("source_file", "page_number", "e.*")


def markdown(docs: DataFrame, separator: str = "---") -> DataFrame:
    """(source_file, markdown): all pages' elements, a separator before every page but the first."""
    rule = F.struct(F.lit("page_separator").alias("label"), F.lit(separator).alias("text"))
    slim = lambda p: F.transform(p["elements"], lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))
    flat = F.flatten(F.transform("pages", lambda p, i: F.when(i > 0, F.concat(F.array(rule), slim(p))).otherwise(slim(p))))
    return docs.withColumn("_flat", flat).select("source_file", elements_markdown("_flat").alias("markdown"))


def title(metadata: Column | str) -> Column:
    """Of a parsed document: the first page's first title element's text, else the stem of the source file; never empty.

    A title element without text gives ``Unknown Title``.
    """
    m = col(metadata)
    first = F.filter(m["pages"], lambda p: p["page_number"].isNotNull())
    found = F.filter(F.get(first, F.lit(0))["elements"], lambda e: F.startswith(e["label"], F.lit("sec_0")) | (e["label"] == "title"))
    text = _nonempty(strip(F.get(found, F.lit(0))["text"]))
    stem = _nonempty(F.regexp_replace(F.substring_index(m["source_file"], "/", -1), r"(?<=.)\.[^.]*$", ""))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.coalesce(text, F.lit("Unknown Title"))).otherwise(F.coalesce(stem, F.lit("Unknown Title")))


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def papers(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Papers with both a text and metadata: paper_id, markdown, paper_title."""
    return texts.join(metadata, "paper_id").select("paper_id", "markdown", title("metadata").alias("paper_title"))
