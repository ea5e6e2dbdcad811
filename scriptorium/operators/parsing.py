"""Documents from PDF files: page images, layout, crops, recognition, nested documents with Markdown.

Each step takes and gives rows, so pages and elements of all documents go through the models in batches, spread over the
cluster whatever documents they come from. Renderer and model are functions that a worker makes once; what fails is a row with
``error_class`` and ``error``, and the other pages and elements of its document go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import ImageExtractionError, ModelLoadError, ValidationError
from ..functions.images import cropped, padded, to_png
from ..functions.layout import page_boxes, parse_layout
from ..functions.models import PageModel
from ..functions.text import strip
from ..scratch import stored
from . import assembly

#: PDF bytes and the longest side in pixels to (height, width, 3) samples of each page.
Renderer = Callable[[bytes, int], Iterator[np.ndarray]]
LONGEST = 896
_FAILED = "error_class string, error string"


def installed_renderer() -> Renderer:
    """A renderer by whichever PDF library is installed; ModelLoadError without any."""
    try:
        import pypdfium2
    except ImportError as error:
        raise ModelLoadError("no PDF library is installed (pypdfium2); pass a renderer") from error

    def render(data: bytes, longest: int) -> Iterator[np.ndarray]:
        for page in pypdfium2.PdfDocument(data):
            yield np.asarray(page.render(scale=longest / max(page.get_size())).to_pil().convert("RGB"))

    return render


def page_images(pdfs: DataFrame, renderer: Callable[[], Renderer] = installed_renderer, longest: int = LONGEST) -> DataFrame:
    """(path, content) rows to pages: source_file, page_number (from 1), width, height, image (RGB samples).

    A file that isn't named ``.pdf``, can't be rendered or has no pages gives one row with an error and no image. A task has one
    document's page at a time.
    """
    schema = f"source_file string, page_number int, width int, height int, image binary, {_FAILED}"

    def pages_of(render: Renderer, path: str, content: bytes | None) -> Iterator[tuple]:
        number = 0
        try:
            if not path.lower().endswith(".pdf"):
                raise ImageExtractionError(f"not a PDF file: {path}")
            for number, page in enumerate(render(bytes(content or b""), longest), start=1):
                height, width = page.shape[:2]
                yield path, number, width, height, np.ascontiguousarray(page, np.uint8).tobytes(), None, None
            if not number:
                raise ImageExtractionError("no pages")
        except Exception as error:  # the document's row says so; the others go on
            yield path, number + 1, None, None, None, ImageExtractionError.__name__, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = renderer()
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for row in pages_of(render, path, content):
                    yield pd.DataFrame([row], columns=names).astype({c: "Int32" for c in ("page_number", "width", "height")})

    return pdfs.select("path", "content").mapInPandas(run, schema)


def _samples(image: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(image, np.uint8).reshape(int(height), int(width), 3)


def _png(pages: DataFrame) -> DataFrame:
    """Adds ``png`` to rows with an image."""

    @F.pandas_udf("binary")
    def encode(image: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([to_png(_samples(*x)) if x[0] is not None else None for x in zip(image, width, height, strict=True)], dtype=object)

    return pages.withColumn("png", encode("image", "width", "height"))


def with_layout(pages: DataFrame, model: Callable[[], PageModel], batch: int = 16) -> DataFrame:
    """Pages with ``dims`` (own and padded size) and ``elements``: boxes, label and reading order of what is on them."""
    asked = _png(pages.where("image IS NOT NULL").drop("error_class", "error"))
    read = assembly.page_model(asked, model, "png", F.lit(assembly.LAYOUT_PROMPT), "layout", batch).drop("png")
    side = F.greatest("width", "height")
    dims = F.struct(F.col("width").alias("original_width"), F.col("height").alias("original_height"), side.alias("padded_width"), side.alias("padded_height"))
    read = read.withColumn("error_class", F.when(F.col("error").isNotNull(), F.lit("LayoutError"))).withColumn("dims", dims)
    return read.withColumn("elements", page_boxes(parse_layout(F.coalesce("layout", F.lit(""))), "dims")).drop("layout")


def element_crops(pages: DataFrame) -> DataFrame:
    """A row for each element of pages with layout: bbox in the page, label, reading_order, and ``crop`` (PNG) of the padded page.

    An element whose box is too small has an error and no crop.
    """
    schema = f"source_file string, page_number int, bbox array<int>, label string, reading_order int, crop binary, {_FAILED}"
    names = ["source_file", "page_number", "bbox", "label", "reading_order", "crop", "error_class", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for page in frame.itertuples(index=False):
                whole, _ = padded(_samples(page.image, page.width, page.height))
                rows = []
                for e in page.elements:
                    box, own = e["box"], e["original"]
                    place = [page.source_file, page.page_number, [own[k] for k in ("x1", "y1", "x2", "y2")], e["label"], e["reading_order"]]
                    try:
                        rows.append((*place, to_png(cropped(whole, box["x1"], box["y1"], box["x2"], box["y2"])), None, None))
                    except ValueError as error:
                        rows.append((*place, None, "RecognitionError", str(error)))
                yield pd.DataFrame(rows, columns=names)

    return pages.where("size(elements) > 0").select("source_file", "page_number", "width", "height", "image", "elements").mapInPandas(run, schema)


def recognised(crops: DataFrame, model: Callable[[], PageModel], batch: int = 32) -> DataFrame:
    """Elements with ``text`` by the model, asked by label; figures have a link to their image instead, which is in ``crop``."""
    good = crops.where("crop IS NOT NULL").drop("error_class", "error")
    read = assembly.page_model(good.where("label <> 'fig'"), model, "crop", assembly.element_prompt("label"), "text", batch)
    read = read.withColumn("error_class", F.when(F.col("error").isNotNull(), F.lit("RecognitionError"))).withColumn("text", strip("text"))
    read = read.withColumn("figure_path", F.lit(None).cast("string")).withColumn("crop", F.lit(None).cast("binary"))
    figures = assembly.figure_link(good.where("label = 'fig'").withColumn("text", F.lit(None).cast("string")))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("error", "error_class")]
    figures = figures.select(*[c for c in figures.columns], *nothing)
    failed = crops.where("crop IS NULL").withColumns({"text": F.lit(None).cast("string"), "figure_path": F.lit(None).cast("string")})
    return read.unionByName(figures.select(*read.columns)).unionByName(failed.select(*read.columns))


@dataclass(frozen=True)
class Parsed:
    """Stored results: nested documents, figures (path and PNG), and failures by document, page and element."""

    documents: DataFrame
    figures: DataFrame
    failures: DataFrame


def parse_documents(pdfs: DataFrame, renderer: Callable[[], Renderer], model: Callable[[], PageModel], longest: int = LONGEST, batch: int = 32) -> Parsed:
    """PDF rows (path, content) to documents (source_file, total_pages, pages with elements in reading order, metadata).

    Pages and elements are written to the scratch folder between the steps, so no model is asked twice and a lost
    executor costs its own rows. Pages without elements stay, as pages without any; failed elements are left out of the documents and
    told in ``failures``, as are files and pages.
    """
    images = stored(page_images(pdfs, renderer, longest), "page-images")
    pages = stored(with_layout(images, model, batch), "page-layouts")
    elements = stored(recognised(element_crops(pages), model, batch), "elements")
    read = elements.where("error IS NULL").select("source_file", "page_number", "bbox", "label", "reading_order", "text", "figure_path")
    failures = [
        images.where("error IS NOT NULL").select("source_file", "page_number", F.lit(None).cast("int").alias("reading_order"), "error_class", "error"),
        pages.where("error IS NOT NULL").select("source_file", "page_number", F.lit(None).cast("int").alias("reading_order"), "error_class", "error"),
        elements.where("error IS NOT NULL").select("source_file", "page_number", "reading_order", "error_class", "error"),
    ]
    found = assembly.documents(read).select("source_file", F.col("pages").alias("with_elements"))
    numbers = pages.groupBy("source_file").agg(F.array_sort(F.collect_list("page_number")).alias("numbers"))
    joined = numbers.join(found, "source_file", "left")
    empty = F.array().cast(found.schema["with_elements"].dataType.elementType["elements"].dataType)
    of = lambda n: F.get(F.filter("with_elements", lambda p: p["page_number"] == n), F.lit(0))["elements"]
    whole = F.transform("numbers", lambda n: F.struct(n.alias("page_number"), F.coalesce(of(n), empty).alias("elements")))
    documents = joined.select("source_file", F.size("numbers").alias("total_pages"), whole.alias("pages"))
    figures = elements.where("figure_path IS NOT NULL").select("source_file", "figure_path", "crop")
    return Parsed(documents, figures, failures[0].unionByName(failures[1]).unionByName(failures[2]))


@dataclass(frozen=True)
class Stage:
    """A step of a pipeline that a user can replace: columns that it needs, and a transform. Stages are joined by :func:`run_stages`."""

    name: str
    transform: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = field(default=())

    def process(self, df: DataFrame) -> DataFrame:
        """The transform; ValidationError where a column is missing."""
        if missing := [c for c in self.needs if c not in df.columns]:
            raise ValidationError(f"{self.name} needs {', '.join(missing)}")
        return self.transform(df)

    def process_batch(self, frames: list[DataFrame]) -> list[DataFrame]:
        return [self.process(df) for df in frames]


def parsing_stages(renderer: Callable[[], Renderer], model: Callable[[], PageModel], longest: int = LONGEST, batch: int = 32) -> list[Stage]:
    """The parser's steps, to be run with :func:`run_stages` whole or with some replaced."""
    return [
        Stage("images", lambda df: page_images(df, renderer, longest), ("path", "content")),
        Stage("layout", lambda df: with_layout(df, model, batch), ("source_file", "page_number", "width", "height", "image")),
        Stage("crops", element_crops, ("source_file", "page_number", "image", "elements")),
        Stage("recognition", lambda df: recognised(df, model, batch), ("label", "crop")),
        Stage("documents", assembly.documents, ("source_file", "page_number", "bbox", "label", "reading_order", "text", "figure_path")),
    ]


def run_stages(df: DataFrame, stages: list[Stage], keep: bool = False, log: Callable[[str], None] = lambda _: None) -> DataFrame:
    """One stage after another; with ``keep`` each result is written to the scratch folder before the next. ``log`` is told each stage's name."""
    for stage in stages:
        log(stage.name)
        df = stored(stage.process(df), stage.name) if keep else stage.process(df)
    return df
