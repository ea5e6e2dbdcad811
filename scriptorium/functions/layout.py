"""Page layout: parsing of layout strings, boxes, and coordinates in padded and original images."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, strip

#: Layout models see pages scaled into a square of this many pixels.
SPACE = 896.0
NUMBER = r"(\d*\.?\d+)"
COORDINATES = rf"\[{NUMBER},{NUMBER},{NUMBER},{NUMBER}\]"


def parse_layout(text: Column | str) -> Column:
    """``[x1,y1,x2,y2][label][PAIR_SEP]...`` to an array of structs: coords (doubles), label, reading_order.

    Segments end at ``[PAIR_SEP]`` and ``[RELATION_SEP]``; those without four numbers or a bracketed label are left out.
    """
    segments = F.transform(F.split(col(text), r"\[(?:PAIR|RELATION)_SEP\]"), strip)
    good = F.filter(segments, lambda s: s.rlike(COORDINATES) & s.rlike(r"\]\[[^\]]+\]"))

    def parsed(s: Column, i: Column) -> Column:
        numbers = F.array(*[F.regexp_extract(s, COORDINATES, g).cast("double") for g in range(1, 5)])
        return F.struct(numbers.alias("coords"), strip(F.regexp_extract(s, r"\]\[([^\]]+)\]", 1)).alias("label"), i.alias("reading_order"))

    return F.transform(good, parsed)


def to_original(box: dict[str, Column], dims: Column) -> dict[str, Column]:
    """A box of the padded image in the original one: shifted, clamped, one pixel at least. ``dims``: original and padded width and height."""
    left = F.floor((dims["padded_width"] - dims["original_width"]) / 2)
    top = F.floor((dims["padded_height"] - dims["original_height"]) / 2)
    x1, y1 = F.greatest(F.lit(0), box["x1"] - left), F.greatest(F.lit(0), box["y1"] - top)
    x2, y2 = F.least(dims["original_width"], box["x2"] - left), F.least(dims["original_height"], box["y2"] - top)
    x2 = F.when(x2 <= x1, F.least(x1 + 1, dims["original_width"])).otherwise(x2)
    y2 = F.when(y2 <= y1, F.least(y1 + 1, dims["original_height"])).otherwise(y2)
    return {k: v.cast("int") for k, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)}


def _pixels(coords: Column, dims: Column) -> dict[str, Column]:
    width, height = dims["padded_width"], dims["padded_height"]
    scale = lambda i, size: F.rint(coords[i] / SPACE * size).cast("int")
    x1 = F.greatest(F.lit(0), F.least(scale(0, width), width - 1))
    y1 = F.greatest(F.lit(0), F.least(scale(1, height), height - 1))
    x2 = F.greatest(F.lit(0), F.least(scale(2, width) + 1, width))
    y2 = F.greatest(F.lit(0), F.least(scale(3, height) + 1, height))
    return {"x1": x1, "y1": y1, "x2": F.when(x2 <= x1, F.least(x1 + 1, width)).otherwise(x2), "y2": F.when(y2 <= y1, F.least(y1 + 1, height)).otherwise(y2)}


def page_boxes(elements: Column | str, dims: Column | str) -> Column:
    """Parsed layout elements of a page to pixel boxes, in order: array of padded and original box, label, reading_order.

    A box that overlaps the one before it is pushed below it, so boxes depend on those before.
    """
    elements, dims = col(elements), col(dims)
    box_type = "struct<x1:int,y1:int,x2:int,y2:int>"
    none = F.lit(None).cast(box_type)
    start = F.struct(F.array().cast(f"array<struct<box:{box_type},original:{box_type},label:string,reading_order:int>>").alias("out"), none.alias("last"))

    def step(acc: Column, e: Column) -> Column:
        b, p, height = _pixels(e["coords"], dims), acc["last"], dims["padded_height"]
        over = p.isNotNull() & (b["x1"] < p["x2"]) & (b["x2"] > p["x1"]) & (b["y1"] < p["y2"]) & (b["y2"] > p["y1"])
        y1 = F.when(over, F.least(p["y2"], height - 1)).otherwise(b["y1"])
        y2 = F.when(over & (b["y2"] <= y1), F.least(y1 + 1, height)).otherwise(b["y2"])
        moved = b | {"y1": y1, "y2": y2}
        as_box = lambda d: F.struct(*[v.cast("int").alias(k) for k, v in d.items()])
        box = as_box(moved)
        row = F.struct(box.alias("box"), as_box(to_original(moved, dims)).alias("original"), e["label"].alias("label"), e["reading_order"].alias("reading_order"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), box.alias("last"))

    return F.aggregate(elements, start, step, lambda acc: acc["out"])


def box_size(box: Column | str) -> Column:
    """Struct of width, height and area; negative where a box is turned inside out."""
    box = col(box)
    width, height = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return F.struct(width.alias("width"), height.alias("height"), (width * height).alias("area"))
