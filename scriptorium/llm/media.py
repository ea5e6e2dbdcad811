"""Media columns: pages as interleaved sequences of text and media references, with payloads joined by digest.

An HTML page becomes an ordered array of structs: pieces of text, and references to media with their
caption. A reference names its payload by digest (``sha256:<hex>`` in the source attribute). Payloads
sit in a media store, once or more often for each digest; what is known of a payload is joined to
all references by digest and put back at the references' positions, so order, positions and captions stay
aligned, and a digest that the store lacks leaves a reference without payload.

The store holds 8-bit grey images in PGM form (``P5``, 24 samples wide), which keep bytes losslessly: any bytes, padded
with 255 to a positive multiple of 576, are the samples of one or more 24 x 24 tiles.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy

WIDTH, TILE, PAD = 24, 576, b"\xff"
PIECES = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"
#: Elements whose content is no text of the page, elements that end a piece of text, and elements that refer to media.
HIDDEN = {"script", "style", "noscript", "template", "title", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
MEDIA = {"img", "video", "audio", "source", "embed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class PageParser(HTMLParser):
    """Collects the pieces of one page. A figure's caption goes to its media; else the ``alt`` text serves."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[dict] = []
        self.buffer: list[str] = []
        self.hidden: list[str] = []
        self.figures: list[int] = []
        self.caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if not text:
            return
        if self.caption and self.figures and len(self.pieces) > self.figures[-1]:
            for piece in self.pieces[self.figures[-1] :]:
                if piece["kind"] == "media":
                    piece["caption"] = text
            return
        self.pieces.append({"position": len(self.pieces), "kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden or tag in HIDDEN:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.pieces))
        self.caption = self.caption or tag == "figcaption"
        if tag in MEDIA and (src := dict(attrs).get("src")):
            digest = src[7:].lower() if re.fullmatch(r"sha256:[0-9a-fA-F]{64}", src) else None
            alt = " ".join((dict(attrs).get("alt") or "").split()) or None
            self.pieces.append({"position": len(self.pieces), "kind": "media", "text": None, "src": src, "digest": digest, "caption": alt})

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.buffer.append(data)


def page_pieces(html: str | None) -> list[dict]:
    """The pieces of a page, in order; none for null or empty."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.pieces


def sequences(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` and ``pieces``, the page's interleaved sequence. Null and broken HTML give what can be read."""
    keep = list(keep)
    kind = pa.list_(pa.struct([("position", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "src", "digest", "caption")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([page_pieces(h.as_py()) for h in batch.column(batch.num_columns - 1)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, "pieces"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (pages.schema[c] for c in keep)), f"pieces {PIECES}"])
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(tidy(run), schema)


def resolved(pages: DataFrame, keep: list[str], media: DataFrame) -> DataFrame:
    """``pages`` with ``pieces`` in which every media reference has its payload's ``media`` struct, or null.

    ``media`` has a ``digest`` and other columns; of several rows with one digest (which describe equal payloads) the
    least serves. References are joined by digest and gathered by page row; pages without references keep
    their sequences. Repeated pages and ids stay separate rows; the columns of ``keep`` may have any names but ``pieces``.
    """
    keep = list(keep)
    what = [c for c in media.columns if c != "digest"]
    store = media.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(*what)).alias("media"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep, F.lit(0)).alias("kept"), "pieces")
    rows = rows.select("row", "kept", F.explode_outer("pieces").alias("piece"))  # the row's number comes before its pieces
    key = F.coalesce("piece.digest", F.concat(F.lit("-"), F.col("row").cast("string")))  # text has no digest: dealt out by page
    joined = rows.withColumn("key", key).join(store, F.col("key") == F.col("digest"), "left")
    whole = F.when(F.col("piece").isNotNull(), F.struct("piece.*", "media"))
    grouped = joined.groupBy("row").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(whole), lambda a, b: a["position"] - b["position"]).alias("pieces"))
    return grouped.select(*[F.col("kept")[c].alias(c) for c in keep], "pieces")


def to_pgm(payload: bytes) -> bytes:
    """A payload of whole tiles as a PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(data: bytes) -> memoryview:
    """The samples of an image that :func:`to_pgm` made; ValueError for anything else."""
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", data)
    samples = memoryview(data)[head.end() :] if head else memoryview(b"")
    if not head or int(head[1]) != WIDTH or len(samples) != WIDTH * int(head[2]):
        raise ValueError("not an image of this store")
    return samples


def padded(raw: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of the tile."""
    return raw + PAD * (-len(raw) % TILE if raw else TILE)


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text (null: empty) as a stored image and a page that shows it: doc_id, n_bytes, html, digest, data.

    Equal texts have equal images and digests. Ids may be null or repeat; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pages, digests, images = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                raw = text.as_py() or b""
                images.append(to_pgm(padded(raw)))
                digests.append(hashlib.sha256(images[-1]).hexdigest())
                sizes.append(len(raw))
                pages.append(f'<article><p>Text of {len(raw)} bytes</p><figure><img src="sha256:{digests[-1]}"><figcaption>{len(images[-1])} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(images, pa.binary())],
                ["doc_id", "n_bytes", "html", "digest", "data"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, html string, digest string, data binary")


def image_features(store: DataFrame) -> DataFrame:
    """Reads stored images (digest, data): sizes, checksums and a feature of the samples.

    ``feature`` is ``rows;mean;deviation;ascii,high,pad`` with mean and population deviation in
    hundredths, and the shares of samples below 128, from 128 to 254, and 255 in per mille.
    ValueError where data is no image of the store or its digest differs.
    """
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = image.as_py()
                own = hashlib.sha256(data).hexdigest()
                if own != digest:
                    raise ValueError(f"stored image {digest} has digest {own}")
                samples = from_pgm(data)
                x = np.frombuffer(samples, np.uint8)
                count = np.bincount(x, minlength=256)
                n, s, q = len(x), int(count @ np.arange(256)), int(count @ np.arange(256) ** 2)
                low, high = int(count[:128].sum()), int(count[128:255].sum())
                feature = f"{n // WIDTH};{100 * s // n};{int(100 * np.sqrt(max(0, n * q - s * s)) / n)};{1000 * low // n},{1000 * high // n},{1000 * int(count[255]) // n}"
                rows.append((digest, n, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), own, feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return store.select("digest", "data").mapInArrow(tidy(run), schema)
