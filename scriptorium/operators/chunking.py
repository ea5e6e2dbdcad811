"""Chunking of documents, one row in and many chunk rows out: by Catalyst expressions, but for loops whose state is text or a place in it.

Nothing here shuffles: a document's chunks, their numbers and totals come from one array per document,
exploded at the end, so plans are map-only and scale with the number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, count_citations, greedy, let, paragraphs, sentences, strip, tail_overlap, word_count

HEADING = r"(?dU)^(#{1,6})\s+(.+)$"


@dataclass(frozen=True)
class HybridOptions:
    """Largest sizes in characters and overlaps as shares of the chunk before."""

    coarse_max: int = 2500
    fine_max: int = 450
    coarse_overlap: float = 0.10
    fine_overlap: float = 0.20
    #: Text before the first heading is left out unless this is set.
    keep_preamble: bool = False

    def __post_init__(self) -> None:
        if min(self.coarse_max, self.fine_max) < 1 or not all(0 <= x < 1 for x in (self.coarse_overlap, self.fine_overlap)):
            raise ValueError("sizes must be positive and overlaps in [0, 1)")


#: The three evaluated strategies are one chunker with different sizes and overlaps.
STRATEGIES = {
    "hybrid": HybridOptions(coarse_max=2600, coarse_overlap=0.15),
    "fixed": HybridOptions(coarse_max=2000, coarse_overlap=0.10),
    "semantic": HybridOptions(coarse_max=10000, coarse_overlap=0.05),
}


@dataclass(frozen=True)
class SplitOptions:
    size: int = 1024
    overlap: int = 100
    least: int = 100
    separators: tuple[str, ...] = field(default=("\n\n", "\n", ". ", " "))


def cleaned(text: Column | str) -> Column:
    """Page breaks (lines of three dashes or more) and runs of blank lines become one blank line."""
    return F.regexp_replace(F.regexp_replace(col(text), "\n---+\n", "\n\n"), "\n{3,}", "\n\n")


def headings(text: Column | str) -> Column:
    """Array of structs (text, level, line from 0) of Markdown headings; code fences are not looked at."""
    return _headings(F.split(col(text), "\n"))


def _headings(lines: Column) -> Column:
    placed = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("line"))), lambda x: F.startswith(x["text"], F.lit("#")))
    heads = F.transform(placed, lambda x: F.struct(strip(F.regexp_extract(x["text"], HEADING, 2)).alias("text"), F.length(F.regexp_extract(x["text"], HEADING, 1)).alias("level"), x["line"].alias("line")))
    return F.filter(heads, lambda h: h["level"] > 0)


def sections(text: Column | str, keep_preamble: bool = False) -> Column:
    """Array of structs (hierarchy, text, char_start, char_end): each heading's lines up to the next heading.

    ``hierarchy`` is the heading with those it stands under. Without headings there is one section,
    ``Document``. Text before the first heading is left out, or a section without hierarchy.
    """
    return let(col(text), lambda t: let(F.split(t, "\n"), lambda lines: let(_headings(lines), lambda heads: _sections(t, lines, heads, keep_preamble))))


def _sections(text: Column, lines: Column, heads: Column, keep_preamble: bool) -> Column:
    """Sections by headings. Folds have places only, as their state is copied at each step."""
    start = F.struct(F.array().cast("array<struct<i:int,level:int>>").alias("stack"), F.array().cast("array<array<int>>").alias("out"))

    def push(acc: Column, h: Column) -> Column:
        above = F.filter(acc["stack"], lambda s: s["level"] < h["level"])
        stack = F.concat(above, F.array(F.struct(h["i"].alias("i"), h["level"].alias("level"))))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.transform(stack, lambda s: s["i"]))).alias("out"))

    joined = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "\n")
    first = F.get(heads, F.lit(0))["line"]
    before = F.when(first > 0, joined(F.lit(0), first))
    origin = F.coalesce(F.length(before) + 1, F.lit(0))
    part = "struct<hierarchy:array<string>,text:string,char_start:int,char_end:int>"
    make = lambda h, t, a: F.struct(h.alias("hierarchy"), t.alias("text"), a.alias("char_start"), (a + F.length(t)).alias("char_end"))

    def placed(pieces: Column, paths: Column) -> Column:
        begin = F.struct(F.array().cast("array<int>").alias("out"), origin.alias("at"))
        follow = lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + n + 1).alias("at"))
        starts = F.aggregate(F.transform(pieces, F.length), begin, follow, lambda acc: acc["out"])
        names = lambda i: F.transform(F.get(paths, i), lambda j: F.get(heads, j)["text"])
        return let(starts, lambda places: F.transform(pieces, lambda t, i: make(names(i), t, F.get(places, i))))

    numbered = F.transform(heads, lambda h, i: F.struct(i.alias("i"), h["level"].alias("level")))
    cut = F.transform(heads, lambda h, i: joined(h["line"], F.coalesce(F.get(heads, i + 1)["line"], F.size(lines))))
    found = let(cut, lambda pieces: let(F.aggregate(numbered, start, push, lambda acc: acc["out"]), lambda paths: placed(pieces, paths)))
    if keep_preamble:
        own = F.array(make(F.array().cast("array<string>"), before, F.lit(0)))
        found = F.when(strip(before) != "", F.concat(own, found)).otherwise(found)
    return F.when(F.size(heads) == 0, F.array(make(F.array(F.lit("Document")), text, F.lit(0))).cast(f"array<{part}>")).otherwise(found)


def packed(text: Column, most: int) -> Column:
    """Paragraphs packed into strings of ``most`` characters at most; a longer paragraph stays whole."""
    return greedy(paragraphs(text), most, "\n\n", extra=2)


def _with_columns(documents: DataFrame, id_col: str, title_col: str | None, text_col: str) -> DataFrame:
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    return documents.select(F.col(id_col).cast("string").alias("paper_id"), title.alias("paper_title"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _coarse(documents: DataFrame, options: HybridOptions) -> DataFrame:
    """paper_id, paper_title and ``_coarse``: the array of coarse chunks."""
    most = options.coarse_max
    split = lambda s: F.when(F.length(s["text"]) <= most, F.array(s["text"])).otherwise(packed(s["text"], most))
    whole = documents.withColumn("_sections", sections(cleaned("_text"), options.keep_preamble))
    raw = F.flatten(F.transform("_sections", lambda s: F.transform(split(s), lambda t: F.struct(t.alias("text"), s["hierarchy"].alias("hierarchy"), s["char_start"].alias("char_start")))))
    whole = whole.select("paper_id", "paper_title", raw.alias("_raw"))
    texts = whole.select("paper_id", "paper_title", "_raw", F.transform("_raw", lambda r: r["text"]).alias("_plain"))
    return texts.select("paper_id", "paper_title", F.arrays_zip(F.col("_raw").alias("raw"), tail_overlap(F.col("_plain"), options.coarse_overlap).alias("text")).alias("_coarse"))


def _rows(documents: DataFrame, options: HybridOptions, kinds: tuple[str, ...]) -> DataFrame:
    """Chunks of the given kinds from one array for each document: sections and coarse chunks are computed once for both."""
    found = documents.select("paper_id", "paper_title", "_coarse")
    first = F.transform(
        "_coarse",
        lambda c, i: F.struct(
            F.lit("coarse").alias("kind"), i.alias("chunk_index"), F.size("_coarse").alias("total"), c["text"].alias("text"), c["raw"]["hierarchy"].alias("hierarchy"),
            c["raw"]["char_start"].alias("char_start"), (i > 0).alias("overlapped"), F.lit(None).cast("int").alias("parent"),
        ),
    )
    if kinds == ("coarse",):
        return found.select("paper_id", "paper_title", F.explode(first).alias("c"))
    plain = F.transform("_coarse", lambda c: packed(c["text"], options.fine_max))
    pieces = F.transform(plain, lambda p: tail_overlap(p, options.fine_overlap))
    each = F.flatten(F.transform(pieces, lambda ps, j: F.transform(ps, lambda t, i: F.struct(j.alias("parent"), i.alias("local"), t.alias("text")))))
    found = found.withColumn("_fine", each)

    def row(c: Column, i: Column) -> Column:
        raw = F.get("_coarse", c["parent"])["raw"]
        return F.struct(
            F.lit("fine").alias("kind"), i.alias("chunk_index"), F.size("_fine").alias("total"), c["text"].alias("text"), raw["hierarchy"].alias("hierarchy"),
            raw["char_start"].alias("char_start"), (c["local"] > 0).alias("overlapped"), c["parent"].alias("parent"),
        )

    second = F.transform("_fine", row)
    return found.select("paper_id", "paper_title", F.explode(F.concat(first, second) if len(kinds) > 1 else second).alias("c"))


def _chunks(documents: DataFrame, options: HybridOptions, kinds: tuple[str, ...], id_col: str, title_col: str | None, text_col: str) -> DataFrame:
    rows = _rows(_coarse(_with_columns(documents, id_col, title_col, text_col), options), options, kinds)
    c = F.col("c")
    return rows.select(
        c["text"].alias("text"), F.format_string("%s_%s_%04d", "paper_id", c["kind"], c["chunk_index"]).alias("chunk_id"), c["kind"].alias("chunk_type"),
        "paper_id", "paper_title", c["hierarchy"].alias("section_hierarchy"), c["char_start"].alias("char_start"), (c["char_start"] + F.length(c["text"])).alias("char_end"),
        c["chunk_index"].alias("chunk_index"), c["total"].alias("total_chunks"), c["overlapped"].alias("overlap_with_previous"),
        F.when(c["parent"].isNotNull(), F.format_string("%s_coarse_%04d", "paper_id", c["parent"])).alias("parent_chunk_id"),
    )


def coarse_chunks(documents: DataFrame, options: HybridOptions = HybridOptions(), id_col: str = "paper_id", title_col: str | None = "paper_title", text_col: str = "markdown") -> DataFrame:
    """Coarse chunks: sections cut at paragraphs, each with the end of the chunk before it.

    char_start is the section's start in the cleaned text, char_end adds the chunk's length to it. Null and empty
    texts give one empty chunk, as a document without headings is one section. Rows are independent.
    """
    return _chunks(documents, options, ("coarse",), id_col, title_col, text_col)


def fine_chunks(documents: DataFrame, options: HybridOptions = HybridOptions(), id_col: str = "paper_id", title_col: str | None = "paper_title", text_col: str = "markdown") -> DataFrame:
    """Fine chunks of each coarse chunk (overlap included), numbered through the document; ``parent_chunk_id`` names it."""
    return _chunks(documents, options, ("fine",), id_col, title_col, text_col)


def hybrid_chunks(
    documents: DataFrame, options: HybridOptions = HybridOptions(), both: bool = True, id_col: str = "paper_id", title_col: str | None = "paper_title", text_col: str = "markdown"
) -> DataFrame:
    """Coarse chunks, and fine chunks of them unless ``both`` is off, in one pass over the documents."""
    return _chunks(documents, options, ("coarse", "fine") if both else ("coarse",), id_col, title_col, text_col)


def strategies(documents: DataFrame, presets: dict[str, HybridOptions] = STRATEGIES, **columns: str) -> DataFrame:
    """Coarse chunks under each preset, in one frame with ``strategy``."""
    frames = [coarse_chunks(documents, o, **columns).withColumn("strategy", F.lit(name)) for name, o in presets.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# Plain chunkers, for text without structure.


def split_sentences(text: Column, size: int) -> Column:
    """Sentences packed greedily; the joining space doesn't count."""
    return F.transform(greedy(sentences(text), size, " "), strip)


def semantic_pieces(text: Column | str, options: SplitOptions = SplitOptions()) -> Column:
    """Paragraphs packed with overlap; a paragraph over 1.5 times the size is cut into sentences.

    Separators don't count towards the size; a last piece below ``least`` characters is dropped.
    """
    return _semantic(options)(col(text))


#: White space after the end of a sentence: Unicode's, without ASCII's four separators, which only ``str.isspace`` has.
SENTENCE_END = re.compile(r"(?<=[.!?])[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _sentences(text: str, size: int) -> list[str]:
    """:func:`split_sentences` of one string."""
    out, held, length = [], [], 0
    for s in SENTENCE_END.split(text):
        if length and length + len(s) > size:
            out.append(" ".join(held).strip())
            length = 0
        held, length = ([*held, s], length + 1 + len(s)) if length else ([s], len(s))
    return [*out, " ".join(held).strip()] if length else out


def _semantic(options: SplitOptions) -> Callable[[Column], Column]:
    """Packs trimmed paragraphs. What a chunk starts with depends on the text of the one before, and a fold by expressions copies all that it has so
    far at each step; so this is a loop over strings, each of which it reads once."""

    def tail(text: str) -> str:
        """The last characters for the overlap, from after the first ``. `` in them; a shorter text whole."""
        end = text[-options.overlap :]
        at = end.find(". ")
        return text if len(text) <= options.overlap else end[at + 2 :] if at >= 0 else end

    def packed(text: str) -> list[str]:
        out, held, size = [], [], 0
        for p in filter(None, map(str.strip, text.split("\n\n"))):
            if len(p) > options.size * 1.5:
                if held:
                    out.append("\n\n".join(held).strip())
                    held, size = [], 0
                out += _sentences(p, options.size)
            elif size + len(p) > options.size:
                before = "\n\n".join(held)
                if before:
                    out.append(before.strip())
                held, size = [p], len(p)
                if options.overlap > 0:
                    end = tail(before)
                    held, size = [f"{end}\n\n{p}"], len(end) + len(p)
            else:
                held.append(p)
                size += len(p)
        last = "\n\n".join(held)
        return [*out, last.strip()] if last and len(last) >= options.least else out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(t) if t is not None else None for t in texts], dtype=object)

    return run.asNondeterministic()  # not to be repeated in a filter that is derived from exploding it


def fixed_pieces(text: Column | str, options: SplitOptions = SplitOptions()) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; those below ``least`` are dropped.

    The text is cut into steps once and a window is its steps joined: a place in a string of bytes is found by counting from its start,
    so looking up each window in the whole text would take time with the square of its length.
    """
    step = options.size - options.overlap
    if step == 0:
        raise ValueError("size and overlap must differ")
    text = col(text)
    if step < 0:
        return F.array().cast("array<string>")
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    several = -(-options.size // step)
    window = lambda parts, i: F.substring(F.array_join(F.slice(parts, i + 1, F.lit(several)), ""), 1, options.size)
    return let(steps, lambda parts: F.filter(F.transform(parts, lambda _, i: window(parts, i)), lambda t: F.length(t) >= options.least))


def _cut(text: str, size: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces between the first separator, those that are too long cut at the next; a text without it is its own only part and goes on like a long one."""
    if not separators:
        yield text
        return
    parts = text.split(separators[0]) if separators[0] else list(text)  # an empty separator cuts between characters
    for p in parts:
        if len(parts) == 1 or len(p) > size:
            yield from _cut(p, size, separators[1:])
        else:
            yield p + separators[0]


def recursive_pieces(text: Column | str, options: SplitOptions = SplitOptions()) -> Column:
    """Cut at the first separator, pieces that are too long at the next, and so on; then packed greedily.

    Pieces keep a separator at their end, the last one too; those cut further lose theirs. A last
    piece below ``least`` characters is dropped. One loop over the pieces, of which a long text has one for each word.
    """
    separators = options.separators or SplitOptions().separators

    def packed(text: str) -> list[str]:
        out, held, length = [], [], 0
        for piece in _cut(text, options.size, separators):
            if length + len(piece) > options.size:
                if length:
                    out.append("".join(held).strip())
                held, length = [], 0
            held.append(piece)
            length += len(piece)
        return [*out, "".join(held).strip()] if length and length >= options.least else out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(t) if t is not None else None for t in texts], dtype=object)

    return run.asNondeterministic()(col(text))


PIECES = {"semantic": semantic_pieces, "fixed": fixed_pieces, "recursive": recursive_pieces}


def plain_chunks(documents: DataFrame, method: str = "semantic", options: SplitOptions = SplitOptions(), text_col: str = "text", keep: list[str] = (), citations_col: str | None = None) -> DataFrame:
    """Chunks with text, chunk_index, length, word_count and the columns ``keep``.

    With ``citations_col`` (an array of strings), ``citations`` has those that a chunk contains, in order. A kept
    column replaces a chunk column of the same name, as caller metadata does.
    """
    found = documents.withColumn("_pieces", PIECES[method](F.coalesce(F.col(text_col), F.lit("")), options))
    base = {"text": F.col("_p"), "chunk_index": F.col("_i"), "length": F.length("_p"), "word_count": word_count("_p")}
    if citations_col:
        found = found.withColumn("_cited", cited("_pieces", citations_col))
        base["citations"] = F.get("_cited", F.col("_i"))
    rows = found.select("*", F.posexplode("_pieces").alias("_i", "_p"))
    return rows.select(*[F.col(c) for c in keep], *[v.alias(k) for k, v in base.items() if k not in keep])


def cited(pieces: Column | str, citations: Column | str) -> Column:
    """For each string of an array, which of the row's ``citations`` (an array of strings) it contains, in their order.

    All patterns of a batch of rows make one automaton (Aho and Corasick), and each string is read once, however many patterns there are.
    Null and empty patterns are left out (an empty string would be in everything); repeated ones are found as often; null arrays have none.
    """

    @F.pandas_udf("array<array<string>>")
    def search(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        asked = [[p for p in (row if row is not None else []) if p] for row in wanted]
        for pattern in {p for row in asked for p in row}:
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        out = []
        for row, own in zip(texts, asked, strict=True):
            found = [{p for _, p in automaton.iter(t)} if own and t else set() for t in (row if row is not None else [])]
            out.append([[p for p in own if p in hits] for hits in found])
        return pd.Series(out, dtype=object)

    return search(col(pieces), col(citations))


def with_citation_counts(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    return chunks.withColumn("citations", count_citations(text_col))
