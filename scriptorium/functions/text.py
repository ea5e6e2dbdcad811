"""Text functions whose white space is Unicode's, as Python has it, not ASCII's, as Java has it by default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Every character for which ``str.isspace`` holds; none lies beyond U+3000.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(SPACES))


def rstrip(c: Column | str, chars: str = SPACES) -> Column:
    return F.rtrim(col(c), F.lit(chars))


def word_count(c: Column | str) -> Column:
    """Number of words separated by white space."""
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def decimals(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, half to even, as C and Python do (Java's ``%.2f`` goes by digits)."""
    return F.replace(F.format_number(value.cast("double"), places), F.lit(","), F.lit(""))


def paragraphs(text: Column | str) -> Column:
    """Trimmed, non-empty pieces between blank lines (two line feeds or more)."""
    return F.filter(F.transform(F.split(col(text), "\n\n+"), strip), lambda p: p != "")


def sentences(text: Column | str) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``."""
    return F.split(col(text), r"(?U)(?<=[.!?])\s+")


def long_sentences(text: Column | str, least: int = 20) -> Column:
    """Trimmed pieces between runs of ``.!?`` with white space after, of more than ``least`` characters."""
    return F.filter(F.transform(F.split(col(text), r"(?U)[.!?]+\s+"), strip), lambda s: F.length(s) > least)


def greedy(pieces: Column, most: int, separator: str = "", extra: int = 0) -> Column:
    """Packs an array of strings: they are joined by ``separator`` as long as the length so far, the next one's and ``extra`` are ``most`` at most.

    A string that is too long stays whole; while nothing is packed yet, the next string starts anew.
    Only lengths and places are folded: a fold copies its state at each step, so strings in it would take time with the square of the text's length.
    """
    state = lambda out, first, size: F.struct(out.alias("out"), first.alias("first"), size.alias("size"))

    def step(acc: Column, p: Column) -> Column:
        fits = acc["size"] + p["n"] + extra <= most
        closed = (acc["size"] > 0) & ~fits
        out = F.when(closed, F.concat(acc["out"], F.array(acc["first"], p["i"]))).otherwise(acc["out"])
        fresh = (acc["size"] == 0) | ~fits
        return state(out, F.when(fresh, p["i"]).otherwise(acc["first"]), F.when(fresh, p["n"]).otherwise(acc["size"] + p["n"] + len(separator)))

    def packed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))
        ends = F.aggregate(sizes, state(F.array().cast("array<int>"), F.lit(0), F.lit(0)), step, lambda acc: F.when(acc["size"] > 0, F.concat(acc["out"], F.array(acc["first"], F.size(parts)))).otherwise(acc["out"]))
        join = lambda e, k: F.array_join(F.slice(parts, F.get(e, 2 * k) + 1, F.get(e, 2 * k + 1) - F.get(e, 2 * k)), separator)
        none = F.slice(parts, F.lit(1), F.lit(0))
        return let(ends, lambda e: F.when(F.size(e) > 0, F.transform(F.sequence(F.lit(0), (F.size(e) / 2).cast("int") - 1), lambda k: join(e, k))).otherwise(none))

    return let(pieces, packed)


def tail_overlap(pieces: Column, share: float) -> Column:
    """Each string after the first gets the end of the one before it, a blank line between.

    The end is ``int(length * share)`` characters, left-trimmed; where that is 0, the whole string.
    """

    def with_tail(ps: Column, p: Column, i: Column) -> Column:
        before = F.get(ps, i - 1)
        n = F.floor(F.length(before) * F.lit(float(share))).cast("int")
        tail = F.when(n == 0, before).otherwise(F.right(before, n))
        return F.when(i == 0, p).otherwise(F.concat(lstrip(tail), F.lit("\n\n"), p))

    return let(pieces, lambda ps: F.transform(ps, lambda p, i: with_tail(ps, p, i)))


def count_citations(text: Column | str) -> Column:
    """Places of ``$^{1}$``, ``[1]`` and ``(1)``, with any digits."""
    return sum((F.regexp_count(col(text), F.lit(f"(?U){p}")) for p in (r"\$\^\{\d+\}\$", r"\[\d+\]", r"\(\d+\)")), F.lit(0))
