"""File names, ids, addresses, and numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, decimals, strip

# Prices in dollars for a million tokens, and vector sizes, by model.
PRICES = {"text-embedding-3-large": 0.13, "text-embedding-3-small": 0.02, "text-embedding-ada-002": 0.10}
DIMENSIONS = {"text-embedding-3-large": 3072, "text-embedding-3-small": 1536, "text-embedding-ada-002": 1536}


def sanitize_filename(name: Column | str, most: int | Column = 200) -> Column:
    """Characters ``<>:"/\\|?*`` become ``_``; runs of ``_`` and white space one ``_``; trimmed, then cut; never empty."""
    safe = F.regexp_replace(F.translate(col(name), '<>:"/\\|?*', "_" * 9), r"(?U)[_\s]+", "_")
    cut = F.substring(F.btrim(safe, F.lit(" _")), F.lit(1), most if isinstance(most, Column) else F.lit(most))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled"))


def work_key(url: Column | str) -> Column:
    """What follows the last slash; empty for null."""
    return F.coalesce(F.substring_index(col(url), "/", -1), F.lit(""))


def pdf_filename(index: Column | str, url: Column | str, title: Column | str, most: int = 200) -> Column:
    """``{index:05d}_{key}_{title}.pdf``; the title is cut so that the whole has ``most`` characters at most."""
    prefix = F.format_string("%05d_%s_", col(index), work_key(url))
    title = F.coalesce(F.nullif(col(title), F.lit("")), F.lit("untitled"))
    return F.concat(prefix, sanitize_filename(title, F.lit(most) - F.length(prefix) - 4), F.lit(".pdf"))


def format_bytes(size: Column | str) -> Column:
    """Two decimals and B, KB, ... TB, and PB from there on."""
    size = col(size).cast("double")
    out = F.concat(decimals(size / 1024.0**5, 2), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(size / 1024.0**power < 1024.0, F.concat(decimals(size / 1024.0**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(seconds: Column | str) -> Column:
    """``4.2s`` below a minute, ``3m 4s`` below an hour, else ``2h 3m 4s``; truncated."""
    s = col(seconds).cast("double")
    whole = F.floor(s).cast("long")
    minutes = F.floor(s / 60).cast("long")
    hours = F.floor(s / 3600).cast("long")
    return (
        F.when(s < 60, F.concat(decimals(s, 1), F.lit("s")))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %dm %ds", hours, minutes % 60, whole % 60))
    )


def format_span(seconds: Column | str) -> Column:
    """A whole number of seconds as ``n seconds``, ``n minutes``, ``n hours m minutes`` or ``n days m hours``."""
    s = col(seconds).cast("long")
    minutes, hours, days = (F.floor(s / n).cast("long") for n in (60, 3600, 86400))
    return (
        F.when(s < 60, F.format_string("%d seconds", s))
        .when(s < 3600, F.format_string("%d minutes", minutes))
        .when(s < 86400, F.format_string("%d hours %d minutes", hours, minutes % 60))
        .otherwise(F.format_string("%d days %d hours", days, hours % 24))
    )


def progress(done: Column | str, total: Column | str, elapsed: Column | str) -> Column:
    """Struct of percent and remaining seconds at the pace so far; zeros where either count is 0."""
    done, total, elapsed = (col(c).cast("double") for c in (done, total, elapsed))
    none = (done == 0) | (total == 0)
    return F.struct(
        F.when(none, F.lit(0.0)).otherwise(F.try_divide(done, total) * 100).alias("percent"),
        F.when(none, F.lit(0.0)).otherwise(F.try_divide(elapsed, done) * (total - done)).alias("eta"),
    )


def normalize_doi(raw: Column | str) -> Column:
    """Without ``doi:`` and ``.../doi.org/`` before it, and query, fragment, outer white space and slashes."""
    doi = F.regexp_replace(strip(raw), r"(?i)^doi:\s*", "")
    inner = F.regexp_extract(doi, r"(?i)doi\.org/(.+)", 1)
    doi = F.when(inner != "", inner).otherwise(doi)
    doi = F.substring_index(F.substring_index(doi, "?", 1), "#", 1)
    return F.btrim(strip(doi), F.lit("/"))


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def pdf_id(path: Column | str) -> Column:
    """The first two ``_`` parts of a file name without any ``.pdf``; the whole name if there is one part."""
    parts = F.split(F.replace(file_name(path), F.lit(".pdf"), F.lit("")), "_")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(F.array_join(parts, "_"))


def stem_id(path: Column | str) -> Column:
    """Like :func:`pdf_id`, but only the last suffix is cut off, whatever it is."""
    parts = F.split(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""), "_")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(F.array_join(parts, "_"))


def output_key(path: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), pdf_id(path), F.lit("/document.md"))


def is_pdf(content_type: Column | str, url: Column | str) -> Column:
    """A content type with ``pdf`` in it, or an address that ends in ``.pdf``; any case."""
    kind, url = F.coalesce(col(content_type), F.lit("")), F.coalesce(col(url), F.lit(""))
    return F.contains(F.lower(kind), F.lit("pdf")) | F.endswith(F.lower(url), F.lit(".pdf"))


def http_or_null(url: Column | str) -> Column:
    """The address if it starts with ``http://`` or ``https://``."""
    return F.when(F.startswith(col(url), F.lit("http://")) | F.startswith(col(url), F.lit("https://")), col(url))


def normalize_score(score: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Min-max into 0..1, clipped; 0.5 where both ends agree."""
    share = F.try_divide(score - low, high - low)
    share = 1 - share if invert else share
    return F.when(high == low, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters: the token count where no tokenizer is at hand."""
    return F.floor(F.length(col(text)) / 4).cast("int")


def token_cost(tokens: Column | str, model: Column | str) -> Column:
    """Dollars for so many tokens; 0.10 for a million where the model is unknown."""
    prices = F.create_map(*[F.lit(x) for item in PRICES.items() for x in item])
    return col(tokens) / 1_000_000 * F.coalesce(F.try_element_at(prices, col(model)), F.lit(0.10))


def embedding_dimension(model: Column | str, chosen: int | None = None) -> Column:
    """The chosen size, else the model's, else 1536."""
    sizes = F.create_map(*[F.lit(x) for item in DIMENSIONS.items() for x in item])
    return F.lit(chosen) if chosen is not None else F.coalesce(F.try_element_at(sizes, col(model)), F.lit(1536))


def filter_map(text: Column | str) -> Column:
    """``k:v,k:v`` to a map: parts are trimmed, those without a colon dropped, and the last of equal keys stays."""
    parts = F.filter(F.split(col(text), ","), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, ":", 1)).alias("k"), strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v")))
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    kept = F.filter(numbered, lambda p: ~F.exists(numbered, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))


def filter_string(filters: Column | str) -> Column:
    """A map back to ``k:v,k:v``, keys in the map's order."""
    return F.array_join(F.transform(F.map_entries(col(filters)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")



def negotiated_language(header: Column | str, supported: tuple[str, ...] = ("en", "fr"), default: str = "en") -> Column:
    """The supported language that an ``Accept-Language`` header wants most: by weight, then by place; regions count for their language."""
    parts = F.transform(F.split(F.lower(F.coalesce(col(header), F.lit(""))), ","), strip)
    weight = lambda p: F.coalesce(F.regexp_extract(p, r";\s*q=([01](?:\.\d+)?)", 1).try_cast("double"), F.lit(1.0))
    weighed = F.transform(parts, lambda p, i: F.struct((-weight(p)).alias("w"), i.alias("i"), F.regexp_extract(p, r"^([a-z]+)", 1).alias("l")))
    good = F.array_sort(F.filter(weighed, lambda x: x["l"].isin(*supported) & (x["w"] < 0)))
    return F.coalesce(F.get(good, F.lit(0))["l"], F.lit(default))


def known_values(values: Column | str) -> Column:
    """A map without its null values."""
    return F.map_filter(col(values), lambda k, v: v.isNotNull())
