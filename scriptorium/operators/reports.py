"""Reports on chunking strategies: what the metrics say, in text and as rows behind charts, and a page that shows both."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import normalize_score
from ..functions.text import decimals
from .evaluation import COMPARED, recommended, report_rows, strategy_score

#: Bars of the dashboard: a metric's column and its title. A missing metric is a bar of 0.
PANELS = [("mean_chars", "Mean chunk size"), ("coherence", "Coherence"), ("boundary", "Boundary similarity"), ("citation_coverage", "Citation coverage")]
GUIDELINES = [
    "Embed and search coarse chunks; read fine chunks of the coarse ones that were hit.",
    "Rerank the candidates of the vector search before they go into a prompt.",
    "Keep section hierarchies with chunks: they explain hits and filter them.",
    "Score strategies again when the corpus or the chunk sizes change.",
]


def total_chunks(metrics: DataFrame) -> DataFrame:
    """The chunks of all strategies together; 0 without any."""
    return metrics.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_chunks"))


def dashboard(metrics: DataFrame, name_col: str = "strategy") -> DataFrame:
    """(strategy, panel, value): the bars of each panel."""
    bars = F.array(*[F.struct(F.lit(title).alias("panel"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c, title in PANELS])
    return metrics.select(name_col, F.explode(bars).alias("b")).select(name_col, "b.panel", "b.value")


def radar(metrics: DataFrame, name_col: str = "strategy") -> DataFrame:
    """(strategy, axis, value): metrics scaled to 0..1 over the strategies, 1 the best; a missing metric is 0."""
    ends = metrics.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(f"_{c}") for c in COMPARED])
    joined = metrics.crossJoin(F.broadcast(ends))  # one row
    axes = [F.struct(F.lit(c).alias("axis"), F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(normalize_score(F.col(c), F.col(f"_{c}")["low"], F.col(f"_{c}")["high"], low)).alias("value")) for c, low in COMPARED.items()]
    return joined.select(name_col, F.explode(F.array(*axes)).alias("a")).select(name_col, "a.axis", "a.value")


def reasons(metrics: DataFrame, name_col: str = "strategy") -> DataFrame:
    """(strategy, reasons): why a strategy may be chosen, from its own metrics; a missing one gives no reason."""
    said = [
        ("coherence", lambda c: F.concat(F.lit("Semantic coherence "), decimals(c, 3))),
        ("boundary", lambda c: F.concat(F.lit("Boundary similarity "), decimals(c, 3))),
        ("citation_coverage", lambda c: F.concat(F.lit("Citations in "), decimals(c * 100, 1), F.lit("% of the chunks"))),
        ("std_chars", lambda c: F.concat(F.lit("Chunk sizes with a deviation of "), decimals(c, 0), F.lit(" characters"))),
    ]
    return metrics.select(name_col, F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), text(F.col(c))) for c, text in said])).alias("reasons"))


def _best(value: Column, metrics: DataFrame, name_col: str) -> dict:
    row = metrics.where(value.isNotNull()).orderBy(value.desc(), name_col).select(name_col, value.alias("value")).first()
    return {"strategy": row[name_col], "value": row["value"]} if row else {}


def insights(metrics: DataFrame, name_col: str = "strategy") -> list[dict[str, str]]:
    """Titles and descriptions of what stands out; metrics have a row for each of a few strategies."""
    titles = {"Coherence": (F.col("coherence"), "has the most coherent chunks"), "Boundaries": (-F.col("boundary"), "has the least similar neighbours"), "Citations": (F.col("citation_coverage"), "keeps citations in most chunks"), "Sizes": (-F.col("std_chars"), "has the most even sizes")}
    found = {title: (_best(value, metrics, name_col), text) for title, (value, text) in titles.items()}
    return [{"title": title, "description": f"{best['strategy']} {text} ({abs(best['value']):.3f})."} for title, (best, text) in found.items() if best]


def executive_summary(metrics: DataFrame, name_col: str = "strategy") -> str:
    n, chunks = metrics.count(), total_chunks(metrics).first()["total_chunks"]
    return f"{n} strategies were compared on the same papers, {chunks} chunks in all, by coherence, boundaries, citations and sizes."


def recommendation(metrics: DataFrame, name_col: str = "strategy") -> str | None:
    """A sentence with the strategy of the highest score; None without strategies."""
    best = recommended(metrics, name_col).first()
    return f"Recommended: {best[name_col]}, with a score of {best['score']:.1f}." if best else None


def bars_svg(rows: list[tuple[str, float]], title: str, width: int = 420) -> str:
    """A bar chart of a few named values as SVG."""
    most = max([v for _, v in rows], default=0) or 1
    bars = "".join(
        f'<text x="0" y="{34 + 22 * i}">{escape(name)}</text><rect x="110" y="{22 + 22 * i}" width="{(width - 190) * max(0.0, v) / most:.1f}" height="15"/><text x="{width - 70}" y="{34 + 22 * i}">{v:.3g}</text>'
        for i, (name, v) in enumerate(rows)
    )
    return f'<svg width="{width}" height="{30 + 22 * len(rows)}" xmlns="http://www.w3.org/2000/svg"><text x="0" y="14">{escape(title)}</text>{bars}</svg>'


def html_report(metrics: DataFrame, name_col: str = "strategy", title: str = "Chunking strategies") -> str:
    """A page on a few strategies: summary, table, dashboard, insights, the recommended one with reasons, guidelines."""
    rows = report_rows(metrics, name_col).orderBy(name_col).collect()
    best = recommended(metrics, name_col).first()
    head = "".join(f"<th>{escape(c)}</th>" for c in rows[0].asDict()) if rows else ""
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    bars = dashboard(metrics, name_col).orderBy(name_col).collect()
    charts = "".join(bars_svg([(str(b[name_col]), b["value"]) for b in bars if b["panel"] == panel], panel) for _, panel in PANELS) if rows else ""
    chosen = ""
    if best:
        why = reasons(metrics.where(F.col(name_col) == best[name_col]), name_col).first()["reasons"]
        chosen = f"<h2>Recommendation</h2><p>{escape(recommendation(metrics, name_col) or '')}</p><ul>{''.join(f'<li>{escape(r)}</li>' for r in why)}</ul>"
    found = "".join(f"<h3>{escape(i['title'])}</h3><p>{escape(i['description'])}</p>" for i in insights(metrics, name_col))
    todo = "".join(f"<li>{escape(g)}</li>" for g in GUIDELINES)
    return (
        f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>{escape(executive_summary(metrics, name_col))}</p>{chosen}"
        f"<table><tr>{head}</tr>{body}</table>{charts}<h2>Insights</h2>{found}<h2>Guidelines</h2><ul>{todo}</ul></body></html>"
    )


__all__ = ["bars_svg", "dashboard", "executive_summary", "html_report", "insights", "radar", "reasons", "recommendation", "strategy_score", "total_chunks"]
