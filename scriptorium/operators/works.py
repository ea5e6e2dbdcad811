"""Bibliographic works: the nested record, its flat row, and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import http_or_null, work_key
from ..functions.text import decimals, let

_LOCATION = "struct<is_oa:boolean,landing_page_url:string,pdf_url:string,source:struct<id:string,display_name:string,issn_l:string,issn:array<string>,host_organization:string,type:string>,license:string,version:string,is_accepted:boolean,is_published:boolean>"
_NAMED = "struct<display_name:string>"
_TOPIC = f"struct<id:string,display_name:string,subfield:{_NAMED},field:{_NAMED},domain:{_NAMED}>"
#: The record as the source delivers it.
WORK_SCHEMA = (
    "struct<id:string,doi:string,title:string,display_name:string,publication_year:int,publication_date:string,type:string,type_crossref:string,"
    "open_access:struct<is_oa:boolean,oa_status:string,oa_url:string,any_repository_has_fulltext:boolean>,"
    f"primary_location:{_LOCATION},best_oa_location:{_LOCATION},locations:array<{_LOCATION}>,"
    "authorships:array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,raw_affiliation_string:string>>,"
    f"primary_topic:{_TOPIC},topics:array<{_TOPIC}>,concepts:array<struct<id:string,wikidata:string,display_name:string,level:int,score:double>>,"
    f"keywords:array<{_NAMED}>,abstract_inverted_index:map<string,array<int>>,cited_by_count:int,cited_by_api_url:string,"
    "is_retracted:boolean,is_paratext:boolean,language:string,referenced_works:array<string>,related_works:array<string>,created_date:string,updated_date:string>"
)
# The statuses that a record may have.
OA_STATUSES = ["bronze", "closed", "diamond", "gold", "green", "hybrid"]
NUMBERS = ["publication_year", "num_locations", "num_pdf_urls", "num_oa_locations", "num_authors", "cited_by_count", "concept_1_score", "concept_2_score", "concept_3_score"]
FLAGS = ["is_oa", "any_repository_has_fulltext", "has_any_pdf", "is_retracted", "is_paratext"]


def parse_works(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """One ``work`` for each JSON record, and ``rejected`` where it is no record, lacks an id or has an unknown status."""
    parsed = F.from_json(json_col, WORK_SCHEMA, {"mode": "PERMISSIVE"})
    status = F.col("work.open_access.oa_status")
    good = F.col("work.id").isNotNull() & F.col("work.open_access").isNotNull() & (status.isNull() | status.isin(OA_STATUSES))
    return pages.withColumn("work", _once(parsed)).withColumn("rejected", ~F.coalesce(good, F.lit(False)))


def _once(value: Column) -> Column:
    """A row's value from a generator: the optimiser copies a projection's expressions into filters and into each later use, not a generator's."""
    return F.explode(F.array(value))


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _pdf(location: Column) -> Column:
    return _nonempty(http_or_null(location["pdf_url"]))


def pdf_urls(work: Column) -> Column:
    """Distinct addresses in order: best location, primary location, all locations."""
    listed = F.concat(F.array(_pdf(work["best_oa_location"]), _pdf(work["primary_location"])), F.coalesce(F.transform(work["locations"], _pdf), F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(listed))


def best_pdf_url(work: Column) -> Column:
    """Best, else primary, else the first open location's; null although another location may have one."""
    open_ = F.filter(work["locations"], lambda x: F.coalesce(x["is_oa"], F.lit(False)) & _pdf(x).isNotNull())
    return F.coalesce(_pdf(work["best_oa_location"]), _pdf(work["primary_location"]), _pdf(F.get(open_, F.lit(0))))


def author_names(work: Column) -> Column:
    return F.array_compact(F.transform(work["authorships"], lambda a: _nonempty(a["author"]["display_name"])))


def _listed(values: Column) -> Column:
    return _nonempty(F.array_join(values, "|"))


def _location_columns(location: Column, prefix: str) -> dict[str, Column]:
    source = location["source"]
    return {
        f"{prefix}_pdf_url": http_or_null(location["pdf_url"]), f"{prefix}_landing_page": http_or_null(location["landing_page_url"]),
        f"{prefix}_version": location["version"], f"{prefix}_license": location["license"],
        f"{prefix}_source": source["display_name"], f"{prefix}_source_type": source["type"],
    }


def flatten(works: DataFrame, work_col: str = "work", full_json: bool = True) -> DataFrame:
    """The flat row of each work: scalars, the first three concepts by place, and lists joined with ``|``."""
    flat = let(F.col(work_col), lambda w: let(F.struct(pdf_urls(w).alias("urls"), author_names(w).alias("names")), lambda x: _flat(w, x["urls"], x["names"], full_json)))
    return works.select(_once(flat).alias("_flat")).select("_flat.*")


def _flat(w: Column, urls: Column, authors: Column, full_json: bool) -> Column:
    topic, access = w["primary_topic"], w["open_access"]
    no = lambda c: F.coalesce(c, F.lit(False))
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    columns = {
        "id": w["id"], "openalex_id": work_key(w["id"]), "doi": w["doi"], "title": F.coalesce(_nonempty(w["title"]), w["display_name"]),
        "publication_year": w["publication_year"], "publication_date": w["publication_date"], "type": w["type"], "language": w["language"],
        "is_oa": no(access["is_oa"]), "oa_status": access["oa_status"], "oa_url": access["oa_url"], "any_repository_has_fulltext": no(access["any_repository_has_fulltext"]),
        **_location_columns(w["best_oa_location"], "best_oa"), **_location_columns(w["primary_location"], "primary"),
        "num_locations": size(w["locations"]), "num_pdf_urls": F.size(urls), "num_oa_locations": size(F.filter(w["locations"], lambda x: no(x["is_oa"]))),
        "all_pdf_urls": _listed(urls), "has_any_pdf": F.size(urls) > 0,
        "topic_id": _nonempty(F.substring_index(topic["id"], "/", -1)), "topic_name": topic["display_name"],
        **{f"topic_{level}": topic[level]["display_name"] for level in ("subfield", "field", "domain")},
        "num_authors": size(w["authorships"]), "first_author": F.get(authors, F.lit(0)), "author_names": _listed(authors),
        **{f"concept_{i + 1}_{part}": F.get(w["concepts"], F.lit(i))[key] for i in range(3) for part, key in (("name", "display_name"), ("score", "score"))},
        "keywords": _listed(F.array_compact(F.transform(w["keywords"], lambda k: _nonempty(k["display_name"])))),
        "cited_by_count": F.coalesce(w["cited_by_count"], F.lit(0)), "is_retracted": no(w["is_retracted"]), "is_paratext": no(w["is_paratext"]),
        "openalex_url": w["id"], "cited_by_api_url": w["cited_by_api_url"],
    }
    if full_json:
        columns["full_json"] = F.to_json(w)
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def rebuilt(flat: DataFrame) -> DataFrame:
    """``work`` from ``full_json``, else from the flat columns: best and primary location only; rows with neither are left out."""
    c = F.col

    def location(prefix: str, is_oa: Column) -> Column:
        source = F.when(c(f"{prefix}_source").isNotNull(), F.struct(c(f"{prefix}_source").alias("display_name"), c(f"{prefix}_source_type").alias("type")))
        body = F.struct(is_oa.alias("is_oa"), c(f"{prefix}_landing_page").alias("landing_page_url"), c(f"{prefix}_pdf_url").alias("pdf_url"), source.alias("source"), c(f"{prefix}_license").alias("license"), c(f"{prefix}_version").alias("version"))
        return F.when(c(f"{prefix}_pdf_url").isNotNull() | c(f"{prefix}_landing_page").isNotNull(), body)

    access = F.struct("is_oa", "oa_status", "oa_url", "any_repository_has_fulltext")
    plain = F.struct(
        c("id"), c("doi"), c("title"), c("publication_year"), c("publication_date"), c("type"), c("language"), access.alias("open_access"),
        location("best_oa", F.lit(True)).alias("best_oa_location"), location("primary", c("is_oa")).alias("primary_location"), c("cited_by_count"), c("is_retracted"), c("is_paratext"),
    )
    back = F.from_json(F.to_json(plain), WORK_SCHEMA)
    return flat.withColumn("work", _once(F.coalesce(F.from_json("full_json", WORK_SCHEMA), F.when(c("id").isNotNull(), back)))).where("work IS NOT NULL")


def typed(flat: DataFrame) -> DataFrame:
    """Numbers and flags of the flat row as such: bad numbers become null, null flags false. Absent columns are left out."""
    numbers = {n: F.expr(f"try_cast({n} AS {'double' if n.endswith('score') else 'int'})") for n in NUMBERS if n in flat.columns}
    return flat.withColumns(numbers | {n: F.coalesce(F.expr(f"try_cast({n} AS boolean)"), F.lit(False)) for n in FLAGS if n in flat.columns})


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(value, count), nulls left out, most frequent first, equal counts by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return out.limit(most) if most else out


def summary(flat: DataFrame) -> DataFrame:
    """One row of totals over flat works."""
    year, cited = F.col("publication_year"), F.col("cited_by_count")
    return flat.agg(
        F.count("*").alias("total_works"), F.count_if("has_any_pdf").alias("with_pdf"), F.count_if(~F.col("has_any_pdf")).alias("without_pdf"),
        F.count("best_oa_pdf_url").alias("with_best_oa_pdf"), F.count("primary_pdf_url").alias("with_primary_pdf"), F.count("doi").alias("with_doi"), F.count_if(F.col("doi").isNull()).alias("without_doi"),
        F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.avg(year).alias("mean_year"),
        F.sum(cited).alias("total_citations"), F.avg(cited).alias("mean_citations"), F.median(cited).alias("median_citations"), F.max(cited).alias("max_citations"),
    )


def summary_report(flat: DataFrame) -> DataFrame:
    """(place, line): the summary as text: availability, statuses, citations and the ten most frequent open sources.

    Shares are of all works, and there are none where there are no works.
    """
    number = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0)), 0)
    share = lambda c: F.coalesce(F.concat(F.lit(" ("), decimals(F.try_divide(F.col(c) * 100.0, "total_works"), 1), F.lit("%)")), F.lit(""))
    counted = [("Works with PDF URLs", "with_pdf"), ("Works without PDF URLs", "without_pdf"), ("Works with best open PDF", "with_best_oa_pdf"), ("Works with primary PDF", "with_primary_pdf"), ("Works with DOI", "with_doi"), ("Works without DOI", "without_doi")]
    cited = [("Citations in all", number("total_citations")), ("Citations, mean", decimals(F.coalesce("mean_citations", F.lit(0.0)), 2)), ("Citations, median", decimals(F.coalesce("median_citations", F.lit(0.0)), 0)), ("Citations, most", number("max_citations"))]
    years = F.concat_ws(" to ", F.col("min_year").cast("string"), F.col("max_year").cast("string"))
    said = [("Works", number("total_works")), *[(t, F.concat(number(c), share(c))) for t, c in counted], ("Years", years), *cited]
    lines = F.array(*[F.concat(F.lit(f"{t}: "), v) for t, v in said])
    whole = summary(flat).select(F.posexplode(lines).alias("place", "line"))
    total = F.sum("count").over(Window.partitionBy())
    statuses = value_counts(flat, "oa_status").withColumn("share", F.col("count") * 100.0 / total)
    ranked = F.row_number().over(Window.orderBy(F.desc("count"), "value"))  # as many rows as there are statuses, or ten
    status_lines = statuses.select((ranked + 99).alias("place"), F.concat(F.lit("Open access, "), "value", F.lit(": "), F.format_number("count", 0), F.lit(" ("), decimals(F.col("share"), 1), F.lit("%)")).alias("line"))
    source_lines = value_counts(flat, "best_oa_source", 10).select((ranked + 199).alias("place"), F.concat(F.lit("Source, "), F.substring("value", 1, 50), F.lit(": "), F.format_number("count", 0)).alias("line"))
    return whole.unionByName(status_lines).unionByName(source_lines)


def filtered(flat: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """The works for which a caller's predicate over the frame holds."""
    return flat.where(predicate(flat))


def abstracts(works: DataFrame, work_col: str = "work") -> DataFrame:
    """(id, abstract): the inverted index read back into text, words by position."""
    entries = F.flatten(F.transform(F.map_entries(F.col(work_col)["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return works.select(F.col(work_col)["id"].alias("id"), F.array_join(F.transform(F.array_sort(entries), lambda x: x["w"]), " ").alias("abstract"))
