"""Queries over works, objects, events, pages and literal fixtures: records, scalars, operations, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import layout, markdown, names
from ..functions.text import strip
from ..operators import assembly, operations, works
from ..sources.files import folders, table
from . import fixtures

WORKS_SQL = """o AS (SELECT *, o_orderkey % 4 AS k4, CASE o_orderstatus WHEN 'F' THEN 'gold' WHEN 'O' THEN 'green' ELSE 'closed' END AS oa_status FROM orders),
u AS (SELECT *, CASE WHEN k4 = 1 THEN 'http://a.example.org/' || o_orderkey || '.pdf' END AS best_oa_pdf_url, CASE WHEN k4 >= 2 AND o_orderkey % 8 <> 2 THEN 'https://b.example.org/' || o_orderkey END AS primary_pdf_url,
      list_transform(range(0, CAST(k4 AS BIGINT) + 1), lambda i: CASE WHEN i = 0 THEN NULL ELSE 'https://c.example.org/' || o_orderkey || '/' || (i % 2) END) AS locs FROM o),
v AS (SELECT *, list_filter(list_concat([best_oa_pdf_url, primary_pdf_url], locs), lambda x: x IS NOT NULL) AS all_urls FROM u),
w AS (SELECT *, list_filter(all_urls, lambda x, i: list_position(all_urls, x) = i) AS urls FROM v),
f AS (SELECT 'W' || o_orderkey AS openalex_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://doi.org/10.1/' || o_orderkey END AS doi,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Name ' || o_orderkey ELSE 'Title ' || o_orderkey END AS title, CAST(year(o_orderdate) AS INT) AS publication_year, oa_status, o_orderkey % 2 = 0 AS is_oa,
      best_oa_pdf_url, primary_pdf_url, CASE WHEN k4 = 1 THEN 'S' || (o_custkey % 7) END AS best_oa_source, CASE WHEN k4 >= 2 THEN 'P' || (o_custkey % 5) END AS primary_source,
      CAST(k4 + 1 AS INT) AS num_locations, CAST(len(urls) AS INT) AS num_pdf_urls, CAST((k4 + 1) // 2 AS INT) AS num_oa_locations, nullif(array_to_string(urls, '|'), '') AS all_pdf_urls, len(urls) > 0 AS has_any_pdf,
      CAST(o_orderkey % 3 + 1 AS INT) AS num_authors, 'Author ' || o_custkey || ' 0' AS first_author,
      'Author ' || o_custkey || ' 0' || CASE WHEN o_orderkey % 3 = 2 THEN '|Author ' || o_custkey || ' 2' ELSE '' END AS author_names,
      'C0' AS concept_1_name, CASE WHEN o_orderkey % 5 >= 2 THEN 'C2' END AS concept_3_name, CASE WHEN o_orderkey % 5 >= 1 THEN 0.5::DOUBLE END AS concept_2_score,
      CASE WHEN o_orderkey % 2 = 1 THEN 'k1|k2' ELSE 'k1' END AS keywords, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(o_custkey % 50 AS INT) END AS cited_by_count FROM w)"""
FLAT = ["openalex_id", "doi", "title", "publication_year", "oa_status", "is_oa", "best_oa_pdf_url", "primary_pdf_url", "best_oa_source", "primary_source", "num_locations", "num_pdf_urls", "num_oa_locations", "all_pdf_urls", "has_any_pdf", "num_authors", "first_author", "author_names", "concept_1_name", "concept_3_name", "concept_2_score", "keywords", "cited_by_count"]


def flatten_works(spark: SparkSession, sf: str) -> DataFrame:
    return works.flatten(fixtures.works(spark, sf)).select(*FLAT)


def best_pdf(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("work")
    return fixtures.works(spark, sf).select(names.work_key(w["id"]).alias("id"), works.best_pdf_url(w).alias("url"), F.size(works.pdf_urls(w)).alias("urls"))


def works_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = works.summary(works.flatten(fixtures.works(spark, sf), full_json=False))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_year", "mean_citations", "median_citations")})


def works_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Flat rows back to works: from the full record for half of them, from flat columns for the others."""
    flat = works.flatten(fixtures.works(spark, sf)).withColumn("full_json", F.when(F.col("publication_year") % 2 == 0, F.col("full_json")))
    back = works.flatten(works.rebuilt(flat), full_json=False)
    return back.select("openalex_id", "title", "num_locations", "num_authors", "best_oa_pdf_url", "primary_pdf_url", "cited_by_count")


def oa_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return works.value_counts(works.flatten(fixtures.works(spark, sf), full_json=False), "oa_status")


def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return works.value_counts(works.flatten(fixtures.works(spark, sf), full_json=False), "best_oa_source", 3)


def works_with_pdf(spark: SparkSession, sf: str) -> DataFrame:
    return works.flatten(fixtures.works(spark, sf), full_json=False).where("has_any_pdf").select("openalex_id", "num_pdf_urls")


def typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("publication_year"), F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "x").alias("is_oa"), F.col("event_type").alias("concept_1_score"))
    return works.typed(raw)


def filter_maps(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("a: x"), "c_custkey", F.lit(" ,b:http://h:1,skip, a:last"), F.col("c_custkey") % 3).alias("s"))
    return c.select("c_custkey", names.filter_string(names.filter_map("s")).alias("filters"))


def unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    return operations.unprocessed(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


def limited_to_do(spark: SparkSession, sf: str) -> DataFrame:
    return operations.to_do(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", 100).select("doc_id")


def already_processed(spark: SparkSession, sf: str) -> DataFrame:
    return operations.processed(table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


def modulo_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return operations.modulo_shard(docs, "doc_id", 2, 7)


def slice_page(spark: SparkSession, sf: str) -> DataFrame:
    return operations.page(table(spark, sf, "documents"), "doc_id", 150, 25).select("doc_id", "n_chars")


def papers_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("markdown"))
    marks = table(spark, sf, "labels")
    title = F.struct(F.concat(F.lit("in/"), "doc_id", F.lit(".v1.pdf")).alias("source_file"), F.array(F.struct(F.lit(0).alias("page_number"), F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("text").alias("label"), F.lit("t").alias("text")), F.struct(F.lit("sec_0").alias("label"), F.when(F.col("toxic") == 0, F.lit(" A title ")).alias("text")))).otherwise(F.array().cast("array<struct<label:string,text:string>>")).alias("elements"))).alias("pages"))
    found = assembly.papers(texts, marks.select(F.col("doc_id").alias("paper_id"), title.alias("metadata")))
    return found.select("paper_id", "paper_title", F.length("markdown").cast("long").alias("length"))


def hourly_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return operations.newest_hours(operations.hourly(table(spark, sf, "events"), F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"), "ts", 24), 12)


def recent_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rate = operations.recent_rate(operations.hourly(e, F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"), "ts", 24))
    return rate.select(F.round("files_per_hour", 6).alias("files_per_hour"), F.round("items_per_hour", 6).alias("items_per_hour"))


def newest_object(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("processed/"), "event_id").alias("path"), F.col("ts").alias("modificationTime"))
    return operations.latest(e).select("path")


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 9 == 0, "failed").when(F.col("o_orderkey") % 7 == 0, "no_url").when(F.col("o_orderkey") % 5 == 0, "skipped").otherwise("ok")
    found = operations.run_counters(table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"), status.alias("status")), ["o_orderpriority"])
    return found.withColumn("success_rate", F.round("success_rate", 6))


def first_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("ok").alias("status"))
    return operations.first_failures(rows)


def props_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"))


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    messy = F.concat(F.lit(" _"), "url", F.lit('<a>: "b"|c?* _ '))
    return p.select(
        "page_id", names.sanitize_filename(messy, 40).alias("safe"), names.work_key("url").alias("key"),
        names.pdf_filename(F.col("page_id").cast("int"), F.concat(F.lit("https://w/W"), "page_id"), F.when(F.col("page_id") % 2 == 0, F.lit("A: title")), 60).alias("pdf"),
        names.is_pdf(F.lit("text/html"), F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(""))).alias("is_pdf"),
        names.http_or_null(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))).alias("url"),
    )


_SAFE = r"""trim(regexp_replace(translate(' _' || url || '<a>: "b"|c?* _ ', '<>:"/\|?*', '_________'), '[_\s]+', '_', 'g'), ' _')"""


def paper_ids(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "pages").select("page_id", F.format_string("raw_pdfs/%05d_W%d_some_title.pdf", F.col("page_id"), F.col("page_id") * 7).alias("long"), F.concat(F.lit("x/plain"), "page_id", F.lit(".pdf")).alias("short"))
    return paths.select("page_id", names.pdf_id("long").alias("a"), names.stem_id("long").alias("b"), names.pdf_id("short").alias("c"), names.stem_id("short").alias("d"), names.output_key("long", "processed/").alias("key"))


def object_folders(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "pages").select(F.concat(F.lit("bucket/processed/"), F.col("page_id") % 17, F.when(F.col("page_id") % 5 > 0, F.lit("/document.md")).otherwise("")).alias("path"))
    return folders(listing, "processed/")


def dois(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(*map(F.lit, ["doi:", " DOI: ", "https://doi.org/", "http://dx.doi.org/", ""])), (F.col("page_id") % 5 + 1).cast("int")), F.lit("10.1/x"), "page_id", F.element_at(F.array(*map(F.lit, ["", "?a=b", "#f", "/ ", " "])), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", names.normalize_doi(raw).alias("doi"))


def quantities(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 13).alias("n"))
    return o.select("o_orderkey", names.format_bytes("n").alias("bytes"), names.format_duration(F.col("n") % 20000).alias("duration"), names.format_span(F.col("n") % 400000).alias("span"))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", names.progress(F.col("o_orderkey") % 100, F.lit(100) * (F.col("o_orderkey") % 2), F.lit(50.0)).alias("p"))
    return o.select("o_orderkey", F.round("p.percent", 6).alias("percent"), F.round("p.eta", 6).alias("eta"))


def token_costs(spark: SparkSession, sf: str) -> DataFrame:
    model = F.element_at(F.array(*[F.lit(m) for m in names.PRICES], F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", names.token_estimate("text").alias("tokens"), model.alias("model"))
    return d.select("doc_id", "tokens", F.round(names.token_cost("tokens", "model"), 12).alias("cost"), names.embedding_dimension("model").alias("dimension"))


_MODEL = f"[{', '.join(repr(m) for m in names.PRICES)}, 'other'][CAST(doc_id % 4 + 1 AS INT)]"


def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    more = F.when(F.col("page_id") % 3 == 0, F.lit('<table class="x"><tr><td>1</td></tr></table>x<table\nid="y"><tr>\n<td>2</td></tr></table>')).otherwise("")
    return table(spark, sf, "pages").select("page_id", markdown.html_tables(F.concat("html", more)).alias("tables"))


LAYOUTS = [
    (1, "[10.5,20,300.25,40][sec_0][PAIR_SEP][10,60,500,400][para][meta][RELATION_SEP][600,60,880,400][fig][PAIR_SEP]"),
    (2, "[1,2,3,4] label[PAIR_SEP]nothing[PAIR_SEP][0,0,896,896][tab]"),
    (3, "[100,100,300,300][para][PAIR_SEP][200,200,400,400][para][PAIR_SEP] [5,5,5,5][ equ ]"),
    (4, ""),
]


def layout_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's page has one of the layouts, moved by the customer's number."""
    given = F.element_at(F.array(*[F.lit(s) for _, s in LAYOUTS]), (1 + F.col("c_custkey") % len(LAYOUTS)).cast("int"))
    moved = F.concat(F.lit("["), F.col("c_custkey") % 800, F.lit(",1,890,9][para][PAIR_SEP]"), given)
    found = table(spark, sf, "customer").select(F.col("c_custkey").alias("page"), F.explode(layout.parse_layout(moved)).alias("e"))
    c = F.col("e.coords")
    return found.select("page", "e.reading_order", "e.label", *[c[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


LAYOUT_SQL = r"""WITH t AS (SELECT c_custkey AS page, '[' || (c_custkey % 800) || ',1,890,9][para][PAIR_SEP]' || [{}][1 + c_custkey % {}] AS layout FROM customer), k AS (SELECT page, list_filter(list_transform(string_split(replace(layout, '[RELATION_SEP]', '[PAIR_SEP]'), '[PAIR_SEP]'), lambda x: trim(x)),
    lambda x: regexp_matches(x, '\[(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+)\]') AND regexp_matches(x, '\]\[[^\]]+\]')) AS k FROM t),
n AS (SELECT page, s, reading_order, string_split(regexp_extract(s, '\[([0-9.,]+)\]', 1), ',') AS c FROM (SELECT page, unnest(k) AS s, unnest(range(len(k))) AS reading_order FROM k))
SELECT page, CAST(reading_order AS INT) AS reading_order, trim(regexp_extract(s, '\]\[([^\]]+)\]', 1)) AS label, c[1]::DOUBLE AS x1, c[2]::DOUBLE AS y1, c[3]::DOUBLE AS x2, c[4]::DOUBLE AS y2 FROM n""".format(
    ", ".join(f"'{s}'" for _, s in LAYOUTS), len(LAYOUTS)
)


def elements_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each benchmark item, with an element of every label."""
    t = lambda label, *text: F.struct(F.lit(label).alias("label"), F.concat(*text).alias("text"))
    lit, body = F.lit, F.translate("text", "\n", " ")
    elements = F.array(
        t("sec_0", lit(" Head\nline ")), t("sec_3", lit("中\n文")), t("text", F.substring(body, 1, 40), lit("-\n"), F.substring(body, F.lit(41), F.length(body)), lit("\n\nend")), t("list", lit(" item ")), t("code", lit("x = 1")),
        t("equ", lit("$a \\leq b\\\\ $")), t("tab", lit('<table a="b"><tr></tr></table>')), t("fig", lit("![Figure](f.png)")), t("fig", lit("iVBOR")), t("text", lit("  ")), t("page_separator", lit("---")),
    )
    return table(spark, sf, "benchmark").select("item_id", markdown.elements_markdown(elements).alias("markdown"))


_BODY = "replace(text, chr(10), ' ')"
ELEMENTS_SQL = f"""SELECT item_id, '# Head line' || chr(10) || chr(10) || '### ' || chr(20013) || chr(25991) || chr(10) || chr(10)
    || trim({_BODY}) || chr(10) || chr(10) || 'end' || chr(10) || chr(10) || '- item' || chr(10) || '```bash' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || chr(10)
    || '$$a \\leq  b$$' || chr(10) || chr(10) || '<table><tr></tr></table>' || chr(10) || chr(10) || chr(10) || '![Figure](f.png)' || chr(10) || chr(10) || '![Figure 8](data:image/png;base64,iVBOR)' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS markdown FROM benchmark"""

# Answers made of a document's letters: with bullets and headings, without headers, without bullets, and an analysis alone.
LETTERS = "trim(concat('about ', substr(regexp_replace(text, '[^a-z]+', ' '), {0}, 60)))"
ANSWER = """CASE doc_id % 4
 WHEN 0 THEN concat('# Executive Summary\\n- ', a, '\\n• ', b, '\\n## Detailed Analysis\\n### First\\n', b, '\\n', c, '\\n### Empty\\n\\n### Second\\n', a, '\\n## References\\n- ', c)
 WHEN 1 THEN a WHEN 2 THEN concat('Executive Summary\\n', a, '\\n', b, '\\nDetailed Analysis\\n', c) ELSE concat('## Detailed Analysis: ', a, '\\n', b) END"""


def answer_sections(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "documents").selectExpr("doc_id", *[f"{LETTERS.format(at)} AS {name}" for name, at in (("a", 1), ("b", 61), ("c", 121))])
    found = parts.select("doc_id", markdown.answer_sections(F.expr(ANSWER)).alias("s"))
    return found.select("doc_id", F.array_join("s.summary", "|").alias("summary"), F.array_join(F.transform("s.details", lambda d: F.concat(d["title"], F.lit("="), d["content"])), "|").alias("details"))


ANSWERS_SQL = """WITH t AS (SELECT doc_id, regexp_replace(text, '[^a-z]+', ' ', 'g') AS t FROM documents),
s AS (SELECT doc_id, trim('about ' || substr(t, 1, 60)) AS a, trim('about ' || substr(t, 61, 60)) AS b, trim('about ' || substr(t, 121, 60)) AS c FROM t)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN a || '|' || b WHEN 1 THEN a WHEN 2 THEN a || chr(10) || b ELSE '' END AS summary,
CASE doc_id % 4 WHEN 0 THEN 'First=' || b || chr(10) || c || '|Second=' || a WHEN 1 THEN '' WHEN 2 THEN 'Detailed Analysis=' || c ELSE 'Detailed Analysis=: ' || a || chr(10) || b END AS details FROM s"""


def stripped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", strip(F.concat(F.lit(" \t  "), "text", F.lit("\n　 "))).alias("text"))


QUERIES = {
    "flatten_works": (flatten_works, f"WITH {WORKS_SQL} SELECT {', '.join(FLAT)} FROM f"),
    "best_pdf": (best_pdf, f"WITH {WORKS_SQL} SELECT 'W' || o_orderkey AS id, coalesce(best_oa_pdf_url, primary_pdf_url, locs[2]) AS url, CAST(len(urls) AS INT) AS urls FROM w"),
    "works_summary": (works_summary, f"""WITH {WORKS_SQL} SELECT count(*) AS total_works, count(*) FILTER (has_any_pdf) AS with_pdf, count(*) FILTER (NOT has_any_pdf) AS without_pdf, count(best_oa_pdf_url) AS with_best_oa_pdf, count(primary_pdf_url) AS with_primary_pdf,
        count(doi) AS with_doi, count(*) - count(doi) AS without_doi, min(publication_year) AS min_year, max(publication_year) AS max_year, round(avg(publication_year), 6) AS mean_year,
        sum(cited_by_count) AS total_citations, round(avg(cited_by_count), 6) AS mean_citations, round(median(cited_by_count), 6) AS median_citations, max(cited_by_count) AS max_citations FROM f"""),
    "works_rebuilt": (works_rebuilt, f"WITH {WORKS_SQL} SELECT openalex_id, title, CASE WHEN publication_year % 2 = 0 THEN num_locations ELSE 0 END AS num_locations, CASE WHEN publication_year % 2 = 0 THEN num_authors ELSE 0 END AS num_authors, best_oa_pdf_url, primary_pdf_url, cited_by_count FROM f"),
    "oa_status_counts": (oa_status_counts, f"WITH {WORKS_SQL} SELECT oa_status AS value, count(*) AS count FROM f GROUP BY 1"),
    "top_sources": (top_sources, f"WITH {WORKS_SQL} SELECT best_oa_source AS value, count(*) AS count FROM f WHERE best_oa_source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "works_with_pdf": (works_with_pdf, f"WITH {WORKS_SQL} SELECT openalex_id, num_pdf_urls FROM f WHERE has_any_pdf"),
    "typed_columns": (typed_columns, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS publication_year, event_id % 3 = 0 AS is_oa, TRY_CAST(event_type AS DOUBLE) AS concept_1_score FROM events"),
    "filter_maps": (filter_maps, "SELECT c_custkey, 'b:http://h:1,a:last' || (c_custkey % 3) AS filters FROM customer"),
    "unprocessed": (unprocessed, "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)"),
    "limited_to_do": (limited_to_do, "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) d ANTI JOIN labels USING (doc_id)"),
    "already_processed": (already_processed, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "modulo_shards": (modulo_shards, "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p % 7 = 2"),
    "slice_page": (slice_page, "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25 OFFSET 150"),
    "papers_with_metadata": (papers_with_metadata, "SELECT d.doc_id AS paper_id, CASE WHEN d.doc_id % 2 = 1 THEN d.doc_id || '.v1' WHEN toxic = 0 THEN 'A title' ELSE 'Unknown Title' END AS paper_title, length(text) AS length FROM documents d JOIN labels l USING (doc_id)"),
    "hourly_uploads": (hourly_uploads, "SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS files FROM events WHERE ts > TIMESTAMP '2024-01-19 12:30:00' GROUP BY 1 ORDER BY 1 DESC LIMIT 12"),
    "recent_rate": (recent_rate, "WITH h AS (SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS files FROM events WHERE ts > TIMESTAMP '2024-01-19 12:30:00' GROUP BY 1 ORDER BY 1 DESC LIMIT 3) SELECT round(avg(files), 6) AS files_per_hour, round(avg(files) / 35, 6) AS items_per_hour FROM h"),
    "newest_object": (newest_object, "SELECT arg_max('processed/' || event_id, {'t': ts, 'p': 'processed/' || event_id}) AS path FROM events"),
    "run_counters": (run_counters, """WITH s AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'no_url' WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'ok' END AS s FROM orders)
        SELECT o_orderpriority, count(*) AS found, count(*) FILTER (s = 'ok') AS downloaded, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'no_url') AS no_url, round(count(*) FILTER (s IN ('ok', 'skipped')) * 100.0::DOUBLE / count(*), 6) AS success_rate FROM s GROUP BY 1"""),
    "first_failures": (first_failures, "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 = 0 ORDER BY 1 LIMIT 10"),
    "props_json": (props_json, "SELECT event_id, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%d %H:00') AS hour FROM events"),
    "file_names": (file_names, f"""SELECT page_id, substr({_SAFE}, 1, 40) AS safe, string_split(url, '/')[-1] AS key, printf('%05d_W%d_', page_id, page_id) || CASE WHEN page_id % 2 = 0 THEN 'A_title' ELSE 'untitled' END || '.pdf' AS pdf,
        page_id % 3 = 0 OR url LIKE '%.pdf' AS is_pdf, CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END AS url FROM pages"""),
    "paper_ids": (paper_ids, "SELECT page_id, printf('%05d_W%d', page_id, page_id * 7) AS a, printf('%05d_W%d', page_id, page_id * 7) AS b, 'plain' || page_id AS c, 'plain' || page_id AS d, printf('processed/%05d_W%d/document.md', page_id, page_id * 7) AS key FROM pages"),
    "object_folders": (object_folders, "SELECT DISTINCT CAST(page_id % 17 AS VARCHAR) AS folder FROM pages WHERE page_id % 5 > 0"),
    "dois": (dois, "SELECT page_id, '10.1/x' || page_id AS doi FROM pages"),
    "quantities": (quantities, """WITH q AS (SELECT o_orderkey, o_orderkey * o_orderkey * 13 AS n FROM orders), r AS (SELECT *, n % 20000 AS d, n % 400000 AS s FROM q)
        SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.2f TB', n / 1099511627776.0::DOUBLE) END AS bytes,
        CASE WHEN d < 60 THEN printf('%.1fs', d::DOUBLE) WHEN d < 3600 THEN printf('%dm %ds', d // 60, d % 60) ELSE printf('%dh %dm %ds', d // 3600, d // 60 % 60, d % 60) END AS duration,
        CASE WHEN s < 60 THEN printf('%d seconds', s) WHEN s < 3600 THEN printf('%d minutes', s // 60) WHEN s < 86400 THEN printf('%d hours %d minutes', s // 3600, s // 60 % 60) ELSE printf('%d days %d hours', s // 86400, s // 3600 % 24) END AS span FROM r"""),
    "progress": (progress, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 100 = 0 THEN 0.0 ELSE (o_orderkey % 100)::DOUBLE END AS percent, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 100 = 0 THEN 0.0::DOUBLE ELSE round(50.0::DOUBLE / (o_orderkey % 100) * (100 - o_orderkey % 100), 6) END AS eta FROM orders"),
    "token_costs": (token_costs, f"""SELECT doc_id, CAST(length(text) // 4 AS INT) AS tokens, round((length(text) // 4) / 1000000::DOUBLE * CASE doc_id % 4 WHEN 0 THEN 0.13 WHEN 1 THEN 0.02 ELSE 0.10 END, 12) AS cost, CAST(CASE doc_id % 4 WHEN 0 THEN 3072 ELSE 1536 END AS INT) AS dimension FROM documents"""),
    "html_tables": (html_tables, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<table><tr><td>1</td></tr></table>' || chr(10) || '<table><tr>' || chr(10) || '<td>2</td></tr></table>' ELSE '' END AS tables FROM pages"),
    "layout_parse": (layout_parse, LAYOUT_SQL),
    "elements_markdown": (elements_markdown, ELEMENTS_SQL),
    "answer_sections": (answer_sections, ANSWERS_SQL),
    "stripped": (stripped, "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations"),
}
