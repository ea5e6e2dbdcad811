"""The queries of the training-data operators, as ``__spark_entry__`` registers them, and their SQL."""

from __future__ import annotations

import importlib.util
import math
import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, chat, decontaminate, exactdedup, langid, license_scan, media, mixing, neardup, quality, runs, shard, token_output
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file: in $TOKENIZER_DIR, else in the installed ``public_tokenizers``."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        raise FileNotFoundError("set TOKENIZER_DIR to the folder of the tokenizers' files")
    return os.path.join(spec.submodule_search_locations[0], name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    media.text_images(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    pages = media.sequences(stored.select("doc_id", "n_bytes", "html"), ["doc_id", "n_bytes"])
    found = media.resolved(pages, ["doc_id", "n_bytes"], media.image_features(stored))
    image = F.col("pieces")[1]
    fields = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select("doc_id", "n_bytes", *[image["media"][c].alias(c) for c in fields], image["caption"].alias("caption"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), vocabulary())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.held_out(), F.lit(False))
    model = langid.fitted(docs.where(~langid.held_out()))
    return langid.predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), seed=7)


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard_documents(table(spark, sf_dir, "documents"), n_shards=16, seed=shard_seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position"
    )


shard_seed = 20_240_601


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten has a period from some word on, by the CRC-32 of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * (-(-(n - a) // p)))[:n]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=planted_period)
    best = F.expr("aggregate(runs, get(runs, 0), (m, r) -> IF(r.length * m.period > m.length * r.period, r, m))")  # exact; the first of equals
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", "runs", best.alias("best"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )


#: Words a period apart that are equal make stretches; CRC-32 by its table, byte by byte.
RUNS_SQL = r"""
WITH k AS (SELECT list(v ORDER BY i) AS k FROM (SELECT i, list_reduce(range(8), lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END, i) AS v FROM range(256) z(i))),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda u, v: xor(u >> 8, k[(xor(u, v) & 255) + 1]), 4294967295::BIGINT)) AS h FROM documents, k),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS m FROM d),
t AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) ELSE w END AS w FROM g),
e AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM p)
      GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
o AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.doc_id = r.doc_id AND (z.length * r.period > r.length * z.period
        OR z.length * r.period = r.length * z.period AND (z.start, z.period) < (r.start, r.period)))),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` have no date: rows whose id has an even CRC-32 are the history, all others the arriving batch."""
    found = exactdedup.exact_duplicates(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    return found.drop("known")


#: What is kept is the same for history and batch, however they are split.
EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op11_periodic_runs": op11_periodic_runs, "op12_exact_dedup": op12_exact_dedup, "op13_tokenizer_alignment": op13_tokenizer_alignment, "op1_license_scan": op1_license_scan, "op10_near_duplicates": op10_near_duplicates, "op2_media_columns": op2_media_columns, "op3_token_output": op3_token_output, "op4_decontaminate": op4_decontaminate, "op5_feistel_shards": op5_feistel_shards, "op6_language_id": op6_language_id, "op7_poisson_mixing": op7_poisson_mixing, "op8_chat_collapse": op8_chat_collapse, "op9_quality": op9_quality}


def license_sql() -> str:
    """Phrases by consecutive words; templates by comparing every line, and every window over a line's end, with every template.

    A window has a line's last words and the next words of the text, on either side ``reach`` at most. Of a block's matches,
    those go whose words are all words of a better one; then those of windows that a line's or another window's match explains.
    """
    templates = []
    for i, (label, template) in enumerate(license_scan.TEMPLATES):
        words = license_scan.words_of(template)
        templates.append(f"({i}, '{label}', [{', '.join(repr(w) for w in words)}], {math.ceil(0.8 * len(words) - 1e-9)})")
    reach = max(len(license_scan.all_words(t)) for _, t in license_scan.TEMPLATES) - 1
    starts = []
    for phrase, label in license_scan.PHRASES:
        words = phrase.split()
        same = " AND ".join(f"w[i+{k + 1}] = '{word}'" for k, word in enumerate(words))
        starts.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    pattern, low = license_scan.WORD, f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"
    return f"""
WITH t(id, label, template, need) AS (VALUES {', '.join(templates)}),
d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{pattern}') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, list_concat({', '.join(starts)}) AS s FROM w),
l AS (SELECT r, i - 1 AS block, regexp_extract_all(lines[i], '{pattern}') AS own
      FROM (SELECT r, string_split(low, chr(10)) AS lines FROM d) x, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) y),
e AS (SELECT *, CAST(sum(len(own)) OVER (PARTITION BY r ORDER BY block) AS BIGINT) AS stop FROM l WHERE len(own) > 0),
u AS (SELECT r, flatten(list(own ORDER BY block)) AS w, flatten(list(list_transform(own, lambda x: block) ORDER BY block)) AS line FROM e GROUP BY r),
b AS (SELECT r, block, block AS last, false AS wrapped, list_distinct(own) AS words, [] AS rest FROM e
      UNION ALL
      SELECT r, block, line[least(stop + {reach}, len(w))], true,
             list_distinct(w[greatest(stop - len(own), stop - {reach}) + 1 : stop + {reach}]), list_distinct(w[stop + 1 : stop + {reach}])
      FROM e JOIN u USING (r) WHERE stop < len(w)),
m AS (SELECT r, block, last, wrapped, id, label, len(template) AS size, list_intersect(words, template) AS found, len(list_intersect(words, template)) / len(template) AS containment
      FROM b, t WHERE len(list_intersect(words, template)) >= need AND (NOT wrapped OR len(list_intersect(rest, template)) < len(list_intersect(words, template)))),
f AS (SELECT * FROM m WHERE NOT EXISTS (
        SELECT 1 FROM m o WHERE o.r = m.r AND o.block = m.block AND o.wrapped = m.wrapped AND (o.containment, o.size, o.label, o.id) > (m.containment, m.size, m.label, m.id)
        AND list_has_all(o.found, m.found))),
k AS (SELECT * FROM f WHERE NOT wrapped OR NOT EXISTS (
        SELECT 1 FROM f o WHERE o.r = f.r AND o.block <= f.last AND o.last >= f.block
        AND CASE WHEN o.wrapped THEN o.id = f.id AND (o.containment > f.containment OR o.containment = f.containment AND o.block < f.block)
                 ELSE 2 * (len(f.found) - len(list_intersect(f.found, o.found))) < len(f.found) END)),
a AS (SELECT r, list(label) AS labels, max(containment) AS containment, count(*) AS n FROM k GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(s) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(s, lambda x: x.at)) AS BIGINT) AS first_word,
       CAST(list_max(list_transform(s, lambda x: x.at)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(s, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score,
       CAST(coalesce(n, 0) AS BIGINT) AS n_matches
FROM p LEFT JOIN a USING (r)"""


#: All runs of five words of documents against those of items; items have five words at least here.
CONTAINMENT_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM documents),
g AS (SELECT r, doc_id, p, array_to_string(w[p+1:p+5], ' ') AS g FROM w, LATERAL (SELECT unnest(range(0, len(w) - 4)) AS p) x),
v AS (SELECT item_id, regexp_extract_all(translate(text, '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[p+1:p+5], ' ') AS g FROM v, LATERAL (SELECT unnest(range(0, len(w) - 4)) AS p) x),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(DISTINCT g) AS n_shared, count(DISTINCT g)::DOUBLE / n_item AS containment,
       min(p) AS first_word, max(p) + 4 AS last_word
FROM g JOIN i USING (g) JOIN n USING (item_id) GROUP BY r, doc_id, item_id, n_item HAVING 100 * count(DISTINCT g) >= 80 * n_item"""

#: Rates stay below 16 in these tables, so each document has one draw.
MIXING_SQL = """
WITH RECURSIVE s AS (SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(bytes) AS bytes, sum(pow(bytes::DOUBLE, 0.5)) AS weight FROM s),
r AS (SELECT source, round(pow(s.bytes::DOUBLE, 0.5) / t.weight * t.bytes::DOUBLE / s.bytes, 9) AS rate FROM s, t),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < 96),
d AS (SELECT *, (('0x' || md5('7:' || doc_id || ':1')[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, d.source, any_value(d.n_chars) AS n_chars, c.rate, count(*) AS n
      FROM d JOIN c ON c.source = d.source AND c.c <= d.u GROUP BY d.doc_id, d.source, c.rate)
SELECT doc_id, text, lang, source, n_chars, rate, copy::INTEGER AS copy, md5('7/order:' || doc_id || ':' || copy) AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS copy) x"""


#: Conversations as lists of turns; a longer one with the same first turns makes one a snapshot.
CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
      UNION ALL SELECT NULL, [{'role': role, 'text': text}] FROM t WHERE conv_id IS NULL),
u AS (SELECT min(conv_id) AS conv_id, l, count(*) AS copies FROM c GROUP BY l)
SELECT conv_id, len(l) AS n_turns, copies,
       list_aggregate(list_transform(l, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.l[1] = u.l[1] AND len(o.l) > len(u.l) AND o.l[1:len(u.l)] = u.l)"""


#: Links by joining shingles of whole texts, components by following links.
NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(len(w) - 2), lambda p: array_to_string(w[p+1:p+3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id AND r.c < l.y)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""


def shard_sql(n_shards: int = 16) -> str:
    """Row numbers by id, the network's rounds one after another, and walks by recursion; CRC-32 by its table, byte by byte."""
    p, inner = shard.PRIME, "SELECT row, x, step, a, b, n, x // b AS l, x % b AS r FROM walk WHERE step = 0 OR x >= n"
    for i, (k1, k2) in enumerate(shard.round_keys(shard_seed)):
        v, into, size = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        other = v
        inner = f"SELECT * EXCLUDE (f), f FROM (SELECT *, ((({v} + {k1}) % {p}) * (({v} + {k1}) % {p}) + {k2}) % {p} AS f FROM ({inner}))"
        inner = f"SELECT row, x, step, a, b, n, ({into} + ((((f + {v}) % {p}) * ((f + {v}) % {p}) + f) % {p})) % {size} AS {into}, {other} FROM ({inner})"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS root FROM d),
m AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, root, unnest(range(root, root + 1024)) AS a FROM c) ORDER BY a * ((n + a - 1) // a), a LIMIT 1),
walk(row, x, step, a, b, n) AS (SELECT row, row, 0, a, b, n FROM d, m UNION ALL SELECT row, l * b + r, step + 1, a, b, n FROM ({inner})),
e AS (SELECT row, x AS position FROM walk WHERE step > 0 AND x < n),
k AS (SELECT list(v ORDER BY i) AS k FROM (SELECT i, list_reduce(range(8), lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END, i) AS v FROM range(256) z(i))),
h AS (SELECT row, doc_id, octet_length(t) AS size, list_transform(range(0, octet_length(t)), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT) AS bytes FROM d)
SELECT doc_id, size + 1 AS size, CASE WHEN size = 0 THEN 0 ELSE xor(4294967295, list_reduce(bytes, lambda u, v: xor(u >> 8, k[(xor(u, v) & 255) + 1]), 4294967295::BIGINT)) END AS text_crc32,
       'rows' AS law, CAST(position % {n_shards} AS INT) AS shard, position // {n_shards} AS slot, NULL::INT AS grown_shard, position
FROM h JOIN e USING (row), k"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_sql(), "op4_decontaminate": CONTAINMENT_SQL, "op5_feistel_shards": shard_sql(), "op7_poisson_mixing": MIXING_SQL,
        "op8_chat_collapse": CHAT_SQL, "op11_periodic_runs": RUNS_SQL, "op12_exact_dedup": EXACT_SQL, "op10_near_duplicates": NEAR_SQL,
    }
