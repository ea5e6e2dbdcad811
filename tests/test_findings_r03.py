"""What the review of round 3 found."""

import time
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from scriptorium.functions import vectors
from scriptorium.functions.models import HashedWords
from scriptorium.operators import evaluation, sparse, works
from scriptorium.plans import chunks, fixtures


def test_boundary_sentences_keep_digits_of_their_place(spark):
    """The sentence of place 1 starts and ends with 1, that of place 0 with 0; spaces at either end go."""
    texts = ["00 starts and ends with 0. 11 is at place one and ends with 11", " 0 is first in the next chunk 0 . 1 is last of it, so far away 1 ", "  0 and this is the end of it 00"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, i int, text string")
    got = {r["i"]: (r["last"], r["first"]) for r in evaluation.boundary_pairs(rows, ["doc_id"], ["i"]).collect()}
    assert got == {0: ("11 is at place one and ends with 11", "0 is first in the next chunk 0"), 1: ("1 is last of it, so far away 1", "0 and this is the end of it 00")}


def test_boundary_scores_count_digits_for_the_least_length(spark):
    """A sentence of 20 characters at place 1 with a 1 at its start is long enough."""
    rows = spark.createDataFrame([(1, 0, "A first one. 1" + "a" * 19), (1, 1, "e" * 20)], "doc_id long, i int, text string")
    got = evaluation.boundary_quality(rows, ["doc_id"], ["i"], fixtures.LetterCounts).select("i", F.round("boundary", 6)).collect()
    assert [r["i"] for r in got] == [0]


def test_works_are_parsed_and_rebuilt_once_a_row(spark, data):
    """Filters on a record and uses of its flat columns don't copy the expressions that make them."""
    flat = works.flatten(fixtures.works(spark, data)).withColumn("full_json", F.when(F.col("publication_year") % 2 == 0, F.col("full_json")))
    plan = works.flatten(works.rebuilt(flat), full_json=False).select("title", "num_authors", "cited_by_count")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 3  # the record, the full record and the record from flat columns


def test_unreadable_works_stay_null_and_rejected(spark):
    """Generators keep rows without a record."""
    got = works.parse_works(spark.createDataFrame([(1, None), (2, "{"), (3, '{"id": "a/W1", "open_access": {}}')], "n int, json string"))
    assert {r["n"]: r["rejected"] for r in got.collect()} == {1: True, 2: True, 3: False}
    flat = works.flatten(got, full_json=True).withColumn("full_json", F.lit(None).cast("string"))
    assert [r["work"]["id"] for r in works.rebuilt(flat).select("work").collect()] == ["a/W1"] and flat.count() == 3


def test_unit_vectors_take_their_norm_once(spark):
    """A long vector takes the time of its length, not of its square; null and zero vectors stay."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "n int, v array<float>")
    got = {r["n"]: r["u"] for r in rows.select("n", vectors.normalized("v").alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}
    began = time.monotonic()
    long = spark.range(1).select(vectors.normalized(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double"))).alias("u")).first()["u"]
    assert time.monotonic() - began < 20 and abs(sum(x * x for x in long) - 1) < 1e-9


def test_hashed_words_remember_a_bounded_number(monkeypatch):
    """The vectors are those of each word hashed anew, whatever is remembered."""
    texts = ["a b A  c", "", None, " ".join(f"w{i}" for i in range(50)) * 2, "x " * 300]
    plain = np.zeros((len(texts), 256))
    for row, text in zip(plain, texts, strict=True):
        for word in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            row[(h >> 1) % 256] += 1 if h & 1 else -1
    length = np.linalg.norm(plain, axis=1, keepdims=True)
    plain = np.divide(plain, length, out=plain, where=length > 0)
    model = HashedWords()
    monkeypatch.setattr(HashedWords, "MOST_WORDS", 7)
    assert np.allclose(model(texts), plain, atol=1e-6) and np.allclose(model(texts), plain, atol=1e-6) and len(model.places) <= 7


def test_parts_of_sparse_scores_are_summed_where_postings_are(spark, data, monkeypatch):
    """Between the join of queries with postings and the scores nothing is shuffled; with more queries than are broadcast, the hits are the same."""
    docs = fixtures.documents(spark, data)
    items = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id AS query_id", "text")
    index = sparse.build(docs, block_docs=64)
    few = {tuple(r) for r in sparse.bm25(index, items, 10).collect()}
    asked, first, _, _ = sparse._goals(index, items, 10)
    plan = sparse._scored(asked, first, index)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count("REPARTITION_BY_NUM") == 1
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in sparse.bm25(index, items, 10).collect()} == few and len(few) > 10


def test_sparse_index_is_written_without_shuffling_postings(spark, data):
    """Blocks are made where texts are read: all that is shuffled are sums. Each term has a row a block, and its postings are those of the texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")

    def shuffled() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    docs.count()
    before = shuffled()
    index = sparse.build(docs, block_docs=64)
    assert shuffled() - before < 20_000
    assert index.lists.groupBy("term", "block").count().where("count > 1").count() == 0
    got = {(r["term"], r["doc_id"]) for r in index.postings.select("term", "doc_id").collect()}
    plain = docs.select("doc_id", F.explode(sparse.words("text")).alias("term")).distinct().collect()
    assert got == {(r["term"], r["doc_id"]) for r in plain}


def test_boundary_scores_equal_their_sql_around_the_least_length(spark, tmp_path):
    """Sentences of 17 to 22 characters, with digits of their place and spaces at either end, score as the SQL says."""
    rng = np.random.default_rng(4)

    def sentence() -> str:
        ends = ["", " ", "  ", "0", "1", "2", "10", " 1", "0 "]
        return rng.choice(ends) + "".join(rng.choice(list("aen x012"), rng.integers(15, 23))) + rng.choice(ends)

    rows = [(i, "\n".join(". ".join(sentence() for _ in range(rng.integers(1, 4))) for _ in range(6)), "s", "en", 0) for i in range(80)]
    spark.createDataFrame([*rows, (80, None, "s", "en", 0), (81, "", "s", "en", 0)], "doc_id long, text string, source string, lang string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    run, sql = chunks.QUERIES["boundary_scores"]
    want = Counter(con.execute(sql).fetchall())
    assert Counter(map(tuple, run(spark, str(tmp_path)).collect())) == want and want.total() > 100


def _differences(spark, folder: str, name: str, texts: list[str]) -> tuple[int, int, int]:
    """Rows of a chunk query's SQL over these documents, those that Spark lacks, and those that only Spark has."""
    rows = [(i, t, "s", "en", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    run, sql = chunks.QUERIES[name]
    want, got = Counter(con.execute(sql).fetchall()), Counter(map(tuple, run(spark, folder).collect()))
    return want.total(), (want - got).total(), (got - want).total()


def test_boundary_queries_have_the_white_space_of_their_sql(spark, tmp_path):
    """Spaces of Unicode end no sentence but are trimmed, the vertical tab does neither, U+001F cuts."""
    rng = np.random.default_rng(5)
    letters = list("aenx aenx .!?") + [*"\t\x0b\f\r\x1c\x85\xa0\u1680\u180e\u2003\u2028\u202f\u205f\u3000\u200b\ufeff"]
    texts = ["\n".join("".join(rng.choice(letters, rng.integers(20, 60))) for _ in range(5)) for _ in range(100)]
    texts += [t.replace("x", "\x1f", 1) for t in texts[:50]]
    for name in ("boundary_pairs", "boundary_scores"):
        rows, missing, extra = _differences(spark, f"{tmp_path}/{name}", name, texts)
        assert rows > 100 and (missing, extra) == (0, 0), name


def test_boundary_scores_are_those_of_their_sql_to_the_last_bit(spark, tmp_path):
    """The first pairs' cosines are nearly 0.9564175 and were rounded to the other side; the rest differed in their last bits."""
    line = lambda a, e, n: "a" * a + "e" * e + "n" * n
    first = [(131, 149, 101, 296, 199, 285), (101, 149, 131, 285, 199, 296), (149, 131, 101, 199, 296, 285), (149, 101, 131, 199, 285, 296)]
    texts = [f"{line(*p[:3])}\n{line(*p[3:])}" for p in [*first, *np.random.default_rng(6).integers(10, 60, (200, 6)).tolist()]]
    assert _differences(spark, str(tmp_path), "boundary_scores", texts) == (204, 0, 0)
    lines = fixtures.documents(spark, str(tmp_path)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    got = {r["doc_id"]: r["boundary"] for r in evaluation.boundary_quality(lines, ["doc_id"], ["i"], fixtures.LetterCounts).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(f"SELECT doc_id, boundary FROM ({chunks.boundary_sql(chunks.LINES_SQL, 'doc_id', 'i')})").fetchall())


def test_boundary_scores_round_the_product_as_their_sql_does(spark, tmp_path, monkeypatch):
    """Near a tie, the cosine's digits and its product by a million can lie on different sides; whatever the cosine is, the SQL's rounding holds."""
    near = (np.random.default_rng(7).integers(0, 1_000_000, 3000) + 0.5) / 1e6
    near = np.concatenate([near, np.nextafter(near, 0), np.nextafter(near, 1)]).tolist()
    rows = spark.createDataFrame(list(enumerate(near)), "doc_id long, boundary double").withColumn("i", F.lit(0))
    monkeypatch.setattr(fixtures, "documents", lambda *_: spark.createDataFrame([(0, "")], "doc_id long, text string"))
    monkeypatch.setattr(evaluation, "boundary_quality", lambda *_, **__: rows)
    got = {r["doc_id"]: r["boundary"] for r in chunks.boundary_scores(spark, str(tmp_path)).collect()}
    want = duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [near]).fetchall()
    assert [got[i] for i in range(len(near))] == [x for x, in want]
