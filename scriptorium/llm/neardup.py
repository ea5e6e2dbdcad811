"""MinHash near-duplicate detection with tensored banding.

Each document has two collections of ``bands`` keys, each key made of two minhashes. A table key is a
pair of one key from either collection, so ``bands**2`` tables of four minhashes each come from
``4 * bands`` minhashes, where plain banding would take ``4 * bands**2``. A pair of similarity s misses all
tables only if one collection has no key in common: chance ``2 * (1 - s**2)**bands`` at most.

Documents with equal shingle sets are one node from the start. Documents that share no key of
either collection drop out before tables are formed. A table bucket is never paired with itself:

1. Each bucket has a hub h, the member found most often in other buckets, and every member x meets the
   hub alone, on full sets. That also gives x's differences from h: r shingles of h it lacks and n
   of its own.
2. For two members x, y of hub h that have s differences in common, the intersection is
   ``|h| - r_x - r_y + s`` and the union ``|h| + n_x + n_y - s``, exactly. Members linked with the hub are
   connected already. Each other, open member is compared with all members of its hub by counting common
   differences in inverted lists; only links come out. A hub's open members and its members are dealt into blocks
   of bounded size, and a task compares one block of open members with one of members, so the work of a
   hub is spread over tasks. It grows with open members times members, not with the members' square: members that
   are linked with their hub, most of a group of near copies, are never compared with one another.

So every pair that shares a bucket is decided exactly, and pairs that miss the threshold make no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, discard, mix, shingle_hashes, stored, tidy, words_plain

#: Differences (8 bytes each) in a block of a hub's members, a task compares two blocks. Smaller groups are dealt out too, into
#: SPREAD blocks at most, as soon as a block has BLOCK_ROWS members.
BLOCK, BLOCK_ROWS, SPREAD = 750_000, 256, 8
#: Ids are broadcast up to this count (8 bytes each, and numbers with some), and joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it has BROADCAST_IDS rows at most."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of the whole sequence where there are fewer."""
    words = hashes.of(words_plain(text))
    size = min(k, len(words))
    return np.unique(shingle_hashes(words, size) ^ np.uint64(size * 0x9E37)) if size else np.empty(0, np.uint64)


def minhashes(h: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhashes of a set that isn't empty."""
    j = np.arange(1, count + 1, dtype=np.uint64)
    xor, times = mix(j)[:, None], (mix(j + np.uint64(1 << 32)) | np.uint64(1))[:, None]
    low = None
    for at in range(0, len(h), 4096):  # bounded memory for long texts
        part = ((h[at : at + 4096][None, :] ^ xor) * times).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(h: np.ndarray, bands: int) -> np.ndarray:
    """2 * bands keys, the first collection before the second."""
    m = minhashes(h, 4 * bands)
    return mix(m[0::2] * np.uint64(0x9E3779B97F4A7C15) + mix(m[1::2]))


def signature(h: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed longs."""
    pair = np.array([mix(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h + np.uint64(77)))], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


SKETCH = "doc_id long, n long, sig1 long, sig2 long, u array<long>, v array<long>"
NO_SHINGLES = (None, None)


def sketches(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(doc_id, text) rows to sizes, signatures and band keys; null and wordless texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, sig1, sig2, u, v = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                h = shingle_set(text.as_py() or b"", k, hashes)
                n.append(len(h))
                if len(h):
                    a, b = signature(h)
                    keys = band_keys(h, bands).view(np.int64)
                    u.append(keys[:bands])
                    v.append(keys[bands:])
                else:
                    a = b = None
                    u.append(None)
                    v.append(None)
                sig1.append(a)
                sig2.append(b)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig1, pa.int64()), pa.array(sig2, pa.int64()), pa.array(u, longs), pa.array(v, longs)],
                ["doc_id", "n", "sig1", "sig2", "u", "v"],
            )

    return docs.mapInArrow(tidy(run), SKETCH)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, sig1, sig2, text) rows to (node, shingles) where the text has that signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for node, a, b, text in zip(*batch.columns[:3], batch.column(3).cast(pa.binary()), strict=True):
                h = shingle_set(text.as_py() or b"", k, hashes)
                if len(h) and signature(h) == (a.as_py(), b.as_py()):
                    nodes.append(node.as_py())
                    sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(tidy(run), "node long, shingles array<long>")


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(_doc, _text) rows with the signature of the text's shingles as ``_sig1`` and ``_sig2``; null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", k, hashes) for t in batch.column(1).cast(pa.binary())]
            sigs = [signature(h) if len(h) else NO_SHINGLES for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[i] for x in sigs], pa.int64()) for i in (0, 1)]], ["_doc", "_sig1", "_sig2"])

    return docs.mapInArrow(tidy(run), StructType([docs.schema["_doc"], StructField("_sig1", LongType()), StructField("_sig2", LongType())]))


def table_members(nodes: DataFrame) -> DataFrame:
    """(key, node) of the tables, for nodes that share a key of either collection with another node."""

    def shared(column: str) -> DataFrame:
        keys = nodes.select("node", F.posexplode(column).alias(f"{column}_i", f"{column}_key"))
        on = [f"{column}_i", f"{column}_key"]
        return keys.join(keys.groupBy(on).agg(F.count("*").alias("c")).where("c > 1"), on, "left_semi")

    return shared("u").join(shared("v"), "node").select(F.xxhash64("u_i", "v_i", "u_key", "v_key").alias("key"), "node")


def merged(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of (x, y) links, by label passing and pointer jumping."""
    edges = stored(links.union(links.select("y", "x")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)")).alias("s")
    before = labels.agg(total).first()["s"]
    while before is not None:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("low"))
        own = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("of"), F.col("label").alias("above"))
        jumped = stored(own.join(up, own["label"] == up["of"], "left").select("node", F.least("label", "above").alias("label")), "labels")
        discard(labels)
        labels, now = jumped, jumped.agg(total).first()["s"]
        if now == before:
            break
        before = now
    discard(edges)
    return labels


def compared(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(node, hub) pairs with linked, the hub's size, and the node's differences: r, n and ``apart``, with lacking shingles negated bitwise.

    A hub of more than BLOCK_ROWS members has its set repeated for each of its parts, among which the members are dealt.
    """
    parts = bounded(stored(pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).where("parts > 1"), "large-hubs"))
    n_parts = F.coalesce("parts", F.lit(1))
    left, right = (shingles.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("node", "hub"))
    right = right.join(parts, "hub", "left").withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).drop("parts")
    dealt = pairs.join(parts, "hub", "left").select("node", "hub", F.pmod(F.xxhash64("node"), n_parts).cast("int").alias("part"))
    lacking, own = F.array_except("s_hub", "s_node"), F.array_except("s_node", "s_hub")
    sized = dealt.join(left, "node").join(right, ["hub", "part"]).select("node", "hub", F.size("s_hub").alias("size"), lacking.alias("lacking"), own.alias("own"))
    r, n = F.size("lacking"), F.size("own")
    apart = F.concat(F.transform("lacking", F.bitwise_not), "own")
    return sized.select("node", "hub", "size", r.alias("r"), n.alias("n"), (100 * (F.col("size") - r) >= percent * (F.col("size") + n)).alias("linked"), apart.alias("apart"))


def blocks_of(members: Column, differences: Column) -> Column:
    """Blocks for so many members with so many differences."""
    by_rows = F.least(F.lit(SPREAD), F.ceil(members / BLOCK_ROWS))
    return F.greatest(F.lit(1), by_rows, F.ceil(differences / BLOCK)).cast("int")


def links_within(spokes: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between members of one hub of which one at least has no link with the hub."""
    open_ = ~F.col("linked")
    length = F.size("apart")
    hubs = spokes.groupBy("hub").agg(
        F.count("*").alias("members"), F.sum(length).alias("total"), F.count_if(open_).alias("open"), F.sum(F.when(open_, length)).alias("open_total")
    )
    hubs = hubs.where("open > 0 AND members > 1").select("hub", blocks_of(F.col("members"), F.col("total")).alias("rows"), blocks_of(F.col("open"), F.col("open_total")).alias("columns"))
    known = spokes.join(bounded(stored(hubs, "open-hubs")), "hub").withColumns({"own": F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), "own_open": F.pmod(F.xxhash64("node"), F.col("columns")).cast("int")})
    n_tasks = int(spokes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = ["hub", "a", "b", "rows", "node", "size", "r", "n", "linked", "asks", "apart"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answers = known.withColumns({"a": each("columns"), "b": F.col("own"), "asks": F.lit(False)}).select(*body)
    asks = known.where(open_).withColumns({"a": F.col("own_open"), "b": each("rows"), "asks": F.lit(True)}).select(*body)

    def links(table: pa.Table) -> pa.Table:
        node, size, r, n = (table[c].to_numpy() for c in ("node", "size", "r", "n"))
        linked, asks = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("linked", "asks"))
        apart = table["apart"].combine_chunks()
        lengths = r + n
        stops = np.cumsum(lengths)
        element = np.unique(apart.flatten().to_numpy(), return_inverse=True)[1].reshape(-1).astype(np.int32)
        answer = np.flatnonzero(~asks)
        place = np.cumsum(~asks, dtype=np.int32) - 1  # of an answering row among these
        kept = np.repeat(~asks, lengths)
        listed = element[kept]
        owner = np.repeat(place, lengths)[kept][np.argsort(listed, kind="stable")]
        ends = np.cumsum(np.bincount(listed, minlength=int(element.max(initial=0)) + 1))
        a_node, a_r, a_n, a_open = node[answer], r[answer], n[answer], ~linked[answer]
        xs, ys = [], []
        for i in np.flatnonzero(asks).tolist():
            lists = [owner[ends[e - 1] if e else 0 : ends[e]] for e in element[stops[i] - lengths[i] : stops[i]].tolist()]
            common = np.bincount(np.concatenate(lists), minlength=len(answer)) if lists else np.zeros(len(answer), np.int64)
            hit = 100 * (size[i] - r[i] - a_r + common) >= percent * (size[i] + n[i] + a_n - common)
            hit &= (a_node > node[i]) | ((a_node < node[i]) & ~a_open)  # two open members ask each other: one answer is enough
            near = a_node[hit]
            xs += [node[i]] * len(near)
            ys += near.tolist()
            if len(xs) > 4 * len(node):  # a forest of the links is enough
                xs, ys = forest(xs, ys)
        xs, ys = forest(xs, ys)
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    task = F.pmod(F.xxhash64("hub") % n_tasks + F.col("a").cast("long") * F.col("rows") + F.col("b"), F.lit(n_tasks)).cast("int")
    dealt = answers.unionByName(asks).withColumn("task", task).repartitionById(n_tasks, F.col("task"))  # a hub's blocks go to tasks one after another
    return dealt.groupBy("task", "hub", "a", "b").applyInArrow(links, "x long, y long").distinct()


def forest(xs: list[int], ys: list[int]) -> tuple[list[int], list[int]]:
    """A subset of links that connects the same nodes, with fewer links than nodes."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    kept = []
    for x, y in zip(xs, ys, strict=True):
        a, b = root(int(x)), root(int(y))
        if a != b:
            parent[a] = b
            kept.append((int(x), int(y)))
    return [x for x, _ in kept], [y for _, y in kept]


def _grouped(docs: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """A stored row for each (doc_id, text) row: doc_id, n, sig1, sig2 and the component's smallest id."""
    rows = stored(sketches(docs, k, bands), "sketches")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig1", "sig2")
    distinct = sets.agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "u", "v")])
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, as they are stored

    keyed = stored(table_members(nodes), "members")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keyed.join(sizes, "key")
    popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
    members = stored(shared.join(popular, "node").select("key", "node", "popular"), "members")
    discard(keyed)
    active = stored(members.select("node").distinct(), "active")
    wanted = bounded(stored(nodes.join(active, "node", "left_semi").select("node", "rep", "sig1", "sig2"), "wanted"))
    texts = docs.join(wanted, docs["doc_id"] == F.col("rep")).select("node", "sig1", "sig2", "text")
    shingles = stored(full_sets(texts, k).dropDuplicates(["node"]), "shingles")
    discard(active)
    hubs = members.groupBy("key").agg(F.max_by("node", F.struct("popular", -F.col("node"))).alias("hub"))
    pairs = stored(members.join(hubs, "key").where("node <> hub").select("node", "hub").distinct(), "pairs")
    discard(members)
    spokes = stored(compared(pairs, shingles, percent), "spokes")
    discard(pairs)
    discard(shingles)
    links = spokes.where("linked").select(F.col("node").alias("x"), F.col("hub").alias("y"))
    labels = merged(links.unionByName(links_within(spokes, percent)))
    discard(spokes)

    least = labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    found = nodes.join(labels.join(least, "label"), "node", "left").select("sig1", "sig2", F.coalesce("least", "rep").alias("component"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = stored(rows.select("doc_id", "n", "sig1", "sig2").join(found, ["sig1", "sig2"], "left").withColumn("component_id", alone).drop("component"), "groups")
    for used in (rows, nodes, labels):
        discard(used)
    return out


KEPT = "coalesce(doc_id = component_id, true)"


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id and kept.

    Texts are linked where ``100 * intersection >= percent * union`` of their shingle sets (A-Z
    lower-cased, words ended by ASCII white space, runs of ``k`` words). component_id is the
    smallest id reachable by links, kept says that it is the row's own. Null and wordless texts have
    no shingles and no links. Rows with one id and different texts are different documents, each with its own links.
    A row whose id is null is linked with nothing: null component_id, kept. An empty table gives no rows;
    other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(docs, k, percent, bands).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr(KEPT).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 10) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, of the smallest id.

    Where an id repeats, rows go by id and text: of equal ones (in shingles) one stays if the group's document is of their id.
    """
    found = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent, bands)
    again = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    gone = stored(found.where(f"NOT {KEPT}").select("doc_id").distinct(), "gone")
    gone, n_again = bounded(gone), again.count()
    columns = docs.columns
    if not n_again:
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    once = docs.join(bounded(again), "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*columns)
    repeated = docs.join(bounded(again), "doc_id", "left_semi").select(F.struct(*columns).alias("_doc"), F.col("text").alias("_text"))
    stay = found.join(bounded(again), "doc_id", "left_semi").where(KEPT).select("doc_id", "sig1", "sig2").distinct()
    same = (F.col("_doc.doc_id") == F.col("doc_id")) & F.col("_sig1").eqNullSafe(F.col("sig1")) & F.col("_sig2").eqNullSafe(F.col("sig2"))
    of_group = signed(repeated, k).join(stay, same).groupBy("doc_id", "sig1", "sig2").agg(F.first("_doc").alias("_doc"))
    return once.unionByName(of_group.select("_doc.*").select(*columns))
