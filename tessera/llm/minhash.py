"""MinHash near-dedup with BagMinHash signatures of weighted shingle bags.

A document is the multiset of its runs of SHINGLE words (white-space words, unchanged; a text of fewer words
is one shingle). For each shingle and each level of the discretised weights ((0, 1], (1, 2], (2, 4], (4, 8] ...)
a Poisson process, seeded by both, throws points at signature components; a point counts if its place in the
level's interval lies within the shingle's weight. Texts that share weight share points, so that the earliest
points of a component agree with a probability that is the weighted Jaccard similarity. Processes run up to a
horizon by which all components are likely hit; texts with an unhit component run on.

BANDS bands of ROWS components make buckets (a pair at similarity 0.8 shares none with a probability of 3e-6).
Equal texts become one row first. In each bucket every text is verified against the bucket's least one, on
exact multiset overlap, then (HUB_ROUNDS times) against the text with most links so far, which the copies of
one original have in common. What is still unconnected within a bucket of three texts or more is compared in blocks
inside tasks, pair by pair, where only found links leave the task; so within buckets no link is lost,
whatever their size, and no list of all pairs is made. Connected components give the classes.

Texts that are null or have no words are classes of their own. Repeated rows and ids each get their row; the
kept document of a class is that with the least doc_id. A row with a null doc_id is compared with nothing: it has no
class and is kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._components import components
from ._session import ship, table, written

SHINGLE, BANDS, ROWS, LEAST, BLOCK_WEIGHT, HUB_ROUNDS = 5, 24, 4, 0.8, 200_000, 1


def bags(w: X.Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by document and hash: document, shingle hash, weight."""
    n = np.diff(w.bounds)
    whole = w.room() >= shingle
    h = X.kgram_hash(w.hash, shingle, 11)
    at = np.flatnonzero(whole[: len(h)])
    doc = np.searchsorted(w.bounds, at, "right") - 1
    few = np.flatnonzero((n > 0) & (n < shingle))
    if len(few):
        h = np.concatenate([h[at], X.spans_hash(w.hash, w.bounds[few], w.bounds[few + 1], 11)])
        doc = np.concatenate([doc, few])
    else:
        h = h[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n_docs x m) of sorted bags; rows of documents without shingles are all ones."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * m, full, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    todo, reach = total > 0, np.log(m) + 3.0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        level, parts = 0, []
        while len(mine):  # a shingle of weight w has the levels below it
            parts.append((mine, np.full(len(mine), level)))
            mine = mine[weight[mine] > (1 << level)]
            level += 1
        item, lev = (np.concatenate(x) for x in zip(*parts, strict=True))
        low = np.where(lev == 0, 0, 1 << np.maximum(lev - 1, 0)).astype(np.float64)
        rate = np.maximum(low, 1.0)
        seed, horizon = X.mix(h[item] ^ (lev.astype(np.uint64) << np.uint64(56)), 3), (reach * m / np.maximum(total, 1))[doc[item]]
        t, k, w, d = np.zeros(len(item)), 0, weight[item], doc[item]
        while len(seed):
            k += 1
            r = X.mix(seed, 16 + k)
            t = t - np.log(_uniform(r)) / rate
            on = np.flatnonzero(t <= horizon)
            seed, t, horizon, rate, low, w, d = (x[on] for x in (seed, t, horizon, rate, low, w, d))
            r2 = X.mix(r[on], 5)
            inside = low + np.floor(_uniform(X.mix(r2, 6)) * rate) < w
            place = d[inside] * m + (r2[inside] % np.uint64(m)).astype(np.int64)
            key = (t[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (r2[inside] >> np.uint64(32))
            np.minimum.at(out, place, key)
        todo = (out.reshape(n_docs, m) == full).any(1) & (total > 0)
        reach *= 3
    return out.reshape(n_docs, m)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            w = X.words(part.column("text"))
            doc, h, weight = bags(w)
            n = part.num_rows
            sig = signatures(doc, h, weight, n, bands * rows).reshape(n * bands, rows)
            band = np.tile(np.arange(bands, dtype=np.uint64), n)
            for j in range(rows):
                band = X.mix(band ^ sig[:, j], j)
            total = np.bincount(doc, weight, n).astype(np.int64)
            keep = np.flatnonzero(total)
            band = band.view(np.int64).reshape(n, bands)[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("doc_id", "t1", "t2")), pa.array(total[keep]), lists], names=["doc_id", "t1", "t2", "weight", "bands"])

    return run


def _bag_rows():
    """(doc, t1, t2, bands, text) to (doc, t1, t2, bands, bag): sorted ids, where copies of a shingle have an id each, so that overlap counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            doc, h, weight = bags(X.words(part.column("text")))
            at = np.repeat(np.arange(len(h)), weight)
            copy = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
            ids, d = np.where(copy > 0, X.mix(h[at] + copy.astype(np.uint64), 9), h[at]), doc[at]
            order = np.lexsort((ids, d))
            cut = np.searchsorted(d[order], np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "t1", "t2", "bands")), lists], names=["doc", "t1", "t2", "bands", "bag"])

    return run


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted id arrays (views of unsigned) overlap by `least` of their union."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    a, b = a.view(np.uint64), b.view(np.uint64)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return n >= least * (len(a) + len(b) - n) - 1e-9


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("bag"), batch.column("bag2")
            good = [similar(a[i].values.to_numpy(), b[i].values.to_numpy(), least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(good, pa.bool_())), batch.column("v").filter(pa.array(good, pa.bool_()))], names=["u", "v"])

    return run


def _compare(least: float):
    """One block of a bucket: texts that ask against targets; a pair once, in its first common band."""

    def run(block: pa.Table) -> pa.Table:
        who, part, asks, target, query = (block.column(c).to_numpy() for c in ("doc", "part", "asks", "target", "query"))
        band = int(block.column("band")[0].as_py())
        bag = [x.values.to_numpy() for x in block.column("bag")]
        size = np.array([len(x) for x in bag])
        signs = np.stack([x.values.to_numpy() for x in block.column("bands")])
        root = {int(p): int(p) for p in part}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        u, v = [], []
        targets = np.flatnonzero(target)
        for i in np.flatnonzero(asks):
            # Targets of other parts and of a fitting size, that met the query in no earlier band. Two that both ask meet
            # twice: the one with the larger id compares.
            near = targets[(part[targets] != part[i]) & (~query[targets] | (who[targets] < who[i])) & (np.minimum(size[targets], size[i]) >= least * np.maximum(size[targets], size[i]))]
            for j in near[(signs[near] == signs[i]).argmax(1) == band]:
                a, b = find(int(part[i])), find(int(part[j]))
                if a != b and similar(bag[i], bag[j], least):
                    u.append(who[i])
                    v.append(who[j])
                    root[max(a, b)] = min(a, b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _parts(exploded: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """Rows of buckets with the component each text has so far."""
    told = exploded.join(found.select(F.col("u").alias("doc"), F.col("v").alias("to")), "doc", "left")
    return told.select("key", "band", "doc", "weight", F.coalesce("to", "doc").alias("part"), *more)


def _hub_pairs(exploded: DataFrame, found: DataFrame, links: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """In each open bucket, the text with most links so far (not tried there yet) against all that aren't with it; and these texts."""
    degree = links.select(F.explode(F.array("u", "v")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("degree"))
    told = _parts(exploded, found, "tried").join(degree, "doc", "left")
    told = written(told.withColumn("score", F.when(F.col("tried"), None).otherwise(F.coalesce("degree", F.lit(0)))).drop("tried", "degree"), "hub-rows")
    hubs = told.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("doc")).alias("id"), "part", "weight"))).alias("hub"))
    hubs = written(hubs.where("n > 2 AND low < high AND hub IS NOT NULL").select("key", "band", (-F.col("hub.id")).alias("at"), F.col("hub.part").alias("hub_part"), F.col("hub.weight").alias("hub_weight")), "hubs")
    pairs = told.join(hubs, ["key", "band"]).where("part <> hub_part").where(F.least("weight", "hub_weight") >= least * F.greatest("weight", "hub_weight"))
    return pairs.groupBy(F.greatest("doc", "at").alias("u"), F.least("doc", "at").alias("v")).agg(F.min("at").alias("hub")), hubs.select("key", "band", "at")


def _rest(exploded: DataFrame, found: DataFrame, bag: DataFrame, least: float, block_weight: int) -> DataFrame:
    """Links between parts of buckets (of three texts or more) that aren't connected yet."""
    told = _parts(exploded, found)
    size = told.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", "doc").alias("main"), F.sum("weight").alias("mass"))
    open_ = written(size.where("n > 2 AND low < high").select("key", "band", "main", F.ceil(F.col("mass") / block_weight).cast("int").alias("cuts")), "open-buckets")
    rows = written(told.join(open_, ["key", "band"]), "open-rows")
    cut = F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int")
    # Block (q, t) compares queries of cut q with targets of cut t. The main part's texts aren't queries: a pair of one
    # of them and another is compared from the other's side. In block (c, c) a text is sent once for both sides.
    query, cuts = F.col("part") != F.col("main"), F.sequence(F.lit(0), F.col("cuts") - 1)
    mine = rows.select("key", "band", "doc", "part", query.alias("query"), cut.alias("c"), F.explode(cuts).alias("x"))
    asked = mine.where("query").select("key", "band", "doc", "part", "query", F.col("c").alias("q"), F.col("x").alias("t"), (F.col("c") == F.col("x")).alias("target"))
    held = mine.where("NOT (query AND c = x)").select("key", "band", "doc", "part", "query", F.col("x").alias("q"), F.col("c").alias("t"), F.lit(True).alias("target"))
    work = asked.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)))
    return work.join(bag, "doc").groupBy("key", "band", "q", "t").applyInArrow(_compare(least), "u long, v long")


def near_duplicates(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """docs: doc_id (an integer), text. One row (doc_id, class_id; t1, t2: hashes of the text; classed: has words) for each row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    signed = docs.where("doc_id IS NOT NULL").mapInArrow(_sign(bands, rows), "doc_id long, t1 long, t2 long, weight long, bands array<long>")
    # Equal texts have equal bands, so the least of each is theirs; numbers one by one are aggregated without a sort.
    each = [F.min(F.col("bands")[i]).alias(f"b{i}") for i in range(bands)]
    mine = signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc"), F.min("weight").alias("weight"), *each)
    mine = written(mine.select("doc", "t1", "t2", "weight", F.array(*(f"b{i}" for i in range(bands))).alias("bands")), "mine")
    exploded = mine.select("doc", "weight", F.posexplode("bands").alias("band", "key"))
    low = written(exploded.groupBy("key", "band").agg(F.min(F.struct("doc", "weight")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "band", "pivot"), "pivots")
    ratio = F.least("weight", "pivot.weight") >= least * F.greatest("weight", "pivot.weight")
    # Used often from here on, so it is shuffled once and written; texts alone in their buckets are out of it.
    in_bucket = written(exploded.join(low, ["key", "band"]), "crowded")
    pairs = written(in_bucket.where(F.col("doc") != F.col("pivot.doc")).where(ratio).select(F.col("doc").alias("u"), F.col("pivot.doc").alias("v")).distinct(), "pairs")
    # Bags of texts in any bucket of two or more; a text that a row repeats has one.
    crowd = mine.join(in_bucket.select("doc").distinct(), "doc", "left_semi").select("doc", "t1", "t2", "bands")
    wanted = docs.select(F.col("doc_id").alias("doc"), "text", "t1", "t2").join(crowd.hint("shuffle_hash"), ["doc", "t1", "t2"])
    bag = wanted.select("doc", "t1", "t2", "bands", "text").mapInArrow(_bag_rows(), "doc long, t1 long, t2 long, bands array<long>, bag array<long>")
    bag = written(bag.dropDuplicates(["doc", "t1", "t2"]).select("doc", "bands", "bag"), "bags")

    def verified(some: DataFrame) -> DataFrame:
        """some: u, v and which of them is the hub, that many rows may share. It is joined first, while rows are ids alone: then no shuffle of bags is uneven."""
        some = some.select("u", "v", "hub", F.when(F.col("hub") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("doc"))
        with_hub = some.join(bag.select(F.col("doc").alias("hub"), F.col("bag").alias("bag2")), "hub")
        both = with_hub.join(bag.select("doc", "bag"), "doc").select("u", "v", "bag", "bag2")
        return written(both.mapInArrow(_verify(least), "u long, v long"), "links")

    links = verified(pairs.withColumn("hub", F.col("v")))
    found = components(links, plain=True)
    crowded = in_bucket.select("key", "band", "doc", "weight", (F.col("doc") == F.col("pivot.doc")).alias("tried"))
    untried, tested = crowded, pairs
    for _ in range(HUB_ROUNDS):
        some, hubs = _hub_pairs(untried, found, links, least)
        some = some.join(tested, ["u", "v"], "left_anti")
        more = verified(some)
        if more.isEmpty():
            break
        untried = untried.join(hubs, ["key", "band"], "left").withColumn("tried", F.col("tried") | F.coalesce(F.col("doc") == F.col("at"), F.lit(False))).drop("at")
        links, tested = links.unionByName(more), tested.unionByName(some.select("u", "v"))
        found = components(found.unionByName(more), plain=True)

    more = written(_rest(crowded, found, bag, least, block_weight), "more-links")
    if not more.isEmpty():
        found = components(found.unionByName(more), plain=True)
    class_of = mine.join(found.select(F.col("u").alias("doc"), "v"), "doc", "left").select("t1", "t2", F.coalesce("v", "doc").alias("class_id"))
    # Texts without words aren't in `mine`.
    told = docs.select("doc_id", "t1", "t2").join(class_of, ["t1", "t2"], "left")
    return told.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "t1", "t2", F.col("class_id").isNotNull().alias("classed"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near-duplicates one row stays, with the least doc_id (ties: the least hash of the text).

    Rows without words or without an id stay.
    """
    names = docs.columns
    rows = docs.toDF(*(c if c in ("text", "doc_id") else f"c{i}" for i, c in enumerate(names)))  # own names never clash
    classes = written(near_duplicates(rows).where("classed AND doc_id IS NOT NULL"), "row-classes")
    key = ["doc_id", "t1", "t2"]
    first = classes.groupBy("class_id").agg(F.min(F.struct(*key)).alias("x")).select("x.*", F.lit(True).alias("first"))
    told = classes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(first, key, "left")
    told = written(told.select(*key, F.coalesce("first", F.lit(False)).alias("first"), (F.col("n") > 1).alias("again")), "row-decisions")
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    # Rows to go and repeated rows are the few; whole rows are shuffled only where one of several equal ones must be picked.
    gone = told.where("NOT first OR again").select(*key)
    again = told.where("first AND again").select(*key)
    kept = rows.join(gone, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(*(c for c in rows.columns if c not in ("t1", "t2"))).toDF(*names)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
g AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM p),
b AS (SELECT doc_id, s, count(*) AS c FROM g WHERE pos + 4 <= n OR (n < 5 AND pos = 1) GROUP BY doc_id, s),
z AS (SELECT doc_id, sum(c) AS t FROM b GROUP BY doc_id),
o AS (SELECT x.doc_id AS u, y.doc_id AS v, sum(least(x.c, y.c)) AS m FROM b x JOIN b y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN z a ON a.doc_id = u JOIN z e ON e.doc_id = v WHERE 5 * m >= 4 * (a.t + e.t - m)),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u)
SELECT u AS doc_id, min(c) AS class_id, u = min(c) AS kept FROM r GROUP BY u
"""
