"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of 13 consecutive words (an item of fewer words is one window). A window
occurs only where all its shingles do, so at containment 1 one shingle is a sufficient prefix: the rarest
over the whole corpus. Documents are joined on these prefix shingles alone; the shingle's place in the
window fixes the only possible start (positional bound), the document's remaining words bound the length,
and every word of the item-sized window is then compared, by hash first and then byte by byte.

Items go to the executors in blocks of about BLOCK_ITEM_WORDS words, which bounds each broadcast; one block is live at a
time. Each block's hits are written, sparse, by text (its SHA-256), and merged: what a text holds depends on the text
alone, so rows that share an id are told apart. One block or many, results and rows are the same.

Null or word-free texts have no words and no hits; null or word-free items, and items without an id, have
no windows; repeated documents and null ids each get their row; repeated items count once by id; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._session import discard, ship, table, written

WINDOW, SHINGLE, BLOCK_ITEM_WORDS = 13, 4, 200_000


@dataclass
class Windows:
    """Distinct windows of one block: word hashes (padded), lengths, texts, owners by CSR, and their prefix shingles."""

    words: np.ndarray
    length: np.ndarray
    texts: list[bytes]  # words joined by one space
    owner_at: np.ndarray
    owner: np.ndarray
    ids: list[str]
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width -> hash, window, offset
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def joined(w: X.Words, at: int, n: int) -> bytes:
    return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[at : at + n].tolist(), w.end[at : at + n].tolist(), strict=True))


def windows_of(ids: list, texts: list, window: int = WINDOW, shingle: int = SHINGLE) -> Windows:
    w = X.words(pa.array(texts, pa.string()), X.ALNUM, lower=True)
    names = sorted({str(i) for i in ids if i is not None})
    number = {x: k for k, x in enumerate(names)}
    of = np.array([-1 if i is None else number[str(i)] for i in ids], np.int64)
    n = np.diff(w.bounds)
    item, size = w.doc(), np.minimum(np.repeat(n, n), window)
    at = np.flatnonzero((w.room() >= size) & (of[item] >= 0)) if len(item) else np.zeros(0, np.int64)
    item, size = of[item[at]], size[at]
    # Words get numbers by their bytes, so that windows are told apart exactly.
    every = [w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    code = {x: k for k, x in enumerate(dict.fromkeys(every), 1)}
    code = np.append(np.array([code[x] for x in every], np.int32), np.zeros(window, np.int32))
    inside = np.arange(window)[None, :] < size[:, None]
    place = np.where(inside, at[:, None] + np.arange(window)[None, :], len(every))
    rows = np.ascontiguousarray(code[place])
    _, first, which = np.unique(rows.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
    length, place = size[first], place[first]
    words = np.append(w.hash, np.uint64(0))[place]
    pair = np.unique(np.stack([which, item], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    owner_at = np.searchsorted(pair[:, 0], np.arange(len(first) + 1))
    shingles = {}
    for width in np.unique(np.minimum(length, shingle)).tolist():
        mine = np.flatnonzero(np.minimum(length, shingle) == width)
        k = np.repeat(mine, length[mine] - width + 1)
        o = np.arange(len(k)) - np.repeat(np.cumsum(length[mine] - width + 1) - (length[mine] - width + 1), length[mine] - width + 1)
        start = at[first][k] + o
        shingles[width] = (X.spans_hash(w.hash, start, start + width), k, o)
    return Windows(words, length, [joined(w, a, m) for a, m in zip(at[first].tolist(), length.tolist(), strict=True)], owner_at, pair[:, 1], names, shingles, {})


def _lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h of members of the sorted keys, and which; a 64-kbit filter spares most searches."""
    flag = np.zeros(1 << 16, bool)
    flag[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(flag[(h & np.uint64(0xFFFF)).astype(np.int64)])
    j = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[j] == h[at]
    return at[ok], j[ok]


def _count(win: Windows):
    keys = {k: np.unique(v[0]) for k, v in win.shingles.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for part in X.slices(batches):
            w = X.words(part.column("text"), X.ALNUM, lower=True)
            room = w.room()
            for width, ks in keys.items():
                at, j = _lookup(ks, X.kgram_hash(w.hash, width))
                total[width] += np.bincount(j[room[at] >= width], minlength=len(ks))
        for width, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), width), pa.int32()), pa.array(keys[width][seen].view(np.int64)), pa.array(n[seen])], names=["width", "shingle", "n"])

    return run


def with_prefixes(win: Windows, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Windows:
    """Keep of each window its rarest shingle (ties: the smaller hash, then the earlier place). counts: sorted shingles and numbers."""
    for width, (h, k, o) in win.shingles.items():
        n = np.zeros(len(h), np.int64)
        if width in counts:
            seen, number = counts[width]
            at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
            n = np.where(seen[at] == h, number[at], 0)
        order = np.lexsort((o, h, n, k))
        first = order[np.unique(k[order], return_index=True)[1]]
        first = first[np.argsort(h[first], kind="stable")]
        win.prefix[width] = (h[first], k[first], o[first])
    return win


def _hits(win: Windows, w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Verified (first word, window) pairs of a slice."""
    starts, which = [], []
    room = w.room()
    for width, (h, k, o) in win.prefix.items():
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        at, j = _lookup(keys, X.kgram_hash(w.hash, width))
        each = n[j]
        spread = np.repeat(np.arange(len(at)), each)
        row = first[j][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(each) - each, each)
        s, win_id = at[spread] - o[row], k[row]
        ok = s >= 0
        s, win_id = s[ok], win_id[ok]
        ok = room[s] >= win.length[win_id]  # from its start the document has the window's words
        s, win_id = s[ok], win_id[ok]
        for c in range(win.words.shape[1]):
            inside = c < win.length[win_id]
            same = ~inside
            same[inside] = w.hash[s[inside] + c] == win.words[win_id[inside], c]
            s, win_id = s[same], win_id[same]
        same = np.array([joined(w, x, win.length[k]) == win.texts[k] for x, k in zip(s.tolist(), win_id.tolist(), strict=True)], bool)
        starts.append(s[same])
        which.append(win_id[same])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(which or none)


OUT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(n_words: int, n_hit: int, items: list[str]) -> tuple:
    sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), sha, n_hit > 0 and 20 * n_hit >= n_words


def _slice_results(win: Windows, part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each row: its words, the mask of hit words' count, and items."""
    w = X.words(part.column("text"), X.ALNUM, lower=True)
    s, k = _hits(win, w)
    delta = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(delta, s, 1)
    np.add.at(delta, s + win.length[k], -1)
    hit = np.cumsum(delta[:-1]) > 0
    doc = np.searchsorted(w.bounds, s, "right") - 1
    of: dict[int, set[int]] = {}
    for d, x in np.unique(np.stack([doc, k]), axis=1).T.tolist() if len(s) else ():
        of.setdefault(d, set()).update(win.owner[win.owner_at[x] : win.owner_at[x + 1]].tolist())
    for i in range(part.num_rows):
        a, b = w.bounds[i], w.bounds[i + 1]
        yield int(b - a), hit[a:b], [win.ids[x] for x in of.get(i, ())]


def _map(win_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = win_b.value
        for part in X.slices(batches):
            rows = [digest(n, int(hit.sum()), items) for n, hit, items in _slice_results(win, part)]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _map_block(win_b):
    """Texts with hits: their key, the places of hit words, and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = win_b.value
        for part in X.slices(batches):
            keep = [(i, np.flatnonzero(hit).tolist(), items) for i, (n, hit, items) in enumerate(_slice_results(win, part)) if items]
            at = pa.array([x[0] for x in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key").take(at), pa.array([x[1] for x in keep], pa.list_(pa.int64())), pa.array([x[2] for x in keep], pa.list_(pa.string()))], names=["key", "places", "items"])

    return run


def blocks_of(benchmark: DataFrame, limit: int) -> Iterator[Windows]:
    """The stated query set, streamed to the driver in blocks of bounded size."""
    ids, texts, n = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += len(r[1] or "") // 2 + 1
        if n >= limit:
            yield windows_of(ids, texts)
            ids, texts, n = [], [], 0
    yield windows_of(ids, texts)


def counted(docs: DataFrame, win: Windows) -> Windows:
    """win with prefixes by corpus rarity; the counts are at most one number for each shingle of the block."""
    n = docs.select("text").mapInArrow(_count(win), "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
    got = n.toArrow()
    width, shingle, number = (got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("width", "shingle", "n"))
    counts = {}
    for x in np.unique(width).tolist():
        mine = np.flatnonzero(width == x)
        seen = shingle[mine].view(np.uint64)
        order = np.argsort(seen)
        counts[x] = seen[order], number[mine][order]
    return with_prefixes(win, counts)


def text_key(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def merged_hits(docs: DataFrame, first: Windows, rest: Iterator[Windows]) -> DataFrame:
    """key, places and items of texts with hits, over several blocks of items; one block at a time is broadcast."""
    parts = []
    for win in itertools.chain([first], rest):
        block = docs.sparkSession.sparkContext.broadcast(counted(docs, win))
        parts.append(written(docs.select("text", text_key(F.col("text")).alias("key")).mapInArrow(_map_block(block), "key binary, places array<long>, items array<string>").dropDuplicates(["key"]), "block-hits"))
        block.destroy()
    every = functools.reduce(DataFrame.unionByName, parts)
    out = written(every.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "hits")
    discard(*parts)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_item_words: int = BLOCK_ITEM_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = blocks_of(benchmark, block_item_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_map(spark.sparkContext.broadcast(counted(docs, first))), OUT.format(id=kind))
    merged = merged_hits(docs, first, itertools.chain([second], blocks))
    plain = docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(_map_counts(), f"doc_id {kind}, key binary, n_words long")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return plain.join(merged, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def _map_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            w = X.words(part.column("text"), X.ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(np.diff(w.bounds))], names=["doc_id", "key", "n_words"])

    return run


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _keep(win_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = win_b.value
        for part in X.slices(batches):
            bad = [digest(n, int(hit.sum()), items)[-1] for n, hit, items in _slice_results(win, part)]
            yield part.filter(pa.array([not x for x in bad]))

    return run


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, block_item_words: int = BLOCK_ITEM_WORDS) -> DataFrame:
    """Pipeline stage: the rows whose text the contamination rule does not mark."""
    ship(spark)
    names = docs.columns
    rows = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))  # own names never clash
    blocks = blocks_of(table(spark, sf_dir, "benchmark"), block_item_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return rows.mapInArrow(_keep(spark.sparkContext.broadcast(counted(rows, first))), rows.schema).toDF(*names)
    merged = merged_hits(rows, first, itertools.chain([second], blocks))
    n_words = rows.select(F.lit(None).cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key")).mapInArrow(_map_counts(), "doc_id long, key binary, n_words long")
    marked = n_words.join(merged, "key").where("20 * n_hit >= n_words").select("key").distinct()
    return rows.withColumn("key", text_key(F.col("text"))).join(marked, "key", "left_anti").drop("key").toDF(*names)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(13, len(ws)) AS l, array_to_string(list_slice(ws, k, k + least(13, len(ws)) - 1), ' ') AS s
      FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS k FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, pos, n, l, string_agg(word, ' ') OVER (PARTITION BY doc_id, l ORDER BY pos ROWS BETWEEN CURRENT ROW AND l - 1 FOLLOWING) AS s
      FROM p, (SELECT DISTINCT l FROM i)),
h AS (SELECT doc_id, pos, d.l, item_id FROM d JOIN i ON d.l = i.l AND d.s = i.s WHERE pos + d.l - 1 <= n),
c AS (SELECT doc_id, count(DISTINCT pos + o) AS n_hit FROM (SELECT doc_id, pos, unnest(range(l)) AS o FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
