"""Substring dedup: matching statistics of documents against suffix automata of reference shards.

A word goes if it lies in a window of WINDOW consecutive words whose sequence also starts in a document with a
smaller doc_id; windows are judged on the input.

Reference text grows with the corpus, so a shard isn't sent to all executors: passages are routed to it. The
key is the window's minimiser, its least hash among its K-word grams: equal windows have equal minimisers.
Consecutive windows with one minimiser place make a run; its text is the run's context. A document's equal runs (of a
repeated line, say) are one row with all their places, from the start. Per minimiser:

1. Minimisers seen in one document alone are dropped (an aggregate with map-side combining).
2. Equal contexts meet by (minimiser, context hash); every document but that with the least doc_id loses the
   run. Only this one representative of each distinct context is left, so a group of copies, however large,
   becomes one row.
3. Where a minimiser has several contexts, they form a reference shard: in doc_id order each is streamed
   through the suffix automaton of the smaller documents' contexts; where the match is WINDOW words or longer,
   the window ending there goes; then the context is added to the automaton.
4. A minimiser with over SHARD_CONTEXTS contexts is cut into single windows, which meet by (minimiser, window
   hash) as in step 2, so that no shard grows without bound and none is dropped.

Where hashes decide (equal contexts, equal windows), two must agree, 64 bits each, that share neither word hashes nor
polynomial: the minimiser's and the context's or window's. Automata read words as 64-bit hashes, 50 of which must
agree. Null texts have no words; repeated rows with one
doc_id don't remove each other; a null doc_id removes and loses nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._session import ship, table, written

WINDOW, K, SHARD_CONTEXTS = 50, 25, 256


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least entry (the first of equals) of each `width` consecutive entries."""
    value, place, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        have += step
    return place


def runs_of(w: X.Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """minimiser, context hash, document, first window (within the document) and number of windows of each run."""
    none = np.zeros(0, np.int64)
    if len(w.hash) < window:
        return none, none, none, none, none
    gram = X.kgram_hash(w.hash, k, 1)
    place = _least(gram, window - k + 1)
    valid = w.room()[: len(place)] >= window
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    # A run ends before the next start or the first window that isn't valid.
    stop = np.ones(len(place) + 1, bool)
    stop[:-1] = new | ~valid
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, "right")]
    context = X.spans_hash(w.other(), start, end + window - 1, 2, 1)
    doc = np.searchsorted(w.bounds, start, "right") - 1
    return gram[place[start]].view(np.int64), context.view(np.int64), doc, start - w.bounds[doc], end - start


def _lists(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def _runs(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            h, context, doc, start, n = runs_of(X.words(part.column("text")), window, k)
            order = np.lexsort((start, context, h, doc))
            h, context, doc, start, n = (x[order] for x in (h, context, doc, start, n))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            at = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(context[first]), part.column("doc_id").take(at), part.column("row").take(at), _lists(np.append(first, len(h)), start), pa.array(n[first])], names=["h", "context", "doc_id", "row", "starts", "n"])

    return run


def _contexts(window: int):
    """Rows (text, need: list of (h, starts, n, whole)) to contexts, or to single windows where whole is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            w = X.words(part.column("text"))
            other = w.other()
            out: dict[str, list] = {x: [] for x in ("h", "at", "starts", "n", "window", "ids")}
            for i, need in enumerate(part.column("need").to_pylist()):
                for x in need:
                    starts, n = np.array(x["starts"], np.int64), x["n"]
                    a = int(w.bounds[i]) + x["starts"][0]
                    hashes = [None] if x["whole"] else X.kgram_hash(other[a : a + n + window - 1], window, 3, 1).view(np.int64).tolist()
                    for j, wh in enumerate(hashes):
                        out["h"].append(x["h"])
                        out["at"].append(i)
                        out["starts"].append(starts + j)
                        out["n"].append(n if x["whole"] else 1)
                        out["window"].append(wh)
                        out["ids"].append(w.hash[a : a + n + window - 1].view(np.int64) if x["whole"] else None)
            at = pa.array(out["at"], pa.int64())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["h"], pa.int64()), part.column("doc_id").take(at), part.column("row").take(at), pa.array(out["starts"], lists), pa.array(out["n"], pa.int64()), pa.array(out["window"], pa.int64()), pa.array(out["ids"], lists)],
                names=["h", "doc_id", "row", "starts", "n", "window", "ids"],
            )

    return run


class Automaton:
    """Suffix automaton of several word sequences: it holds every substring of each."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the string of p followed by c, which p already leads to; cloned where the target is longer."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        out, state, size = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            out.append(size)
        return out


def _match(window: int):
    """Contexts sorted by (h, doc_id) to spans (doc_id, row, starts, n) of windows seen in smaller documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, doc, waiting, automaton = None, None, [], Automaton()
        for batch in batches:
            at, starts, sizes = [], [], []
            ids, places = batch.column("ids"), batch.column("starts")
            for i, (h, d) in enumerate(zip(batch.column("h").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                if h != shard:
                    shard, doc, waiting, automaton = h, d, [], Automaton()
                elif d != doc:
                    for x in waiting:
                        automaton.add(x)
                    doc, waiting = d, []
                x = ids[i].as_py()
                if len(automaton.length) > 1:
                    good = np.array(automaton.statistics(x)[window - 1 :]) >= window
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        at.append(i)
                        starts.append(places[i].values.to_numpy() + a)
                        sizes.append(b - a)
                waiting.append(x)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("row").take(where), pa.array(starts, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "row", "starts", "n"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """docs: doc_id, row, text. Rows (doc_id, row, starts, n, path): n windows from each of the words `starts` on go.

    path says what found them: 0 equal contexts, 1 automata, 2 single windows of minimisers with many contexts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = written(docs.mapInArrow(_runs(window, k), f"h long, context long, doc_id {kind}, row long, starts array<long>, n long").where("doc_id IS NOT NULL"), "runs")
    shared = written(runs.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("context") != F.max("context")).alias("several")).where("low < high").select("h", "several"), "minimisers")
    runs = written(runs.join(shared, "h"), "shared-runs")
    first = written(runs.groupBy("h", "context").agg(F.min("doc_id").alias("first"), F.first("several").alias("several")), "contexts")
    told = runs.drop("several").join(first, ["h", "context"])
    span = ["doc_id", "row", "starts", "n"]
    copies = told.where("first < doc_id").select(*span, F.lit(0).alias("path"))
    sizes = first.where("several").groupBy("h").agg((F.count(F.lit(1)) <= shard_contexts).alias("whole"))
    need = told.where("several AND first = doc_id").select("h", *span).join(written(sizes, "shards"), "h")
    by_row = need.groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "starts", "n", "whole")).alias("need"))
    # Texts are the streamed side; what a document needs is far smaller than it.
    pieces = docs.join(by_row.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", "need").mapInArrow(_contexts(window), f"h long, doc_id {kind}, row long, starts array<long>, n long, window long, ids array<long>")
    pieces = written(pieces, "pieces")
    whole = pieces.where("window IS NULL").select("h", *span, "ids").repartition("h").sortWithinPartitions("h", "doc_id")
    matched = whole.mapInArrow(_match(window), f"doc_id {kind}, row long, starts array<long>, n long").withColumn("path", F.lit(1))
    single = pieces.where("window IS NOT NULL").select("h", "window", *span)
    low = written(single.groupBy("h", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "windows")
    cut = single.join(low, ["h", "window"]).where("first < doc_id").select(*span, F.lit(2).alias("path"))
    return copies.unionByName(matched).unionByName(cut)


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            w = X.words(part.column("text"))
            gone = np.zeros(len(w.start) + 1, np.int64)
            spans = part.column("spans")
            size = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            if len(flat):
                starts = flat.field("starts")
                each = starts.value_lengths().to_numpy(zero_copy_only=False)
                begin = np.repeat(np.repeat(w.bounds[:-1], size), each) + starts.flatten().to_numpy(zero_copy_only=False)
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + np.repeat(flat.field("n").to_numpy(zero_copy_only=False), each) + window - 1, -1)
            keep = np.cumsum(gone[:-1]) <= 0
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *kept_columns(w, keep)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def kept_columns(w: X.Words, keep: np.ndarray) -> list[pa.Array]:
    """n_words, n_removed and the digest of each document's kept words, joined by one space."""
    n = np.diff(w.bounds)
    kept = np.concatenate([[0], np.cumsum(keep)])[w.bounds]
    at = np.flatnonzero(keep)
    delta = np.zeros(len(w.data) + 1, np.int8)
    delta[w.start[at]] += 1
    delta[w.end[at]] -= 1
    inside = np.cumsum(delta[:-1], dtype=np.int8) > 0
    out = w.data.copy()
    # Behind each kept word but its document's last there is white space: one byte of it becomes the joint.
    last = kept[1:][kept[1:] > kept[:-1]] - 1
    joint = np.ones(len(at), bool)
    joint[last] = False
    where = w.end[at[joint]]
    inside[where] = True
    out[where] = 32
    text = out[inside]
    # A document's bytes start where its first kept word does.
    count = np.concatenate([[0], np.cumsum(inside)])
    digests = []
    for i in range(len(n)):
        a, b = kept[i], kept[i + 1]
        digests.append(hashlib.sha256(text[count[w.start[at[a]]] : count[w.end[at[b - 1]]]] if b > a else b"").hexdigest())
    return [pa.array(n), pa.array(n - np.diff(kept)), pa.array(digests)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, window, k, shard_contexts).groupBy("doc_id", "row").agg(F.collect_list(F.struct("starts", "n")).alias("spans"))
    full = docs.join(spans.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    return full.mapInArrow(_finish(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
k AS (SELECT doc_id, pos, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM k WHERE pos + 49 <= n GROUP BY s),
r AS (SELECT DISTINCT k.doc_id, k.pos + o.o AS pos FROM k JOIN f USING (s), (SELECT unnest(range(50)) AS o) o WHERE k.pos + 49 <= k.n AND k.doc_id > f.m),
c AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n_kept FROM p ANTI JOIN r USING (doc_id, pos) GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
