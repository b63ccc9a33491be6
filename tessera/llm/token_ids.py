"""Token-ID output: documents in ascending doc_id order to coded files and back.

Texts are encoded with the tokenizers library. Where the tokenizer's rules (read from its file) cut at white space,
before punctuation and around digits, and keep no case, a text's ids are those of its words one after another; then the
words of a slice are told apart by Arrow, each distinct one is encoded once and remembered (a cache of bounded size,
kept by the Python worker over its tasks). Words of letters alone are encoded by lines, without the pattern. A test holds this against encoding whole texts. Other
tokenizers get whole texts. Each document ends with END_ID.

Rows are range-partitioned by doc_id (ties by a hash of the text, so that one repeated id can spread) and
sorted; each task writes file images (see id_coder) of about FILE_IDS ids with its own running start. Parts'
totals, one small row a partition, give the global starts. Files travel as binary values of a Parquet table in
the shared folder, because only Spark's writers reach every store.

Null texts count as empty: the end id alone. Repeated rows and ids each get their row, in the order above; null
ids come first; other columns are ignored. A damaged file raises Damaged.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import id_coder
from ._session import shared_dir, ship, table
from ._text import LOWER, bytes_of, slices, spans_hash

END_ID, CACHE, SLICE_BYTES, FILE_IDS = 1, 2_000_000, 8 << 20, id_coder.FILE_IDS
#: The rules under which words may be encoded one by one (fixed values of the format): white space becomes one space,
#: case is dropped, and this pattern finds the parts that the model sees.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Byte classes of lower-case text. Between two bytes there is a cut where _LEFT of the first meets _RIGHT of the second:
#: 1 behind a digit, 2 before one, 4 between letter and punctuation, 8 where a word ends at white space, 16 where one begins.
_SPACE, _LOWER = b" \t\n\v\f\r", bytes(LOWER)
_BEGINS, _ENDS = 1 | 2 | 4 | 16, 1 | 2 | 4 | 8


def _class(space: int, digit: int, letter: int, other: int, more: int) -> bytes:
    """A table of bytes; more: those of longer characters."""
    return bytes(space if x in _SPACE else digit if 48 <= x < 58 else letter if 97 <= x < 123 else other if x < 128 else more for x in range(256))


_LEFT, _RIGHT = _class(16, 1 | 2 | 8, 2 | 4 | 8, 2 | 8, 8), _class(8, 1 | 2 | 16, 1 | 16, 1 | 4 | 16, 16)
#: Words of letters alone: of ASCII, and of Latin-1 too (which are composed already).
_ASCII, _LATIN = r"\A[a-z]+\z", r"\A[a-zÀ-ÖØ-öø-ÿ]+\z"


def _word_bounds(whole: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of lower-case texts: cut at white space, at digits, and before punctuation behind a letter.

    Letters are those of ASCII and, before punctuation and digits, of Latin-1.
    """
    if not whole:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = (np.frombuffer(whole.translate(x), np.uint8) for x in (_LEFT, _RIGHT))
    cut = left[:-1] & right[1:]
    data = np.frombuffer(whole, np.uint8)
    second = np.flatnonzero(data[:-2] == 0xC3) + 1
    second = second[(data[second] | 0x20) != 0xB7]  # but for the signs of multiplication and division
    cut[second] = _LEFT[97] & right[second + 1]
    edge = off[(off > 0) & (off < len(data))]
    cut[edge - 1] = (left[edge - 1] & 8) | (right[edge] & 16)
    first, last = np.flatnonzero((cut & _BEGINS) != 0), np.flatnonzero((cut & _ENDS) != 0)
    return np.concatenate([np.zeros(right[0] >> 4 & 1, np.int64), first + 1]), np.concatenate([last + 1, np.full(left[-1] >> 3 & 1, len(data))])


def _hashes(words: pa.Array) -> np.ndarray:
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(data, np.uint8, off[-1]) if data is not None else np.zeros(0, np.uint8)
    return spans_hash(data.astype(np.uint64) + np.uint64(1), off[:-1], off[1:])


class Encoder:
    """Ids of a column of texts."""

    def __init__(self, model: str) -> None:
        """model: the tokenizer's JSON."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        rules = json.loads(model)
        norm, pre, bpe = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}, rules["model"]
        split = (pre.get("pretokenizers") or [{}])[0]
        special = [x["content"] for x in rules["added_tokens"]]
        self.by_word = norm.get("normalizers") == _NORMALIZERS and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": _PARTS}, "Removed", True) and pre["pretokenizers"][1:] == [_BYTES] and bool(bpe.get("end_of_word_suffix"))
        # Where a special token's text occurs, the whole text goes to the library.
        self.special = [x.lower().encode() for x in special if x]
        closing = [i for x, i in self.tokenizer.get_vocab().items() if x.endswith(bpe.get("end_of_word_suffix") or "\0")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[closing] = True
        if self.by_word:  # the same model for lines of such words, which need no pattern (and ASCII's lower-case letters stay as they are)
            self.ascii, self.latin, split = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model), pre_tokenizers.WhitespaceSplit()
            self.ascii.pre_tokenizer, self.latin.normalizer = split, normalizers.Lowercase()
            self.latin.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())  # remembered words; the ids of word k are ids[at[k] : at[k] + size[k]]
        self.ids, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # the words' hashes in order, and whose they are

    def _library(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def _letters(self, words: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone are one part each, which the last id of each closes; so a line of them can be told apart."""
        at = np.append(np.arange(0, len(words), 256), len(words))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), words), pa.scalar(" ", pa.large_string()))
        ids, _ = self._library(lines.to_pylist(), tokenizer)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._library(words.to_pylist())

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Where each of some distinct words is, -1 if it isn't known. Words are found by their hashes and compared by their bytes."""
        out = np.full(len(words), -1, np.int32)
        if not len(self.hash):
            return out
        order = hashes.argsort()  # near ones after one another
        at = np.minimum(np.searchsorted(self.hash, hashes[order]), len(self.hash) - 1)
        same = self.hash[at] == hashes[order]
        order, slot = order[same], self.slot[at[same]]
        same = pc.equal(words.take(pa.array(order)), self.known.take(pa.array(slot))).to_numpy(zero_copy_only=False)
        out[order[same]] = slot[same]
        return out

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Remember words, and where each is now."""
        slot, text = np.empty(len(words), np.int32), words.cast(pa.large_string())
        ascii_, latin = (pc.match_substring_regex(text, x).to_numpy(zero_copy_only=False) for x in (_ASCII, _LATIN))
        for which, tokenizer in ((np.flatnonzero(ascii_), self.ascii), (np.flatnonzero(latin & ~ascii_), self.latin), (np.flatnonzero(~latin), None)):
            if len(which):
                some = text.take(pa.array(which))
                ids, size = self._letters(some, tokenizer) if tokenizer else self._library(some.to_pylist())
                slot[which] = len(self.known) + np.arange(len(which))
                self.known = pa.concat_arrays([self.known, some.cast(pa.large_binary())])
                self.at = np.concatenate([self.at, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
                self.size = np.concatenate([self.size, size.astype(np.int32)])
                self.ids = np.concatenate([self.ids, ids])
        order = hashes.argsort()
        at = np.searchsorted(self.hash, hashes[order])
        self.hash, self.slot = np.insert(self.hash, at, hashes[order]), np.insert(self.slot, at, slot[order])
        return slot

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. Null counts as empty."""
        raw, off = bytes_of(column)
        whole = raw.tobytes().translate(_LOWER)
        if not self.by_word or any(x in whole for x in self.special):
            return self._library(["" if x is None else x for x in column.to_pylist()])
        start, end = _word_bounds(whole, off)
        at = np.concatenate([[0], np.cumsum(end - start)])
        text = whole.translate(None, _SPACE)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(text)]).dictionary_encode()
        distinct = words.dictionary
        hashes = _hashes(distinct)
        slot = self._find(distinct, hashes)
        if len(self.known) + (slot < 0).sum() > CACHE:
            self._forget()
            slot[:] = -1
        missing = np.flatnonzero(slot < 0)
        slot[missing] = self._learn(distinct.take(pa.array(missing)), hashes[missing])
        each = words.indices.to_numpy()
        size = self.size.take(slot).take(each)
        ends = np.concatenate([[0], np.cumsum(size)])
        from_ = np.repeat(self.at.take(slot).take(each) - ends[:-1].astype(np.int32), size)
        from_ += np.arange(ends[-1], dtype=np.int32)
        return self.ids.take(from_), np.diff(ends[np.searchsorted(start, off)])


_encoders: dict[str, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    """The worker's encoder of this model, with what earlier tasks left in its cache."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _write(model, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = encoder_of(model.value), TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def image() -> pa.RecordBatch:
            nonlocal before, size
            names = pa.concat_arrays(docs)
            data = id_coder.encode_file(names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False), np.concatenate(counts), np.concatenate(ids), before)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "before", "n_ids", "image"])
            before += size
            for x in (docs, counts, ids):
                x.clear()
            size = 0
            return out

        for piece in slices(batches, limit=SLICE_BYTES):
            got, n = encoder.encode(piece.column("text"))
            n += 1
            cut = np.concatenate([[0], np.cumsum(n)])
            closed = np.full(cut[-1], end_id, np.uint32)
            own = np.ones(cut[-1], bool)
            own[cut[1:] - 1] = False
            closed[own] = got
            at = 0
            while at < len(n):  # a file ends with the document that reaches file_ids
                to = min(len(n), int(np.searchsorted(cut, cut[at] + file_ids - size)))
                docs.append(piece.column("doc_id").slice(at, to - at))
                counts.append(n[at:to])
                ids.append(closed[cut[at] : cut[to]])
                size += int(cut[to] - cut[at])
                at = to
                if size >= file_ids:
                    yield image()
        if docs:
            yield image()

    return run


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write docs' ids as coded files to the folder `out`; path: the tokenizer's JSON, which only the driver reads."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # as large as the vocabulary
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(_write(model, end_id, file_ids), "part int, before long, n_ids long, image binary").write.option("compression", "none").parquet(out)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files in `out`."""
    ship(spark)
    files = spark.read.schema("part int, before long, n_ids long, image binary").parquet(out)
    # One row a part, whose number the writer chose, not the data's size.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offset = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    full = files.join(F.broadcast(offset), "part").select((F.col("offset") + F.col("before")).alias("start"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column("start").to_pylist(), batch.column("image"), strict=True):
                doc_ids, null, counts, ids, _ = id_coder.decode_file(image.as_buffer().to_pybytes())
                cut = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null), pa.array(first + cut[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return full.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = os.path.join(shared_dir(spark), f"token-ids-{uuid.uuid4().hex}")
    write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), out)
    return read_ids(spark, out)
