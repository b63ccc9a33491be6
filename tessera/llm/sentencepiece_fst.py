"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is a composition, expanded lazily for each input:

* N, the normaliser: after an initial arc that writes the dummy prefix, one state whose arcs map a space to the
  model's space mark and every other character to itself, at weight 0;
* P, the pieces: a lexicon transducer whose states are the prefixes of pieces. Its arcs read characters at weight 0;
  where a piece ends, an arc writes its id and returns to the start at the piece's weight. A character that is no piece
  writes its UTF-8 bytes' ids (byte fallback) at weight FALLBACK beyond the dearest piece;
* C, for BPE models, an acceptor of piece pairs with one state for each piece: the arc x -> y weighs 0 where the model's
  merges leave x y as it is, and infinity elsewhere. Its test is the pair test of the published linear-time BPE
  encoders (the `bpe` crate of GitHub's rust-gems): a sequence whose neighbours all pass is the one that the merges
  give, because the first merge across a border of it would also happen with these two pieces alone.

The encoding is the tropical shortest path of input o N o P o C: weights add along a path, and of paths to a state the
lesser is kept (the earlier one of equals). A unigram model's pieces weigh their negative scores and it needs no C, so
its paths compete by weight. A BPE model's scores are merge ranks, whose sums don't give its encoding; there pieces
weigh 1 and C leaves each position one finite state, that of the prefix's own encoding.

Where no piece holds a space mark behind another character, every run of marks starts a new component of the
composition; characters in no longer piece stand alone as well. Components are remembered by text in a cache
of bounded size.

Models with a normalisation table, white-space removal, or user-defined or unused pieces raise an error.

Null and empty texts have no ids and decode to the empty text. Repeated rows each get theirs; other columns
are ignored. A text that holds the space mark itself decodes to a space there (round_trip is false).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._session import ship, table
from ._text import slices

MARK, CACHE, PAIRS, FALLBACK, NEVER = "▁", 500_000, 1_000_000, 10.0, float("inf")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass
class Transducer:
    """The compiled machine; pieces of text to id, ranks for merging, ids of bytes, and what each id writes."""

    ids: dict[str, int]
    rank: dict[str, int]  # of pieces of several characters that merges reach, by falling score
    halves: dict[str, tuple[str, str]]  # the two pieces of each one's last merge
    byte_ids: list[int]
    written: list[bytes]
    dummy_prefix: bool
    cut: str
    weight: dict[str, float] | None  # of the pieces; None: each weighs 1, and C decides
    dearest: float  # weight of a character that is no piece
    lexicon: dict = field(default_factory=dict)  # P as a tree of characters; under "" stands the piece that ends there
    pairs: dict[str, dict[str, float]] = field(default_factory=dict)  # C's arcs that were met
    n_pairs: int = 0
    young: dict[str, bytes] = field(default_factory=dict)
    old: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": {}, "n_pairs": 0, "young": {}, "old": {}, "lexicon": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def __post_init__(self) -> None:
        for piece in self.weight if self.weight is not None else [*self.rank, *(p for p in self.ids if len(p) == 1)]:
            node = self.lexicon
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece

    # C: the acceptor of pairs, expanded when a pair is first met.
    def pair(self, x: str, y: str) -> float:
        """The weight of the arc x -> y: 0 if no merge crosses the border of x y, which are taken apart latest merge first;
        each pair that once met there must have merged later than the next merge of either."""
        known = self.pairs.get(y)
        if known is None:
            known = self.pairs[y] = {}
        found = known.get(x)
        if found is None:
            self.n_pairs += 1
            if self.n_pairs > PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            found = known[x] = 0.0 if self._agree(x, y) else NEVER
        return found

    def _agree(self, x: str, y: str) -> bool:
        rank, until = self.rank.get, len(self.rank) + 1
        while rank(x + y, until) >= until:
            rx, ry = rank(x, -1), rank(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until, x = rx, self.halves[x][1]
            else:  # of equal merges the left one comes first, so that a crossing one still precedes y's
                until, y = ry + 1, self.halves[y][0]
        return False

    def normalised(self, text: str) -> str:
        """input o N."""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def path(self, text: str) -> list[str]:
        """Pieces of the shortest path through one component of input o N o P o C; single characters stand for fallback."""
        n, pairs, lexicon, weight, bpe = len(text), self.pairs, self.lexicon, self.weight, self.weight is None
        least, last = [0.0] + [NEVER] * n, [""] * (n + 1)
        for start in range(n):
            here, before, node, end = least[start], last[start], lexicon, start
            while end < n:
                node = node.get(text[end])
                end += 1
                if node is None:
                    if end > start + 1:
                        break
                    node, piece = {}, text[start]
                    cost = here + self.dearest
                else:
                    piece = node.get("")
                    if piece is None:
                        if end == start + 1 and not bpe and text[start] not in weight:
                            piece, cost = text[start], here + self.dearest
                        else:
                            continue
                    else:
                        cost = here + (1.0 if bpe else weight[piece])
                if bpe and start:
                    known = pairs.get(piece)
                    more = known.get(before) if known is not None else None
                    cost += self.pair(before, piece) if more is None else more
                if cost < least[end]:
                    least[end], last[end] = cost, piece
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def arcs(self, piece: str) -> list[int]:
        one = self.ids.get(piece)
        return [one] if one is not None else [self.byte_ids[b] for b in piece.encode("utf-8")]

    def component(self, text: str) -> bytes:
        found = self.young.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = np.array([i for p in self.path(text) for i in self.arcs(p)], "<u4").tobytes()
            if len(text) <= 64:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[text] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get, parts = self.young.get, re.findall(self.cut, self.normalised(text))
        out = list(map(get, parts))
        for i, x in enumerate(out):
            if x is None:
                out[i] = self.component(parts[i])
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse: pieces' bytes, marks as spaces, without the dummy prefix; a byte that is no UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def merge_order(score: dict[str, float]) -> tuple[dict[str, int], dict[str, tuple[str, str]]]:
    """Ranks and last merges of the pieces of several characters that the merges make of their own text."""
    halves = {}
    for piece in score:
        parts, pair = list(piece), ("", "")
        while len(parts) > 1:
            able = [(-score[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score]
            if not able:
                break
            i = min(able)[1]
            pair = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(piece) > 1 and len(parts) == 1:
            halves[piece] = pair
    place = {s: i for i, s in enumerate(sorted({score[p] for p in halves}, reverse=True))}
    return {p: place[score[p]] for p in halves}, halves


def compile_model(path: str) -> Transducer:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.trainer_spec
    if kind.model_type not in (kind.BPE, kind.UNIGRAM) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix:
        raise ValueError("a BPE or unigram model with the identity normaliser and kept white space is needed")
    if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces aren't supported")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
    byte_ids = [byte[f"<0x{b:02X}>"] for b in range(256)]
    out = [p.piece.encode() if p.type == NORMAL else b"" for p in model.pieces]
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    longer = [p for p in ids if len(p) > 1]
    inner = {c for p in longer for c in p}
    if any(MARK in p.lstrip(MARK) for p in longer):
        cut = r"[\s\S]+"
    else:
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        cut = f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
    score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
    if kind.model_type == kind.BPE:
        return Transducer(ids, *merge_order(score), byte_ids, out, norm.add_dummy_prefix, cut, None, 1.0)
    return Transducer(ids, {}, {}, byte_ids, out, norm.add_dummy_prefix, cut, {p: -x for p, x in score.items()}, FALLBACK - min(score.values()))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs' doc_id with ids (array<int>), n_tokens, ids_crc32, decoded_sha256 and round_trip."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(compile_model(path or model_path()))  # as large as the model
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for part in slices(batches):
            ids, n, crc, sha, same = [], [], [], [], []
            for text in part.column("text").to_pylist():
                raw = machine.encode(text)
                got = np.frombuffer(raw, "<u4")
                back = machine.decode(got)
                ids.append(got.astype(np.int32))
                n.append(len(got))
                crc.append(zlib.crc32(raw))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (text or ""))
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents")).drop("ids")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document that is left."""
    return encoded(docs)
