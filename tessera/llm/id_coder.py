"""Adaptive context-mixing range coder for token ids.

A file's ids are cut into blocks of about BLOCK_IDS. Every block starts from a fresh model, decodes from its own words
and the file's header alone, and carries a CRC-32 of its ids and words.

Model of a block. What was coded so far (the history) is kept sorted by id (as numbered by falling share in the file), next id and the id after that, so that
one sorted array holds the adaptive counts of all orders: the entries that begin with the last two ids are
order 2's distribution of the next one, those that begin with the last id order 1's, and all entries order 0's. A
fourth part is the file's own distribution (powers of two near the counts, in the header), which gives every id of the
file a share. The four are mixed: their weights are adaptive shares, in the block, of how often each order was the
highest to know the next id, by how many entries orders 2 and 1 have there. The sorted history and the weights are
renewed when the block has grown fourfold (marks()), in between they stand still; an id takes the highest order
that knows it. Its interval in 2^26 drives a 48-bit range coder with 16-bit words; carries are added when a
block ends.

Blocks are coded side by side, one numpy lane each, which changes nothing in a block's bytes. The encoder sorts each
block once: the entries of a history are those of the whole block's order that came early enough, so all its intervals
come from running counts, and only the range itself is narrowed id by id. The decoder sorts at each renewal.

A file image: the header (magic, version, blocks, documents, ids, ids before it in its part), then zlib-packed
document ids (with a null flag each), id counts, the distinct ids and their shares, then for each block its words and
CRC-32, then the blocks' words. Numbers are little-endian. Ids are unsigned 32-bit ones, up to 2^21 distinct ones a file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION, BLOCK_IDS, LANES = b"TIDB", 3, 2048, 3072
FILE_IDS = 2048 * BLOCK_IDS  # a file ends with the document that reaches this
_HEAD = struct.Struct("<4sHIQQQIII")
_MIX, _SPAN = 12, 14
#: All arithmetic on ranges is on whole numbers in doubles, which are exact below 2^53.
_ONE, _TOP, _WORD, _LEAST, _FULL = 2.0**_SPAN, 2.0 ** (_MIX + _SPAN), 2.0**16, 2.0**32, 2.0**48
_ROWS = 32  # lanes whose tables are made at once, so that they stay in the processor's cache
#: Classes of how many entries order 2 and order 1 have: the least number of each class.
_STEPS2, _STEPS1 = np.array([0, 1, 2, 3, 6]), np.array([0, 1, 2, 4, 9, 25])
_CLASSES = len(_STEPS2) * len(_STEPS1)
#: Counts that the weights start from: orders 2, 1, 0 and the file's distribution.
_START = np.array([[[3 * c2 + 2 if c2 else 0, c1 + 1 if c1 else 0, 6, 4] for c1 in range(len(_STEPS1))] for c2 in range(len(_STEPS2))]).reshape(_CLASSES, 4)


class Damaged(ValueError):
    """A file image or block that isn't what was written."""


def marks(n: int) -> list[int]:
    """Sizes at which a block of n ids renews its model, and n."""
    out = [0]
    while (at := max(64, 4 * out[-1])) < n:
        out.append(at)
    return [*out, n]


def _classes(steps: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(steps, np.arange(n + 1), "right") - 1


def _weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts: lanes x classes x 4. Where order 2, 1, 0 and the file's distribution begin, up to _TOP, and how wide they are in steps of _ONE."""
    top = 1 << _MIX
    share = np.where(_START > 0, counts * (top - 4) // counts.sum(2, keepdims=True) + 1, 0)
    first, second = share[:, :, 0], share[:, :, 0] + share[:, :, 1]
    begin = np.stack([np.zeros_like(first), first, second, top - share[:, :, 3]], 2).reshape(-1, 4)
    return begin * _ONE, np.diff(begin, append=top).astype(float)


def _sorted(h: np.ndarray, entries: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """h: lanes x ids (below 2^bits). The order of each lane's first `entries` places by the three ids from each, and the keys."""
    n = h.shape[1]
    key = np.zeros((len(h), entries), np.uint64)
    for k in range(3):
        key <<= np.uint64(bits)
        there = min(entries, n - k)
        key[:, :there] |= h[:, k : k + there].astype(np.uint64)
    place = max(1, (entries - 1).bit_length())
    if 3 * bits + place <= 64:
        key <<= np.uint64(place)
        key |= np.arange(entries, dtype=np.uint64)
        key.sort(axis=1)
        return (key & np.uint64((1 << place) - 1)).astype(np.int32), key >> np.uint64(place)
    order = key.argsort(axis=1, kind="stable")
    return order.astype(np.int32), np.take_along_axis(key, order, 1)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted key, all lanes one after another: where a new run of equal keys begins, and these places."""
    new = np.ones(key.shape, bool)
    np.not_equal(key[:, 1:], key[:, :-1], out=new[:, 1:])
    new = new.ravel()
    return new, np.flatnonzero(new).astype(np.int32)


def _prepared(h: np.ndarray, bits: int, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and width of each id's interval among 2^(_MIX + _SPAN), and whether the file's distribution follows."""
    lanes, n = h.shape
    start, width, fresh = np.zeros((lanes, n)), np.zeros((lanes, n)), np.ones((lanes, n), bool)
    order, key = _sorted(h, n, bits)
    flat = (np.arange(lanes)[:, None] * n + order).ravel()
    runs = []  # of one, two and three equal ids: where they begin (and the last one ends), and each place's run
    for level in (1, 2, 3):
        new, begin = _runs(key >> np.uint64(bits * (3 - level)))
        run = np.empty(lanes * n, np.int32)
        run[flat] = np.cumsum(new, dtype=np.int32) - 1
        runs.append((np.append(begin, np.int32(lanes * n)), run.reshape(lanes, n)))
    counts = np.tile(_START, (lanes, 1, 1))
    early = order.astype(np.int16) if n < 1 << 15 else order
    class2, class1 = _classes(_STEPS2, n) * len(_STEPS1), _classes(_STEPS1, n)
    lane = np.arange(lanes)[:, None] * _CLASSES
    for a, b in zip(ends[1:-1], ends[2:], strict=True):
        below = np.zeros(lanes * n + 1, np.int32)  # entries before each place, over all lanes
        np.cumsum(early.ravel() <= a - 3, out=below[1:])
        edges = []
        for (begin, run), last in zip(runs, (b, b, b - 2), strict=True):
            entries, mine = below.take(begin), run[:, a - 2 : last]
            edges += [entries.take(mine), entries.take(mine + 1)]
        s1, e1, s2, e2, s3, e3 = edges
        c1, c2 = s1[:, 1:-1], s2[:, :-2]
        n1, n2 = e1[:, 1:-1] - c1, e2[:, :-2] - c2
        in2, in1, in0 = e3 > s3, e2[:, 1:-1] > s2[:, 1:-1], e1[:, 2:] > s1[:, 2:]
        out2, out1, out0 = (~x.view(np.uint8) & 1 for x in (in2, in1, in0))
        at = out2 * (1 + out1 * (1 + out0))  # the first that knows it
        kind = (lane + class2.take(n2) + class1.take(n1)) * 4 + at
        base, w = (x.take(kind) for x in _weights(counts))
        every = np.arange(lanes)[:, None] * (a - 2)  # where each lane's entries begin
        size = np.where(in2, n2, np.where(in1, n1, a - 2))
        low = np.where(in2, s3 - c2, np.where(in1, s2[:, 1:-1] - c1, s1[:, 2:] - every))
        high = np.where(in2, e3 - c2, np.where(in1, e2[:, 1:-1] - c1, e1[:, 2:] - every))
        low, high = np.floor(low * _ONE / size), np.floor(high * _ONE / size)
        new = at == 3
        low[new], high[new] = 0, _ONE
        start[:, a:b] = base + w * low
        width[:, a:b] = w * (high - low)
        fresh[:, a:b] = new
        counts += np.bincount(kind.ravel(), minlength=counts.size).reshape(counts.shape)
    return start, width, fresh


def encode_blocks(ids: np.ndarray, n: np.ndarray, cum: np.ndarray) -> list[np.ndarray]:
    """ids: one row a block, of n ids each (n falls, by 1 at most), below len(cum) - 1; cum: running shares of the ids.

    Each block's 16-bit words.
    """
    lanes, longest = ids.shape
    bits, ends = max(1, (len(cum) - 2).bit_length()), marks(longest)
    start, width, fresh = np.empty((longest, lanes)), np.empty((longest, lanes)), np.empty((longest, lanes), bool)
    for a in range(0, lanes, _ROWS):
        for out, part in zip((start, width, fresh), _prepared(ids[a : a + _ROWS], bits, ends), strict=True):
            out[:, a : a + _ROWS] = part.T
    total, room = float(cum[-1]), 4 * longest + 8
    words, at = np.zeros(lanes * room, np.uint32), np.arange(lanes, dtype=np.int64) * room
    low, size = np.zeros(lanes), np.full(lanes, _FULL)
    share, cum = np.diff(cum).astype(float), cum.astype(float)
    fresh_at = np.concatenate([[0], np.cumsum(np.count_nonzero(fresh, axis=1))])  # of the ids that the file's distribution codes
    fresh_lane = np.nonzero(fresh)[1]
    fresh_id = ids.T[fresh]
    fresh_low, fresh_share = cum.take(fresh_id), share.take(fresh_id)
    model = ends[1] if len(ends) > 2 else longest

    def settle(low: np.ndarray, size: np.ndarray, at: np.ndarray, ready: np.ndarray) -> None:
        while len(ready):
            x, y, where = low.take(ready), size.take(ready) * _WORD, at.take(ready)
            word = np.floor(x * (1 / _LEAST))
            words[where] = word
            low[ready], size[ready], at[ready] = (x - word * _LEAST) * _WORD, y, where + 1
            ready = ready[y < _LEAST]

    for t in range(longest):
        if t == longest - 1:  # blocks that are shorter by one have ended
            live = int((n == longest).sum())
            held = low[live:].copy(), at[live:].copy()
            lo, sz, to = low[:live], size[:live], at[:live]
        else:
            live, lo, sz, to = lanes, low, size, at
        if t >= model:
            r = np.floor(sz * (1 / _TOP))
            lo += start[t, :live] * r
            np.multiply(width[t, :live], r, out=sz)
            settle(lo, sz, to, np.flatnonzero(sz < _LEAST))
        some = slice(fresh_at[t], fresh_at[t] + np.searchsorted(fresh_lane[fresh_at[t] : fresh_at[t + 1]], live))
        new = fresh_lane[some]
        if len(new):
            r = np.floor(sz.take(new) / total)
            lo[new] += fresh_low[some] * r
            r *= fresh_share[some]
            sz[new] = r
            settle(lo, sz, to, new[r < _LEAST])
    if longest:
        low[live:], at[live:] = held
    low = low.astype(np.int64)
    for shift in (32, 16, 0):  # the low end closes a block
        words[at] = (low >> shift) if shift == 32 else (low >> shift) & 0xFFFF
        at += 1
    used = at - np.arange(lanes) * room
    words = words.reshape(lanes, room)[:, : used.max()]
    while (over := words > 0xFFFF).any():
        words[over] -= 0x10000
        words[:, :-1] += over[:, 1:]
    return [words[i, : used[i]].astype(np.uint16) for i in range(lanes)]


class _History:
    """The decoder's tables of one renewal, lanes one after another.

    order: the sorted entries. at: for each place y of the history its id, and the runs that it stands in as the first,
    second and third id (of the entries y, y - 1 and y - 2), each as where it begins and ends.
    """

    def __init__(self, h: np.ndarray, bits: int) -> None:
        lanes, n = h.shape
        self.entries = n - 2
        self.order, at = np.empty((lanes, n - 2), np.int32), np.zeros((lanes, n, 4), np.uint32)
        for a in range(0, lanes, _ROWS):
            self._fill(h[a : a + _ROWS], bits, self.order[a : a + _ROWS], at[a : a + _ROWS])
        self.order, self.at = self.order.ravel(), at.view(np.uint16).reshape(-1, 8)  # each number as its low and high half

    def found(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, and rows of numbers: begin of all entries and of the three runs, and their ends."""
        got, out = self.at.take(places, axis=0), np.zeros((8, len(places)))
        out[4] = self.entries
        out[1:4], out[5:] = got[:, 2::2].T, got[:, 3::2].T
        return got.view(np.uint32)[:, 0].astype(np.int64), out

    @staticmethod
    def _fill(h: np.ndarray, bits: int, order: np.ndarray, at: np.ndarray) -> None:
        lanes, n = h.shape
        order[:], key = _sorted(h, n - 2, bits)
        flat = (np.arange(lanes, dtype=np.int32)[:, None] * n + order).ravel()
        at[:, :, 0] = h
        for level in (1, 2, 3):
            some = key >> np.uint64(bits * (3 - level))
            _, begin = _runs(some)
            size = np.diff(begin, append=np.int32(some.size))
            begin %= n - 2
            run = np.zeros(lanes * n, np.uint32)
            run[flat] = np.repeat((begin | (begin + size) << 16).astype(np.uint32), size)
            run = run.reshape(lanes, n)
            # The last two places aren't entries, but their runs are contexts.
            for place in {1: (n - 2, n - 1), 2: (n - 2,), 3: ()}[level]:
                want = np.zeros(lanes, np.uint64)
                for k in range(level):
                    want = (want << np.uint64(bits)) | h[:, place + k].astype(np.uint64)
                run[:, place] = np.count_nonzero(some < want[:, None], axis=1) | np.count_nonzero(some <= want[:, None], axis=1) << 16
            at[:, level - 1 :, level] = run[:, : n - level + 1]


def decode_blocks(words: list[np.ndarray], n: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """The inverse: one row a block; the last id of a row that is shorter by one is 0."""
    lanes, longest = len(words), int(n.max())
    room = max(map(len, words)) + 8
    data = np.zeros((lanes, room), np.int64)
    for i, w in enumerate(words):
        data[i, : len(w)] = w
    data = data.ravel()
    bits, ends, total = max(1, (len(cum) - 2).bit_length()), marks(longest), float(cum[-1])
    lane = every = np.arange(lanes, dtype=np.int64)
    at = lane * room
    last = at + room - 1
    code = ((data[at] << 32) | (data[at + 1] << 16) | data[at + 2]).astype(float)
    at += 3
    size = np.full(lanes, _FULL)
    ids, share, cum = np.zeros((longest, lanes), np.int64), np.diff(cum).astype(float), cum.astype(float)
    group_first = np.flatnonzero(np.diff(share, prepend=0))  # ids of equal shares one after another
    group_low, group_share = cum.take(group_first), share.take(group_first)
    counts = np.tile(_START, (lanes, 1, 1))
    class2, class1 = _classes(_STEPS2, longest) * len(_STEPS1), _classes(_STEPS1, longest)

    def settle(ready: np.ndarray) -> None:
        while len(ready):
            where, y = at.take(ready), size.take(ready) * _WORD
            # (The bounds are for damaged words alone.)
            code[ready] = np.minimum(code.take(ready) * _WORD, _FULL - _WORD) + data.take(np.minimum(where, last.take(ready)))
            size[ready], at[ready] = y, where + 1
            ready = ready[y < _LEAST]

    def from_file(some: np.ndarray) -> np.ndarray:
        r = np.floor(size.take(some) / total)
        v = np.minimum(np.floor(code.take(some) / r), total - 1)
        group = np.searchsorted(group_low, v, "right") - 1
        x = group_first.take(group) + ((v - group_low.take(group)) / group_share.take(group)).astype(np.int64)
        code[some] -= cum.take(x) * r
        r *= share.take(x)
        size[some] = r
        settle(some[r < _LEAST])
        return x

    def trimmed() -> None:
        """Only blocks of full length have a last id."""
        nonlocal lane, code, size, at, last
        live = int((n == longest).sum())
        lane, code, size, at, last = lane[:live], code[:live], size[:live], at[:live], last[:live]

    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a == 0:
            for t in range(b):
                if t == longest - 1:
                    trimmed()
                ids[t, : len(lane)] = from_file(lane)
            continue
        table = _History(np.ascontiguousarray(ids[:a].T), bits)
        begins, widths = _weights(counts)
        row, first, kinds = lane * a, lane * table.entries, lane * _CLASSES
        _, known = table.found(row + a - 1)
        seen = []
        for t in range(a, b):
            if t == longest - 1:
                trimmed()
                row, first, kinds, known = row[: len(lane)], first[: len(lane)], kinds[: len(lane)], np.ascontiguousarray(known[:, : len(lane)])
            live = len(lane)
            kind = kinds + class2.take((known[6] - known[2]).astype(np.int64)) + class1.take((known[5] - known[1]).astype(np.int64))
            edges = begins.take(kind, axis=0)
            r = np.floor(size * (1 / _TOP))
            v = np.minimum(np.floor(code / r), _TOP - 1)
            in2, in1, in0 = v < edges[:, 1], v < edges[:, 2], v < edges[:, 3]
            higher = in2.view(np.int8) + in1.view(np.int8)
            kind *= 4
            kind += 3 - (higher + in0.view(np.int8))
            base, w = begins.take(kind), widths.take(kind)
            at_order = higher * np.int64(live) + every[:live]  # of order 0, 1 or 2's row
            begin = known.take(at_order)
            some = known.take(at_order + 4 * live) - begin
            place = ((np.floor((v - base) / w) + 1) * some - 1) * (1 / _ONE)  # its whole part
            y = row + table.order.take(first + (begin + np.floor(place)).astype(np.int64)) + higher
            x, known = table.found(y)
            at_order += live  # of one id more
            low, high = known.take(at_order) - begin, known.take(at_order + 4 * live) - begin
            low, high = np.floor(low * _ONE / some), np.floor(high * _ONE / some)
            known[2] *= in1
            known[6] *= in1
            new = np.flatnonzero(~in0)
            low[new], high[new] = 0, _ONE
            code -= (base + w * low) * r
            np.multiply(w * (high - low), r, out=size)
            settle(np.flatnonzero(size < _LEAST))
            if len(new):
                x[new] = from_file(new)
                known[1, new] = known[5, new] = 0
            ids[t, : len(lane)] = x
            seen.append(kind)
        counts += np.bincount(np.concatenate(seen), minlength=counts.size).reshape(counts.shape)
    return ids.T


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, each id's place among them, and the exponents of their shares."""
    if ids.max(initial=0) < 1 << 24:
        n = np.bincount(ids)
        distinct = np.flatnonzero(n)
        place = np.zeros(len(n), np.int64)
        place[distinct] = np.arange(len(distinct))
        rank, n = place[ids], n[distinct]
    else:
        distinct, rank, n = np.unique(ids, return_inverse=True, return_counts=True)
    if len(distinct) > 1 << 21:
        raise ValueError("a file holds 2^21 distinct ids at most")
    return distinct.astype(np.uint32), rank, (np.frexp(n)[1] - 1).astype(np.uint8)


def _by_share(exponents: np.ndarray) -> np.ndarray:
    """The order in which a file's ids are coded: by falling share, so that one is found by few comparisons."""
    return np.argsort(-exponents.astype(np.int8), kind="stable")


def _running(exponents: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.int64(1) << exponents.astype(np.int64))])


def _sizes(n_ids: int, n_blocks: int) -> np.ndarray:
    """Blocks are equally long, the first ones by one more where that doesn't go even."""
    return n_ids // n_blocks + (np.arange(n_blocks) < n_ids % n_blocks) if n_blocks else np.zeros(0, np.int64)


def encode_file(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, before: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A file image of whole documents: their ids, how many each has, and all ids one after another."""
    if block_ids > 1 << _SPAN:
        raise ValueError("a block has 2^14 ids at most")
    distinct, rank, exponents = _alphabet(ids)
    order = _by_share(exponents)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rank, cum = place[rank], _running(exponents[order])
    sizes = _sizes(len(ids), -(-len(ids) // block_ids))
    cut = np.concatenate([[0], np.cumsum(sizes)])
    table, payload = [], []
    for a in range(0, len(sizes), LANES):
        n = sizes[a : a + LANES]
        grid = np.zeros((len(n), int(n.max())), np.int64)
        grid[np.arange(grid.shape[1])[None, :] < n[:, None]] = rank[cut[a] : cut[a + len(n)]]
        for i, w in enumerate(encode_blocks(grid, n, cum), a):
            raw = w.astype("<u2").tobytes()
            table.append((len(w), zlib.crc32(raw, zlib.crc32(ids[cut[i] : cut[i + 1]].astype("<u4").tobytes()))))
            payload.append(raw)
    docs = doc_ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + counts.astype("<u8").tobytes()
    docs = zlib.compress(docs + np.diff(distinct, prepend=np.uint32(0)).astype("<u4").tobytes() + exponents.tobytes(), 6)
    blocks = np.array(table, "<u4").reshape(-1, 2).tobytes()
    head = _HEAD.pack(MAGIC, VERSION, len(sizes), len(doc_ids), len(ids), before, len(distinct), len(docs), zlib.crc32(docs + blocks))
    return b"".join([head, docs, blocks, *payload])


def decode_file(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """What encode_file was given; Damaged if anything differs from its checksums."""
    if len(image) < _HEAD.size:
        raise Damaged("short header")
    magic, version, n_blocks, n_docs, n_ids, before, n_distinct, size, crc = _HEAD.unpack_from(image)
    at = _HEAD.size + size
    if magic != MAGIC or version != VERSION or zlib.crc32(image[_HEAD.size : at + 8 * n_blocks]) != crc:
        raise Damaged("header or tables differ from their checksum")
    docs = zlib.decompress(image[_HEAD.size : at])
    doc_ids, null, counts = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs).astype(bool), np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    distinct = np.cumsum(np.frombuffer(docs, "<u4", n_distinct, 17 * n_docs), dtype=np.uint32)
    exponents = np.frombuffer(docs, np.uint8, n_distinct, 17 * n_docs + 4 * n_distinct)
    order = _by_share(exponents)
    distinct, cum = distinct[order], _running(exponents[order])
    table = np.frombuffer(image, "<u4", 2 * n_blocks, at).reshape(-1, 2).astype(np.int64)
    at += 8 * n_blocks
    cut = at + 2 * np.concatenate([[0], np.cumsum(table[:, 0])])
    if cut[-1] != len(image):
        raise Damaged("another length than the block table's")
    sizes = _sizes(n_ids, n_blocks)
    place = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.empty(n_ids, np.uint32)
    for a in range(0, n_blocks, LANES):
        n = sizes[a : a + LANES]
        got = decode_blocks([np.frombuffer(image, "<u2", table[i, 0], cut[i]) for i in range(a, a + len(n))], n, cum)
        ids[place[a] : place[a + len(n)]] = distinct[got[np.arange(got.shape[1])[None, :] < n[:, None]]]
    for i in range(n_blocks):
        if zlib.crc32(image[cut[i] : cut[i + 1]], zlib.crc32(ids[place[i] : place[i + 1]].astype("<u4").tobytes())) != table[i, 1]:
            raise Damaged(f"block {i} differs from its checksum")
    return doc_ids, null, counts, ids, before
