"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte of a document goes if a string of ``SPAN`` bytes that covers it also
starts in a document with a smaller doc_id. Sorting every suffix of a corpus
would move each byte fifty times, so only anchors are sorted: of the 26 grams of
``GRAM`` bytes inside a string of 50 the leftmost one with the least hash. The
same string has the same anchor wherever it stands, hence no repeat is lost; of a
suffix only the 50 bytes count that a string can reach.

1. One pass hashes the grams of each text and picks the anchors; anchors whose
   gram occurs in one document only are dropped with the help of a bit table of
   fixed size (a false hit only costs work).
2. Each task sorts the suffixes at its anchors, with up to 25 bytes before them,
   into one run per key range and front-codes it: every suffix is stored as the
   length of the prefix it shares with the one before and the rest. Of equal
   suffixes a run holds that of its smallest document; the others are repeats for
   certain, so copies cost one element a task. Runs go to the owner of their range.
3. The owner merges its runs with a loser tree. A suffix carries the length of
   the prefix it has in common with the last winner; two suffixes with different
   such lengths are ordered without looking at a byte, and equal lengths are
   compared from there on, so known prefixes are never compared again.
4. In the merged order the suffixes of one gram stand together. For each of the 26
   places of the anchor within a string, the smallest document with the same bytes
   before and behind decides whether the string is a repeat. Grams that very many
   documents share are not gathered: their strings themselves are sorted, in the
   order of a hash and then of their bytes, front-coded and merged the same way, so
   each is a key of its own and its bytes decide. Such grams are counted exactly,
   and from a number of documents that grows with the input, so that there are at
   most ``MOST_HOT``, whatever the size.
5. What was found goes back to its document as intervals, and the kept bytes are
   written.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced

SPAN = 50
GRAM = 25
BEFORE = SPAN - GRAM  # an anchor stands at place 0..BEFORE of a string
KEY = SPAN + 1 + BEFORE + 1  # bytes behind, how many; bytes before, nearest first, how many
TABLE_BITS = 27  # of the table of shared grams: 16 MB
HOT_LEAST, MOST_HOT = 2_000, 1 << 18  # a gram is hot from so many documents; as many grams at most
RANGE = 64 << 20  # bytes of text for which there is a key range at least
WIDE = 8 + SPAN  # a hash and a string
SAMPLE_DOCS = 2_000  # whose anchors give the key ranges
PIECE = 1 << 19  # bytes hashed at once
RUN = 200_000  # anchors in a run
HELD = 800_000  # anchors gathered before those of single documents are dropped

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_AT = np.uint64((1 << 24) - 1)
_WEIGHTS = np.random.default_rng(50).integers(0, 1 << 63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shaken(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of the texts [starts, ends) in ``data``: positions, hashes of
    their grams, and of the strings that each is the anchor of the bytes before and
    behind it. Texts shorter than ``SPAN`` have none."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < SPAN:
        return none, np.empty(0, np.uint64), none, none
    m = n - GRAM + 1
    h1 = (data.astype(np.uint64) + np.uint64(1)) * _M1
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint64(29))) * _M2 + h1[1:]
    h4 = (h2[:-2] ^ (h2[:-2] >> np.uint64(31))) * _M1 + h2[2:]
    h8 = (h4[:-4] ^ (h4[:-4] >> np.uint64(30))) * _M2 + h4[4:]
    x = _shaken(_shaken(_shaken(h8[:m]) + h8[8 : 8 + m]) + h8[16 : 16 + m] + h1[24 : 24 + m])
    key = (x & ~_AT) | np.arange(m, dtype=np.uint64)  # of equal hashes the leftmost
    width = 1
    while width * 2 <= BEFORE + 1:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    rest = BEFORE + 1 - width
    key = np.minimum(key[: len(key) - rest], key[rest:])  # least of the grams of the string at each place
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= SPAN
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(key)]) > 0)  # where strings begin
    pos = (key[at] & _AT).astype(np.int64)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(pos)), bool), pos[1:] != pos[:-1])))
    last = np.append(new[1:], len(pos))[: len(new)] - 1
    pos, first, last = pos[new], at[new], at[last]
    # hashed anew: the least of many hashes are small ones
    return pos, _shaken(x[pos] * _M1 + _M2), pos - first, last + SPAN - pos


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in joined pieces: [(index, offset of the piece in its text)], bytes,
    starts, ends. A long text comes in overlapping pieces that hold each of its
    strings once."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        lengths = np.array([len(x) for *_, x in held], np.int64)
        ends = np.cumsum(lengths)
        return [(i, o) for i, o, _ in held], np.frombuffer(b"".join(x for *_, x in held), np.uint8), ends - lengths, ends

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - SPAN + 1, 1), PIECE):
            part = text if len(text) <= PIECE else text[at : at + PIECE + SPAN - 1]
            if held and size + len(part) > PIECE:
                yield joined()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield joined()


def _gathered(batches: Iterator[pa.RecordBatch], limit: int):
    """Anchors of about ``limit`` at a time: documents (id, text hash, text) and
    arrays of document index, position in the text, gram hash, bytes before and
    behind."""
    docs: list[tuple[int, int, bytes]] = []
    found: list[tuple[np.ndarray, ...]] = []
    n = 0
    for b in sliced(batches):
        base, texts = len(docs), [t or b"" for t in b.column(2).to_pylist()]
        docs += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True)
        for where, data, starts, ends in _pieces(texts):
            pos, *rest = anchors(data, starts, ends)
            part = np.searchsorted(ends, pos, side="right")
            index = (np.array([i for i, _ in where], np.int64)[part] + base).astype(np.int32)
            at = pos - starts[part] + np.array([o for _, o in where], np.int64)[part]
            x, before, behind = rest
            found.append((index, at, x, before.astype(np.uint8), behind.astype(np.uint8)))
            n += len(pos)
        if n >= limit:
            yield docs, *map(np.concatenate, zip(*found, strict=True))
            docs, found, n = [], [], 0
    if n:
        yield docs, *map(np.concatenate, zip(*found, strict=True))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if len(x) and x.max() < 1 << 32 else x


def _packed(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(raw: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _grams(bits: int):
    """First pass: the gram hashes of a task by bucket, with the numbers of documents
    that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, index, _, x, _, _ in _gathered(batches, HELD):
            order = np.lexsort((index, x))
            x, index = x[order], index[order]
            first = np.concatenate(([True], (x[1:] != x[:-1]) | (index[1:] != index[:-1])))
            x = x[first]
            gram, docs = np.unique(x, return_counts=True)
            bucket = (gram >> np.uint64(64 - bits)).astype(np.int64)
            low = (gram >> np.uint64(32 - bits)).astype(np.uint32)
            docs = docs.astype(np.uint32)
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
            rows = [(int(bucket[a]), _packed(low[a:b], docs[a:b])) for a, b in zip(cuts, [*cuts[1:], len(gram)], strict=True)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    return run


def _tables(bits: int, hot_least: int):
    """Of one bucket: which table slots hold a gram of two documents or more, and
    the hashes of the hot grams."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, docs = map(np.concatenate, zip(*map(_unpacked, pdf["payload"]), strict=True))
        order = np.argsort(low, kind="stable")
        low, docs = low[order], docs[order].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        docs, low = np.add.reduceat(docs, cuts), low[cuts]
        slots = np.zeros(1 << (TABLE_BITS - bits), np.uint8)
        slots[low[docs > 1] >> np.uint32(32 - TABLE_BITS + bits)] = 1
        hot = low[docs >= hot_least].astype("<u4").tobytes()
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "shared": [np.packbits(slots).tobytes()], "hot": [hot]})

    return run


def _joined_tables(tables: dict[int, tuple[bytes, bytes]], bits: int) -> tuple[bytes, np.ndarray, int]:
    """The bit table, the sorted first ``bits`` + 32 bits of the hot grams, and the
    number of bits to shift a gram's hash by for that."""
    none = bytes(1 << max(0, TABLE_BITS - bits - 3))
    hot = [(np.uint64(b) << np.uint64(32)) + np.frombuffer(raw, "<u4").astype(np.uint64) for b, (_, raw) in sorted(tables.items())]
    return b"".join(tables[b][0] if b in tables else none for b in range(1 << bits)), np.concatenate([np.empty(0, np.uint64), *hot]), 32 - bits


def _is_hot(hot: np.ndarray, shift: int, x: np.ndarray) -> np.ndarray:
    key = x >> np.uint64(shift)
    at = np.minimum(hot.searchsorted(key), max(0, len(hot) - 1))
    return hot[at] == key if len(hot) else np.zeros(len(x), bool)


def _hit(table: bytes, bits: int, x: np.ndarray) -> np.ndarray:
    slot = (x >> np.uint64(64 - bits)).astype(np.int64)
    return (np.frombuffer(table, np.uint8)[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


def _keys(docs: list, index: np.ndarray, pos: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """A row of ``KEY`` bytes for each anchor."""
    lengths = np.array([len(d[2]) for d in docs], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(d[2] for d in docs), np.uint8)
    out = np.zeros((len(pos), KEY), np.uint8)
    at = starts[index] + pos
    for i in range(SPAN):
        rows = np.flatnonzero(i < behind)
        out[rows, i] = data[at[rows] + i]
    for i in range(BEFORE):
        rows = np.flatnonzero(i < before)
        out[rows, SPAN + 1 + i] = data[at[rows] - 1 - i]
    out[:, SPAN], out[:, KEY - 1] = behind, before
    return out


def _places(before: int, behind: int) -> int:
    """Bit t: the string that begins t bytes before an anchor is one of its own,
    which reach so many bytes before and behind."""
    return (1 << before + 1) - (1 << max(0, SPAN - behind)) if before >= SPAN - behind else 0


_PLACES = np.array([[_places(b, a) for a in range(SPAN + 1)] for b in range(BEFORE + 1)], np.uint32)


def _valid(keys: np.ndarray) -> np.ndarray:
    return _PLACES[keys[:, KEY - 1], keys[:, SPAN]]


def _string(keys: np.ndarray, t: int) -> np.ndarray:
    return np.concatenate((keys[:, SPAN + 1 : SPAN + 1 + t][:, ::-1], keys[:, : SPAN - t]), axis=1)


_ROWS = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("payload", pa.binary())])
_ROWS_SQL = "kind int, part long, doc_id long, th long, payload binary"
_FOUND_SQL = "doc_id long, th long, payload binary"


def _by_doc(ids: np.ndarray, hashes: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc_id, text hash, positions and masks) for each document."""
    if not len(ids):
        return []
    order = np.lexsort((hashes, ids))
    ids, hashes, pos, mask = ids[order], hashes[order], pos[order], mask[order]
    cuts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))).tolist()
    return [(int(ids[a]), int(hashes[a]), pos[a:b].astype("<i8").tobytes() + mask[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]


def _runs(shared, splitters, buckets: int):
    """Second pass: sorted, front-coded runs by key range (kind 0), what a task
    can decide alone (kind 1), and runs of the strings of hot grams (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_grams, shift = shared.value
        bounds = splitters.value

        def candidates():
            """Batches of anchors in the table, joined up to a run's size."""
            for docs, index, pos, x, before, behind in _gathered(batches, HELD):
                keep = np.flatnonzero(_hit(table, TABLE_BITS, x))
                for a in range(0, len(keep), RUN):
                    part = keep[a : a + RUN]
                    used, local = np.unique(index[part], return_inverse=True)
                    yield [docs[i] for i in used.tolist()], local, pos[part], x[part], before[part], behind[part]

        for docs, index, pos, x, before, behind in candidates():
            ids, hashes = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
            keys, owner = _keys(docs, index, pos, before, behind), ids[index]
            rows = np.concatenate((keys, (owner.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)), axis=1)
            order = np.argsort(np.ascontiguousarray(rows).view(f"V{KEY + 8}").ravel().view(f"S{KEY + 8}"), kind="stable")
            keys, owner, index, pos, x = keys[order], owner[order], index[order], pos[order], x[order]
            differs = keys[1:] != keys[:-1]
            new = np.concatenate(([True], differs.any(axis=1)))
            cuts = np.flatnonzero(new)
            least = np.repeat(owner[cuts], np.diff(np.append(cuts, len(owner))))
            later = owner > least
            out = [(1, r[0] % buckets, *r) for r in _by_doc(owner[later], hashes[index[later]], pos[later], _valid(keys[later]))]
            # what stays: the occurrences in the smallest document of each key
            own = ~later
            group = (np.cumsum(new) - 1)[own]
            refs = (index[own], pos[own], np.bincount(group, minlength=len(cuts)))
            keys, owner, x = keys[cuts], owner[cuts], x[cuts]
            begin = np.concatenate(([0], np.cumsum(refs[2])))
            hot = _is_hot(hot_grams, shift, x)
            out += _front_coded(keys, refs, begin, np.flatnonzero(~hot), ids, hashes, bounds)
            hot = np.flatnonzero(hot)
            for a in range(0, len(hot), RUN // (BEFORE + 1)):
                out += _hot_strings(keys, owner, refs, begin, hot[a : a + RUN // (BEFORE + 1)], ids, hashes, buckets)
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return run


def _spread(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the references of some elements, and the element of each."""
    counts = begin[which + 1] - begin[which]
    first = np.repeat(begin[which] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(len(first)), np.repeat(np.arange(len(which)), counts)


def _tails(k: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Front-codes sorted, different keys: the bytes each shares with the one before,
    and the rest of all."""
    differs = k[1:] != k[:-1]
    shared = np.concatenate(([0], differs.argmax(axis=1))).astype(np.uint8)
    return shared, k[np.arange(k.shape[1])[None, :] >= shared[:, None]].tobytes()


def _front_coded(keys, refs, begin, which, ids, hashes, bounds) -> list[tuple]:
    if not len(which):
        return []
    part = np.searchsorted(bounds, np.ascontiguousarray(keys[which, :GRAM]).view(f"S{GRAM}").ravel(), side="right")
    out = []
    for p in np.unique(part).tolist():  # ascending, as the keys are
        mine = which[part == p]
        at, _ = _spread(begin, mine)
        used, local = np.unique(refs[0][at], return_inverse=True)
        out.append((0, p, None, None, _packed(*_tails(keys[mine]), refs[2][mine].astype(np.uint32), local.astype(np.uint32), _narrow(refs[1][at]), ids[used], hashes[used])))
    return out


def _hot_strings(keys, owner, refs, begin, which, ids, hashes, buckets: int) -> list[tuple]:
    """The strings of some elements as a run of their own: a hash, which deals them
    to the owners of its ranges, and the bytes."""
    k, own = keys[which], owner[which]
    fits, parts = _valid(k), []
    for t in range(BEFORE + 1):
        e = np.flatnonzero(fits >> np.uint32(t) & np.uint32(1))
        s = _string(k[e], t)
        h = _shaken((s.astype(np.uint64) + np.uint64(1)) @ _WEIGHTS)
        parts.append((np.concatenate((h.astype(">u8").view(np.uint8).reshape(-1, 8), s), axis=1), h, e, np.full(len(e), t, np.uint32)))
    wide, h, e, t = map(np.concatenate, zip(*parts, strict=True))
    if not len(wide):
        return []
    rows = np.concatenate((wide, (own[e].astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)), axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{WIDE + 8}").ravel().view(f"S{WIDE + 8}"), kind="stable")
    wide, h, e, t = wide[order], h[order], e[order], t[order]
    cuts = np.flatnonzero(np.concatenate(([True], (wide[1:] != wide[:-1]).any(axis=1))))
    sizes = np.diff(np.append(cuts, len(e)))
    later = own[e] > np.repeat(own[e[cuts]], sizes)
    at, of = _spread(begin, which[e[later]])
    found = _by_doc(ids[refs[0][at]], hashes[refs[0][at]], refs[1][at], np.uint32(1) << t[later][of])
    out = [(1, r[0] % buckets, *r) for r in found]
    # what stays: the occurrences in the smallest document of each string
    group = (np.repeat(np.arange(len(cuts)), sizes))[~later]
    e, wide, t, part = e[~later], wide[cuts], t[cuts], ((h[cuts] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(group, np.arange(len(cuts) + 1))
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        some = e[first[mine[0]] : first[mine[-1] + 1]]  # a range of the hash is a stretch of the run
        at, of = _spread(begin, which[some])
        counts = np.bincount(group[first[mine[0]] : first[mine[-1] + 1]][of] - mine[0], minlength=len(mine))
        used, local = np.unique(refs[0][at], return_inverse=True)
        out.append((2, p, None, None, _packed(*_tails(wide[mine]), counts.astype(np.uint32), local.astype(np.uint32), _narrow(refs[1][at]), ids[used], hashes[used], t[mine])))
    return out


def _stream(payload: bytes, number: int):
    """The elements of a run in order: (key, prefix shared with the one before, owner, run, element)."""
    shared, tails, counts, local, _, ids, *_ = _unpacked(payload)
    width = KEY if len(_) == 1 else WIDE
    owner = ids[local[np.cumsum(counts, dtype=np.int64) - counts]]
    key, at = b"", 0
    for i, (n, o) in enumerate(zip(shared.tolist(), owner.tolist(), strict=True)):
        end = at + width - n
        key = key[:n] + tails[at:end]
        at = end
        yield key, n, o, number, i


def merged(streams: list) -> Iterator[tuple[int, bytes, int, int, int]]:
    """Merges sorted streams of (key, shared, owner, run, element) with a loser
    tree: (prefix shared with the key before, key, owner, run, element).

    Each loser keeps the length of the prefix it shares with the winner that beat
    it. After a win, the next key of that stream shares ``shared`` bytes with the
    key just given out, as do the losers on its path with theirs: the longer
    prefix is the smaller key, and only at equal lengths are bytes compared, from
    that length on."""
    k = 1
    while k < len(streams):
        k *= 2
    heads: list = [next(s, None) for s in streams] + [None] * (k - len(streams))
    tree, common = [0] * k, [0] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner with its prefix, loser with the prefix it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, la, b, 0
        if x is None:
            return b, lb, a, 0
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        p, q, n = x[0], y[0], la
        if p == q:
            return a, la, b, len(p)
        while p[n] == q[n]:
            n += 1
        return (a, la, b, n) if p[n] < q[n] else (b, lb, a, n)

    winners = [(i, 0) for i in range(k)]
    level = k // 2
    while level >= 1:
        new = []
        for j in range(level):
            w, lw, lose, ll = play(*winners[2 * j], *winners[2 * j + 1])
            tree[level + j], common[level + j] = lose, ll
            new.append((w, lw))
        winners, level = new, level // 2
    w, lw = winners[0]
    while heads[w] is not None:
        key, _, owner, run, element = heads[w]
        yield lw, key, owner, run, element
        heads[w] = head = next(streams[w], None)
        lw = head[1] if head else 0
        node = (w + k) // 2
        while node >= 1:
            w, lw, tree[node], common[node] = play(w, lw, tree[node], common[node])
            node //= 2


def _covered(group: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(run, element, mask) for the elements of one gram that have strings in a
    smaller document."""
    first, low = group[0][0], min(g[1] for g in group)
    if all(g[1] == low for g in group):
        return
    if all(g[0] == first for g in group):
        mask = _places(first[KEY - 1], first[SPAN])
        for _, owner, run, element in group:
            if owner > low:
                yield run, element, mask
        return
    masks = [0] * len(group)
    for t in range(BEFORE + 1):
        least: dict[tuple[bytes, bytes], int] = {}
        of = []
        for key, owner, _, _ in group:
            if t <= key[KEY - 1] and SPAN - t <= key[SPAN]:
                s = (key[SPAN + 1 : SPAN + 1 + t], key[: SPAN - t])
                of.append(s)
                if owner < least.get(s, 1 << 64):
                    least[s] = owner
            else:
                of.append(None)
        for i, s in enumerate(of):
            if s is not None and least[s] < group[i][1]:
                masks[i] |= 1 << t
    for (_, _, run, element), mask in zip(group, masks, strict=True):
        if mask:
            yield run, element, mask


def _same(group: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, None]]:
    """(run, element, None) for the elements of one string that are in a larger
    document than its smallest."""
    low = min(g[1] for g in group)
    for _, owner, run, element in group:
        if owner > low:
            yield run, element, None


def _merge(pdf: pd.DataFrame, strings: bool = False) -> pd.DataFrame:
    """Merges the runs of a range: of suffixes, by gram, or of whole ``strings``."""
    payloads = pdf["payload"].tolist()
    found: list[list[tuple[int, int]]] = [[] for _ in payloads]
    group: list[tuple[bytes, int, int, int]] = []
    width, decide = (WIDE, _same) if strings else (GRAM, _covered)

    def close() -> None:
        if len(group) > 1:
            for run, element, mask in decide(group):
                found[run].append((element, mask))
        group.clear()

    for shared, key, owner, run, element in merged([_stream(p, i) for i, p in enumerate(payloads)]):
        if shared < width:
            close()
        group.append((key, owner, run, element))
    close()
    out = []
    for payload, hits in zip(payloads, found, strict=True):
        if hits:
            _, _, counts, local, pos, ids, hashes, *places = _unpacked(payload)
            e = np.array([h[0] for h in hits])
            mask = np.uint32(1) << places[0][e] if strings else np.array([h[1] for h in hits]).astype(np.uint32)
            at, of = _spread(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), e)
            i = local[at]
            out += _by_doc(ids[i], hashes[i], pos[at], mask[of])
    return pd.DataFrame(out, columns=["doc_id", "th", "payload"])


def _decided(pdf: pd.DataFrame) -> pd.DataFrame:
    """All rows of a kind and part: what has been decided passes on."""
    kind = int(pdf["kind"].iloc[0])
    return pdf[["doc_id", "th", "payload"]] if kind == 1 else _merge(pdf, kind == 2)


def removed(lengths: np.ndarray, payloads: list[list[bytes] | None]) -> np.ndarray:
    """Which bytes go, of texts of some ``lengths`` laid end to end, from the
    positions and masks found for each."""
    starts = np.cumsum(lengths) - lengths
    pos, mask = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for start, found in zip(starts.tolist(), payloads, strict=True):
        for raw in found or ():
            k = len(raw) // 12
            pos.append(np.frombuffer(raw, "<i8", k) + start)
            mask.append(np.frombuffer(raw, "<u4", k, 8 * k))
    pos, mask = np.concatenate(pos), np.concatenate(mask)
    size = int(lengths.sum()) + 1
    out = np.zeros(size, np.int64)
    for t in range(BEFORE + 1):
        begin = pos[(mask >> np.uint32(t)) & np.uint32(1) > 0] - t
        out += np.bincount(begin, minlength=size) - np.bincount(begin + SPAN, minlength=size) if len(begin) else 0
    return np.cumsum(out[:-1]) > 0


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 64):
        texts = [t or b"" for t in b.column(1).to_pylist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        gone = removed(lengths, b.column(2).to_pylist())
        rows, at = [], 0
        for text in texts:
            cut = gone[at : at + len(text)]
            at += len(text)
            n = int(cut.sum())
            spans = int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])) if n else 0
            rows.append((len(text), n, spans, np.frombuffer(text, np.uint8)[~cut].tobytes() if n else text))
        n, m, k, kept = zip(*rows, strict=True)
        yield pa.record_batch(
            [b.column(0), *(pa.array(c, pa.int64()) for c in (n, m, k)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def _splitters(slim: DataFrame, parts: int) -> np.ndarray:
    """Bounds between key ranges from the anchors of at most SAMPLE_DOCS documents."""
    ids = slim.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = slim.join(F.broadcast(ids.distinct()), "doc_id").select(F.substring("text", 1, 4000).alias("text")).limit(SAMPLE_DOCS).collect()
    grams = []
    for _, data, starts, ends in _pieces([bytes(r.text or b"") for r in rows]):
        pos, *_ = anchors(data, starts, ends)
        grams += [data[p : p + GRAM].tobytes() for p in pos.tolist()]
    grams.sort()
    picked = sorted({grams[len(grams) * i // parts] for i in range(1, parts)}) if grams else []
    return np.array(picked, f"S{GRAM}")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row of
    ``docs`` (doc_id, text): the bytes that stay, and counts of those that go.

    Defined cases: null text counts as empty; texts under ``SPAN`` bytes lose
    nothing; a null doc_id takes no part and keeps all; rows that share a doc_id
    are never repeats of each other; repeats within one document stay; an empty
    table gives no rows. kept may cut a character in two, so it is binary.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = min(16, max(6, (4 * parts - 1).bit_length()))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    slim = every.where("doc_id is not null")
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    hot_least, ranges = max(HOT_LEAST, size // MOST_HOT), max(4 * parts, -(-size // RANGE))
    grams = slim.mapInArrow(_grams(bits), "bucket long, payload binary")
    tables = {
        r.bucket: (bytes(r.shared), bytes(r.hot))
        for r in grams.groupBy("bucket").applyInPandas(_tables(bits, hot_least), "bucket long, shared binary, hot binary").collect()  # 17 MB in all
    }
    sc = spark.sparkContext
    run = _runs(sc.broadcast(_joined_tables(tables, bits)), sc.broadcast(_splitters(slim, ranges)), ranges)
    found = slim.mapInArrow(run, _ROWS_SQL).groupBy("kind", "part").applyInPandas(_decided, _FOUND_SQL)
    by_doc = found.groupBy("doc_id", "th").agg(F.collect_list("payload").alias("payloads"))
    joined = every.join(by_doc, ["doc_id", "th"], "left").select("doc_id", "text", "payloads")
    return joined.mapInArrow(_finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
