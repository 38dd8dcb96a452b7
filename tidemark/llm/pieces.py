"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces reads a text once. At each
position it follows its output links over all pieces that end there, and each
relaxes the best score of that position: a single-pass Viterbi for the
segmentation with the greatest sum of piece scores. Characters without a piece
fall back to byte pieces.

Between two characters that no piece holds next to each other every segmentation
has a border. Texts are cut there, many at once in arrays, and equal parts are
encoded once: parts are known by 64-bit hashes and their ids are held in a flat
array of bounded size. New parts of a batch are read by the automaton in one go,
with a character between them that no piece has, and relaxed together: all matches
that end k characters into their parts are one array step. The model's own scores
are used; for a model of merges these are negated merge ranks, so the result is the
best segmentation under them and not the one that replaying merges gives. Decoding
gives back the very text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced
from tidemark.llm.hashing import PIECE, Sums, numbers

HELD = 1 << 21  # ids, and a quarter as many parts, that a worker holds
LONGEST = 48  # characters of a part that is relaxed with others
TOGETHER = 4_096  # parts relaxed together
SPACE = "▁"  # what pieces have for a space


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces; ``encode`` and ``decode`` for single texts. Spaces become
    U+2581 and one is put in front, as the model's own encoder does; a U+2581 of
    the text itself is written in byte pieces, which keeps decoding exact."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        if self.size > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.out: list[bytes] = [b""] * self.size
        self.byte: list[int] = [-1] * 256
        self.pieces: dict[str, tuple[int, int, float]] = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte[value], self.out[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = (i, len(piece), sp.get_score(i))
                self.out[i] = piece.replace(SPACE, " ").encode()
        if -1 in self.byte:
            raise ValueError("the model has no byte pieces to fall back to")
        self.automaton = ahocorasick.Automaton()
        self.lengths, self.values = [0] * self.size, [0.0] * self.size
        for piece, (i, n, v) in self.pieces.items():
            self.automaton.add_word(piece, i)
            self.lengths[i], self.values[i] = n, v
        self.automaton.make_automaton()
        self.single = {p for p in self.pieces if len(p) == 1}
        self.unknown = min(s for _, _, s in self.pieces.values() if s > -1e8) - 10
        self.adjacent = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # a border before each space that follows another character: long texts may be cut there
        self.by_word = not any(a != SPACE and b == SPACE for a, b in self.adjacent)
        self.sizes, self.scores = np.array(self.lengths), np.array(self.values)
        free = (c for c in map(chr, range(0x10FFFF, 0, -1)) if c not in self.single)
        self.between, self.own_space = next(free), next(free)  # noncharacters: between texts, and for a U+2581 of a text
        letters = sorted({c for pair in self.adjacent for c in pair})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number = {c: i for i, c in enumerate(letters, start=1)}
        pairs = np.array(sorted(number[a] * self.width + number[b] for a, b in self.adjacent))
        flags = np.zeros(self.width * self.width, bool)
        flags[pairs] = True
        self.together_bits = np.packbits(flags, bitorder="little")
        self.number = numbers(0x110000)
        self.forget()

    def forget(self) -> None:
        """Empties the cache of parts."""
        self.slots: dict[int, int] = {}
        self.flat = np.zeros(1 << 12, np.uint16)
        self.used = 0
        self.begin, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def best(self, s: str) -> list[int]:
        """Ids of the best segmentation of ``s``, where spaces are U+2581. Of equal
        scores the longer last piece wins."""
        n = len(s)
        score, back, at = [0.0] + [float("-inf")] * n, [0] * (n + 1), 0
        known = self.single.issuperset(s)
        sizes, values = self.lengths, self.values

        def fall_back(to: int) -> None:
            for q in range(at + 1, to + 1):
                if s[q - 1] not in self.single and score[q - 1] + self.unknown > score[q]:
                    score[q], back[q] = score[q - 1] + self.unknown, -1

        for end, i in self.automaton.iter(s):
            end += 1
            size, value = sizes[i], values[i]
            if not known and end > at:
                fall_back(end)
                at = end
            v = score[end - size] + value
            if v > score[end]:
                score[end], back[end] = v, i
        if not known:
            fall_back(n)
        ids: list[int] = []
        while n:
            if back[n] < 0:
                n -= 1
                ids += [self.byte[b] for b in reversed(s[n].encode())]
            else:
                ids.append(back[n])
                n -= sizes[back[n]]
        return ids[::-1]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of known characters, as ``best`` gives them."""
        n, length = len(words), np.array([len(w) for w in words])
        starts = np.cumsum(length + 1) - length - 1
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(self.between.join(words))), np.int64)
        ends, ids = flat[::2], flat[1::2]
        word = np.searchsorted(starts, ends, "right") - 1
        at = ends + 1 - starts[word]
        order = np.argsort(at, kind="stable")  # by place; of one word the longest first
        at, word, ids = at[order], word[order], ids[order]
        begin = at - self.sizes[ids]
        score, back = np.full((n, int(length.max()) + 1), -np.inf), np.zeros((n, int(length.max()) + 1), np.int64)
        score[:, 0] = 0.0
        cuts = np.searchsorted(at, np.arange(1, score.shape[1] + 1))
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), start=1):
            w = word[a:b]
            v = score[w, begin[a:b]] + self.scores[ids[a:b]]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            top = np.maximum.reduceat(v, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
            best = np.flatnonzero(v == top[group])
            best = best[np.concatenate(([True], group[best][1:] != group[best][:-1]))]
            score[w[first], k], back[w[first], k] = top, ids[a:b][best]
        steps, left, rows = [], length.copy(), np.arange(n)
        while left.any():
            piece = np.where(left > 0, back[rows, left], -1)
            steps.append(piece)
            left -= np.where(left > 0, self.sizes[piece], 0)
        found = np.stack(steps[::-1], axis=1)
        raw, sizes = found[found >= 0].astype("<u2").tobytes(), 2 * (found >= 0).sum(axis=1)
        stops = np.cumsum(sizes)
        return [raw[a:b] for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]

    def _learn(self, hashes: list[int], parts: list[str]) -> None:
        """Holds the ids of parts by their hashes."""
        ids: list[bytes] = [b""] * len(parts)
        easy = [i for i, p in enumerate(parts) if len(p) <= LONGEST and self.single.issuperset(p)]
        for i in range(0, len(easy), TOGETHER):
            some = easy[i : i + TOGETHER]
            for k, raw in zip(some, self.together([parts[k] for k in some]), strict=True):
                ids[k] = raw
        done = set(easy)
        for k, p in enumerate(parts):
            if k not in done and p != self.between:
                found = [self.byte[b] for b in SPACE.encode()] if p == self.own_space else self.best(p)
                ids[k] = np.array(found, "<u2").tobytes()
        new = np.frombuffer(b"".join(ids), "<u2")
        sizes = np.array([len(x) // 2 for x in ids])
        first, n = len(self.slots), len(parts)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + n > len(self.begin):
            self.begin, self.count = np.concatenate((self.begin, self.begin)), np.concatenate((self.count, self.count))
        self.flat[self.used : self.used + len(new)] = new
        self.begin[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.count[first : first + n] = sizes
        self.used += len(new)
        self.slots.update(zip(hashes, range(first, first + n), strict=True))

    def encode(self, text: str | None) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; none for empty text or null."""
        found: list[list[bytes]] = [[] for _ in texts]
        for part in self._pieces(texts):
            for (i, _), raw in zip(part, self._joined([p for _, p in part]), strict=True):
                found[i].append(raw)
        return [f[0] if len(f) == 1 else b"".join(f) for f in found]

    def _pieces(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(index, stretch) in groups of about PIECE characters, spaces as U+2581. A
        long text is cut before a space behind another character."""
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            s, at = SPACE + text.replace(SPACE, self.own_space).replace(" ", SPACE), 0
            while self.by_word and len(s) - at > PIECE:
                cut = s.rfind(SPACE, at + 1, at + PIECE)
                while cut > at and s[cut - 1] == SPACE:
                    cut -= 1
                if cut <= at:
                    break
                yield [(i, s[at:cut])]
                at = cut
            s = s[at:]
            if held and (size + len(s) > PIECE or at):
                yield held
                held, size = [], 0
            held.append((i, s))
            size += len(s) + 1
        if held:
            yield held

    def _joined(self, stretches: list[str]) -> list[bytes]:
        joined = self.between.join(stretches) + self.between
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = self.place[codes]
        pair = at[:-1].astype(np.int64) * self.width + at[1:]
        inner = (self.together_bits[pair >> 3] >> (pair & 7).astype(np.uint8) & 1).astype(bool)
        starts = np.concatenate(([0], np.flatnonzero(~inner) + 1))
        ends = np.append(starts[1:], len(codes))
        kinds, first, of = np.unique(Sums(self.number[codes]).of(starts, ends), return_index=True, return_inverse=True)
        if self.used > HELD or len(self.slots) > HELD // 4:
            self.forget()
        hashes = kinds.tolist()
        slots = [self.slots.get(h) for h in hashes]
        new = [k for k, s in enumerate(slots) if s is None]
        if new:
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn([hashes[k] for k in new], [joined[x:y] for x, y in zip(a, b, strict=True)])
            for k in new:
                slots[k] = self.slots[hashes[k]]
        slot = np.array(slots)[of]
        counts = self.count[slot]
        before = np.cumsum(counts) - counts
        raw = self.flat[np.repeat(self.begin[slot] - before, counts) + np.arange(counts.sum())].astype("<u2").tobytes()
        offsets = np.cumsum([0] + [len(s) + 1 for s in stretches])
        cuts = 2 * np.append(before, counts.sum())[np.searchsorted(starts, offsets)]
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist()))[1:].decode()


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One model a worker process; its caches serve later tasks."""
    return Pieces(path)


def _encoded(path: str, names: tuple[str, ...], kept: int, at: int):
    """Appends the ids of the texts in column ``at`` to the first ``kept`` columns,
    and, where a second name is given, the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for b in sliced(batches):
            ids = model.batch(b.column(at).to_pylist())
            new = [pa.array(ids, pa.binary())]
            if len(names) > 1:
                new.append(pa.array([model.decode(np.frombuffer(i, "<u2")) for i in ids], pa.string()))
            yield pa.record_batch([*b.columns[:kept], *new], [*b.schema.names[:kept], *names])

    return run


def _decoded(path: str, names: tuple[str, ...], kept: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for b in sliced(batches):
            texts = [model.decode(np.frombuffer(i or b"", "<u2")) for i in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns[:kept], pa.array(texts, pa.string())], [*b.schema.names[:kept], *names])

    return run


def _mapped(df: DataFrame, path: str, make, source: str, kind: str, to: dict[str, str]) -> DataFrame:
    """``df`` and the columns ``to`` (name -> type) that ``make`` gives of ``source``,
    a column of type ``kind`` or cast to it. It is sent once if it stays anyway."""
    keep = [c for c in df.columns if c not in to]
    sent = [F.col(f"`{c}`") for c in keep]
    if source in keep and df.schema[source].dataType.simpleString() == kind:
        at = keep.index(source)
    else:
        at = len(keep)
        sent.append(F.col(f"`{source}`").cast(kind).alias("__in"))
    types = {c: df.schema[c].dataType.simpleString() for c in keep} | to
    fields = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return df.select(*sent).mapInArrow(make(path, tuple(to), len(keep), at), fields)


def encode(docs: DataFrame, path: str, text_col: str = "text", to: str = "piece_ids") -> DataFrame:
    """``docs`` and, as binary column ``to``, each text's ids (little-endian
    unsigned 16-bit integers). Null and empty texts have none; a column of that
    name is replaced; an empty table stays empty."""
    return _mapped(docs, path, _encoded, text_col, "string", {to: "binary"})


def decode(coded: DataFrame, path: str, ids_col: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``coded`` and, as column ``to``, the text of the ids; null ids give empty text."""
    return _mapped(coded, path, _decoded, ids_col, "binary", {to: "string"})


def round_trip(docs: DataFrame, path: str, text_col: str = "text", to: str = "piece_ids", back: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: a worker decodes the ids it has just
    made, so no second worker holds the model. Null text gives no ids and empty
    text; columns of these names are replaced."""
    return _mapped(docs, path, _encoded, text_col, "string", {to: "binary", back: "string"})
