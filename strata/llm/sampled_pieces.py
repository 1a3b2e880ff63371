"""SentencePiece encoding with seeded merge-dropout, and decoding (operator 7).

A text is prefixed with a space (the model's dummy prefix) and cut into units that no piece of the
vocabulary crosses: runs of spaces with the word behind them, and line ends. In a unit, candidate
merges wait in an agenda ordered by the model's score; a popped candidate is skipped if the keyed
hash of (seed, document id, place of the unit, left, middle, right) falls below ``dropout``. So every
merge of every occurrence is skipped on its own, and nothing is shared between occurrences. All units
of a batch of documents are merged together, one agenda step of each at a time; units longer than
``wide`` go through ``Pieces.merged`` alone, by the same hashes. The same seed gives the same ids on
every run, whatever the batches; dropout 0 gives the library's own ids.

Characters outside the vocabulary, a literal U+2581 among them, become byte pieces, so decoding gives
back every text exactly. Cases: null text has null ids and decodes to null; empty text has no ids;
a null document id hashes as 0; equal documents get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
M1, M2, GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1
NONE = (1 << 31) - 1
#: Units of these lengths and below are merged together; a position takes six bits.
BANDS = (*range(2, 13), 14, 16, 20, 24, 32, 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary of a SentencePiece BPE model, with spaces for U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                own = piece.replace(SPACE_MARK, " ")
                self.ids[own], self.rank[own] = i, -sp.get_score(i)
                self.raw.append(own.encode())
        #: units may be cut at line ends and before spaces only if no piece reaches across
        self.cuts = not any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in self.ids)

    @cached_property
    def merges(self) -> Merges:
        return Merges(self)

    def merged(self, unit: str, draw: int, seed: int, dropout: float) -> list[str | None]:
        """The symbols of one unit after agenda processing with dropout, each at its first character's place."""
        sym: list[str | None] = list(unit)
        n = len(sym)
        if n > 1:
            rank = self.rank
            limit = int(dropout * (1 << 32))
            base = (draw * M2 ^ seed * GOLD) & FULL
            nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [(r, i, i + 1, p) for i in range(n - 1) if (r := rank.get(p := unit[i:i + 2])) is not None]
            heapify(agenda)
            while agenda:
                _, a, b, piece = heappop(agenda)
                left, right = sym[a], sym[b]
                if left is None or right is None or nxt[a] != b or len(left) + len(right) != len(piece):
                    continue  # a neighbour was merged meanwhile
                if limit:
                    h = base ^ ((a << 42 | b << 21 | (b + len(right))) & FULL)
                    h = (h ^ h >> 30) * M1 & FULL
                    h = (h ^ h >> 27) * M2 & FULL
                    if (h ^ h >> 31) >> 32 < limit:
                        continue
                sym[a], sym[b] = piece, None
                c = nxt[a] = nxt[b]
                if c < n:
                    prv[c] = a
                    if (r := rank.get(p := piece + sym[c])) is not None:
                        heappush(agenda, (r, a, c, p))
                z = prv[a]
                if z >= 0 and (r := rank.get(p := sym[z] + piece)) is not None:
                    heappush(agenda, (r, z, a, p))
        return sym

    def segment(self, unit: str, draw: int, seed: int, dropout: float) -> list[int]:
        """Ids of one unit; ``draw``: the key of its occurrence, ``seed``: a 32-bit key."""
        out = []
        for s in self.merged(unit, draw, seed, dropout):
            if s is not None:
                i = self.ids.get(s)
                if i is None:
                    out += [self.byte_id[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def decode(self, ids) -> str:
        """The text of an id sequence, without the dummy prefix."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


class Merges:
    """The vocabulary as arrays: symbols are pieces and their characters, pairs of symbols give pieces."""

    def __init__(self, pieces: Pieces):
        names = list(dict.fromkeys([*pieces.ids, *(c for p in pieces.ids for c in p)]))
        self.symbol = {s: i for i, s in enumerate(names)}
        #: a character that no piece has
        self.other = len(names)
        self.id = np.array([pieces.ids.get(s, -1) for s in names] + [-1], np.int32)
        self.byte_id = np.array(pieces.byte_id, np.int32)
        self.char = np.full(0x110000, self.other, np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        place = {r: i for i, r in enumerate(sorted(set(pieces.rank.values())))}
        #: agenda order of a piece, above the six bits of a position; last (at -1): no piece
        self.order = np.array([place[pieces.rank[s]] << 6 if s in pieces.rank else NONE for s in names] + [NONE, NONE], np.int32)
        keys, values = [], []
        for p in pieces.ids:
            for i in range(1, len(p)):
                a, b = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(self.symbol[p])
        bits = max(8, (6 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = left[free], value[free]
            put = self.keys[slot] == left  # of several in one slot the last one got it
            self.values[slot[put]] = value[put]
            left, value, slot = left[~put], value[~put], (slot[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(GOLD)) >> self.shift).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two symbols give, or -1."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found, out = self.keys[slot], self.values[slot]
        miss = found != key
        out[miss] = -1
        at = np.flatnonzero(miss & (found >= 0))
        slot, key = slot[at], key[at]
        while len(at):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == key
            out[at[hit]] = self.values[slot[hit]]
            rest = np.flatnonzero(~hit & (found >= 0))
            at, slot, key = at[rest], slot[rest], key[rest]
        return out


class SampledEncoder:
    """Ids of texts; up to ``max_units`` units and ``max_chars`` characters are merged together."""

    def __init__(self, pieces: Pieces, seed: str, dropout: float, wide: int = BANDS[-1], max_units: int = 100_000, max_chars: int = 400_000):
        if not 0 <= dropout < 1:
            raise ValueError("dropout must be in [0, 1)")
        self.pieces, self.dropout, self.limit = pieces, dropout, int(dropout * (1 << 32))
        key = hashlib.blake2b(seed.encode(), digest_size=12).digest()
        self.seed, self.base = int.from_bytes(key[:4], "little"), int.from_bytes(key[4:], "little")
        self.wide, self.max_units, self.max_chars = min(wide, BANDS[-1]), max_units, max_chars

    def encode(self, text: str, doc_id: int) -> np.ndarray:
        return self.encode_all([text], [doc_id])[0]

    def encode_all(self, texts: list[str], doc_ids: list[int]) -> list[np.ndarray]:
        """The ids of each text."""
        some = [i for i, t in enumerate(texts) if t]
        out = [np.zeros(0, np.int32)] * len(texts)
        if some:
            joined = " " + " ".join(texts[i] for i in some)
            size = np.array([len(texts[i]) + 1 for i in some])
            doc_key = np.array([(doc_ids[i] * GOLD + self.base) & FULL for i in some], np.uint64)
            ids, ends = self._encode(joined, np.cumsum(size) - size, doc_key)
            for i, part in zip(some, np.split(ids, ends[:-1]), strict=True):
                out[i] = part
        return out

    def _encode(self, joined: str, docs: np.ndarray, doc_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents that start at ``docs``, and where each one's end."""
        merges = self.pieces.merges
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cut = np.zeros(len(chars), bool)
        if self.pieces.cuts:
            line, space = chars == 10, chars == 32
            cut |= line
            cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[docs] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(chars))
        first = np.searchsorted(start, docs)
        units = np.diff(first, append=len(start))
        place = (np.arange(len(start)) - np.repeat(first, units)).view(np.uint64)
        draw = mix64(place + np.repeat(doc_key, units))
        symbols = merges.char[chars]
        lo = 0
        while lo < len(start):
            hi = min(lo + self.max_units, max(lo + 1, int(np.searchsorted(start, start[lo] + self.max_chars))))
            a, b = int(start[lo]), int(start[hi]) if hi < len(start) else len(chars)
            self._merge(joined, symbols[a:b], a, start[lo:hi] - a, size[lo:hi], draw[lo:hi])
            lo = hi
        alive = np.flatnonzero(symbols >= 0)
        ids = merges.id[symbols[alive]]
        ends = np.searchsorted(alive, np.append(docs[1:], len(chars)))
        bad = np.flatnonzero(ids < 0)
        if len(bad):
            c = chars[alive[bad]]
            times = np.ones(len(ids), np.int64)
            times[bad] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            ids = np.repeat(ids, times)
            ids[ids < 0] = merges.byte_id[np.frombuffer(c.tobytes().decode("utf-32-le").encode(), np.uint8)]
            ends = np.append(0, np.cumsum(times))[ends]
        return ids, ends

    def _merge(self, joined: str, sym: np.ndarray, offset: int, start: np.ndarray, size: np.ndarray, draw: np.ndarray) -> None:
        """Merges the symbols of the units in place; -1 where a symbol went into the one before it."""
        merges = self.pieces.merges
        long = np.flatnonzero(size > self.wide)
        for u in long.tolist():
            a, n = int(start[u]), int(size[u])
            kept = self.pieces.merged(joined[offset + a:offset + a + n], int(draw[u]), self.seed, self.dropout)
            for i, s in enumerate(kept):
                if s is None:
                    sym[a + i] = -1
                elif len(s) > 1:
                    sym[a + i] = merges.symbol[s]
        where = np.arange(len(sym))
        nxt, prv = where + 1, where - 1
        cand = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            cand[:-1] = merges.pair(sym[:-1], sym[1:])
        cand[start + size - 1] = -1
        agenda = merges.order[cand]
        band = np.searchsorted(BANDS, size)
        band[(size < 2) | (size > self.wide)] = -1
        base = (draw * np.uint64(M2)) ^ np.uint64(self.seed * GOLD & FULL)
        for k, width in enumerate(BANDS):
            rows = np.flatnonzero(band == k)
            if len(rows):
                self._merge_band(width, sym, nxt, prv, cand, agenda, start[rows], size[rows], base[rows])

    def _merge_band(self, width, sym, nxt, prv, cand, agenda, start, size, base) -> None:
        merges = self.pieces.merges
        end = start + size
        # one line a place: the order of the merge that starts there, and the place; the smallest is next
        queue = np.empty((width - 1, len(start)), np.int32)
        for p in range(width - 1):
            at = start + p
            if p < int(size.min()) - 1:
                queue[p] = agenda[at] | p
            else:
                queue[p] = np.where(p < size - 1, agenda[np.minimum(at, len(agenda) - 1)] | p, NONE)
        while True:
            least = queue.min(axis=0)
            live = least != NONE
            if not live.all():
                at = np.flatnonzero(live)
                if not len(at):
                    return
                queue, start, end, base, least = queue[:, at], start[at], end[at], base[at], least[at]
            col = np.arange(len(start))
            j = (least & 63).astype(np.int64)
            a = start + j
            b = nxt[a]
            c = nxt[b]
            queue[j, col] = NONE
            s = start
            if self.limit:
                x = mix64(base ^ (j << 42 | (b - s) << 21 | (c - s)).view(np.uint64))
                keep = np.flatnonzero((x >> np.uint64(32)) >= np.uint64(self.limit))
                if not len(keep):
                    continue
                col, a, b, c, j, s = col[keep], a[keep], b[keep], c[keep], j[keep], s[keep]
            piece = cand[a]
            sym[a], sym[b] = piece, -1
            nxt[a] = c
            inner = b - s < width - 1
            queue[(b - s)[inner], col[inner]] = NONE
            more = np.flatnonzero(c < end[col])
            at, right = a[more], c[more]
            prv[right] = at
            found = merges.pair(piece[more], sym[right])
            cand[at] = found
            queue[j[more], col[more]] = merges.order[found] | j[more].astype(np.int32)
            more = np.flatnonzero(j)
            left = prv[a[more]]
            found = merges.pair(sym[left], piece[more])
            cand[left] = found
            z = left - s[more]
            queue[z, col[more]] = merges.order[found] | z.astype(np.int32)


@lru_cache(maxsize=2)
def _task_encoder(path: str | None, seed: str, dropout: float) -> SampledEncoder:
    """One encoder per Python worker, so that later tasks find its tables."""
    import public_tokenizers

    return SampledEncoder(Pieces(path or public_tokenizers.path("piece_bpe_32k.model")), seed, dropout)


def _encode(path: str | None, seed: str, dropout: float):
    def run(batches):
        enc = _task_encoder(path, seed, dropout)
        pieces = enc.pieces
        for batch in batches:
            own, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                part = texts.slice(lo, 512).to_pylist()
                docs = own.slice(lo, 512)
                coded = [None if t is None else c for t, c in zip(part, enc.encode_all(part, [d or 0 for d in docs.to_pylist()]), strict=True)]
                same = [t is None or pieces.decode(c.tolist()) == t for t, c in zip(part, coded, strict=True)]
                lens = np.array([0 if c is None else len(c) for c in coded], np.int64)
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                flat = np.concatenate([c for c in coded if c is not None] or [np.zeros(0, np.int32)])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([c is None for c in coded]))
                crc = [zlib.crc32(b"" if c is None else c.astype("<u4")) for c in coded]
                yield pa.RecordBatch.from_arrays([docs, ids, pa.array(lens), pa.array(crc, pa.int64()), pa.array(same)],
                                                 names=["doc_id", "ids", "n_tokens", "ids_crc32", "lossless"])

    return run


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "dropout-1", dropout: float = 0.1,
                     model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, lossless) per document; ``lossless``: its ids decode to its text.
    Each task works on its own rows; nothing is shuffled."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(_encode(model, seed, dropout), "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) from ids."""
    def run(batches):
        import public_tokenizers

        pieces = Pieces(model or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            texts = [None if c is None else pieces.decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
