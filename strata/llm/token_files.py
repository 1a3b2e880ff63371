"""Token-id files (operator 3): documents become token ids in patched frame-of-reference blocks.

A dataset is a table written and committed by Spark, so it lives in any store Spark can write to
and a lost executor's attempt leaves nothing behind. Each row is one segment: whole documents of
one shard, about ``SEGMENT_IDS`` ids. Shards are ranges of the document id, so shards, segments and
documents are in ascending id order. A segment's payload is self-contained:

    "PFR1" | n_docs u32 | n_ids u64 | block u32 | n_blocks u32
    doc ids i64[n_docs] | null marks u8[n_docs] | ids per document u64[n_docs]
    block starts u64[n_blocks + 1]             (index, relative to the first block)
    per block: minimum u32 | width u8 | n_values u16 | n_exceptions u16
               values - minimum, ``width`` bits each, little-endian | positions u16[] | excess u32[]

A block's width is the bit length of the ``PERCENTILE``-th percentile of its differences; larger
ones are exceptions and are patched from the list. ``read_ids`` decodes only the blocks it needs.

Cases: null text is an empty text and holds just the end id. Documents with equal id are ordered by
a hash of their text; null ids come first. A document's ids never cross a segment. An empty table
gives an empty dataset.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK, SEGMENT_IDS, PERCENTILE = 1024, 1 << 20, 90
HEAD, BLOCK_HEAD = struct.Struct("<4sIQII"), struct.Struct("<IBHH")
#: A word of lower-case letters of ASCII and Latin-1, which no normaliser changes, and the ASCII punctuation that may follow
#: it, without the apostrophe (contractions are pre-tokens).
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip([*_OWN, *(b for b in range(256) if b not in _OWN)], [*_OWN, *range(256, 512 - len(_OWN))], strict=True))
#: Stands for the end of a text among its words; no word holds a space.
END = b" "
SCHEMA = "shard int, segment int, shard_start long, n_tokens long, n_docs int, payload binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The encoded blocks of an id array and their starts (one more than blocks)."""
    n = len(ids)
    k = -(-n // BLOCK)
    if not k:
        return [], np.zeros(1, np.uint64)
    full = np.empty(k * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1]
    rows = full.reshape(k, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    at = BLOCK * PERCENTILE // 100
    width = _bit_length(np.partition(diff, at, axis=1)[:, at])
    packed: list[bytes] = [b""] * k
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            for part in np.array_split(which, -(-len(which) // 256)):
                bits = ((diff[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
                raw = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
                for i, r in zip(part, raw, strict=True):
                    packed[i] = r.tobytes()
    over = diff >> np.minimum(width, 31).astype(np.uint32)[:, None]
    over[width >= 32] = 0
    if n < k * BLOCK:
        over[-1, n - (k - 1) * BLOCK:] = 0
    blocks = []
    for i in range(k):
        pos = np.flatnonzero(over[i])
        count = BLOCK if i < k - 1 else n - (k - 1) * BLOCK
        blocks.append(BLOCK_HEAD.pack(int(low[i]), int(width[i]), count, len(pos)) + packed[i]
                      + pos.astype("<u2").tobytes() + diff[i, pos].astype("<u4").tobytes())
    starts = np.zeros(k + 1, np.uint64)
    np.cumsum([len(b) for b in blocks], out=starts[1:])
    return blocks, starts


def _unpack(data: memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; ``starts`` are their offsets in ``data``, with the end."""
    k = len(starts) - 1
    heads = [BLOCK_HEAD.unpack_from(data, int(s)) for s in starts[:-1]]
    out = np.zeros((k, BLOCK), np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    size = BLOCK_HEAD.size
    for w in np.unique(width):
        if w:
            for part in np.array_split(np.flatnonzero(width == w), -(-int((width == w).sum()) // 256)):
                step = BLOCK * int(w) // 8
                raw = np.stack([np.frombuffer(data, np.uint8, step, int(starts[i]) + size) for i in part])
                bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), BLOCK, int(w))
                value = np.zeros((len(part), BLOCK), np.uint32)
                for b in range(int(w)):
                    value |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
                out[part] = value
    for i, (_, w, _, n_exc) in enumerate(heads):
        if n_exc:
            at = int(starts[i]) + size + BLOCK * w // 8
            pos = np.frombuffer(data, "<u2", n_exc, at)
            out[i, pos] = np.frombuffer(data, "<u4", n_exc, at + 2 * n_exc)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    return np.concatenate([out[i, :h[2]] for i, h in enumerate(heads)]) if k else np.zeros(0, np.uint32)


def pack_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks, starts = pack_blocks(ids)
    return b"".join([
        HEAD.pack(b"PFR1", len(doc_ids), len(ids), BLOCK, len(blocks)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(counts, "<u8").tobytes(), starts.astype("<u8").tobytes(), *blocks])


class Segment:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        self.data = memoryview(payload)
        magic, n, self.n_ids, block, k = HEAD.unpack_from(self.data)
        if magic != b"PFR1" or block != BLOCK:
            raise ValueError("not a segment of this format")
        at = HEAD.size
        ids = np.frombuffer(self.data, "<i8", n, at)
        null = np.frombuffer(self.data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(self.data, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.frombuffer(self.data, "<u8", k + 1, at + 17 * n)
        self.body = self.data[at + 17 * n + 8 * (k + 1):]

    def read_ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` ids from ``start`` (all by default); only blocks that hold them are decoded."""
        stop = self.n_ids if count is None else min(start + count, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        return _unpack(self.body, self.starts[first:last + 1])[start - first * BLOCK:stop - first * BLOCK]


class _Numbers(dict):
    """Numbers of words; a word not seen before gets the next one and is noted in ``new``."""

    def __init__(self):
        super().__init__({END: 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Ids of whole texts, word by word. The tokenizer lower-cases, drops white space and never joins
    across it, so a text's ids are those of its white-space separated pieces with A-Z lower-cased; each
    distinct piece is encoded once and kept in a bounded cache."""

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.model = self.tokenizer.model
        self._reset()

    def _reset(self) -> None:
        self.index = _Numbers()
        self.flat, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.length[0] = self.used = 1

    def _code(self, words: list[bytes]) -> list[list[int]]:
        """Ids per piece. A run of plain letters is one pre-token, and punctuation other than an apostrophe
        behind it is another, so the library's model codes these directly; all other pieces take its whole
        pipeline, many to a call."""
        memo: dict[bytes, list[int]] = {}

        def letters(w: bytes) -> list[int]:
            if (ids := memo.get(w)) is None:
                ids = memo[w] = [t.id for t in self.model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(BYTE_CHARS))]
            return ids

        out, other = [], []
        for i, w in enumerate(words):
            plain = PLAIN.fullmatch(w)
            if plain is None:
                out.append(None)
                other.append(i)
                continue
            stem, tail = plain.groups()
            if tail and tail not in memo:
                memo[tail] = self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids
            out.append(letters(stem) + memo[tail] if tail else letters(stem))
        coded = self.tokenizer.encode_batch_fast([words[i].decode() for i in other], add_special_tokens=False)
        for i, e in zip(other, coded, strict=True):
            out[i] = e.ids
        return out

    def _learn(self) -> None:
        """Ids of the new words, in the order of their numbers."""
        words, n = self.index.new, len(self.index) - len(self.index.new)
        for lo in range(0, len(words), 4096):
            part = words[lo:lo + 4096]
            coded = self._code(part)
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(lens.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) > len(self.start):
                self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
            self.flat[self.used:self.used + len(flat)] = flat
            self.start[n:n + len(part)] = self.used + np.cumsum(lens) - lens
            self.length[n:n + len(part)] = lens
            self.used += len(flat)
            n += len(part)
        self.index.new = []

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end``, and the ids per text."""
        split = [t.lower().split() for t in texts]
        for s in split:
            s.append(END)
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split))) - 1
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > max(self.max_words, len(self.index.new) + 1):     # full, and it holds words of earlier texts
            self._reset()
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._learn()
        self.flat[0] = end
        lens = self.length[at]
        upto = np.cumsum(lens)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        src = np.repeat((self.start[at] - upto + lens).astype(kind), lens)
        src += np.arange(total, dtype=kind)
        return self.flat[src], np.diff(upto[last], prepend=0)


def _chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@lru_cache(maxsize=1)
def _task_encoder(path: str | None) -> WordEncoder:
    """One encoder per Python worker, so that later tasks find its cache warm."""
    import public_tokenizers

    return WordEncoder(path or public_tokenizers.path("word_bpe_49k.json"))


def _encoder(path: str | None, end: int):
    def run(batches):
        enc = _task_encoder(path)
        shard = TaskContext.get().partitionId()
        docs, counts, parts, held, segment, start = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs, counts, parts, held, segment, start
            ids = np.concatenate(parts)
            row = {"shard": [shard], "segment": [segment], "shard_start": [start], "n_tokens": [held],
                   "n_docs": [len(docs)], "payload": [pack_segment(docs, counts, ids)]}
            segment, start, docs, counts, parts, held = segment + 1, start + held, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()),
                ("n_docs", pa.int32()), ("payload", pa.binary())]))

        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in _chunks(texts):
                ids, n = enc.encode(texts[lo:hi], end)
                docs += own[lo:hi]
                counts += n.tolist()
                parts.append(ids)
                held += len(ids)
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 2,
                 tokenizer: str | None = None) -> None:
    """Encode ``docs`` to a dataset at ``path``. One range shuffle of (id, text) puts documents in id
    order; encoding and packing run in the same task. ``tokenizer``: a tokenizers file, by default
    the public 49k word BPE."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .withColumn("h", F.xxhash64("text")) \
        .repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h") \
        .select("doc_id", "text").mapInArrow(_encoder(tokenizer, end), SCHEMA).write.parquet(path)


def _reader(batches):
    for batch in batches:
        col = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            seg = Segment(col["payload"][i].as_py())
            ids = seg.read_ids().astype("<u4")
            stop = np.cumsum(seg.counts)
            begin = stop - seg.counts
            base = col["first"][i].as_py()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg.doc_ids, pa.int64()), pa.array(begin + base), pa.array(seg.counts), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first``, the number of ids before each in the whole dataset. Only counts
    are read; the one window runs over one row per shard."""
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = shards.withColumn("base", F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))) \
        .select("shard", F.coalesce("base", F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "shard").withColumn("first", F.col("base") + F.col("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    return read_index(spark, path).select("payload", "first") \
        .mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/strata-llm/tokens-{uuid.uuid4().hex}"
