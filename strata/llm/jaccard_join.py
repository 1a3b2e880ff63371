"""N-gram Jaccard join by parity sketches (operator 9).

A document's tokens are its distinct ``SHINGLE``-word shingles (A-Z lower-cased). Two documents link if
the Jaccard similarity of their sets is at least ``NUM`` / 100; the result is each document's component
of links. Sizes a <= b can only link if 3b <= 4a, and then their symmetric difference D is at most
(a + b) / 7. (Written here for the default 75; the code takes the bounds from ``NUM``.)

Parity sketches. The hash space of tokens is cut into segments; a segment's value is the XOR of the
hashes of its tokens. One differing token changes one segment, so the number of differing segments (the
Hamming distance of the sketches) is at most D. A set with s filled segments therefore shares at least
s - D of them with a partner, and by the pigeonhole principle, under any common order of segments, the
first D + 1 filled segments of both hold a common one. Only these are joined, per size band (sizes
[4^k, 4^(k+1)); a set that can be the larger partner of one in the band below also joins there). The
order puts segments last whose tokens are known to be frequent: those that ``REPEATS`` documents of one batch
share, the ``FREQUENT`` most counted of them (a bounded hint for the order, never a filter). So shared
passages do not bring unrelated documents together.

From candidates to components, nothing lost:
1. equal sets form classes by map-side aggregation; only the smallest id of a class goes on;
2. in a group of equal segments every member is a candidate with the smallest one only (first within its
   batch, then across batches), so groups are neither gathered nor paired;
3. candidates are checked by size, by the Hamming distance of compact bit sketches (a lower bound of D),
   then exactly on the token sets, the partners of one document in parts of about ``PARTNERS`` that go to
   different tasks; links are merged to components;
4. two members of a group that ended in different components may still link. Groups with equal members count
   once. Open groups get further stars around other members (a keyed hash picks 8, then 64, ...) while these link enough,
   compared by sketches inside the tasks like the blocks below; new links only join the components found so far. What is left is compared by sketches across components, block by
   block (``BLOCK_MEMBERS`` a side), so that no group meets in one task; only pairs that the sketches do not
   rule out become rows, and these are checked exactly. Near copies share most of their groups: a pair becomes a row in
   the first of them only (``FIRST_KEYS``). A turn's files go as soon as the next one has its own.
After step 4 every pair that shares a segment is linked, checked, or inside one component.

Cases: null texts and texts without words have n_shingles 0 and link with nothing; fewer words than a
shingle form one token. A null id takes part in nothing (component null). Rows that share an id are
versions of one document; a link of any of them counts. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import discard, names, release, small, staged
from .link_components import components as components_of
from .wordhash import WordHasher, mix64, positions, text_chunks, window_hash

SHINGLE, NUM = 5, 75
REPEATS, FREQUENT = 3, 1_000_000
#: Open groups get further stars, of CENTERS, CENTERS^2, ... centers, while the last ones linked this share of the pairs they
#: checked exactly and blocks would leave more than CHECKS pairs a member (and FEW_CHECKS) to check.
STAR_YIELD, CENTERS, CHECKS, FEW_CHECKS = 0.05, 8, 4, 100_000
#: Members and bytes of sketches of a block.
BLOCK_MEMBERS, BLOCK_BYTES = 2_048, 4 << 20
#: Pairs that a task gathers before it sends them on.
PAIRS_HELD = 250_000
#: Open groups that each member's row names, those with the smallest keys. A pair that meets in a group named by both is
#: left out in every later group.
FIRST_KEYS = 16
#: Pairs of one document that are checked exactly in one task; more are dealt over several.
PARTNERS = 128
PART_BYTES, COUNT_BYTES = 8 << 20, 16 << 20
SHINGLE_BASE = 0xE7037ED1A0B428DB
SALT = [np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
META = "id long, n long, s1 long, s2 long, sketch binary, token long, count long"


def max_difference(total: int, num: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add to ``total``: with i >= num (a + b) /
    (100 + num), a + b - 2 i <= (a + b)(100 - num) / (100 + num)."""
    return total * (100 - num) // (100 + num)


def shingle_sets(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token hashes of all texts (ascending in each) and tokens per text."""
    words, counts = hasher(texts)
    owner, place = positions(counts)
    h = window_hash(words, SHINGLE, SHINGLE_BASE)
    whole = place[:len(h)] + SHINGLE <= counts[owner[:len(h)]]
    token, text = h[whole], owner[:len(h)][whole]
    brief = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(brief):
        start = np.cumsum(counts) - counts
        extra = []
        for i in brief:
            own = words[start[i]:start[i] + counts[i]]
            extra.append(window_hash(own, len(own), SHINGLE_BASE + 2 * len(own))[0])
        token, text = np.concatenate([token, np.array(extra, np.uint64)]), np.concatenate([text, brief])
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    return token[new], np.bincount(text[new], minlength=len(texts))


def bit_sketch(tokens: np.ndarray) -> bytes:
    """XOR of one bit per token, in a power of two of at least 256 bits and two bits a token."""
    bits = max(256, 2 << (max(1, len(tokens)) - 1).bit_length())
    at = (mix64(tokens ^ SALT[2]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two bit sketches; the longer one is folded by XOR to the other's length."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def band(n: int) -> int:
    return (n.bit_length() - 1) // 2


def segments(tokens: np.ndarray, k: int, frequent: np.ndarray, length: int) -> np.ndarray:
    """Keys of the first ``length`` filled segments of a set in band ``k``: rare ones first."""
    # small sets: so many segments that each token has its own
    n_segments = np.uint64(4 ** (k + 1) if k >= 3 else 1 << 40)
    seg = mix64(tokens ^ SALT[3]) % n_segments
    order = np.argsort(seg, kind="stable")
    seg, tok, often = seg[order], tokens[order], frequent[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    key = mix64(np.bitwise_xor.reduceat(tok, first) + (seg[first] + np.uint64(k + 1)) * GOLDEN)
    late = np.logical_and.reduceat(often, first)
    return key[np.lexsort((key, late))[:length]]


def _meta(batches):
    """A row per document (token null), and a row per token that ``REPEATS`` documents of a batch share."""
    hasher = WordHasher(3, lower=True)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()),
                        ("token", pa.int64()), ("count", pa.int64())])

    def repeated(found):
        every = np.concatenate(found)
        found.clear()
        every.sort()
        # a token has its distinct documents side by side; only those with REPEATS of them are gathered
        token = np.unique(every[:max(0, len(every) - REPEATS + 1)][every[REPEATS - 1:] == every[:max(0, len(every) - REPEATS + 1)]])
        count = np.searchsorted(every, token, side="right") - np.searchsorted(every, token)
        return pa.record_batch([*(pa.nulls(len(token), f.type) for f in list(schema)[:5]), pa.array(token.view(np.int64)), pa.array(count)], schema=schema)

    for batch in batches:
        ids, lo, found, size = batch.column("id"), 0, [], 0
        for part in text_chunks(batch.column("text")):
            token, n = shingle_sets(hasher, part)
            stop = np.cumsum(n)
            filled = np.flatnonzero(n > 0)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(filled):
                start = (stop - n)[filled]
                s1[filled] = np.add.reduceat(mix64(token ^ SALT[0]), start)
                s2[filled] = np.bitwise_xor.reduceat(mix64(token ^ SALT[1]), start)
            sketch = [bit_sketch(token[b - c:b]) if c else b"" for b, c in zip(stop, n, strict=True)]
            yield pa.record_batch([ids.slice(lo, len(part)), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                                   pa.array(sketch, pa.binary()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], schema=schema)
            lo += len(part)
            found.append(token)
            size += sum(map(len, part))
            if size >= COUNT_BYTES or lo == batch.num_rows:
                yield repeated(found)
                size = 0


def frequent_tokens(meta: DataFrame) -> np.ndarray:
    """Sorted hashes of the ``FREQUENT`` tokens that batches counted most."""
    top = meta.filter("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")) \
        .orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)


def _emit(often: np.ndarray, num: int):
    """Segment keys of each document, settled inside a batch part: of equal keys the smallest id is sent
    on (r = key), every other document is a candidate with it (r = id)."""
    schema = pa.schema([("r", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("c", pa.int64())])

    def run(batches):
        hasher = WordHasher(3, lower=True)
        for batch in batches:
            ids, lo = batch.column("id").to_numpy(), 0
            keys, owner, size = [], [], 0
            for part in text_chunks(batch.column("text")):
                token, n = shingle_sets(hasher, part)
                hot = np.zeros(len(token), bool)
                if len(often):
                    at = np.minimum(np.searchsorted(often, token), len(often) - 1)
                    hot = often[at] == token
                stop = np.cumsum(n)
                for i in np.flatnonzero(n > 0):
                    own, c = slice(stop[i] - n[i], stop[i]), int(n[i])
                    k = band(c)
                    most = c + c * 100 // num  # this set and its largest partner
                    mine = [segments(token[own], k, hot[own], max_difference(most, num) + 1)]
                    if k and c * num <= 100 * (4 ** k - 1):  # the band below holds possible smaller partners
                        mine.append(segments(token[own], k - 1, hot[own], max_difference(2 * c, num) + 1))
                    for m in mine:
                        keys.append(m)
                        owner.append(np.full(len(m), ids[lo + i]))
                lo += len(part)
                size += sum(map(len, part))
                if keys and (size >= PART_BYTES or lo == batch.num_rows):
                    yield from sift(np.concatenate(keys), np.concatenate(owner))
                    keys, owner, size = [], [], 0

    def sift(key, own):
        order = np.lexsort((own, key))
        key, own = key[order].view(np.int64), own[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        least = own[first][np.cumsum(new) - 1]
        yield pa.record_batch([pa.array(key[first]), pa.nulls(len(first), pa.int64()), pa.array(own[first]), pa.nulls(len(first), pa.int64())], schema=schema)
        rest = own != least
        if rest.any():
            yield pa.record_batch([pa.array(own[rest]), pa.array(key[rest]), pa.array(own[rest]), pa.array(least[rest])], schema=schema)

    return run


def _stars(batches):
    """Reducer over rows sorted by (r, id): candidates (key, x, c) of each id with the smallest of its key."""
    schema = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("c", pa.int64())])
    held = None
    for batch in batches:
        done = batch.column("c").is_valid()
        ready = batch.filter(done)
        if ready.num_rows:
            yield pa.record_batch([ready.column("key"), ready.column("id"), ready.column("c")], schema=schema)
        rows = batch.filter(pc.invert(done))
        if not rows.num_rows:
            continue
        key, ids = rows.column("r").to_numpy(), rows.column("id").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        least = ids[new]
        if held and held[0] == key[0]:
            least[0] = held[1]
        center = least[np.cumsum(new) - 1]
        held = (key[-1], center[-1])
        out = ids != center
        yield pa.record_batch([pa.array(key[out]), pa.array(ids[out]), pa.array(center[out])], schema=schema)


def _near(num: int):
    """Pairs that size and sketch distance do not rule out."""
    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            lo, hi = np.minimum(na, nb), np.maximum(na, nb)
            keep = lo * 100 >= hi * num
            sa, sb = batch.column("ka"), batch.column("kb")
            for i in np.flatnonzero(keep):
                keep[i] = sketch_distance(sa[i].as_py(), sb[i].as_py()) <= max_difference(int(na[i] + nb[i]), num)
            picked = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([picked.column("a"), picked.column("b")], names=["a", "b"])

    return run


def _sets(batches):
    """The token set of b beside each pair, in batches of about ``CHUNK_BYTES`` of text; equal neighbours are hashed once."""
    hasher = WordHasher(3, lower=True)
    last = (None, None)
    for batch in batches:
        lo = 0
        for part in text_chunks(batch.column("text")):
            sets = []
            for t in part:
                if t != last[0]:
                    last = (t, shingle_sets(hasher, [t])[0].view(np.int64))
                sets.append(last[1])
            lens = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("a").slice(lo, len(part)), batch.column("b").slice(lo, len(part)),
                                              pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(sets)))], names=["a", "b", "tokens"])
            lo += len(part)


def _linked(num: int):
    def run(batches):
        hasher = WordHasher(3, lower=True)
        last = (None, None)
        for batch in batches:
            keep = []
            other = batch.column("tokens")
            for i, t in enumerate(chain.from_iterable(text_chunks(batch.column("text")))):
                if t != last[0]:
                    last = (t, shingle_sets(hasher, [t])[0].view(np.int64))
                mine, theirs = last[1], other[i].values.to_numpy()
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                keep.append(100 * both >= num * (len(mine) + len(theirs) - both))
            picked = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([picked.column("a"), picked.column("b")], names=["a", "b"])

    return run


def near_pairs(pairs: DataFrame, meta: DataFrame, num: int) -> DataFrame:
    """The candidate pairs (a, b) that sizes and sketches do not rule out."""
    m = lambda x: meta.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    return staged(pairs.join(m("a"), "a").join(m("b"), "b").mapInArrow(_near(num), "a long, b long").distinct(), "near")


def spread_join(texts: DataFrame, pairs: DataFrame, near: DataFrame, key: str, by: str) -> DataFrame:
    """``pairs`` (the rows of ``near``, with any further columns) beside the text of their ``key``. The pairs of
    one document are dealt by the hash of their other end over one part per ``PARTNERS`` of them; only the
    text of ``key`` is repeated, once a part, so the center of a hot group meets its members in many tasks."""
    ids = small(near.groupBy(F.col(key).alias("id")).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")))
    own = texts.join(ids, "id").select("id", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(ids.withColumnRenamed("id", "hot"), F.col(key) == F.col("hot")) \
        .select(*pairs.columns, F.pmod(F.xxhash64(by), F.col("parts")).cast("int").alias("at"))
    return own.join(dealt, (F.col("id") == F.col(key)) & (F.col("part") == F.col("at"))).select(*pairs.columns, "text", "part")


def linked_pairs(near: DataFrame, texts: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) that link by exact intersection. Token sets of b travel to a; only the texts of
    documents in these pairs are shuffled."""
    sets = spread_join(texts, near, near, "b", "a").select("a", "b", "text").mapInArrow(_sets, "a long, b long, tokens array<long>")
    both = spread_join(texts, sets, near, "a", "b").sortWithinPartitions("a", "part").select("a", "b", "tokens", "text")
    return materialize(both.mapInArrow(_linked(num), "a long, b long").distinct())


def _distinct_groups(members: DataFrame) -> DataFrame:
    """Of groups with equal members only one: the members of a near copy's many equal groups are looked at once."""
    per = members.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s1"),
                                     F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("s2"))
    return members.join(per.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key"), "key")


def _open_members(members: DataFrame, label: DataFrame) -> tuple[DataFrame, int, float]:
    """(key, id, n, label) of the groups whose members are in several components, how many, and their pairs
    in different components (a pair once per group)."""
    named = members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    found = staged(named.join(several, "key", "left_semi"), "open")
    parts = found.groupBy("key", "label").agg(F.count("*").cast("double").alias("c"))
    per = parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"))
    r = per.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("same")) / 2)).first()
    return found, int(r[0] or 0), r[1] or 0.0


def _merge_labels(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links: searched among the components so far, not their members."""
    if label is None:
        return materialize(components_of(links))
    a, b = (label.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = materialize(components_of(between))
    old = label.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left") \
        .select("node", F.coalesce("now", "component").alias("component"))
    return materialize(old.unionByName(merged.join(label, "node", "left_anti")))


def _padded(lists: pa.Array) -> np.ndarray:
    """Ascending keys a row, filled up with the largest number, which is below no key."""
    out = np.full((len(lists), FIRST_KEYS), np.iinfo(np.int64).max)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out[np.arange(FIRST_KEYS) < size[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return out


def _compare(key: int, n: np.ndarray, label: np.ndarray, block: np.ndarray, ids: np.ndarray, keys: np.ndarray, stars: np.ndarray, sketches: list[bytes],
             across_blocks: bool, num: int):
    """(a, b) id arrays of members in different components (and different blocks, if two blocks meet here)
    that sizes and sketches do not rule out and that no group before ``key`` is known to compare."""
    order = np.argsort(n, kind="stable")
    n, label, block, ids, keys, stars = n[order], label[order], block[order], ids[order], keys[order], stars[order]
    width = np.array([len(sketches[i]) for i in order])
    by_width = {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        full = np.frombuffer(b"".join(sketches[order[i]] for i in at), np.uint64).reshape(len(at), -1)
        half = full.shape[1] // 2
        by_width[int(w)] = (at, full, full[:, :half] ^ full[:, half:])
    out_a, out_b = [], []
    stop = np.searchsorted(n, n * 100 // num, side="right")
    for i in range(len(n)):
        w = int(width[i])
        at, own, _ = by_width[w]
        mine = own[np.searchsorted(at, i)]
        for rows, sketch in ((at, own), (by_width[2 * w][0], by_width[2 * w][2]) if 2 * w in by_width else (at[:0], own[:0])):
            lo, hi = np.searchsorted(rows, (i + 1, stop[i]))
            j = rows[lo:hi]
            keep = label[j] != label[i]
            if across_blocks:
                keep &= block[j] != block[i]
            j, other = j[keep], sketch[lo:hi][keep]
            near = np.bitwise_count(other ^ mine).sum(axis=1) <= (n[j] + n[i]) * (100 - num) // (100 + num)
            j = j[near]
            if len(j):
                before = [(theirs[j][:, :, None] == own_keys[own_keys < key]).any(axis=(1, 2)) for theirs, own_keys in ((keys, stars[i]), (stars, keys[i]))]
                j = j[~(before[0] | before[1])]
            out_a.append(np.minimum(ids[i], ids[j]))
            out_b.append(np.maximum(ids[i], ids[j]))
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare_groups(num: int):
    """Groups (key, p, q) come sorted and hold at most two blocks; a group cut by a batch is carried on."""
    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cols = [rows.column(c).to_numpy() for c in ("key", "p", "q")]
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            first = np.flatnonzero(new)
            held = rows.slice(first[-1])
            yield from done(rows.slice(0, first[-1]), first, cols)
        if held is not None:
            yield from done(held, np.zeros(1, np.int64), [held.column(c).to_numpy() for c in ("key", "p", "q")])

    def done(rows, first, cols):
        if not rows.num_rows:
            return
        n, label, block, ids = (rows.column(c).to_numpy() for c in ("n", "label", "block", "id"))
        keys, stars = (_padded(rows.column(c).combine_chunks()) for c in ("keys", "stars"))
        sketches = rows.column("sketch").to_pylist()
        found, held = [], 0
        for x, y in zip(first, np.append(first[1:], rows.num_rows), strict=False):
            if x < rows.num_rows:
                found.append(_compare(cols[0][x], n[x:y], label[x:y], block[x:y], ids[x:y], keys[x:y], stars[x:y], sketches[x:y], cols[1][x] != cols[2][x], num))
                held += len(found[-1][0])
                if held > PAIRS_HELD:
                    yield unique(found)
                    found, held = [], 0
        if held:
            yield unique(found)

    def unique(found):
        pairs = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _blocks(count, size):
    """Blocks that so many members with so many bytes of sketches are cut into."""
    return F.greatest(F.ceil(count / BLOCK_MEMBERS), F.ceil(size / BLOCK_BYTES)).cast("long")


def _first_keys(members: DataFrame, star) -> DataFrame:
    """Of each id the open groups with the smallest keys (``keys``) and those among them where it is compared with every
    other member (``stars``)."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("key", star.alias("star")))), 1, FIRST_KEYS)
    return members.groupBy("id").agg(first.alias("first")) \
        .select("id", F.col("first.key").alias("keys"), F.filter("first", lambda x: x["star"])["key"].alias("stars"))


def _near_units(units: DataFrame, first: DataFrame, meta: DataFrame, num: int) -> DataFrame:
    """Near pairs of the members that meet in a unit (key, p, q), in different blocks if p and q differ."""
    about = meta.select("id", "sketch").join(first, "id")
    rows = units.join(about, "id").select("key", "p", "q", "block", "id", "n", "label", "keys", "stars", "sketch") \
        .repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return staged(rows.mapInArrow(_compare_groups(num), "a long, b long").distinct(), "near")


def near_across(members: DataFrame, meta: DataFrame, num: int) -> DataFrame:
    """Near pairs of open-group members in different components. A large group is cut into blocks, by count and
    by bytes of sketches, and each pair of blocks is a unit of work; blocks of the group's largest component
    are not compared with each other."""
    wide = members.join(meta.select("id", F.length("sketch").alias("width")), "id")
    parts = wide.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("width").alias("bytes"))
    most = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.sum("bytes").alias("all"), F.max_by("bytes", F.struct("c", "label")).alias("bytes"))
    plan = most.select("key", F.col("top.label").alias("main"), _blocks(F.col("top.c"), F.col("bytes")).alias("inner"),
                       _blocks(F.col("m") - F.col("top.c"), F.col("all") - F.col("bytes")).alias("outer"))
    # blocks 0 .. outer - 1 hold the smaller components, the others the largest one
    own = F.when(F.col("label") == F.col("main"), F.col("outer") + F.pmod(F.xxhash64(F.lit(2), "id"), F.col("inner"))) \
        .otherwise(F.pmod(F.xxhash64(F.lit(2), "id"), F.col("outer")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("label") == F.col("main"), F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1))
    placed = members.join(plan, "key").withColumn("block", own).withColumn("other", F.explode(others)) \
        .withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    return _near_units(placed, _first_keys(members, F.lit(True)), meta, num)


def near_stars(members: DataFrame, meta: DataFrame, turn: int, num: int) -> tuple[DataFrame, float]:
    """Near pairs of each group's members with about ``CENTERS`` ** turn others, picked by a keyed hash, in different
    components; and how many pairs were looked at (a pair once per group). Members and centers are cut into blocks, a
    unit is one block of each, and pairs are compared inside it, so pairs that the sketches rule out never become rows."""
    wide = members.join(meta.select("id", F.length("sketch").alias("width")), "id")
    size = wide.groupBy("key").agg(F.count("*").alias("m"), _blocks(F.count("*"), F.sum("width")).alias("inner"))
    draw = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = staged(wide.join(size, "key").withColumn("center", draw * F.col("m") < F.lit(float(CENTERS ** turn))).drop("m"), "drawn")
    parts = drawn.groupBy("key", "label").agg(F.count("*").alias("m"), F.count_if("center").alias("c"), F.sum(F.when(F.col("center"), F.col("width")).otherwise(0)).alias("w"))
    stars = parts.groupBy("key").agg(_blocks(F.sum("c"), F.sum("w")).alias("outer"), (F.sum("m").cast("double") * F.sum("c") - F.sum(F.col("m").cast("double") * F.col("c"))).alias("tried"))
    stars = staged(stars.filter("outer > 0"), "stars")
    p, q = F.pmod(F.xxhash64(F.lit(2), "id"), "inner"), -1 - F.pmod(F.xxhash64(F.lit(3), "id"), "outer")
    zero = F.lit(0).cast("long")
    as_member = F.transform(F.sequence(zero, F.col("outer") - 1), lambda x: F.struct(p.alias("p"), (-1 - x).alias("q"), zero.alias("block")))
    as_center = F.transform(F.sequence(zero, F.col("inner") - 1), lambda x: F.struct(x.alias("p"), q.alias("q"), (zero + 1).alias("block")))
    placed = drawn.join(stars, "key").withColumn("u", F.explode(F.when(F.col("center"), F.concat(as_member, as_center)).otherwise(as_member)))
    near = _near_units(placed.select("key", "id", "n", "label", "u.p", "u.q", "u.block"), _first_keys(drawn, F.col("center")), meta, num)
    tried = stars.agg(F.sum("tried")).first()[0] or 0.0
    discard(drawn, stars)
    return near, tried


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row: class_id is the smallest id with the
    same token set, component_id the smallest id reachable by links."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    both = staged(texts.mapInArrow(_meta, META), "meta")
    meta = both.filter("token IS NULL").drop("token", "count")
    classes = staged(meta.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id")), "classes")
    reps = classes.select(F.col("class_id").alias("id")).distinct()
    rows = texts.join(reps, "id", "left_semi").mapInArrow(_emit(frequent_tokens(both), num), "r long, key long, id long, c long")
    stars = staged(rows.repartition("r").sortWithinPartitions("r", "id").mapInArrow(_stars, "key long, x long, c long").filter("x <> c"), "stars")
    release(spark)
    rep_meta = meta.join(classes, ["n", "s1", "s2"]).filter("id = class_id").select("id", "n", "sketch").distinct()
    first = staged(stars.select(F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b")).distinct(), "pairs")
    groups = stars.select("key", F.explode(F.array("x", "c")).alias("id")).distinct().join(rep_meta.select("id", "n"), "id")
    members = staged(_distinct_groups(groups), "members")
    discard(stars)
    near = near_pairs(first, rep_meta, num)
    label = _merge_labels(None, linked_pairs(near, texts, num))
    n_tried, n_near = first.count(), near.count()
    discard(first, near)
    release(spark)
    left, size, pairs = _open_members(members, label)
    turn = 0
    # a group's pairs are compared by sketches at once, unless too many of them would then be checked exactly
    while pairs * n_near > (CHECKS * size + FEW_CHECKS) * max(n_tried, 1):
        turn += 1
        near, n_tried = near_stars(left, rep_meta, turn, num)
        links = linked_pairs(near, texts, num)
        label = _merge_labels(label, links)
        n_near, n_links = near.count(), links.count()
        done, (left, size, pairs) = left, _open_members(left.drop("label"), label)
        discard(done, near)
        release(spark)
        if n_links <= STAR_YIELD * n_near:
            break
    release(spark)
    near = near_across(left, rep_meta, num)
    label = _merge_labels(label, linked_pairs(near, texts, num))
    discard(left, near, members)
    joined = meta.join(classes, ["n", "s1", "s2"], "left").withColumn("class_id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")))
    return joined.join(label, joined["class_id"] == label["node"], "left") \
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM) -> DataFrame:
    """The documents, in their own columns, with the smallest id of each component. Of several rows with
    that id and equal texts one stays; a null id or a text without words is no reason to go."""
    found = components(docs, doc_id, text, num)
    gone = found.filter((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    again = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    g, v = names("_", docs.columns, "gone", "again")
    own = F.col(f"`{doc_id}`")
    kept = docs.join(small(gone.withColumnRenamed("doc_id", g)), own == F.col(g), "left_anti")
    # rows that share an id are rare: only they are looked at, all others pass untouched
    again = small(again.withColumnRenamed("doc_id", v))
    once, several = (kept.join(again, own == F.col(v), how) for how in ("left_anti", "left_semi"))
    return once.unionByName(several.dropDuplicates([doc_id, text]))
