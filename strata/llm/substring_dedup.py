"""Substring dedup (operator 5): words are removed that lie in a window of ``WINDOW`` words whose word
sequence also starts in a document with a smaller id.

Anchors. With the difference cover ``COVER`` modulo ``PERIOD`` any two positions have a common shift
below the period that brings both to cover places. So two equal windows share an equal run of
``ANCHOR`` = WINDOW - PERIOD + 1 words that starts at a cover place in both documents, and only these
anchors (3 of 7 positions) are compared across documents:

1. anchors are hashed; those that occur in two documents survive;
2. around surviving anchors the match is extended to whole windows, which are compared by a 96-bit
   hash; a window goes to the smallest id it starts in, and is a claim against every other;
3. claims come back to their documents and the covered words are cut.

The texts are shuffled once, by id, and all three steps read that shuffle. Before either hash shuffle
each task compares its own documents: of a hash only the smallest id is sent on, the other documents'
claims are settled on the spot (as position runs). So a passage shared by a third of all rows arrives
as one row a batch, never as pairs, and reducers stream sorted hashes without holding a group.

Exact copies of a whole text are found first, by narrow 128-bit hashes: all windows of a copy start in
the smallest id with that text, so only that document goes through the three steps.

Windows are judged on the input. Cases: null text has no words. Texts shorter than a window keep all.
Rows with a null id take no part and keep all. Rows that share an id are versions of one document: they
claim nothing from each other, each is cut by its own words. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import every, small
from .wordhash import WordHasher, mark_runs, positions, runs_of, window_hash

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
IN_COVER = np.isin(np.arange(PERIOD), COVER)
ANCHOR_BASE, WINDOW_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
BATCH_BYTES = 8 << 20
#: Hash rows: (k, b, id) sent on, or settled runs x of document id (then k is the id). Anchors have no b.
RUNS = pa.struct([("th", pa.int64()), ("runs", pa.binary())])
FIELDS = {"k": ("long", pa.int64()), "b": ("int", pa.int32()), "id": ("long", pa.int64()), "x": ("struct<th:long,runs:binary>", RUNS)}


def _shape(checked: bool) -> tuple[str, pa.Schema]:
    own = {n: f for n, f in FIELDS.items() if checked or n != "b"}
    return ", ".join(f"{n} {f[0]}" for n, f in own.items()), pa.schema([(n, f[1]) for n, f in own.items()])


def _rows(checked: bool, **columns) -> pa.RecordBatch:
    """Rows of the given columns; what is not given is null."""
    schema = _shape(checked)[1]
    n = len(columns["id"])
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _parts(batch: pa.RecordBatch):
    """Slices of about ``BATCH_BYTES`` of text: (slice, texts)."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield batch.slice(lo, i - lo), texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if texts:
        yield batch.slice(lo), texts[lo:]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Marks of the first row of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _sift(key: np.ndarray, check: np.ndarray | None, owner: np.ndarray, place: np.ndarray, ids: np.ndarray, th: np.ndarray):
    """Settle hashes inside one batch whose documents are in id order: each hash is sent on once, with the
    smallest id that has it. Of a hash that two ids share, every document has a claim (anchors, without
    ``check``), or every document but that of the smallest id (windows)."""
    checked = check is not None
    order = np.lexsort((owner, check, key) if checked else (owner, key))
    k, o, p = key[order], owner[order], place[order]
    b = check[order] if checked else None
    new = _groups(k, b) if checked else _groups(k)
    first = np.flatnonzero(new)
    if not len(first):
        return
    group = np.cumsum(new) - 1
    least = ids[o[first]]
    shared = ids[o[np.append(first[1:], len(k)) - 1]] != least
    claim = shared[group]
    if checked:
        claim &= ids[o] != least[group]
    yield _rows(checked, k=pa.array(k[first].view(np.int64)), id=pa.array(least), **({"b": pa.array(b[first])} if checked else {}))
    o, p = o[claim], p[claim]
    by_doc = np.lexsort((p, o))
    o, p = o[by_doc], p[by_doc]
    docs, start = np.unique(o, return_index=True)
    if len(docs):
        runs = [runs_of(np.unique(x)) for x in np.split(p, start[1:])]
        x = pa.StructArray.from_arrays([pa.array(th[docs]), pa.array(runs, pa.binary())], fields=list(RUNS))
        yield _rows(checked, k=pa.array(ids[docs]), id=pa.array(ids[docs]), x=x)


def _hashed_anchors(hashes: np.ndarray, counts: np.ndarray):
    """(hash, text index, place) of all anchors of texts with a whole window."""
    owner, place = positions(counts)
    h = window_hash(hashes, ANCHOR, ANCHOR_BASE)
    owner, place = owner[:len(h)], place[:len(h)]
    ok = IN_COVER[place % PERIOD] & (place + ANCHOR <= counts[owner]) & (counts[owner] >= WINDOW)
    return h[ok], owner[ok], place[ok]


def _anchors(batches):
    hasher = WordHasher(1)
    for batch in batches:
        for part, texts in _parts(batch):
            h, owner, place = _hashed_anchors(*hasher(texts))
            yield from _sift(h, None, owner, place, part.column("id").to_numpy(), part.column("th").to_numpy())


def _windows(batches):
    first, second = WordHasher(1), WordHasher(2)
    for batch in batches:
        for part, texts in _parts(batch):
            known = [i for i, (k, r) in enumerate(zip(part.column("keys").is_valid().to_pylist(), part.column("local").is_valid().to_pylist(),
                                                      strict=True)) if k or r]
            if not known:
                continue
            part, texts = part.take(pa.array(known)), [texts[i] for i in known]
            hashes, counts = first(texts)
            checks, _ = second(texts)
            h, owner, place = _hashed_anchors(hashes, counts)
            begin = np.cumsum(counts) - counts
            bound = np.searchsorted(owner, np.arange(len(texts) + 1))
            th = part.column("th").to_numpy()
            wanted = np.zeros(len(hashes), bool)
            for i, (keys, local) in enumerate(zip(part.column("keys").to_pylist(), part.column("local").to_pylist(), strict=True)):
                own = slice(bound[i], bound[i + 1])
                alive = np.isin(h[own].view(np.int64), np.array(keys or (), np.int64))
                at = np.zeros(counts[i], bool)
                at[place[own][alive]] = True
                for x in local or ():
                    if x["th"] == th[i]:
                        mark_runs(at, x["runs"])
                # windows that hold a surviving anchor start up to WINDOW - ANCHOR words before it
                near = at.copy()
                for back in range(1, WINDOW - ANCHOR + 1):
                    near[:-back] |= at[back:]
                near[max(0, counts[i] - WINDOW + 1):] = False
                wanted[begin[i]:begin[i] + counts[i]] = near
            owner, place = positions(counts)
            pick = np.flatnonzero(wanted)
            key = window_hash(hashes, WINDOW, WINDOW_BASE)[pick]
            check = (window_hash(checks, WINDOW, CHECK_BASE)[pick] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield from _sift(key, check, owner[pick], place[pick], part.column("id").to_numpy(), th)


def _settle(checked: bool):
    """A reducer over rows sorted by hash and id: hash rows (k, b, id) become claims of the hashes that two
    ids share, settled runs pass. Only the current hash's smallest id is carried from batch to batch."""
    def run(batches):
        held = None  # (hash, smallest id, whether a second id was seen)
        for batch in batches:
            done = batch.column("x").is_valid()
            settled = batch.filter(done)
            if settled.num_rows:
                yield _rows(checked, id=settled.column("id"), x=settled.column("x"))
            rows = batch.filter(pc.invert(done))
            if not rows.num_rows:
                continue
            ids = rows.column("id").to_numpy()
            key = [rows.column(c).to_numpy() for c in ("k", "b") if checked or c == "k"]
            keep = _groups(*key, ids)
            ids, key = ids[keep], [c[keep] for c in key]
            new = _groups(*key)
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            least, most = ids[first], ids[np.append(first[1:], len(ids)) - 1]
            shared = least != most
            late = []
            if held and all(c[0] == h for c, h in zip(key, held[0], strict=True)):
                second = bool(most[0] != held[1])
                if not checked and second and not held[2] and ids[0] != held[1]:
                    late = [held]  # the first id of an anchor learns only now that a second one has it
                least[0], shared[0] = held[1], held[2] or second
            claim = shared[group]
            if checked:
                claim &= ids != least[group]
            held = ([c[-1] for c in key], least[-1], bool(shared[-1]))
            out = {"id": np.concatenate([ids[claim], np.array([x[1] for x in late], np.int64)])}
            for i, (name, c) in enumerate(zip(("k", "b"), key, strict=False)):
                out[name] = np.concatenate([c[claim], np.array([x[0][i] for x in late], c.dtype)])
            yield _rows(checked, **{n: pa.array(v) for n, v in out.items()})

    return run


def _claims(rows: DataFrame, checked: bool) -> DataFrame:
    """Claims per id: ``keys`` (hashes) and ``local`` (position runs of one version of the text)."""
    order = ["k", "b", "id"] if checked else ["k", "id"]
    settled = rows.repartition("k").sortWithinPartitions(*order).mapInArrow(_settle(checked), _shape(checked)[0])
    key = F.struct("k", "b") if checked else F.col("k")
    lists = settled.groupBy("id").agg(F.collect_list(F.when(F.col("k").isNotNull(), key)).alias("keys"), F.collect_list("x").alias("local"))
    empty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return lists.select(F.col("id").alias("claim_id"), empty("keys"), empty("local"))


def _cut(with_text: bool):
    def run(batches):
        first, second = WordHasher(1), WordHasher(2)
        for batch in batches:
            for part, texts in _parts(batch):
                n_words, n_removed, digest, kept_text = [], [], [], []
                keys, local, th, copy = (part.column(c).to_pylist() for c in ("keys", "local", "th", "copy"))
                for text, ks, ls, own, is_copy in zip(texts, keys, local, th, copy, strict=True):
                    words = text.split()
                    gone = np.zeros(len(words), bool)
                    starts = np.full(max(0, len(words) - WINDOW + 1), bool(is_copy))
                    for x in ls or ():
                        if x["th"] == own:
                            mark_runs(starts, x["runs"])
                    if ks and len(starts):
                        k = window_hash(first([text])[0], WINDOW, WINDOW_BASE).view(np.int64)
                        hit = np.flatnonzero(np.isin(k, np.array([x["k"] for x in ks], np.int64)))
                        if len(hit):
                            b = (window_hash(second([text])[0], WINDOW, CHECK_BASE)[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                            real = {(x["k"], x["b"]) for x in ks}
                            starts[[i for i, pair in zip(hit, zip(k[hit].tolist(), b.tolist(), strict=True), strict=True) if pair in real]] = True
                    if starts.any():
                        edge = np.zeros(len(words) + 1, np.int32)
                        edge[:len(starts)] += starts
                        edge[WINDOW:WINDOW + len(starts)] -= starts
                        gone = np.cumsum(edge)[:-1] > 0
                        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    else:
                        kept = b" ".join(words)
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_text.append(kept if n_removed[-1] else text)
                arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
                if with_text:
                    whole = pa.array(kept_text, pa.binary()).cast(pa.string())
                    valid = part.column("text").is_valid()
                    yield pa.RecordBatch.from_arrays([part.column("row"), pc.if_else(valid, whole, pa.scalar(None, pa.string())), *arrays],
                                                     names=["row", "kept_text", "n_words", "n_removed", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], names=["id", "n_words", "n_removed", "kept_sha256"])

    return run


def _copies(texts: DataFrame) -> DataFrame:
    """(copy_id, ths): ids with the hashes of those of their texts that also belong to a smaller id."""
    narrow = texts.filter(F.col("id").isNotNull()).select("id", "th", F.xxhash64(F.lit("second"), "text").alias("th2"))
    several = narrow.groupBy("th", "th2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    found = narrow.join(small(several), ["th", "th2"]).filter("id > first")
    return materialize(found.groupBy("id").agg(F.collect_set("th").alias("ths")).withColumnRenamed("id", "copy_id"))


def _deduplicated(texts: DataFrame, shape: str, with_text: bool) -> DataFrame:
    """``texts`` has id, th, text (and row). All joins are on the id alone, so all read the one shuffle of
    the texts by id."""
    nowhere = texts.filter(F.col("id").isNull()).withColumns({
        "keys": F.lit(None).cast("array<struct<k:long,b:int>>"), "local": F.lit(None).cast("array<struct<th:long,runs:binary>>"),
        "copy": F.lit(None).cast("boolean")})
    dealt = texts.filter(F.col("id").isNotNull()).repartition("id").sortWithinPartitions("id", "th")
    copies = _copies(texts)
    marked = dealt.join(copies, F.col("id") == F.col("copy_id"), "left") \
        .withColumn("copy", F.coalesce(F.array_contains("ths", F.col("th")), F.lit(False))).drop("copy_id", "ths")
    in_order = lambda d: d.sortWithinPartitions("id", "th")
    single = marked.filter(~F.col("copy"))
    anchors = _claims(in_order(single).mapInArrow(_anchors, _shape(False)[0]), False)
    known = single.join(anchors, F.col("id") == F.col("claim_id"), "left").drop("claim_id")
    windows = _claims(in_order(known).mapInArrow(_windows, _shape(True)[0]), True)
    final = marked.join(windows, F.col("id") == F.col("claim_id"), "left").drop("claim_id")
    cut = _cut(with_text)
    return final.mapInArrow(cut, shape).unionByName(nowhere.mapInArrow(cut, shape))


def measure_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return _deduplicated(texts, "id long, n_words long, n_removed long, kept_sha256 string", False).withColumnRenamed("id", "doc_id")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """The documents in their own columns with repeated words cut out of ``text``: a cut text is its kept
    words joined by one space, others stay as they are. ``length``: a column that gets the characters left."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"),
                        F.struct(*every(docs, text)).alias("row"))
    kind = texts.schema["row"].dataType.simpleString()
    out = _deduplicated(texts, f"row {kind}, kept_text string, n_words long, n_removed long, kept_sha256 string", True)
    own = lambda c: F.col("kept_text") if c == text else (
        F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(dict(docs.dtypes)[c])).otherwise(F.col(f"row.`{c}`")) if c == length
        else F.col(f"row.`{c}`"))
    return out.select(*[own(c).alias(c) for c in docs.columns])
