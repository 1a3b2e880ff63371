"""Language identification by compression (operator 8).

For every language a zstandard raw-content dictionary is built from a bounded hash sample of its
labelled texts. The whole text is compressed with each dictionary, in blocks of ``BLOCK`` bytes so that
it is matched against the dictionary rather than against itself; the language whose dictionary gives the
fewest bytes in all is predicted. ``rejected`` marks predictions whose margin to the runner-up is below
``min_margin`` of the best size.

Bounds (the only sampling): ``SAMPLE_DOCS`` different texts a language, ``SAMPLE_CHARS`` characters of each
from a place that a hash of the text picks,
``DICT_BYTES`` a dictionary, less if there are so many languages that all would pass ``TOTAL_BYTES``.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything if no language
was learned. Equal sizes go to the smaller language name. Null languages teach nothing. Repeated rows
are predicted alike.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, TOTAL_BYTES = 64, 2_000, 96 << 10, 64 << 20
LEVEL, BLOCK = 6, 1024
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    m = LETTER.search(text)  # word characters that are no digits: letters, and a few numbers such as Roman ones
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def plain(text: str) -> bytes:
    """Letters only, lower case, one space between words."""
    return OTHER.sub(" ", text.lower()).encode()


def learn(labelled: DataFrame, doc_id: str, text: str, lang: str) -> dict[str, bytes]:
    """Dictionary content per language from (id, text, lang) rows. Equal texts count once: the smallest
    hashes of texts are chosen from a narrow aggregate, with the rank filter before the shuffle in every task,
    and only the chosen texts' spans are read in a second pass."""
    hashed = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).alias("lang"), F.xxhash64(F.lit("langid"), F.col(text)).alias("h"), F.col(text).alias("text"))
    order = W.partitionBy("lang").orderBy("h")
    chosen = small(hashed.select("lang", "h").distinct().withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= SAMPLE_DOCS))
    spans = F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))
    at = (F.pmod(F.xxhash64(F.lit("span"), F.col("text")), spans) + 1).cast("int")
    rows = hashed.join(chosen, ["lang", "h"]).select("lang", "h", "rn", F.substr("text", at, F.lit(SAMPLE_CHARS)).alias("part")) \
        .groupBy("lang", "h", "rn").agg(F.min("part").alias("part")).collect()
    langs = sorted({r["lang"] for r in rows}, key=lambda x: x.encode())
    most = min(DICT_BYTES, TOTAL_BYTES // max(1, len(langs)))
    out = {}
    for name in langs:
        parts = list(dict.fromkeys(plain(r["part"]) for r in sorted((r for r in rows if r["lang"] == name), key=lambda r: r["rn"])))
        content = b" ".join(parts)[:most]
        if len(content.strip()) >= 8:
            out[name] = content
    return out


def _predictor(dictionaries: dict[str, bytes], min_margin: float):
    langs = list(dictionaries)

    def run(batches):
        import zstandard

        coders = []
        for name in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            pred, score, rejected = [], [], []
            for lo in range(0, batch.num_rows, 256):
                for t in batch.column(1).slice(lo, 256).to_pylist():
                    if t is None or not langs or not has_letter(t):
                        pred.append("und")
                        score.append(0.0)
                        rejected.append(True)
                        continue
                    raw = plain(t)
                    parts = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
                    size = np.array([sum(len(c.compress(x)) for x in parts) for c in coders])
                    best = int(size.argmin())
                    over = np.delete(size, best) - size[best]
                    pred.append(langs[best])
                    # a byte less is worth a factor of two
                    score.append(float(1 / (1 + np.exp(-math.log(2) * over).sum())))
                    rejected.append(bool(len(over) and over.min() < min_margin * size[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", min_margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row, in place."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(_predictor(dictionaries, min_margin), "doc_id long, lang_pred string, score double, rejected boolean")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: that of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds
