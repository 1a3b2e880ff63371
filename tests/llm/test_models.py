"""Operators 2, 3, 6, 7 and 8 against brute force, round trips and held-out labels."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import ann, langid, quality_model, sampled_pieces, token_files
from strata.llm import queries as Q

SF = "/root/testdata/sf0.001"


# -- 2: nearest neighbours


def exact(vectors, queries, k):
    out = {}
    ids = sorted(vectors)
    for q in queries:
        scored = sorted((-float(np.dot(np.float64(vectors[q]), np.float64(vectors[i]))), i) for i in ids if i != q)
        out[q] = scored[:k]
    return out


def recall(got, want, k):
    """Share of true neighbours found; equal scores are interchangeable."""
    hit = total = 0
    for q, best in want.items():
        worst = -best[-1][0]
        hit += sum(s >= worst - 1e-9 for s in got[q])
        total += len(best)
    return hit / total


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.score)
    return out


def test_nearest_on_the_table(llm):
    rows = llm.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in rows}
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 20)
    out = Q.queries()["op2_nearest_vectors"](llm, SF).collect()
    assert recall(by_query(out), want, 20) >= 0.9
    for r in out:
        assert r.score == pytest.approx(float(np.dot(np.float64(vectors[r.query_id]), np.float64(vectors[r.vec_id]))), abs=1e-12) and r.vec_id != r.query_id
    assert all(sorted(r["rank"] for r in out if r.query_id == q) == list(range(1, 21)) for q in want)


def test_nearest_over_many_cells(llm, monkeypatch):
    """Clustered vectors of different lengths in several cells and query blocks."""
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 24)) * 2
    x = (centers[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 24))).astype(np.float32)
    vectors = dict(enumerate(x.tolist()))
    df = llm.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    out = ann.nearest(df, lambda i: i % 20 == 0, k=10).collect()
    assert recall(by_query(out), exact(vectors, range(0, 1500, 20), 10), 10) >= 0.9


def test_nearest_edge_rows(llm):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]),
            (6, [1.0, 2.0, 3.0]), (7, []), (8, [0.5, 0.5]), (20, [0.0, -1.0])] + [(100 + i, [0.5, 0.5]) for i in range(60)]
    out = ann.nearest(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=20).collect()
    own = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == 0)
    assert [v for _, v, _ in own] == [1, 8, *range(100, 118)] and all(s == 0.5 for *_, s in own)
    assert {r.query_id for r in out} == {0, 20, 100, 120, 140}
    few = ann.nearest(llm.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), lambda i: i == 0)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(llm.createDataFrame([], "vec_id long, embedding array<double>"), lambda i: i == 0).count() == 0
    assert ann.nearest(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 77).count() == 0


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# -- 3: token files


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2 ** 32, n, dtype=np.uint32), rng.zipf(1.3, n).clip(0, 2 ** 32 - 1).astype(np.uint32), np.full(n, 7, np.uint32)):
        seg = token_files.Segment(token_files.pack_segment([3, None], [n, 0], ids))
        assert (seg.read_ids() == ids).all() and seg.doc_ids == [3, None] and seg.counts.tolist() == [n, 0]
        for a, c in ((0, 10), (1000, 50), (n - 1, 5), (n, 3)):
            if a >= 0:
                assert (seg.read_ids(a, c) == ids[a:a + c]).all()


def test_outliers_are_patched():
    ids = np.full(4096, 5, np.uint32)
    ids[::100] = 4_000_000_000
    blocks, _ = token_files.pack_blocks(ids)
    assert sum(map(len, blocks)) < 600 and (token_files.Segment(token_files.pack_segment([1], [4096], ids)).read_ids() == ids).all()


def check_token_files(out, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted(out, key=lambda r: r.start)
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens
    want = sorted((d is not None, d or 0, len(i), zlib.crc32(np.array(i, "<u4"))) for d, t in rows
                  for i in [tok.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in out) == want
    known = [r.doc_id for r in out if r.doc_id is not None]
    assert known == sorted(known)


def test_token_files(llm, sample_rows):
    check_token_files(Q.queries()["op3_token_files"](llm, SF).collect(), sample_rows)


def test_token_files_edge_rows(llm, odd_docs, no_docs, monkeypatch):
    path = token_files.new_path(llm)
    token_files.write_tokens(odd_docs, path)
    check_token_files(token_files.read_documents(llm, path).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    path = token_files.new_path(llm)
    token_files.write_tokens(no_docs, path)
    assert token_files.read_documents(llm, path).count() == 0


def test_encoder_cache_is_bounded(sample_rows):
    texts = [(t or "").encode() for _, t in sample_rows]
    path = public_tokenizers.path("word_bpe_49k.json")
    a, b = token_files.WordEncoder(path, max_words=50), token_files.WordEncoder(path)
    for t in texts[:40]:
        assert (a.encode([t], 2)[0] == b.encode([t], 2)[0]).all()


def test_latin_words_go_to_the_model(monkeypatch):
    """Lower-case Latin-1 letters are coded by the model like a-z, with the ids of the whole pipeline; signs, capitals and
    combining marks among them take the pipeline. A full cache and texts without words change nothing."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = [f"{chr(c)}a{chr(c)}" for c in range(0xDF, 0x100) if c != 0xF7] + ["schön.", "über,$$", "naïve", "ça!", "ßß", "façade"]
    other = ["ÄÉ", "é÷é", "a×b", "e\u0301t\u0301", "étés's", "l'été", "ñ1ñ", "\u0142za", "ª", "µm", "ſ", "İx", "日本é"]
    texts = [" ".join(plain + other), "", " \n", *plain, *other, "Voilà ÉTÉ été, été"]
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    for most in (1, 1_000_000):
        enc = token_files.WordEncoder(path, max_words=most)
        ids, counts = enc.encode([t.encode() for t in texts], 7)
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
        assert [enc.encode([t.encode()], 7)[0].tolist() for t in texts] == want

    piped = []

    class Pipeline:
        def encode_batch_fast(self, words, **kw):
            piped.extend(words)
            return whole.encode_batch_fast(words, **kw)

        encode = whole.encode

    enc = token_files.WordEncoder(path)
    enc.tokenizer = Pipeline()
    enc.encode([" ".join(plain).encode()], 7)
    assert piped == []


# -- 6: quality model


def test_quality_model_held_out(llm):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in Q.queries()["op6_quality_model"](llm, sf).collect()}
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    truth = [(r.quality, out[r.doc_id]) for r in llm.read.parquet(f"{sf}/labels.parquet").collect() if out[r.doc_id].held_out]
    good, bad = [r.score for q, r in truth if q == 1], [r.score for q, r in truth if q == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.9, auc


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality_model.fit_trees(x, y, rounds=30, depth=3)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.95
    for row, s in zip(x[:20], score, strict=False):
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < 7:
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - 7]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_model_edge_rows(llm, odd_docs, no_docs):
    stats = quality_model.staged_statistics(odd_docs)
    for labels in ([], [(1, None)], [(1, 1), (2, 1)], [(1, 1), (1, 0), (10, 1), (None, 0), (77, 0)]):
        trees = quality_model.train(stats, llm.createDataFrame(labels, "doc_id long, quality int"))
        out = quality_model.score(stats, trees).collect()
        assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_model.score(quality_model.staged_statistics(no_docs), trees).count() == 0


# -- 7: sampled pieces


@pytest.fixture(scope="module")
def pieces():
    return sampled_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_without_dropout_equals_the_library(pieces, sample_rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    enc = sampled_pieces.SampledEncoder(pieces, "s", 0.0, 4)
    for d, t in sample_rows:
        assert enc.encode(t, d).tolist() == sp.encode(t)


def test_dropout_varies_and_decodes(pieces, sample_rows):
    enc, again = (sampled_pieces.SampledEncoder(pieces, "s", 0.3, 8, max_units=m) for m in (400_000, 20))
    other = sampled_pieces.SampledEncoder(pieces, "t", 0.3, 8)
    rnd = random.Random(5)
    odd = ["", " ", "\n", "  a\n\n b ", "▁x ▁▁", "é́ 😀 \x00", "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(300)), "a" * 400]
    for d, t in sample_rows[:40] + list(enumerate(odd)):
        ids = enc.encode(t, d).tolist()
        assert pieces.decode(ids) == t and ids == again.encode(t, d).tolist()
    text = " ".join(["internationalization of the segmentation"] * 30)
    a, b, c = (e.encode(text, d).tolist() for e, d in ((enc, 1), (enc, 2), (other, 1)))
    assert a != b and a != c and len(a) > len(sampled_pieces.SampledEncoder(pieces, "s", 0.0, 1).encode(text, 1))


def test_each_merge_is_skipped_at_the_rate(pieces):
    """A two-letter unit has one candidate: over many draws it is skipped about as often as asked."""
    whole = sum(len(pieces.segment("th", d, 12345, 0.2)) == 1 for d in range(4000)) / 4000
    assert 0.77 < whole < 0.83


def test_every_occurrence_is_segmented_on_its_own(pieces):
    """A frequent word takes many segmentations, and each merge is skipped at the rate."""
    enc = sampled_pieces.SampledEncoder(pieces, "s", 0.1)
    n = 3000
    units = lambda word, d: pieces_of_units(pieces, enc.encode(" ".join([word] * n), d).tolist())
    one, two = units("internationalization", 1), units("internationalization", 2)
    assert len(one) == len(two) == n and len(set(one)) > 20 and one != two
    whole = units("a", 3).count((pieces.ids[" a"],)) / n  # one candidate
    assert abs(whole - 0.9) < 0.025


def pieces_of_units(pieces, ids):
    out = []
    for i in ids:
        if pieces.raw[i].startswith(b" "):
            out.append([])
        out[-1].append(i)
    return [tuple(u) for u in out]


def test_units_merged_together_equal_units_merged_alone(pieces, sample_rows):
    texts = [t for _, t in sample_rows[:60]] + ["", "  a\n\n b ", "▁x é́ 😀 \x00" * 9, "x" * 70 + " " * 70 + "y"]
    docs = [d for d, _ in sample_rows[:60]] + [0, -1, 2 ** 62, 7]
    together, alone = (sampled_pieces.SampledEncoder(pieces, "s", 0.2, wide=w).encode_all(texts, docs) for w in (64, 1))
    assert [x.tolist() for x in together] == [x.tolist() for x in alone]


def test_encode_documents(llm, odd_docs, no_docs):
    out = sampled_pieces.encode_documents(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r.lossless for r in rows)
    assert all((r.ids is None) == (t.text is None) for r, t in zip(rows, odd_docs.collect(), strict=True))
    texts = sampled_pieces.decode_documents(out).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, texts), key=key) == sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=key)
    assert sampled_pieces.encode_documents(no_docs).count() == 0


# -- 8: language


def test_language_held_out(llm):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in Q.queries()["op8_language_id"](llm, sf).collect()}
    docs = llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(out) == 1000 and all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    held = [r for r in docs if out[r.doc_id].held_out]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95


def test_dictionaries_from_different_texts_and_places(llm):
    """Copies count once, and long texts are read beyond their shared header."""
    header = "license " * 400
    rows = [(i, "same text again " * 5, "en") for i in range(3000)] + [(10_000 + i, f"own{chr(97 + i)} words here", "en") for i in range(20)]
    rows += [(20_000 + i, header + " ".join(f"body{chr(97 + i)}{chr(97 + j % 26)}" for j in range(4000)), "fr") for i in range(20)]
    learned = langid.learn(llm.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert all(f"own{chr(97 + i)}".encode() in learned["en"] for i in range(20)) and learned["en"].count(b"same") == 5
    assert sum(f"body{chr(97 + i)}".encode() in learned["fr"] for i in range(20)) > 15


def test_language_edge_rows(llm, odd_docs, no_docs):
    rows = [(i, t, n) for i, (t, n) in enumerate([("the cat and the dog of the house " * 20, "en"), ("le chat et le chien de la maison " * 20, "fr"),
                                                  ("der hund und die katze " * 30, None)])]
    learned = langid.learn(llm.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert list(learned) == ["en", "fr"]
    test = llm.createDataFrame([(1, "the dog and the cat"), (2, "le chien et le chat"), (3, None), (4, "123 ... ! Ⅷ ²"), (5, ""), (1, "the dog and the cat"), (None, "la maison de le chat")],
                               "doc_id long, text string")
    out = [(r.doc_id, r.lang_pred) for r in langid.predict(test, learned).collect()]
    assert out == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (1, "en"), (None, "fr")]
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.predict(odd_docs, {}).collect())
    assert langid.predict(no_docs, learned).count() == 0
    assert langid.learn(odd_docs.filter(F.col("lang").isNull()), "doc_id", "text", "lang") == {}
