"""The pipeline, each stage against brute force on its own input."""

import math
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from strata.llm import mixing, quality
from strata.llm.common import staged
from tests.llm.test_duplicates import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"


def test_registered():
    q = entry.queries()
    assert q["pipeline"] is corpus_pipeline.run
    assert {int(k[2:].split("_")[0]) for k in q if k.startswith("op") and k[2].isdigit()} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_repeats", "mix_sources", "encode_pieces"]


def test_stages(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = staged(stage(llm, docs, SF), name)
        seen[name] = (before, docs.collect())
        if name != "encode_pieces":
            assert docs.columns == columns

    before, after = seen["quality_rules"]
    judged = {r.doc_id: r.kept for r in quality.judge(llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert Counter(after) == Counter(r for r in before if judged[r.doc_id]) and 0 < len(after) < len(before)

    before, after = seen["near_duplicates"]
    comp = brute_components([(r.doc_id, r.text) for r in before])
    assert Counter(after) == Counter(r for r in before if comp[r.doc_id][1] == r.doc_id) and len(after) < len(before)

    before, after = seen["substring_repeats"]
    want = {x[0]: x for x in brute_repeats([(r.doc_id, r.text) for r in before])}
    assert len(after) == len(before) and sum(w[2] > 0 for w in want.values())
    old = {r.doc_id: r for r in before}
    for r in after:
        _, n, removed, _ = want[r.doc_id]
        assert len(r.text.encode().split()) == n - removed and r.n_chars == len(r.text) or not removed
        assert removed or r == old[r.doc_id]
        assert (r.lang, r.source) == (old[r.doc_id].lang, old[r.doc_id].source)

    before, after = seen["mix_sources"]
    rows = mixing.mix(llm.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert Counter(r.doc_id for r in after) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert set(after) <= set(before)

    before, after = seen["encode_pieces"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before) and all(r.lossless for r in after)
    assert all(math.isclose(len(r.ids), r.n_tokens) for r in after)


def test_odd_and_empty_inputs(llm, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, odd_docs, SF)
        assert out.count() > 0
        if name != "encode_pieces":
            assert out.columns == odd_docs.columns
        assert stage(llm, no_docs, SF).count() == 0
