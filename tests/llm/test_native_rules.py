"""Operators 1, 4 and 10: DuckDB parity, guarantees and edge rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strata.llm import mixing, quality, url_rules
from strata.llm import queries as Q
from tests.oracle_compare import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twin(llm, name):
    df = Q.queries()[name](llm, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(Q.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_native(llm, name):
    plan = Q.queries()[name](llm, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_counts(text):
    ws = (text or "").encode().split()
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_on_odd_rows(odd_docs):
    got = odd_docs.filter("doc_id <> 7 OR doc_id IS NULL").select("text", quality.text_stats(F.col("text")).alias("s")).collect()
    for r in got:
        s = r["s"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == brute_counts(r["text"])


def test_binomial_tail(llm):
    cases = [(k, n) for n in (1, 5, 40, 300, 2000) for k in range(0, max(1, n // 20))]
    df = llm.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.05))
    for r in df.collect():
        exact = sum(math.comb(r.n, i) * 0.05 ** i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9) or r.k >= r.n * 0.05


def test_cutoffs_limit_false_rejection(llm):
    """Planted symbols: bad rows carry many, good rows few; each stratum is cut on its own evidence."""
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(4000):
        good = i % 4 > 0
        stratum = None if i % 10 == 9 else "big" if i % 10 else "tiny" if i < 400 else "big"
        rows.append((i, stratum, False, rnd.uniform(0, 0.15) if good else rnd.uniform(0.5, 2), 0.0, 0.0, 5.0))
        labels.append((i, int(good)))
    scored = llm.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, symbols_per_word double, dup_line_share double, repeat_share double, word_length double")
    cut = {r.lang: r for r in quality.fit_cutoffs(scored, llm.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, quality int"), "doc_id", "lang").collect()}
    assert cut["big"].symbols_per_word == 0.2 and "tiny" not in cut and None not in cut  # too few labels prove nothing
    kept = quality.apply_cutoffs(scored, llm.createDataFrame(list(cut.values())), "lang").collect()
    good = [r for r in kept if r.doc_id % 4 and r.lang == "big"]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert not any(r.kept for r in kept if r.doc_id % 4 == 0 and r.lang == "big")
    assert all(r.kept for r in kept if r.lang in (None, "tiny"))


def test_quality_edge_rows(llm, odd_docs, no_docs):
    labels = llm.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    out = quality.judge(odd_docs, labels).collect()
    assert len(out) == odd_docs.count()
    assert all(r.kept is False for r in out if r.n_words < 50) and all(r.kept is not None for r in out)
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 10, None}
    assert quality.judge(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels.limit(0)).count() == 0


def test_mix_targets(llm):
    """Budget by weights 1, 2, 3 with the cap of three epochs; taken words end within half a document."""
    rows = [(i, "x " * (1 + i % 7), ["b", "a", None, "hot"][0 if i < 10 else 1 if i < 40 else 2 if i < 300 else 3]) for i in range(3000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, bucket_rows=100).collect()
    assert [tuple(r) for r in sorted(out)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(7), bucket_rows=100).collect())]
    total = sum(r.size for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        size, target = own[0].source_size, own[0].target
        assert target <= 3 * size + 1e-9 and all(r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 3.5
        epochs = {r.copies for r in own}
        assert max(epochs) - min(epochs) <= 1  # complete epochs first
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(total)
    docs2 = mixing.mixed_documents(docs, bucket_rows=100)
    assert docs2.columns == docs.columns
    assert docs2.count() == sum(r.copies for r in out)


def test_mix_prefers_weight(llm):
    """Of two kinds of documents in one source, the clean kind (weight 1) is taken more often."""
    docs = llm.createDataFrame([(i, "good words here" if i % 2 else "*** ### ***", "a" if i < 2000 else "b") for i in range(2600)],
                               "doc_id long, text string, source string")
    out = [r for r in mixing.mix(docs).collect() if r.source == "a"]
    clean, noisy = (sum(r.copies for r in out if r.doc_id % 2 == z) for z in (1, 0))
    assert 0 < noisy < 0.5 * clean


def test_mix_edge_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r.size == 0 for r in out if r.doc_id in (4, 5, 6))
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_url_parts_and_list(llm):
    urls = [(1, "http://www.Example.com/en/x?a#b"), (2, "https://a.example.com/en/y"), (3, "x://foo.com"), (4, "x://foo.com/"), (5, None),
            (6, "no scheme"), (7, "h://n.net/fr/z"), (8, "h://xnet/fr/z"), (9, "h://a.b/c://d.net/es/"), (10, ""), (1, "h://q.net/es/")]
    out = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_rules.judge(
        llm.createDataFrame(urls, "page_id long, url string"), llm.createDataFrame([], "page_id long, bad boolean")).collect()}
    assert out == {
        (1, "www.example.com"): ("/en/x", "www.example.com/en/", "allow"), (2, "a.example.com"): ("/en/y", "example.com/en/", "block"),
        (3, "foo.com"): ("", None, "allow"), (4, "foo.com"): ("/", "com/", "allow"), (5, ""): ("", None, "allow"), (6, ""): ("", None, "allow"),
        (7, "n.net"): ("/fr/z", "net/fr/", "block"), (8, "xnet"): ("/fr/z", None, "allow"), (9, "a.b"): ("/c://d.net/es/", None, "allow"),
        (10, ""): ("", None, "allow"), (1, "q.net"): ("/es/", "net/es/", "block")}


def test_mined_rules(llm):
    """Bad pages share a host word and a query key; only that rule is mined, and it blocks new pages."""
    rows = [(i, f"http://{'spam' if i % 5 == 0 else 'site' + str(i % 3)}.org/p/{i}" + ("?ref=x" if i % 2 else "")) for i in range(300)]
    labels = [(i, i % 5 == 0) for i in range(200)] + [(3, None), (None, True)]
    out = url_rules.judge(llm.createDataFrame(rows, "page_id long, url string"), llm.createDataFrame(labels, "page_id long, bad boolean")).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == set(range(0, 300, 5))
    empty = llm.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, llm.createDataFrame(labels, "page_id long, bad boolean")).count() == 0
