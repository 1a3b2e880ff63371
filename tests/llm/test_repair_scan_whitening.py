"""Operators 11 to 13: brute force, guarantees and edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from strata.llm import bidiagonal, conversations, license_scan, whitening
from strata.llm import queries as Q

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- operator 11
def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        if code == 4:
            role = "user"
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def brute_faults(rows):
    """Rows of one conversation in order, with their first fault."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip("\t\n\x0b\f\r ")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_edits(rows):
    """Least (cost, audit) and the rows it leaves, over every script with few inserts."""
    best = None
    n = len(rows)
    for ops in itertools.product("KRrD", repeat=n):
        if any(o != "D" and f in "bd" for o, (_, _, f) in zip(ops, rows)):
            continue
        for extra in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
            out, audit, cost = [], "", 0
            for i in range(n + 1):
                for c in extra[i]:
                    out.append({"u": ("user", ""), "a": ("assistant", "")}[c])
                    audit, cost = audit + "I", cost + 3
                if i < n:
                    role, text, fault = rows[i]
                    audit += ops[i].upper()
                    if ops[i] == "D":
                        cost += 4
                        continue
                    cost += (3 if fault == "t" else 0) + (0 if ops[i] == "K" else 3)
                    out.append((role if ops[i] == "K" else {"R": "user", "r": "assistant"}[ops[i]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def plain_edits(rows):
    """The same least script for longer conversations, by a table over rows and states."""
    table = {0: {conversations.EMPTY: (0, "")}}
    n = len(rows)
    for i in range(n + 1):
        now = dict(table.get(i, {}))
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                after = conversations.AFTER[state]
                now[after] = min(now.get(after, (1e9, "")), (cost + 3, audit + "I"))
        if i == n:
            return min(now[s] for s in (conversations.EMPTY, conversations.ASSISTANT) if s in now)
        step = table.setdefault(i + 1, {})
        role, _, fault = rows[i]
        for state, (cost, audit) in now.items():
            after = conversations.AFTER[state]
            extra = 3 if fault == "t" else 0
            ways = [(state, 4, "D")]
            if fault not in "bd":
                ways.append((after, 3 + extra, "R"))
                if role[:1] == conversations.INITIAL[after]:
                    ways.append((after, extra, "K"))
                if role[:1] == "s" and state == conversations.EMPTY:
                    ways.append((conversations.SYSTEM, extra, "K"))
                if not role:
                    ways.append((state, extra, "K"))
            for to, more, letter in ways:
                step[to] = min(step.get(to, (1e9, "")), (cost + more, audit + letter))


def brute_repair(rows):
    out = {}
    damaged = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        faults = brute_faults(mine)
        cost, audit = plain_edits(faults)
        lines = list(conversations.apply_audit(conversations.EMPTY, audit, faults))
        turns = {r[1] for r in mine if r[1] is not None}
        count = {f: sum(x[2] == f for x in faults) for f in "bdt"}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["b"], count["d"], count["t"], illegal, cost, audit, digest(lines))
    return out


def test_agenda_against_all_scripts():
    rnd = random.Random(5)
    for _ in range(60):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", ""]), f"x{i}", rnd.choice("-----tbd")) for i in range(rnd.randint(0, 3))]
        symbols = "".join(conversations._symbol(r, f) for r, _, f in rows)
        cost, audit, _ = conversations.lightest(((conversations.EMPTY, 0),), symbols, True).copy().popitem()[1]
        want = brute_edits(rows)
        assert (cost, audit) == want[:2]
        assert digest(conversations.apply_audit(conversations.EMPTY, audit, rows)) == digest(want[2])
        assert plain_edits(rows) == want[:2]


def _repaired(df):
    return {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damage(df)).collect()}


@pytest.mark.parametrize("chunk", [3, 256])
def test_repair_against_brute_force(llm, monkeypatch, chunk):
    """Nulls anywhere, empty texts, equal turns, repeated rows, odd roles, a conversation without rows left, and one
    with a third of all rows; small chunks must not change anything."""
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk)
    rnd = random.Random(9)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None]
    texts = ["Yes.", "no", "", " \t", None, "What?", "ok!", "Ünï. ", "a.b"]
    rows = [(c, rnd.choice([t, t, t, None, t - 1]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.3 else f"text {rnd.random()}.")
            for c in [None, *range(60)] for t in range(rnd.randint(1, 9))]
    rows += [(1000, t, ("user", "assistant")[(t + t // 7) % 2], f"line {t % 150}" + "." * (t % 3)) for t in range(300)]
    rows += rows[:20]
    gone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi."))
    df = llm.createDataFrame([Row(conv_id=a, turn=b, role=c, text=d, kind=7, md="x", cost=0, audit=None) for a, b, c, d in rows],
                             "conv_id long, turn long, role string, text string, kind int, md string, cost int, audit string").repartition(5)
    got, want = _repaired(df), brute_repair(rows)
    assert got == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    if chunk == 3:  # the functions of the tasks run in their own processes; the chunked stream is checked here
        for conv in want:
            stream = conversations._Conversation(conv)
            seen = set()
            mine = sorted((r for r in brute_damage(rows) if r[0] == conv),
                          key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
            for (_, turn, role, text), (_, _, fault) in zip(mine, brute_faults(mine)):
                stream.add(turn, role, text, "-" if fault == "d" else fault, (role, text) not in seen)
                seen.add((role, text))
            assert stream.result()[1:] == want[conv]
    damaged = conversations.damage(df)
    lines = conversations.repaired_rows(damaged, conversations.repair(damaged)).collect()
    for conv in want:
        mine = sorted((r for r in lines if r["conv_id"] == conv), key=lambda r: r["place"])
        assert digest([(r["role"], r["text"]) for r in mine]) == want[conv][-1]


def test_repair_of_the_table_and_of_nothing(llm):
    rows = [tuple(r) for r in llm.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.queries()["op11_conversation_repair"](llm, SF).collect()}
    assert got == brute_repair(rows)
    empty = llm.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert _repaired(empty) == {}


# ---------------------------------------------------------------- operator 12
def brute_scan(text):
    plain = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    found = []
    for t in license_scan.TEMPLATES:
        w = t.words
        for o in range(-len(w), len(ws)):
            same = [0 <= o + k < len(ws) and ws[o + k] == w[k] for k in range(len(w))]
            if all(same[k] for k in t.key) and sum(same) / len(w) >= license_scan.MIN_SHARE:
                found.append((t.label, t.base, o, sum(same) / len(w)))
    base = [f for f in found if f[1]]
    return (len(ws), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None),
            ",".join(sorted({f[0] for f in base})), ",".join(sorted({f[0] for f in found})), max((f[3] for f in found), default=0.0))


LICENSED = [
    "Released under the MIT License.", "licensed under the Apache License, Version 2.0.", "MIT License", "MIT-License mit license MIT/LICENSE",
    "This work is licensed under the GNU General Public License, version 3.", "GNU General Public Licence", "license mit cc-by CC BY-NC 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction", "hereby granted permission is free of charge",
    "use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:", "gnu general public license version 2 " * 3, "apache licenſe", "miт license",
    "general public license version 2 gnu general public license", "Kreİ mit license", None, "",
]


def test_scan_against_brute_force(llm, odd_docs):
    rows = [Row(doc_id=i % 7 if i % 5 else None, text=t, words="x", label="y", matches=1, found=2, base=None, at=i) for i, t in enumerate(LICENSED)]
    df = llm.createDataFrame(rows, "doc_id long, text string, words string, label string, matches int, found int, base int, at int")
    got = sorted(map(repr, (tuple(r) for r in license_scan.labelled(license_scan.scan(df)).collect())))
    assert got == sorted(repr((r["doc_id"], *brute_scan(r["text"]))) for r in rows)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(map(repr, (tuple(r) for r in license_scan.labelled(license_scan.scan(odd_docs)).collect())))
    assert got == sorted(repr((i, *brute_scan(t))) for i, t in odd)
    assert license_scan.labelled(license_scan.scan(odd_docs.limit(0))).collect() == []


def test_scan_reports_spans(llm):
    df = llm.createDataFrame([(1, "x y under the MIT License and CC BY-NC 4.0")], "doc_id long, text string")
    matches = license_scan.scan(df).first()["matches"]
    assert {(m["label"], m["start"], m["length"], m["share"]) for m in matches} == {("mit", 4, 2, 1.0), ("cc-by", 7, 2, 1.0), ("cc-by-nc", 5, 5, 0.6)}


# ---------------------------------------------------------------- operator 13
@pytest.mark.parametrize("kind", ["random", "close", "equal", "graded", "low_rank", "diagonal", "one"])
def test_singular_values_and_vectors(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 24
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    size = {"random": None, "close": 1 + 1e-9 * np.arange(d), "equal": np.ones(d), "graded": 10.0 ** -np.arange(0, 12, 0.5)[:d],
            "low_rank": np.r_[np.arange(10, 0, -1.0), np.zeros(14)], "diagonal": np.arange(d, 0, -1.0), "one": np.array([3.0])}[kind]
    r = rng.standard_normal((d, d)) if size is None else np.linalg.qr(np.diag(size) @ q.T, mode="r")
    if kind == "diagonal":
        r = np.diag(size)
    values, vectors = bidiagonal.singular(r, d)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-12 * want[0]


def whiten_brute(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    top = x.astype(object) * n - s.astype(object)
    c = top.astype(float) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    return n, (top * top).sum(axis=1), c, value[::-1], vector[:, ::-1]


def check_whitened(rows, ids, vectors):
    n, deviation, c, value, vector = whiten_brute(vectors)
    k = min(32, int((value > 1e-12 * value[0]).sum()))
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(ids) and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    for j in range(k):
        got = np.array([by[i][j + 1]["whitened"] for i in ids])
        want = c @ vector[:, j] / np.sqrt(value[j])
        want *= np.sign(want @ got)
        assert np.abs(got - want).max() < 1e-7
    for i, dev in zip(ids, deviation):
        assert by[i][1]["n"] == n and by[i][1]["deviation"] == dev
    assert rows[0]["identity_error"] < 1e-9
    assert np.allclose([by[ids[0]][j + 1]["explained"] for j in range(k)], value[:k] / value.sum(), rtol=1e-9)


def test_whitening_of_the_table(llm):
    table = llm.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitened(Q.queries()["op13_whitening"](llm, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_of_odd_rows(llm):
    rng = np.random.default_rng(8)
    good = [[float(v) for v in rng.standard_normal(6) * [5, 3, 1, 1, 0.5, 0.2]] for _ in range(400)]
    rows = [(i, v) for i, v in enumerate(good)]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] + [0.0] * 5), (1005, [1.0, 2.0])]
    df = llm.createDataFrame([Row(vec_id=i, embedding=v, x="clash", n=1, m=2, part="p", v=None) for i, v in rows + bad],
                             "vec_id long, embedding array<double>, x string, n int, m int, part string, v string").repartition(40)
    check_whitened(whitening.whiten(df).collect(), [i for i, _ in rows], good)
    assert whitening.whiten(df.limit(0)).collect() == []
    same = llm.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []
    twice = llm.createDataFrame([(i % 3 or None, [float(i % 2), 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(twice).collect()) == 6


def test_deviation_beyond_longs():
    x = np.array([[0, 10 ** 12], [10 ** 12, 0]], np.int64)
    sums = [10 ** 12, 10 ** 12]
    assert whitening.deviation(x, 10 ** 9, sums) == [None, None]
    assert whitening.deviation(x // 10 ** 10, 2, [100, 100]) == [2 * 100 ** 2] * 2
