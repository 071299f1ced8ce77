"""Operators 11 to 13 against brute force, on planted and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.llm import decontam, periodic, whitening
from tests.llm.test_operators import lines, table

ODD = [(1, None, "a"), (2, "", None), (3, "word " * 30000, "a"), (4, "x y z " * 20 + "tail", "b"), (5, "x y z " * 20 + "tail", "b"), (5, "x y z " * 20 + "tail", "b"), (5, "other", "b"),
       (None, "p q " * 9, "b"), (None, None, "b"), (7, " \t\n", "c"), (8, "é ü " * 40, None)]


# ---------------------------------------------------------------- 12

def brute_runs(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def looped(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_digest(doc_id, text):
    w = looped(doc_id, text)
    runs = brute_runs(w) if len(set(w)) > 1 else [(0, len(w), 1)] if len(w) >= 6 else []
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def digested(df):
    return sorted(map(tuple, periodic.digest(periodic.find(df.select("doc_id", periodic.looped(F.col("doc_id"), F.col("text")).alias("text")))).collect()), key=str)


def test_runs_match_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(150):
        w = lines(rng, rng.choice([0, 5, 40, 300]), rng.choice(["a", "ab", "abcdefgh"])).split()
        if i % 3 == 0 and w:
            p, a = rng.randint(1, 1 + len(w) // 5), rng.randrange(len(w))
            w = w[:a] + w[a:a + p] * rng.randint(3, 7) + w[a:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w), "a"))
    want = sorted((brute_digest(i, t) for i, t, _ in rows), key=str)
    assert digested(table(spark, rows).repartition(3)) == want and sum(r[1] > 0 for r in want) > 30 and any(r[4] and r[4] > 20 for r in want)


def test_runs_of_odd_rows(spark):
    got = digested(table(spark, ODD, extra=True).withColumns({"runs": F.lit(1), "start": F.lit(2), "kept": F.lit(3)}))
    assert got == sorted((brute_digest(i, t) for i, t, _ in ODD), key=str)
    assert digested(table(spark, ODD).filter("false")) == []
    found = {r["doc_id"]: r for r in periodic.find(table(spark, ODD).filter("doc_id is not null and source = 'b'")).collect()}
    assert found[4]["collapsed"] == "x y z tail" and [tuple(r) for r in found[4]["runs"]] == [(0, 60, 3)]


@pytest.mark.parametrize("block, v", [(7, 21), (1 << 19, 133)])
def test_extensions_over_both_covers(monkeypatch, block, v):
    assert all(len({(y - x) % m for x in c for y in c}) == m for m, c in periodic.COVERS.items())
    monkeypatch.setattr(periodic, "BLOCK", block)
    monkeypatch.setattr(periodic, "cover", lambda n: periodic.Cover(v))
    rng = random.Random(22)
    for _ in range(30):
        w = [rng.randint(0, rng.choice([1, 3, 99])) for _ in range(rng.randint(0, 400))]
        w = w * rng.randint(1, 6) + w[:rng.randint(0, 9)]
        found = periodic.find_runs(np.array(w, np.uint64), np.array([0, len(w)]))
        assert sorted(map(tuple, found[:, 1:].tolist())) == brute_runs(w)
        ext = periodic.Extensions(np.array(w, np.uint64))
        for _ in range(min(len(w), 20)):
            a, b = sorted(rng.sample(range(len(w)), 2)) if len(w) > 1 else (0, 0)
            k = 0
            while a < b and b + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            assert a == b or int(ext.common(np.array([a]), np.array([b]))[0]) == k


# ---------------------------------------------------------------- 11

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as whitened", "3 as n").repartition(3)


def test_whitening_matches_an_eigensolver(spark):
    rng = np.random.default_rng(23)
    x = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0]), (905, []), (906, [1e30] * 12)]
    same = [(7, rows[7][1]), (None, rows[8][1])]
    got = whitening.components_by_row(vectors(spark, rows + odd + same)).collect()
    whole = np.array([np.floor(1024 * np.array(v, np.float64)).astype(np.int64) + 100000 for _, v in rows + same])
    n, s = len(whole), whole.sum(0)
    y = whole - s / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    want = (y @ basis / np.sqrt(values))[:, :8]
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {n}
    at = {}
    for r in got:
        at.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for k in range(8):
        one = np.array([at[k + 1][i][0]["whitened"] for i in range(700)])
        sign = np.sign(one[0] * want[0, k])
        assert np.abs(one * sign - want[:700, k]).max() < 1e-8 and abs(at[k + 1][0][0]["explained"] / (values[k] / values.sum()) - 1) < 1e-9
    exact = [sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in whole]
    assert [at[1][i][0]["deviation"] for i in range(700)] == exact[:700] and len(at[3][7]) == 2 and at[3][None][0]["deviation"] == exact[-1]
    assert max(r["identity_error"] for r in got) < 1e-8


@pytest.mark.parametrize("rank", [0, 1, 3])
def test_whitening_of_few_directions(spark, rank):
    rng = np.random.default_rng(24)
    x = np.floor(rng.normal(size=(90, rank)) * 50) @ np.floor(rng.normal(size=(rank, 6)) * 9) / 64
    got = whitening.components_by_row(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])).collect()
    assert len(got) == 90 * rank and all(np.isfinite(r["whitened"]) and r["identity_error"] < 1e-6 for r in got)
    assert whitening.components_by_row(vectors(spark, [(1, [1.0])]).filter("false")).collect() == []


def test_deviation_beyond_64_bits(spark):
    big = [(1, [float(2**30), 0.0]), (2, [-float(2**30), 1.0]), (3, [0.0, 0.0])]
    got = {r["vec_id"]: r for r in whitening.components_by_row(vectors(spark, big)).filter("component = 1").collect()}
    x = [[int(1024 * c) + 100000 for c in v] for _, v in big]
    s = [sum(c) for c in zip(*x)]
    assert {i: int(r["deviation_exact"]) for i, r in got.items()} == {k + 1: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for k, v in enumerate(x)}
    assert got[1]["deviation"] is None and got[3]["deviation"] == int(got[3]["deviation_exact"])


def test_factor_and_rotations():
    rng = np.random.default_rng(25)
    for n in (1, 2, 5, 8):
        b = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-3, 3, n)
        a = b @ b.T
        order, factor = whitening.pivoted_cholesky(a)
        assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], rtol=1e-10) and np.allclose(factor, np.tril(factor)) and (np.diff(np.diag(factor)) <= 1e-12).all()
        values, unit = whitening.components(a, 1)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9) and np.abs(unit.T @ unit - np.eye(n)).max() < 1e-12


# ---------------------------------------------------------------- 13

def brute_hits(docs, items, width=10):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: token.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = low(t)
        k = min(width, len(w))
        for s in range(len(w) - k + 1 if k and i is not None else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, seen = low(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit |= set(range(s, s + k))
                    seen |= windows[tuple(w[s:s + k])]
        out.append((i, len(w), len(hit), sorted(seen)))
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as window", "2 as shingle")


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_contained_windows_match_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontam, "bit_map", lambda s, c, f=decontam.bit_map: f(s, c, bits))
    rng = random.Random(26)
    items = [(i, lines(rng, n, "abc")) for i, n in enumerate([1, 2, 4, 5, 6, 9, 10, 11, 25, 40, 0])]
    items += [(100, items[9][1].upper().replace(" ", " -- ")), (100, items[8][1]), (None, items[9][1]), (101, None), (102, "x y z x y z x y z x y z x y z")]
    docs = []
    for i in range(120):
        t = lines(rng, rng.randint(0, 40), "abc" if i % 3 else "defg")
        if i % 2:
            w = rng.choice(items)[1] or ""
            a = rng.randint(0, len(w) // 2)
            t += "; " + (w if i % 4 == 1 else w[a:a + rng.randint(0, len(w))]) + ", " + lines(rng, rng.randint(0, 9), "fgh")
        docs.append((i, t))
    docs += [(i, t) for i, t, _ in ODD] + [(500, "x y z " * 300), (501, items[9][1] + "é"), (502, "é" + items[9][1])]
    got = decontam.decontaminate(table(spark, [(i, t, "a") for i, t in docs], extra=True).repartition(3), benchmark(spark, items)).collect()
    want = brute_hits(docs, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want and sum(r[2] > 0 for r in want) > 40


def test_nothing_to_find(spark):
    docs, none = table(spark, ODD), benchmark(spark, [(1, "x")]).filter("false")
    assert [r["n_hit"] for r in decontam.decontaminate(docs, none).collect()] == [0] * len(ODD)
    assert decontam.decontaminate(docs.filter("false"), benchmark(spark, [(1, "x y")])).collect() == []


def test_an_item_of_many_and_a_window_of_many_items(spark):
    shared = " ".join(f"w{k}" for k in range(10))
    items = [(i, f"{shared} own{i}") for i in range(200)]
    docs = [(i, shared if i % 3 else f"{shared} own{i}") for i in range(300)]
    got = {r["doc_id"]: r for r in decontam.decontaminate(table(spark, [(i, t, "a") for i, t in docs]), benchmark(spark, items)).collect()}
    assert all(len(r["items"]) == 200 for r in got.values()) and got[3]["n_hit"] == 11 and got[1]["n_hit"] == 10
