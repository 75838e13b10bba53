"""Periodic runs against a search of every lag."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_cases import edge_docs, no_docs, texts

from lexidra.llm import periodic


def brute_runs(words):
    """Every maximal stretch of each lag, if no smaller lag describes it."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            own = words[start : start + length]
            if i > start and length >= max(6, 4 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    pick = random.Random(letters)
    for _ in range(400):
        words = [pick.randrange(letters) for _ in range(pick.randint(0, 70))]
        for _ in range(pick.randint(0, 2)):
            start, q = pick.randint(0, len(words)), pick.randint(1, 15)
            part = words[start : start + q]
            words[start : start + q] = part * pick.randint(1, 7) + part[: pick.randint(0, q)]
        assert periodic.runs_of(np.array(words, dtype=np.int64)) == brute_runs(words), words


def test_hot_words_stay_linear():
    n = 400_000
    assert periodic.runs_of(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    assert periodic.runs_of(np.arange(n) % 90_001) == [(0, n, 90_001)]
    # One seed a position at most, whatever the number of equal grams.
    assert all(len(at) <= n for at, _ in periodic.seeds(np.zeros(n, dtype=np.int64)))


def test_edge_cases(spark):
    rows = texts() + [(30, "a b " * 5 + "c", "a"), (31, " x" * 6, None), (32, "x " * 5, None), (33, ("p q r " * 4 + "s ") * 4, None)]
    docs = edge_docs(spark).limit(0)
    docs = docs.unionByName(spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string"), allowMissingColumns=True)
    got = periodic.collapse_runs(docs).collect()
    want = Counter()
    for i, t, _ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words) if len(words) < 2000 else []
        want[(i, len(words), tuple(runs), collapsed(words, runs))] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.text) for r in got) == want
    assert {r.doc_id: len(r.runs) for r in got if r.doc_id in (30, 31, 32, 33)} == {30: 1, 31: 1, 32: 0, 33: 5}
    assert periodic.collapse_runs(no_docs(spark)).count() == 0
    assert periodic.report(periodic.collapse_runs(periodic.planted(no_docs(spark)))).count() == 0


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40)), "s") for i in range(300)] + [(None, "a b c", "s"), (7, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in periodic.planted(docs).where("text IS NOT NULL").collect()}
    for i, text, _ in rows[:-2]:
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        assert got[i].split() == words
    assert got[None] == "a b c"


def test_report_names_the_longest_run(spark):
    docs = spark.createDataFrame([(1, "a " * 7 + "b c " * 5 + "x"), (2, "a " * 6 + "x " + "b " * 6), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.report(periodic.collapse_runs(docs)).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (2, 7, 10, 2, 5000)
    assert (got[2].n_runs, got[2].start, got[2].length) == (2, 0, 6)
    assert (got[3].n_runs, got[3].start, got[3].period, got[3].exponent_milli) == (0, None, None, None)
    assert got[3].runs_sha256 == got[3].collapsed_sha256
