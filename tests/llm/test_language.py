"""Hyperdimensional language profiles against plain sums, and on held-out documents."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from edge_cases import edge_docs, no_docs, prose
from pyspark.sql import functions as F

from lexidra.llm import language
from lexidra.llm.queries import QUERIES

DOCS = [
    (1, "the cat and the hat", "en"),
    (2, "The thing with the other", "en"),
    (3, "der hund und die katze", "de"),
    (4, "ÜBER den hund, über die katze!", "de"),
    (5, "le chat et la souris", "fr"),
    (6, "été à la plage", "fr"),
    (7, "den und die", None),
    (8, "  123 -- ", "en"),
    (9, None, "fr"),
    (10, "", None),
    (11, "x", "en"),
    (11, "x", "en"),
    (None, "la souris", None),
]


def brute_profile(text):
    """Every trigram's vector, one after the other."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    codes = [0 if c == " " else ord(c) for c in f" {' '.join(words)} "] if words else []
    total = np.zeros(language.DIM)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        va, vb, vc = (language.letter_vector(x).astype(int) for x in (a, b, c))
        total += [va[i - 2] * vb[i - 1] * vc[i] for i in range(language.DIM)]
    return total


def length_one(v):
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def brute_identify(rows, training):
    sums = defaultdict(lambda: np.zeros(language.DIM))
    for i, text, lang in rows:
        if training(i) and lang is not None:
            sums[lang] += brute_profile(text)
    sums = {k: length_one(v) for k, v in sums.items() if v.any()}
    common = sum(sums.values()) / len(sums) if len(sums) > 1 else np.zeros(language.DIM)
    own = {k: length_one(v - common) for k, v in sums.items()}
    out = []
    for i, text, _ in rows:
        v = length_one(brute_profile(text))
        if not v.any() or not own:
            out.append((i, "und", 0.0))
            continue
        near = {k: float(length_one(v - common) @ p) for k, p in own.items()}
        best = min(near, key=lambda k: (-near[k], k))
        out.append((i, best, max(0.0, near[best])))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("shipped", [1024, 1])
def test_predictions_equal_brute_force(spark, monkeypatch, shipped):
    monkeypatch.setattr(language, "SHIPPED", shipped)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    got = language.identify(docs, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)), {"doc_id": F.col("doc_id")}).collect()
    want = brute_identify(DOCS, lambda i: i is None or i % 4 != 0)
    for g, w in zip(by_id(map(tuple, got)), by_id(want), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9


def test_pieces_and_blocks_add_up(monkeypatch):
    texts = [prose(1, 300), "", None or "", prose(2, 50) + " ééé ñ 日本語 テキスト", "ab", prose(3, 2000)]
    want = language.profiles(texts)
    assert np.array_equal(want, np.stack([brute_profile(t) for t in texts]))
    monkeypatch.setattr(language, "PIECE", 37)
    monkeypatch.setattr(language, "HELD_GRAMS", 11)
    assert np.array_equal(language.profiles(texts), want)


def test_edge_cases(spark):
    docs = edge_docs(spark)
    got = language.identify(docs, F.lit(True), {"doc_id": F.col("doc_id"), "key": F.col("key")})
    rows = got.collect()
    assert got.columns == ["doc_id", "key", "lang_pred", "score"]
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (5, 6, 7)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 8, 9, 15)} == {"en"}
    assert language.identify(no_docs(spark), F.lit(True)).count() == 0
    nothing = language.identify(docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_held_out_documents(spark, sf_dir):
    """Names of languages play no part: texts alone tell them."""
    got = QUERIES["op12_language"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and both.held_out.any()
    assert (both.lang == both.lang_pred)[both.held_out].mean() >= 0.98
    assert both.score.between(0, 1).all()
