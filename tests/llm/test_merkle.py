"""Merkle manifests against a tree built level by level in plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from edge_cases import edge_docs, no_docs
from pyspark.sql import functions as F

from lexidra.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(leaves):
    """The root, and for every leaf ``(sibling or None, sibling is left)`` level by level."""
    ways, place, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for k, p in enumerate(place):
            other = p ^ 1
            ways[k].append((now[other] if other < len(now) else None, other < p))
            place[k] = p // 2
        now = [digest(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return now[0], ways


def brute(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)`` -> Counter of the report's rows."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {name: sorted(trees[name], key=lambda x: x[:3]) for name in names}
    climbed = {name: climb([x[2] for x in own[name]]) for name in names}
    root, upper = climb([climbed[name][0] for name in names])
    out = Counter()
    for k, name in enumerate(names):
        for (_, _, leaf, r), way in zip(own[name], climbed[name][1], strict=True):
            now, steps = leaf, way + upper[k]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now = leaf_of(r[0], r[1], r[2], r[3] + 1, r[4])
            for other, left in steps:
                now = digest(other, now) if other and left else digest(now, other or "")
            proof = digest(*[s for s, _ in steps if s])
            out[(r[0], leaf, climbed[name][0], root, proof, now, now == root)] += 1
    return out


NAMES = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(n):
    langs = ["en", None, "é", "", "de", "zz"]
    return [
        (
            None if i % 17 == 5 else i // 2 * 3,
            None if i % 5 == 0 else f"s{i % 3}",
            langs[min(5, (i * i) % 11)],
            None if i % 7 == 3 else i,
            None if i % 13 == 0 else "größe " * (i % 4),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("levels, n", [(8, 300), (1, 70), (2, 131), (3, 1), (8, 2)])
def test_report_equals_brute_force(spark, monkeypatch, levels, n):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = rows_of(n) + rows_of(n)[: n // 3]
    got = merkle.report(spark.createDataFrame(rows, NAMES).repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_labels_nest(spark):
    docs = spark.createDataFrame(rows_of(90), NAMES)
    found = merkle.manifest(docs, F.col("lang"), [F.col("doc_id")], F.sha2("text", 256), {"lang": F.col("lang")}).collect()
    for r in found:
        lo, hi = r.lo, r.lo + 1
        for step in r.path:
            if step.scope == merkle.ROWS and step.digest:
                assert (step.hi == lo) if step.left else (step.lo == hi)
                lo, hi = min(lo, step.lo), max(hi, step.hi)
        assert (lo, hi) == (0, sum(x.lang == r.lang for x in found))


def test_edge_cases(spark):
    docs = edge_docs(spark).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en"))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert merkle.report(no_docs(spark)).count() == 0
