"""The quality classifier against a plain version over all documents of a table."""

from __future__ import annotations

import math
import os
import re
import struct
from collections import Counter

import pytest
import xxhash

from lexidra.llm import resample
from lexidra.llm.queries import QUERIES

MASK = (1 << 64) - 1
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff \t\n\r\x0b\x0c\0]+")


def mixed(x):
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    return ((x >> 32) * (resample.BUCKETS - 1) >> 32) + 1


def token_hash(token):
    found, power = 0, resample.BASE
    for i, byte in enumerate(token):
        found += (byte + 1) * pow(power, i, 1 << 64)
    return found & MASK


def grams(text):
    """Buckets of all unigrams and bigrams of a text, counted."""
    hashes = [token_hash(t) for t in TOKEN.findall((text or "").encode().lower())]
    found = Counter(mixed(h) for h in hashes)
    for a, b in zip(hashes, hashes[1:]):
        found[0 if a == b else mixed((a * 0xD6E8FEB86659FD93 + b) & MASK)] += 1
    return found


def noise(doc_id):
    """Gumbel noise of an id; that of a null id depends on the seed alone."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", resample.SEED), seed=42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=h)
    return -math.log(-math.log(((h >> 11) + 0.5) / 2**53)) * resample.TEMPERATURE


def plain(docs, labels):
    """``(doc_id, n_grams, log_weight, key)`` of every ``(doc_id, text)``, and how many are kept."""
    judged = {}
    for doc_id, quality in labels:
        if doc_id is not None and quality is not None:
            judged[doc_id] = min(quality, judged.get(doc_id, quality))
    good = {d for d, q in judged.items() if q == 1}
    counted = [(d, grams(t)) for d, t in docs]
    raw, target = Counter(), Counter()
    for d, c in counted:
        raw.update(c)
        if d in good:
            target.update(c)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    add = resample.SMOOTHING

    def ratio(bucket):
        if not n_target:
            return 0.0
        return math.log((target[bucket] + add) / (raw[bucket] * n_target / n_raw + add))

    ratios = {b: ratio(b) for b in raw}
    rows = []
    for d, c in counted:
        weight = sum(ratios[b] * n for b, n in c.items())
        rows.append((d, sum(c.values()), weight, weight + noise(d)))
    share = len(good) / len(judged) if judged else 1.0
    return rows, max(sum(r[2] >= 0 for r in rows), round(len(rows) * share))


def same(got, want, keep):
    """Weights and keys up to their rounding, and the kept rows are the largest keys."""
    # Ratios and noise are rounded to a multiple of the unit each.
    off = lambda n: resample.UNIT * (n + 2) / 2 + 1e-9
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert abs(g[2] - w[2]) <= off(g[1]) and abs(g[3] - w[3]) <= off(g[1])
    ranked = sorted((w[3] for w in want), reverse=True)
    cut = ranked[keep - 1]
    for g, w in zip(got, want):
        if abs(w[3] - cut) > 2 * off(max(r[1] for r in got)):
            assert g[4] == (w[3] > cut)
    assert abs(sum(g[4] for g in got) - keep) <= sum(abs(k - cut) <= 2 * off(max(r[1] for r in got)) for k in ranked)


def test_query_equals_plain_version(spark, sf_dir):
    read = lambda name: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    docs = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.quality) for r in read("labels").select("doc_id", "quality").collect()]
    want, keep = plain(docs, labels)
    got = [(r.doc_id, r.n_grams, r.log_weight, r.key, r.kept) for r in QUERIES["op8_quality_resampling"](spark, sf_dir).collect()]
    same(got, want, keep)
    assert 0 < keep < len(docs)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows_equal_plain_version(spark, labelled):
    docs = [(1, None), (2, ""), (3, "a a a a"), (3, "A, a! ÄÖ 7x"), (None, "the cat\x00sat"), (5, "the cat sat " * 500), (6, "--- ---\n...")]
    labels = [(5, 1), (5, 1), (3, 1), (3, 0), (None, 1), (2, None), (77, 0)] if labelled else []
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = resample.weigh(frame, spark.createDataFrame(labels, "doc_id bigint, quality int"), ["doc_id"]).collect()
    want, keep = plain(docs, labels)
    same([(r.row.doc_id, r.n_grams, r.log_weight, r.key, r.kept) for r in rows], want, keep)
