"""Tokens, packing, duplicates, mixing and sampling against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from edge_cases import edge_docs, no_docs, prose, texts
from pyspark.sql import functions as F

from lexidra.llm import fuse, line_dedup, mixing, resample, simhash
from lexidra.llm.bpe import Encoder, stable_parts
from lexidra.llm.exact_dedup import exact_groups
from lexidra.llm.packing import pack
from lexidra.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHITE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def slow(encoder, text):
    return encoder.slow.encode(text, add_special_tokens=False).ids


def test_both_encoders_agree_on_every_code_point(encoder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    samples = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}  {chr(c)} {chr(c)}{chr(c)}x" for c in points]
    for start in range(0, len(samples), 20_000):
        some = samples[start : start + 20_000]
        found = encoder.slow.encode_batch_fast(some, add_special_tokens=False)
        assert all(e.ids == encoder.ids(t).tolist() for e, t in zip(found, some, strict=True))


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000 + "x", "\n" * 3000 + "a", "!" * 5000, "<|endoftext|>" * 3 + " <|endo", "    x"])
def test_both_encoders_agree_on_runs(encoder, text):
    assert encoder.ids(text).tolist() == slow(encoder, text)
    assert "".join(stable_parts(text, 100)) == text
    assert np.concatenate([*encoder.parts(text, 100)]).tolist() == slow(encoder, text)


def test_refused_texts_are_encoded_anyway(encoder):
    text = " " * 3_000_000 + "a"
    assert len(encoder.ids(text)) == len(slow(encoder, text))


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (64, 8), (1000, 2)])
def test_token_counts(spark, encoder, chunk, overlap):
    got = token_counts(edge_docs(spark), PATH, chunk, overlap).collect()
    want = [(i, len((t or "").encode()), len(slow(encoder, t or ""))) for i, t, _ in texts()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert token_counts(no_docs(spark), PATH).count() == 0


def test_token_counts_without_ranks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Encoder(path)
    assert own.fast is None
    rows = [(1, "Some plain words"), (2, None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(slow(own, rows[0][1])), 2: 0}


@pytest.mark.parametrize("capacity", [2048, 100, 1])
def test_packing(spark, encoder, capacity):
    docs = edge_docs(spark).where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    got = pack(docs, PATH, capacity).toPandas()
    want = Counter()
    for i, t, _ in texts():
        if len(t or "") < 5000:
            want[(i, (*slow(encoder, t or ""), 1))] += 1
    pieces = defaultdict(list)
    for r in got.itertuples():
        pieces[(None if np.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    for (doc, ids), n in want.items():
        own = Counter(pieces[(doc, len(ids))])
        data = np.array(ids, dtype="<u4")
        cuts = sorted({a for a, _, _ in own})
        assert cuts[0] == 0
        for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            assert own[(a, b - a, zlib.crc32(data[a:b].tobytes()))] >= n
    assert got.length.sum() == sum(len(ids) * n for (_, ids), n in want.items())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= capacity
    assert got.sequence_id.nunique() <= got.length.sum() / capacity * 1.02 + 2
    assert pack(no_docs(spark), PATH, capacity).count() == 0


def test_filters_hold_every_key():
    pick = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 5000):
        keys = pick.integers(0, 2**63, n).astype(np.uint64)
        built = fuse.build(np.concatenate([keys, keys]))
        assert fuse.contains(keys, *built).all()
        assert fuse.contains(pick.integers(0, 2**63, 20_000).astype(np.uint64), *built).mean() < 0.01


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("incoming", ["doc_id % 2 = 1 OR doc_id IS NULL", "false", "true"])
def test_exact_groups(spark, incoming, digest_bytes):
    got = exact_groups(edge_docs(spark), F.expr(incoming), digest_bytes).toPandas()
    groups = defaultdict(list)
    for i, t, _ in texts():
        groups[(t or "").encode().translate(None, WHITE)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for data, own in groups.items():
        keep = min(own)
        for place, (_, _, _, i) in enumerate(sorted(own)):
            want[(i, keep[3], len(own), place == 0, hashlib.sha256(data).hexdigest())] += 1
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.itertuples()]
    plain = Counter((None if np.isnan(a) else int(a), None if np.isnan(b) else int(b), *rest) for a, b, *rest in rows)
    assert plain == want
    assert exact_groups(no_docs(spark), F.lit(True)).count() == 0


def brute_simhash(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[j : j + size]) for j in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    root = np.arange(len(values))
    bits = np.array(values, dtype=np.uint64)
    for k in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[k]) <= radius)
        root = simhash.unite(root, np.full(len(near), k), near)
    return root


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_simhash_components(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    rows = [(i, t) for i, t, _ in texts() if len(t or "") < 5000]
    docs = edge_docs(spark).where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    got = simhash.simhash_components(docs).collect()
    prints = [brute_simhash(t) for _, t in rows]
    root = components(prints, 3)
    least = {r: min((i for (i, _), x in zip(rows, root, strict=True) if x == r and i is not None), default=None) for r in set(root)}
    want = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_components(no_docs(spark)).count() == 0


@pytest.mark.parametrize("bits, radius, rows", [(64, 3, 8192), (64, 3, 20), (32, 2, 8192), (32, 2, 15), (16, 4, 10)])
def test_ball_pairs_join_all_links(spark, bits, radius, rows):
    pick = np.random.default_rng(bits + rows)
    centres = pick.integers(0, 1 << (bits - 1), 12)
    values = {int(c) ^ sum(1 << int(b) for b in set(pick.integers(0, bits - 1, pick.integers(0, 6)).tolist())) for c in centres for _ in range(25)}
    values = sorted(values)
    points = spark.createDataFrame([(v, 0, v) for v in values], "node long, space int, value long")
    direct = simhash.ball_pairs(points, bits, radius, False, rows).collect()
    assert all(bin(p.a ^ p.b).count("1") <= radius for p in direct)
    pairs = [*direct, *simhash.ball_pairs(points, bits, radius, True, rows).collect()]
    at = {v: k for k, v in enumerate(values)}
    root = np.arange(len(values))
    for p in pairs:
        root = simhash.unite(root, np.array([at[p.a]]), np.array([at[p.b]]))
    assert (root == components(values, radius)).all()


def test_majority_of_many_hashes():
    pick = np.random.default_rng(5)
    sizes = np.array([0, 1, 2, 255, 256, 700, 0, 3])
    hashes = pick.integers(0, 2**63, sizes.sum()).astype(np.uint64) * np.uint64(2) + pick.integers(0, 2, sizes.sum()).astype(np.uint64)
    got, start = simhash.majority_bits(hashes, sizes), 0
    for value, n in zip(got, sizes, strict=True):
        own = hashes[start : start + n].tolist()
        assert int(value) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        start += n


def test_near_duplicates_reach_the_similarity(spark):
    rows = []
    for i in range(60):
        words = prose(1000 + i, 200).split()
        rows.append((i, " ".join(words)))
        rows.append((1000 + i, " ".join(["changed", *words[1:150], *(["new"] if i % 2 else []), *words[150:]])))
        rows.append((2000 + i, " ".join(words[:100] + prose(5000 + i, 100).split())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = {r.doc_id: r.keep_id for r in simhash.near_duplicates(docs).select("row.doc_id", "keep_id").collect()}
    assert all(keep[i] == i and keep[2000 + i] == 2000 + i for i in range(60))
    assert sum(keep[1000 + i] == i for i in range(60)) >= 58
    edge = simhash.near_duplicates(edge_docs(spark))
    assert edge.count() == len(texts())
    stays = [r.doc_id for r in edge.where("kept").select("row.doc_id").collect()]
    assert set(stays) == {1, 5, None, 8, 9, 10, 12, 13, 14, 15} and len(stays) == 10
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_near_duplicates_count_a_repeated_passage_once(spark):
    rows = []
    for i in range(10):
        words = prose(7000 + i, 200).split()
        rows += [(i, " ".join(words)), (100 + i, " ".join([*words, *words[90:100] * 60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = {r.doc_id: r.keep_id for r in simhash.near_duplicates(docs).select("row.doc_id", "keep_id").collect()}
    assert all(keep[i] == keep[100 + i] == i for i in range(10))


def words_of(line):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", line.lower())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    seen = [(i is None, i or 0, no, tuple(w)) for i, t in rows for no, line in enumerate((t or "").split("\n")) if (w := words_of(line))]
    classes = sorted({s[3] for s in seen})
    at = {c: k for k, c in enumerate(classes)}
    root = np.arange(len(classes))
    for k in range(len(classes)):
        for j in range(k):
            x, y = " ".join(classes[k]), " ".join(classes[j])
            most = int(max(len(x), len(y)) * 0.1 + 1e-9)
            if abs(len(x) - len(y)) <= most and edits(x, y) <= most:
                root = simhash.unite(root, np.array([k]), np.array([j]))
    first, gone = {}, set()
    for unnamed, i, no, words in sorted(seen):
        if first.setdefault(root[at[words]], (unnamed, i, no)) != (unnamed, i, no):
            gone.add((unnamed, i, no))
    return {
        i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i is None, i or 0, no) not in gone)
        for i, t in rows
    }


def test_line_dedup(spark):
    base = [prose(i, 60) for i in range(4)]
    changed = [" ".join([*b.split()[:59], "q" + b.split()[59]]) for b in base]
    rows = [
        (3, "\n".join(base)),
        (1, "\n".join([base[1].upper() + "!!", "", "...", "own line of the first"])),
        (2, "\n".join([*changed, base[1], "own line of the first", prose(9, 40_000)])),
        (4, None),
        (5, ""),
        (6, "a\na\nb"),
        (7, prose(77, 300)),
        (8, prose(77, 300).replace(" ", ", ")),
        (None, base[0] + "\nonly here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("no", F.lit(2))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).select("row.doc_id", "text").collect()}
    small = [r for r in rows if r[0] != 2] + [(2, rows[2][1].rpartition("\n")[0])]
    want = brute_lines(small)
    got[2] = got[2].rpartition("\n")[0]
    assert got == want
    twice = spark.createDataFrame([(1, "x y\n\nz"), (1, "x y\n\nz")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(twice).collect()) == ["", "x y\n\nz"]
    assert line_dedup.dedup_lines(edge_docs(spark)).count() == len(texts())
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


def test_line_dedup_finds_changed_lines(spark):
    """Copies of lines of 20, 40 and 100 words, each changed in another way; the shares that are found."""
    rows, asked = [], {}
    for words in (20, 40, 100):
        for kind in ("letter", "letters", "word out", "word in", "words of a twentieth"):
            for _ in range(30):
                pick = np.random.default_rng(len(rows))
                base = prose(50_000 + len(rows), words)
                own = base.split()
                at = [int(i) for i in pick.permutation(words)]
                if kind == "word out":
                    del own[at[0]]
                elif kind == "word in":
                    own.insert(at[0], "zz")
                elif kind == "words of a twentieth":
                    left = len(base) // 20
                    for i in at:
                        if len(own[i]) <= left:
                            left, own[i] = left - len(own[i]), "z" * len(own[i])
                else:
                    for i in at[: 1 if kind == "letter" else 2]:
                        own[i] = "z" + own[i][1:]
                rows += [(len(rows), base), (len(rows) + 1, " ".join(own))]
                asked[len(rows) - 1] = (words, kind)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_removed > 0").select("row.doc_id").collect()}
    assert gone <= set(asked)
    found = Counter(asked[i] for i in gone)
    # Five changed words of a hundred leave a quarter as it is in about half of the cases.
    assert {k: n for k, n in found.items() if n < 27 and k != (100, "words of a twentieth")} == {}
    assert len(found) == 15


def test_line_dedup_of_a_large_group(spark, monkeypatch):
    """Hundreds of variants of a line meet under the same keys; they still end as one group."""
    words = prose(5, 400).split()
    rows = [(i, " ".join([*words, f"v{i}"])) for i in range(150)] + [(1000 + i, prose(100 + i, 30)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in line_dedup.dedup_lines(docs).where("text <> ''").select("row.doc_id").collect()}
    assert {i for i in left if i >= 1000} == set(range(1000, 1050))
    assert len([i for i in left if i < 1000]) <= 3 and 0 in left


def test_line_dedup_of_mixed_families(spark):
    """Families of near copies of the same words, so that all meet under the same keys; one line of each stays."""
    pick, words, rows = np.random.default_rng(3), prose(6, 40).split(), []
    for family in range(12):
        order = [words[k] for k in pick.permutation(40)]
        rows.append((family, " ".join(order)))
        for k in pick.permutation(39)[:25].tolist():
            rows.append((family, " ".join([*order[:k], order[k + 1], order[k], *order[k + 2 :]])))
    rows = [(i, *rows[k]) for i, k in enumerate(pick.permutation(len(rows)).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, family long, text string").repartition(8)
    left = {r.doc_id for r in line_dedup.dedup_lines(docs).where("text <> ''").select("row.doc_id").collect()}
    assert left == {min(i for i, f, _ in rows if f == family) for family in range(12)}


def test_line_dedup_counts_character_edits(spark):
    """Short lines against brute force over all pairs, and a line of twelve words with two typos."""
    pick, lines = np.random.default_rng(11), []
    for k in range(25):
        base = prose(300 + k, 1 + k % 9)
        for _ in range(5):
            line = list(base)
            for _ in range(int(pick.integers(0, 2 + len(base) // 8))):
                at = int(pick.integers(0, len(line)))
                line[at : at + int(pick.integers(0, 2))] = "xyz"[: int(pick.integers(0, 2))]
            lines.append(" ".join(words_of("".join(line))) or base)
    lines = [x for x in lines if len(x) <= line_dedup.SHORT]
    long = prose(400, 12)
    lines += ["Subscribe to our newsletter today", "Subscribe to our newsletter todey", "menu home about", "menu home abuot", long, "x" + long[1:-1] + "z"]
    root = np.arange(len(lines))
    for k, x in enumerate(lines):
        for j, y in enumerate(lines[:k]):
            if edits(x.lower(), y.lower()) <= int(max(len(x), len(y)) * 0.1 + 1e-9):
                root = simhash.unite(root, np.array([k]), np.array([j]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(8)
    left = {r.doc_id for r in line_dedup.dedup_lines(docs).where("text <> ''").select("row.doc_id").collect()}
    assert left == set(root.tolist())


def test_mixing(spark):
    rows = mixing.mix_report(edge_docs(spark)).collect()
    sizes = Counter((i, len((t or "").encode().split())) for i, t, _ in texts())
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    total = sum(n * k for (_, n), k in sizes.items())
    by = defaultdict(int)
    for i, t, s in texts():
        by[s] += len((t or "").encode().split())
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while True:
        rest = total - sum(3 * by[s] for s in names if s not in free)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) if s in free else 3 * by[s] for s in names}
        over = {s for s in free if target[s] > 3 * by[s]}
        if not over:
            break
        free -= over
    taken, source = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
    report = mixing.mix_report(edge_docs(spark).select("doc_id", "text", "source"))
    for (s, size), own in _by_target(report).items():
        taken[s] += own
        source[s] = size
    assert {round(t, 6) for t in target.values()} == {round(s, 6) for s in taken}
    assert all(abs(taken[s] - s) <= max(8, 0.01 * s) for s in taken)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_report(edge_docs(spark)).collect()), key=str)
    assert mixing.mix_report(no_docs(spark)).count() == 0


def _by_target(report):
    out = defaultdict(int)
    for r in report.collect():
        out[(r.target, r.source_size)] += r.taken
    return out


def test_mix_takes_what_it_reports(spark):
    docs = edge_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.dtypes == docs.dtypes
    taken = Counter()
    for r in mixing.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mix(no_docs(spark)).count() == 0


@pytest.mark.parametrize("votes, most, seats", [([5.0, 3.0, 1.0], [9, 9, 9], 7), ([1.0] * 9, [2] * 9, 5), ([100.0, 0.1, 0.1], [3, 5, 5], 9), ([2.0], [5], 0)])
def test_sainte_lague(spark, votes, most, seats):
    cells = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(votes, most, strict=True))], "i int, votes double, most long")
    got = {r.i: r.quota for r in mixing.sainte_lague(cells, seats, [F.col("i")]).collect()}
    want = dict.fromkeys(range(len(votes)), 0)
    for _ in range(seats):
        open_cells = [i for i in want if want[i] < most[i]]
        if open_cells:
            want[max(open_cells, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == want


def test_ngrams_do_not_depend_on_the_pieces(monkeypatch):
    own = [t.encode() for t in ("One two, TWO two!! x", "", "ünï " * 50, prose(3, 400), "a\n\nb")]

    def counted():
        found = Counter()
        for text, bucket in resample.ngrams(own, 1000):
            found.update(zip(text.tolist(), bucket.tolist(), strict=True))
        return found

    whole = counted()
    assert whole[(0, resample.AGAIN)] == 1 and whole[(2, resample.AGAIN)] == 49
    assert sum(n for (t, _), n in whole.items() if t == 4) == 3
    monkeypatch.setattr(resample, "PIECE_BYTES", 16)
    monkeypatch.setattr(resample, "SLICE_BYTES", 40)
    assert counted() == whole


def test_resampling_on_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = labels.where("doc_id % 3 <> 0")
    found = resample.weigh(docs, fit, ["doc_id"]).select("row.doc_id", "kept").join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.97
    assert found[found.quality == 0].kept.mean() < 0.1


def test_resampling_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1), (8, None)], "doc_id long, quality int")
    found = resample.weigh(edge_docs(spark), labels, ["doc_id"]).collect()
    assert len(found) == len(texts())
    assert all(r.n_grams == 0 and r.log_weight == 0 for r in found if r.row.doc_id in (5, 6, 7))
    none = labels.where("false")
    assert resample.weigh(edge_docs(spark), none, ["doc_id"]).where("NOT kept").count() == 0
    assert resample.weigh(no_docs(spark), labels, ["doc_id"]).count() == 0


def test_kth_largest(spark):
    values = [5, -3, 5, 2**40, 0, -(2**50), 5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [resample.kth_largest(df, "v", k) for k in range(1, 8)] == sorted(values, reverse=True)
