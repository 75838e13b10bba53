"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant: one that the first
reaches by ``radius // 2`` flips and the second by the rest.  Every fingerprint therefore meets
the others at all its variants within half the radius.  Rows are shuffled by the leading bits of
the variants, one row for each leading pattern that a fingerprint can reach; the variants of one
pattern are written out inside the task, looked up, and the pairs that collide are verified.
How many leading bits are used follows from the largest group, so a dense region of
fingerprints is dealt out like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidra.llm.components import connected_components
from lexidra.llm.tables import discard, slices, stored, utf8

SEED = 42
RADIUS = 3
SHINGLE = 3
BITS = 64
GROUP_ROWS = 8192
MOST_ROUTE_BITS = 16
LOOKUPS = 1 << 19
BLOCK_BYTES = 1 << 20
#: Near-duplicates: five-word shingles, a Jaccard similarity of 0.8, as many fingerprints to
#: estimate it, the estimate up to which pairs are verified (sets of four and five shingles with four
#: in common are taken for 0.7 on average), and how many halves of fingerprints candidates are found by.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
COPIES = 16
LOOSE = 0.5
SPACES = 24
# Rows whose ids are shipped to every task at most: 8 MB.
SHIPPED_ROWS = 1 << 20
# Marks pairs of whole fingerprints among those that met.
WHOLE = -2
HALF_RADIUS = 2
HALF_GROUP_ROWS = 32_768
WHITE = b" \t\n\r\x0b\x0c"


def _text_blocks(data: bytes) -> Iterator[bytes]:
    """``data`` in blocks that end at white space."""
    start = 0
    while len(data) - start > 2 * BLOCK_BYTES:
        end = start + BLOCK_BYTES
        while end < len(data) and data[end] not in WHITE:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included.

    A-Z are lower-cased, words are runs of characters other than ASCII white space, the words of
    a shingle are joined by a space.  Fewer words make one shingle, none make none.
    """
    digest, found, carried = xxhash.xxh64_intdigest, [], []
    for block in _text_blocks(data):
        words = carried + block.lower().split()
        if len(words) >= size:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: len(words) - size + 1].tolist()
            pairs = zip(starts, ends[size - 1 :].tolist(), strict=True)
            found.append(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=len(starts)))
        carried = words[len(words) - size + 1 :] if len(words) >= size and size > 1 else [] if size == 1 else words
    if not found:
        return np.array([digest(b" ".join(carried), SEED)] if carried else [], dtype=np.uint64)
    return np.concatenate(found)


def mixed(hashes: np.ndarray, copy: int) -> np.ndarray:
    """Independent hashes from ``hashes``; copy 0 is the hashes themselves."""
    if not copy:
        return hashes
    x = hashes + np.uint64(copy * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``sizes`` hashes, the bits set in over half of them.

    Eight counters of a byte are added at once, at most 255 hashes at a time.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    blocks = -(-sizes[filled] // 255)
    starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    cuts = np.repeat(starts, blocks) + 255 * inner
    ones = np.uint64(0x0101010101010101)
    value = np.zeros(len(filled), dtype=np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & ones, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * counts > sizes[filled][:, None]
        for byte in range(8):
            value |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    out[filled] = value
    return out


def fingerprints(
    docs: DataFrame, shingle: int, copies: int = 1, carry: list[str] | None = None, distinct: bool = False, also: int | None = None
) -> DataFrame:
    """``(doc_id, row, f0, f1, ...)``: ``copies`` fingerprints of 64 bits for every row of ``docs(doc_id, text)``.

    ``row`` is a struct of the columns in ``carry``.  With ``distinct`` a shingle counts once however often it repeats.
    ``also`` adds ``whole``, the fingerprint of shingles of so many words, repeats included.
    """
    names = [f"f{c}" for c in range(copies)] + ["whole"] * (also is not None)

    def joined(own: list[np.ndarray], once: bool) -> tuple[np.ndarray, np.ndarray]:
        own = [np.unique(h) for h in own] if once else own
        return np.concatenate(own) if own else np.empty(0, dtype=np.uint64), np.array([len(h) for h in own], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data = utf8(batch.column(2))
                hashes, sizes = joined([shingle_hashes(text, shingle) for text in data], distinct)
                columns = [pa.array(majority_bits(mixed(hashes, c), sizes).view(np.int64)) for c in range(copies)]
                if also is not None:
                    columns.append(pa.array(majority_bits(*joined([shingle_hashes(text, also) for text in data], False)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "row", *names])

    row = F.struct(*[F.col(f"`{c}`") for c in carry or ["doc_id"]]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *[T.StructField(n, T.LongType()) for n in names]]))


def flips(bits: int, most: int) -> np.ndarray:
    """All patterns of at most ``most`` set bits among the lowest ``bits``."""
    chosen = [sum(1 << b for b in some) for n in range(min(most, bits) + 1) for some in combinations(range(bits), n)]
    return np.array(chosen, dtype=np.uint64)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of ``a`` and ``b``; a label is the smallest member."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def ball_collisions(
    values: np.ndarray, route: int, route_bits: int, bits: int, radius: int, links: bool, rows: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Pairs of places in ``values`` that share a variant whose leading bits are ``route``.

    Each value is paired with the first value that reaches the variant with the smaller number of
    flips.  Only pairs within ``radius`` are returned.  With ``links`` the pairs themselves are
    what is looked for; then those that join all classes are enough and only they are returned.
    With ``rows``, how many rows each value stands for, a third array says which pairs share a
    variant that at least three rows reach, so that rows besides the first may not have met.
    """
    low, high = radius // 2, radius - radius // 2
    rest = bits - route_bits
    suffix = values & np.uint64((1 << rest) - 1)
    used = np.bitwise_count((values >> np.uint64(rest)) ^ np.uint64(route)) if route_bits else np.zeros(len(values), dtype=np.uint8)
    keys, owners = [], []
    for n in range(low + 1):
        place = np.flatnonzero(used == n)
        masks = flips(rest, low - n)
        keys.append((suffix[place][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(place, len(masks)))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=bool)
    keys, owners = keys[new], owners[new]
    none = np.empty(0, dtype=np.int64)
    if not len(keys):
        return (none, none) if rows is None else (none, none, none.astype(bool))
    shift = np.uint64(64 - max(10, min(24, int(len(keys)).bit_length() + 4)))
    factor = np.uint64(0x9E3779B97F4A7C15)
    present = np.zeros(1 << (64 - int(shift)), dtype=bool)
    present[(keys * factor) >> shift] = True
    root, pairs, shared, reached = np.arange(len(values)), [], [], np.zeros(len(keys))
    for n in range(high + 1):
        place = np.flatnonzero(used == n)
        masks = flips(rest, high - n)
        if not len(place):
            continue
        step = max(1, LOOKUPS // len(place))
        for start in range(0, len(masks), step):
            variants = (suffix[place][:, None] ^ masks[None, start : start + step]).ravel()
            some = np.flatnonzero(present[(variants * factor) >> shift])
            at = np.searchsorted(keys, variants[some])
            same = keys[np.minimum(at, len(keys) - 1)] == variants[some]
            a = place[some[same] // len(masks[start : start + step])]
            b = owners[at[same]]
            if rows is not None:
                reached += np.bincount(at[same], weights=rows[a], minlength=len(keys))
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= radius)
            a, b = a[near], b[near]
            if links:
                root = unite(root, a, b)
            elif rows is not None:
                pairs.append(a * len(values) + b)
                shared.append(at[same][near])
            elif len(a):
                pairs.append(np.unique(a * len(values) + b))
    if links:
        a = np.flatnonzero(root != np.arange(len(values)))
        return a, root[a]
    both = np.unique(np.concatenate(pairs)) if pairs else none
    if rows is None:
        return both // len(values), both % len(values)
    crowded = np.concatenate(pairs)[reached[np.concatenate(shared)] >= 3] if pairs else none
    return both // len(values), both % len(values), np.isin(both, crowded)


def cross_collisions(values: np.ndarray, roots: np.ndarray, route: int, route_bits: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in ``values`` of different ``roots`` within ``radius`` that share a variant whose leading bits are ``route``."""
    low, high = radius // 2, radius - radius // 2
    rest, size = bits - route_bits, max(1, len(values))
    suffix = values & np.uint64((1 << rest) - 1)
    used = np.bitwise_count((values >> np.uint64(rest)) ^ np.uint64(route)) if route_bits else np.zeros(len(values), dtype=np.uint8)
    own = np.unique(roots, return_inverse=True)[1].astype(np.int64)
    keys, owners = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for n in range(low + 1):
        place = np.flatnonzero(used == n)
        masks = flips(rest, low - n)
        keys.append((suffix[place][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(place, len(masks)))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((own[owners], keys))
    keys, owners = keys[order], owners[order]
    # The owners of a variant stand together, those of one root among them too.
    known, number = np.unique(keys, return_inverse=True)
    edges, groups = np.append(np.searchsorted(keys, known), len(keys)), number * size + own[owners]
    found = []
    for n in range(high + 1):
        place = np.flatnonzero(used == n)
        masks = flips(rest, high - n)
        if not len(place) or not len(known):
            continue
        step = max(1, LOOKUPS // len(place))
        for start in range(0, len(masks), step):
            variants = (suffix[place][:, None] ^ masks[None, start : start + step]).ravel()
            at = np.minimum(np.searchsorted(known, variants), len(known) - 1)
            hit = np.flatnonzero(known[at] == variants)
            a, at = place[hit // len(masks[start : start + step])], at[hit]
            # Whoever reaches a variant meets the owners of it before those of the same root, and behind them.
            group = at * size + own[a]
            spans = [(edges[at], np.searchsorted(groups, group)), (np.searchsorted(groups, group, side="right"), edges[at + 1])]
            for begins, ends in spans:
                many, first = np.cumsum(ends - begins), 0
                while first < len(a):
                    last = max(first + 1, int(np.searchsorted(many, (many[first - 1] if first else 0) + LOOKUPS, side="right")))
                    m = (ends - begins)[first:last]
                    x = np.repeat(a[first:last], m)
                    y = owners[np.repeat(begins[first:last], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                    found.append(np.unique(np.minimum(x, y) * size + np.maximum(x, y)))
                    first = last
    both = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    return both // size, both % size


def _route_bits(points: DataFrame, bits: int, group_rows: int) -> int:
    """Leading bits for which no group is larger than ``group_rows``, as far as ``MOST_ROUTE_BITS`` go."""
    most = min(MOST_ROUTE_BITS, bits)
    lead = F.shiftrightunsigned("value", bits - most) if bits > most else F.col("value")
    counts = points.groupBy("space", lead.alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("space", "lead", "n", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("p"))
    groups = each.groupBy("p", "space", F.expr(f"shiftrightunsigned(lead, {most} - p)").alias("g")).agg(F.sum("n").alias("n"))
    sizes = {r["p"]: r["n"] for r in groups.groupBy("p").agg(F.max("n").alias("n")).collect()}
    return next((p for p in range(most + 1) if sizes.get(p, 0) <= group_rows), most)


def ball_pairs(points: DataFrame, bits: int, radius: int, links: bool, group_rows: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose values meet in a variant; see ``ball_collisions``.

    ``points(node, space, value)``: values of ``bits`` bits, compared within their space.  Nodes
    of a space have distinct values, unless the pairs are verified elsewhere.  With a column
    ``root`` as well, all pairs of different roots are returned; see ``cross_collisions``.  With a
    column ``n``, the rows that a value stands for, a pair has a column ``crowd`` too: a space
    where it shares a variant that at least three rows reach, or -1 where it does otherwise.
    """
    rooted, counted = "root" in points.columns, "n" in points.columns
    route_bits = _route_bits(points, bits, group_rows)
    masks = [int(m) for m in flips(route_bits, radius - radius // 2)]
    lead = F.shiftrightunsigned("value", bits - route_bits) if route_bits else F.lit(0).cast("long")
    # The patterns in order of their number of flips: a row for each leading pattern in reach.
    carried = ["node", "value", *["root"] * rooted, *["n"] * counted]
    routed = points.select(
        "space", lead.alias("lead"), *carried, F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    ).select("space", F.col("lead").bitwiseXOR(F.col("mask")).alias("route"), *carried)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes, values = nodes[order], group.column("value").to_numpy().view(np.uint64)[order]
        found = {}
        if rooted:
            a, b = cross_collisions(values, group.column("root").to_numpy()[order], key[1].as_py(), route_bits, bits, radius)
        elif counted:
            a, b, more = ball_collisions(values, key[1].as_py(), route_bits, bits, radius, links, group.column("n").to_numpy()[order])
            found = {"crowd": np.where(more, key[0].as_py(), -1)}
        else:
            a, b = ball_collisions(values, key[1].as_py(), route_bits, bits, radius, links)
        found = {"a": nodes[a], "b": nodes[b], **found}
        return pa.table(found, schema=pa.schema([(name, pa.int64()) for name in found]))

    return routed.groupBy("space", "route").applyInArrow(run, "a long, b long" + ", crowd long" * counted).distinct()


def hex_digits(value: str) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    Fingerprints link when they differ in at most ``radius`` bits; ``component_id`` is the
    smallest id that links lead to.  Texts without words, null ones included, have fingerprint
    zero and link like any other.  Equal fingerprints, so repeated rows too, are one node.  Rows
    with a null id get a component as well (null where all its ids are).  Other columns are
    ignored; an empty table gives an empty one.
    """
    rows = stored(fingerprints(docs, shingle).drop("row"), "fingerprints")
    nodes = rows.groupBy("f0").agg(F.min("doc_id").alias("least"))
    points = nodes.select(F.col("f0").alias("node"), F.lit(0).alias("space"), F.col("f0").alias("value"))
    roots = connected_components(ball_pairs(points, BITS, radius, links=True, group_rows=GROUP_ROWS))
    rooted = nodes.join(roots, nodes["f0"] == roots["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("f0", "component_id"), "components")
    return rows.join(classes, "f0").select("doc_id", hex_digits("f0").alias("fingerprint"), "component_id")


def most_bits(similarity: float, bits: int) -> int:
    """How many of ``bits`` SimHash bits two shingle sets of this Jaccard similarity differ in on average."""
    cosine = 2 * similarity / (1 + similarity)
    return int(bits * np.arccos(cosine) / np.pi)


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)`` of ``rows(node, text)``: distinct 32-bit hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                own = [np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in utf8(batch.column(1))]
                lists = pa.array([x.tolist() for x in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<int>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(row, row_id, keep_id, kept)`` for every row of ``docs(doc_id, text, ...)``; ``row`` is the whole row.

    Near-duplicates have a Jaccard similarity of ``similarity`` or more on the sets of their
    five-word shingles (a shorter text is one shingle).  Candidates are rows that ``simhash_components``
    links, and rows of which one of
    ``SPACES`` halves of fingerprints differ in at most ``HALF_RADIUS`` bits: that finds 95 % of
    the pairs at a similarity of 0.8 and 99 % at 0.85.  Pairs that all fingerprints together put
    below ``LOOSE`` are dropped, the others verified.  In a large group rows meet the first of
    each set of colliding variants, and then all others of the set that verified pairs have not joined them with;
    only sets of three rows or more take part in that.  So do rows that ``simhash_components`` links in
    threes or more: all within its radius are compared.  Of every connected group the row with the smallest
    id stays (null last).  Texts without words are one group; of rows repeated whole one stays.
    An empty table gives an empty one.
    """
    names = [f"f{c}" for c in range(COPIES)]
    rows = fingerprints(docs, NEAR_SHINGLE, COPIES, docs.columns, distinct=True, also=SHINGLE)
    rows = stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")).alias("best")
    keys = [*names, "whole"]
    nodes = rows.groupBy(*keys).agg(best).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, "near-nodes")
    low = (1 << 32) - 1
    halves = [F.col(n).bitwiseAND(F.lit(low)) for n in names] + [F.shiftrightunsigned(n, 32) for n in names]
    # Both halves of the first fingerprints.
    used = [halves[i // 2 + (i % 2) * COPIES] for i in range(SPACES)]
    points = stored(nodes.select("node", F.posexplode(F.array(*used)).alias("space", "value")), "near-points")
    # Equal halves are one point, and the rows that share one meet its first row.
    values = points.groupBy("space", "value").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    values = stored(values, "near-values")
    shared = values.where("n > 1").select("space", "value", F.col("node").alias("a"))
    equal = points.join(shared, ["space", "value"]).where("node <> a")
    equal = equal.select("a", F.col("node").alias("b"), F.col("space").cast("long").alias("crowd"))
    whole = _whole_links(nodes).withColumn("crowd", F.lit(WHOLE).cast("long"))
    met = ball_pairs(values, 32, HALF_RADIUS, links=False, group_rows=HALF_GROUP_ROWS).unionByName(equal).unionByName(whole)
    met = stored(met, "near-met")
    pairs = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    links = _verified(pairs, nodes, rows, names, similarity)
    # Rows that meet only through others which they do not resemble: where three rows or more met
    # in a variant, those that are not in one component yet are compared with one another.
    found = connected_components(links)
    crowd = met.where("crowd >= 0").select(F.col("crowd").cast("int").alias("space"), F.explode(F.array("a", "b")).alias("node")).distinct()
    crowd = crowd.join(found, "node", "left").select("space", "node", F.coalesce("root", "node").alias("root"))
    # A point that was represented by another one stands for itself here.
    apart = stored(points.join(crowd, ["space", "node"]), "near-crowd")
    linked = stored(_whole_crowd(met.where(F.col("crowd") == WHOLE), nodes, found), "near-whole-crowd")
    discard(values, points, met)
    apart = ball_pairs(apart, 32, HALF_RADIUS, links=False, group_rows=HALF_GROUP_ROWS)
    if not linked.isEmpty():
        apart = apart.unionByName(ball_pairs(linked, BITS, RADIUS, links=False, group_rows=GROUP_ROWS)).distinct()
    late = stored(apart.join(pairs, (apart["a"] == pairs["a"]) & (apart["b"] == pairs["b"]), "left_anti"), "near-late-pairs")
    roots = connected_components(links.unionByName(_verified(late, nodes, rows, names, similarity)))
    discard(pairs, late)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("keep"))
    classes = rooted.join(kept, "root").select(*keys, F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_id").alias("keep_row"))
    narrow = rows.select("row_id", *keys).join(classes, keys).select("row_id", "keep_id", (F.col("row_id") == F.col("keep_row")).alias("kept"))
    narrow = stored(narrow, "near-kept")
    discard(nodes)
    return rows.select("row", "row_id").join(narrow, "row_id")


def _whole_links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of ``nodes(node, whole)`` as ``simhash_components`` makes them: equal fingerprints are one point."""
    points = stored(nodes.groupBy(F.col("whole").alias("value")).agg(F.min("node").alias("node")), "near-whole")
    equal = nodes.join(points.select(F.col("value").alias("whole"), F.col("node").alias("a")), "whole")
    equal = equal.where("node <> a").select("a", F.col("node").alias("b"))
    return ball_pairs(points.select("node", F.lit(0).alias("space"), "value"), BITS, RADIUS, links=True, group_rows=GROUP_ROWS).unionByName(equal)


def _whole_crowd(links: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Points ``(node, space, value, root)`` of whole fingerprints that ``links`` join in threes or more, as far as verified pairs have not.

    The links are only enough to join all fingerprints, and the texts of two that are compared
    need not be those that resemble one another.
    """
    joined = connected_components(links.select("a", "b")).withColumnRenamed("root", "linked")
    joined = joined.join(roots, "node", "left").select("node", "linked", F.coalesce("root", "node").alias("root"))
    open_ = joined.groupBy("linked").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    some = joined.join(open_.where("n > 2 AND least < most").select("linked"), "linked")
    return some.join(nodes.select("node", F.col("whole").alias("value")), "node").select("node", F.lit(0).alias("space"), "value", "root")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, names: list[str], similarity: float) -> DataFrame:
    """The pairs of nodes whose texts have the similarity; those that their fingerprints put far below it are not read."""
    left = nodes.select(F.col("node").alias("a"), F.array(*names).alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.array(*names).alias("y"))
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    loose = pairs.join(left, "a").join(right, "b").where(bits <= most_bits(LOOSE, BITS * COPIES)).select("a", "b")
    pairs = stored(loose, "near-loose")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = stored(nodes.join(ids, "node").select("node", F.col("best.row_id").alias("row_id")), "near-places")
    wanted = F.broadcast(places) if places.count() <= SHIPPED_ROWS else places
    sets = stored(shingle_sets(rows.select("row_id", "row.text").join(wanted, "row_id").select("node", "text"), NEAR_SHINGLE), "near-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b")
    links = stored(both.where(common >= (F.size("x") + F.size("y") - common) * similarity).select("a", "b"), "near-links")
    discard(pairs, places, sets)
    return links
