"""Merkle manifest of a table: nodes labelled with the interval of leaf ranks that they cover.

Each group of rows is a binary tree over its leaves in order, and the groups' roots, in order,
are the leaves of one more tree.  A node of level ``l`` covers the ranks ``[lo, hi)``; a node
contains another exactly if their intervals do.

Levels are taken in buckets of ``LEVELS``: the nodes of a bucket below one node of the next
bucket are one row, of at most ``2 ** LEVELS`` units and the levels above them.  Rising, the
rows' top nodes are the units of the next bucket.  Falling, a join by containment gives each row
the ancestors of its top node; inside it, a node's interval taken from its parent's leaves the
sibling's.  So ``n`` leaves need ``log2(n) / LEVELS`` rounds, each over a fraction of the rows of
the one before, and no row meets more than its own ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexidra.llm.crc import crc32_sql
from lexidra.llm.tables import stored

LEVELS = 8

_NODES = "array<struct<level: int, lo: long, hi: long, digest: string>>"
# ``digest`` is null where a node has no sibling and is hashed alone.
_PATH = "array<struct<scope: int, level: int, lo: long, hi: long, left: boolean, digest: string>>"
_ENTRY = pa.struct(
    [("scope", pa.int32()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("left", pa.bool_()), ("digest", pa.string())]
)
# Scopes of a path: among the rows of a group, among the groups.
ROWS, GROUPS = 0, 1


def field(column: Column) -> Column:
    """``-`` for null, otherwise the number of bytes, a colon, the value."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows(tree, ...)`` with ``n``, the rows of the tree, and ``idx``, the rank in it.

    Rows are dealt out by range and sorted, so a large tree is many tasks; a rank is the place in
    the task plus the counts of the tasks before.  ``rows`` is read from a table: the order of rows
    that are equal in everything else is that of their ids there.
    """
    keys = [F.col("tree").asc_nulls_first(), *order, F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = stored(dealt.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy("tree", "task").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("size"))
    tree = W.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(
        F.col("tree").alias("t"),
        F.col("task").alias("k"),
        (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"),
        F.sum("size").over(tree).alias("n"),
    )
    both = placed.join(parts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("task") == F.col("k")))
    return both.select("tree", "n", (F.col("place") + F.col("shift")).alias("idx"), *[c for c in rows.columns if c != "tree"])


def _height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def _hasher(base: int):
    """Adds the nodes of a block, the units first, and its top digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, tops = [], []
            for n, block, items in zip(batch["n"].to_pylist(), batch["block"].to_pylist(), batch["items"], strict=True):
                now, first, own = items.values.field("digest").to_pylist(), block << LEVELS, []
                for level in range(base, min(base + LEVELS, _height(n)) + 1):
                    if level > base:
                        now = [hashlib.sha256("".join(now[i : i + 2]).encode()).hexdigest() for i in range(0, len(now), 2)]
                        first >>= 1
                    for i, digest in enumerate(now, first):
                        own.append({"level": level, "lo": i << level, "hi": min(n, (i + 1) << level), "digest": digest})
                nodes.append(own)
                tops.append(now[0])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.string())]))
            columns = [*batch.columns, pa.array(nodes, kind), pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "nodes", "top"])

    return run


def _rise(units: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks ``(tree, n, block, items, nodes, top)`` of every bucket of levels, and the roots ``(tree, n, root)``."""
    buckets: list[DataFrame] = []
    roots = None
    while True:
        base = LEVELS * len(buckets)
        items = F.collect_list(F.struct("idx", "digest", *[c for c in units.columns if c not in ("tree", "n", "idx", "digest")]))
        grouped = units.groupBy("tree", "n", F.shiftright("idx", LEVELS).alias("block")).agg(
            F.array_sort(items, lambda a, b: F.signum(a["idx"] - b["idx"]).cast("int")).alias("items")
        )
        schema = f"tree {grouped.schema['tree'].dataType.simpleString()}, n long, block long, "
        schema += f"items {grouped.schema['items'].dataType.simpleString()}, nodes {_NODES}, top string"
        blocks = stored(grouped.mapInArrow(_hasher(base), schema), "merkle")
        buckets.append(blocks)
        ended = blocks.where(F.col("n") <= 1 << (base + LEVELS)).select("tree", "n", F.col("top").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        units = blocks.where(F.col("n") > 1 << (base + LEVELS)).select("tree", "n", F.col("block").alias("idx"), F.col("top").alias("digest"))
        if units.isEmpty():
            return buckets, roots


def siblings(n: int, first: int, units: int, base: int) -> list[tuple[np.ndarray, ...]]:
    """For each level of a bucket, the interval left of every unit's parent and the side it lies on.

    ``(level, lo, hi, left)``; an empty interval means that there is no sibling.
    """
    out = []
    at = np.arange(first, first + units, dtype=np.int64) << base
    for level in range(base, min(base + LEVELS, _height(n))):
        lo = at >> level << level
        hi = np.minimum(n, lo + (1 << level))
        parent = at >> (level + 1) << (level + 1)
        end = np.minimum(n, parent + (2 << level))
        left = lo > parent
        out.append((np.full(units, level), np.where(left, parent, hi), np.where(left, lo, end), left))
    return out


def _faller(base: int, scope: int):
    """One row a unit: the siblings on its way up inside the block, then those above the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, block = batch["n"][row].as_py(), batch["block"][row].as_py()
                items, nodes, above = (batch[c][row].values for c in ("items", "nodes", "path"))
                units = len(items)
                steps = siblings(n, block << LEVELS, units, base)
                level, lo, hi, left = (np.array(c).T.reshape(-1) for c in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 4
                labels = nodes.field("level").to_numpy().astype(np.int64) * (1 << 48) + nodes.field("lo").to_numpy()
                found = np.searchsorted(labels, level * (1 << 48) + lo)
                digest = nodes.field("digest").take(pa.array(found, mask=lo >= hi))
                own = [pa.array(np.full(len(level), scope), pa.int32()), pa.array(level, pa.int32()), pa.array(lo, pa.int64())]
                own += [pa.array(hi, pa.int64()), pa.array(left.astype(bool)), digest]
                inside = pa.StructArray.from_arrays(own, fields=list(_ENTRY))
                both = pa.concat_arrays([inside, above.cast(_ENTRY)])
                upper = np.broadcast_to(len(level) + np.arange(len(above)), (units, len(above)))
                order = np.concatenate([np.arange(len(level)).reshape(units, len(steps)), upper], axis=1)
                offsets = pa.array(np.arange(units + 1) * order.shape[1], pa.int32())
                path = pa.ListArray.from_arrays(offsets, both.take(pa.array(order.reshape(-1))))
                same = [pa.array([batch[c][row].as_py()] * units, batch[c].type) for c in ("tree", "subroot", "root")]
                yield pa.RecordBatch.from_arrays([items, path, *same], names=["item", "path", "tree", "subroot", "root"])

    return run


def _fall(buckets: list[DataFrame], above: DataFrame, scope: int) -> DataFrame:
    """``(tree, item, path, subroot, root)`` of every leaf; ``above(tree, n, path, subroot, root)`` is what lies over the roots."""
    upper = None
    for number in reversed(range(len(buckets))):
        base = number * LEVELS
        whole = above.where((F.col("n") <= 1 << (base + LEVELS)) & (F.col("n") > (1 << base if number else 0)))
        whole = whole.select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
        upper = whole if upper is None else whole.unionByName(upper.select("tree", "item.idx", "path", "subroot", "root"))
        upper = upper.withColumnsRenamed({"tree": "t", "idx": "i"})
        # The interval of unit i of the next bucket contains exactly the block i of this one.
        blocks = buckets[number].join(upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("i")))
        kinds = {c: blocks.schema[c].dataType.simpleString() for c in ("tree", "items")}
        element = kinds["items"].removeprefix("array<").removesuffix(">")
        schema = f"item {element}, path {_PATH}, tree {kinds['tree']}, subroot string, root string"
        upper = blocks.select("tree", "n", "block", "items", "nodes", "path", "subroot", "root").mapInArrow(_faller(base, scope), schema)
    return upper


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(*keep, leaf, lo, path, subroot, root)``: the leaf digest of every row and its way to the root.

    Trees are made per value of ``group`` (a string; null is a group) over the rows in ascending
    ``order`` (null first, then by digest), then over the groups in ascending order (null first).  Every two nodes,
    or a last single one, become the SHA-256 of their joined digests while more than one remains.
    ``lo`` is the rank of the row in its group.  ``path`` has an entry for each level:
    ``scope`` 0 inside the group, 1 among the groups; the label ``lo, hi`` of the sibling, whether
    it is ``left`` of the row's node, and its ``digest``, null where there is no sibling.

    Repeated rows are leaves of their own.  Rows equal in ``order`` and digest are interchangeable.
    A null digest counts as that of ``-``; an empty table gives an empty manifest.  Only digests and ``keep`` are shuffled.
    """
    columns = [c.alias(f"kept_{name}") for name, c in (keep or {}).items()]
    orders = [c.alias(f"order_{i}") for i, c in enumerate(order)]
    leaves = stored(rows.select(group.cast("string").alias("tree"), F.coalesce(leaf, F.sha2(F.lit("-"), 256)).alias("digest"), *orders, *columns), "leaves")
    by = [*[F.col(f"order_{i}").asc_nulls_first() for i in range(len(order))], F.col("digest")]
    buckets, roots = _rise(_ranked(leaves, by).drop(*[f"order_{i}" for i in range(len(order))]))
    # The roots of the groups are the leaves of the last tree; its units name their group.
    groups = roots.select(F.lit(0).alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("name"), F.col("n").alias("rows"))
    upper, tops = _rise(_ranked(groups, [F.col("name").asc_nulls_first()]))
    nothing = F.array().cast(_PATH).alias("path")
    last = tops.select("tree", "n", nothing, F.lit(None).cast("string").alias("subroot"), "root")
    above = _fall(upper, last, GROUPS).select(
        F.col("item.name").alias("tree"), F.col("item.rows").alias("n"), "path", F.col("item.digest").alias("subroot"), "root"
    )
    found = _fall(buckets, stored(above, "group-paths"), ROWS)
    kept = [F.col(f"item.kept_{name}").alias(name) for name in keep or {}]
    return found.select(*kept, F.col("item.digest").alias("leaf"), F.col("item.idx").alias("lo"), "path", "subroot", "root")


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""

    def up(digest: Column, step: Column) -> Column:
        pair = F.when(step["left"], F.concat(step["digest"], digest)).otherwise(F.concat(digest, step["digest"]))
        return F.sha2(F.coalesce(pair, digest), 256)

    return F.aggregate(path, leaf, up)


def report(docs: DataFrame) -> DataFrame:
    """Manifest of documents by language, with proofs checked against tampered leaves.

    Where 7 divides the CRC-32 of the id, tampering adds 1 to ``n_chars``; a null stays, and so do rows with a null id.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chars = F.when(crc % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaf = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    other = F.when(crc % 7 == 0, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), chars, F.col("text")))
    keep = {"doc_id": F.col("doc_id"), "tampered": other}
    found = manifest(docs, F.col("lang"), [F.col("doc_id")], leaf, keep)
    found = found.withColumn("folded_root", fold(F.col("path"), F.coalesce("tampered", "leaf")))
    proof = F.sha2(F.array_join("path.digest", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _leaf_sql(chars: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', chars, 'text'))})"


# All levels of a forest, one recursion a level; ``t`` is the tree, ``n`` its leaves.
_LEVELS_SQL = """SELECT t, n, 0 AS l, i, digest FROM {leaves}
        UNION ALL SELECT t, any_value(n), any_value(l) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {nodes}
        WHERE (1::BIGINT << l) < n GROUP BY t, i // 2"""
# A sibling with its side before it, or ``N`` where there is none.
_WAY_SQL = """SELECT x.t, x.i, list(CASE WHEN s.digest IS NULL THEN 'N' WHEN s.i < x.i >> u.l THEN 'L' || s.digest ELSE 'R' || s.digest END
        ORDER BY u.l) AS way FROM {leaves} AS x JOIN (SELECT unnest(range(48)) AS l) AS u ON (1::BIGINT << u.l) < x.n
        LEFT JOIN {nodes} AS s ON s.t IS NOT DISTINCT FROM x.t AND s.l = u.l AND s.i = xor(x.i >> u.l, 1) GROUP BY x.t, x.i"""
_FOLD_SQL = """list_reduce(way, lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END), {leaf})"""

SQL = f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER () AS r, {crc32_sql("doc_id")} % 7 = 0 AS hit, {_leaf_sql("n_chars")} AS leaf FROM documents),
    o AS MATERIALIZED (SELECT r, lang AS t, leaf AS digest, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
        count(*) OVER (PARTITION BY lang) AS n FROM d),
    a AS ({_LEVELS_SQL.format(leaves="o", nodes="a")}),
    g AS MATERIALIZED (SELECT 0 AS t, t AS name, digest, row_number() OVER (ORDER BY encode(t) NULLS FIRST) - 1 AS i, count(*) OVER () AS n
        FROM a WHERE (1::BIGINT << l) >= n),
    b AS ({_LEVELS_SQL.format(leaves="g", nodes="b")}),
    wa AS MATERIALIZED ({_WAY_SQL.format(leaves="o", nodes="a")}),
    wb AS MATERIALIZED ({_WAY_SQL.format(leaves="g", nodes="b")}),
    f AS (SELECT d.doc_id, d.leaf, g.digest AS subroot, (SELECT digest FROM b WHERE (1::BIGINT << l) >= n) AS root,
            coalesce(wa.way, []) || coalesce(wb.way, []) AS way,
            CASE WHEN hit THEN {_leaf_sql("(n_chars + 1)")} ELSE d.leaf END AS other
        FROM d JOIN o ON d.r = o.r JOIN g ON g.name IS NOT DISTINCT FROM o.t
        LEFT JOIN wa ON wa.t IS NOT DISTINCT FROM o.t AND wa.i = o.i LEFT JOIN wb ON wb.i = g.i),
    z AS (SELECT *, {_FOLD_SQL.format(leaf="other")} AS folded_root FROM f)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(list_filter(way, lambda s: s <> 'N'), lambda s: s[2:]), 'string_agg', ''), ''))
        AS proof_sha256, folded_root, folded_root = root AS verified FROM z"""
