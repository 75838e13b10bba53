"""Dense blocks inside a task: Arrow columns as matrices, and the k best of a block product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexidra.functions.numeric import SCORE_SCALE

QUERY_STEP = 256
ITEM_STEP = 4096
# Candidates within this margin of the bound are kept until their rounded scores are compared.
MARGIN = 4.0 / SCORE_SCALE


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Matrix of a list column whose lists all have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(len(column), -1)


def list_column(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Cut ``values`` into consecutive lists of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError("too many values for one list column")
    offsets = offsets.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def vector_column(rows: np.ndarray) -> pa.ListArray:
    """Matrix rows as a list column."""
    values = np.ascontiguousarray(rows, dtype=np.float64)
    return list_column(pa.array(values.ravel()), np.full(len(values), values.shape[1]))


def snap(values: np.ndarray, scale: float = SCORE_SCALE) -> np.ndarray:
    return np.floor(values * scale + 0.5) / scale


def _true_places(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true entries; eight entries at a time are tested for being all false."""
    flat = mask.ravel()
    whole = len(flat) - len(flat) % 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    group, place = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[group] * 8 + place, whole + np.flatnonzero(flat[whole:])])


class ItemBlock:
    """Items prepared for a metric: the exact operand of the product and a single-precision copy."""

    def __init__(self, x: np.ndarray, metric: str) -> None:
        if metric not in ("l2", "dot"):
            raise ValueError(f"unknown metric {metric!r}")
        self.metric = metric
        self.exact = np.hstack([x, (x * x).sum(axis=1, keepdims=True)]) if metric == "l2" else x
        self.coarse = np.ascontiguousarray(self.exact.T, dtype=np.float32)
        self.reach = float(np.sqrt((self.exact * self.exact).sum(axis=1)).max(initial=0.0))

    def __len__(self) -> int:
        return len(self.exact)

    def left(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query operand and the part of the cost that depends on the query only."""
        if self.metric == "l2":
            return np.hstack([-2.0 * q, np.ones((len(q), 1))]), (q * q).sum(axis=1)
        return -q, np.zeros(len(q))


def block_topk(
    q: np.ndarray, items: ItemBlock, k: int, ceiling: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` cheapest items of every query: ``(query row, item row, cost, place from 0)``.

    Cost is the squared distance (``l2``) or the negated dot product (``dot``), rounded to
    the score grid; ties go to the lower item row.  ``ceiling`` drops costs above a bound
    already known per query.

    Products are taken in single precision and compared with the running k-th cost plus the
    largest error such a product can have; what passes is computed again in double
    precision, so the result is that of the double-precision search.
    """
    n, metric = len(q), items.metric
    left, base = items.left(q)
    coarse = left.astype(np.float32)
    unit = (left.shape[1] + 4) * 2.0**-24
    error = unit * np.sqrt((left * left).sum(axis=1)) * items.reach + MARGIN
    bound = np.full(n, np.inf) if ceiling is None else ceiling - base
    rows = np.empty(0, dtype=np.int64)
    cols = np.empty(0, dtype=np.int64)
    costs = np.empty(0)
    place = np.empty(0, dtype=np.int64)
    products = below = None
    for start in range(0, len(items), ITEM_STEP):
        width = min(ITEM_STEP, len(items) - start)
        if products is None or width < products.shape[1]:
            products, below = np.empty((n, width), dtype=np.float32), np.empty((n, width), dtype=bool)
        raw = np.matmul(coarse, items.coarse[:, start : start + width], out=products)
        if width > k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(raw, k - 1, axis=1)[:, k - 1].astype(np.float64) + error)
        limit = np.nextafter((bound + error).astype(np.float32), np.float32(np.inf))
        hit = _true_places(np.less_equal(raw, limit[:, None], out=below))
        if not len(hit):
            continue
        r, c = hit // width, hit % width + start
        value = np.einsum("ij,ij->i", left[r], items.exact[c]) + base[r]
        value = snap(value) if metric == "l2" else -snap(-value)
        rows, cols, costs = np.concatenate([rows, r]), np.concatenate([cols, c]), np.concatenate([costs, value])
        order = np.lexsort((cols, costs, rows))
        rows, cols, costs = rows[order], cols[order], costs[order]
        first = np.searchsorted(rows, np.arange(n))
        place = np.arange(len(rows)) - first[rows]
        kept = place < k
        rows, cols, costs, place = rows[kept], cols[kept], costs[kept], place[kept]
        last = place == k - 1
        bound[rows[last]] = np.minimum(bound[rows[last]], costs[last] - base[rows[last]])
    if ceiling is not None and len(rows):
        kept = costs <= ceiling[rows]
        rows, cols, costs, place = rows[kept], cols[kept], costs[kept], place[kept]
    return rows, cols, costs, place
