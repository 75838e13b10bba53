"""Periodic run detection: seeds from k-grams of guaranteed overlap, extended along their diagonal.

A run of smallest period ``q`` is at least ``4 q`` words long, so it agrees with itself, moved by
``q``, over ``3 q`` words or more.  For the lags ``k/2 < q <= k`` every k-gram is therefore sure
to occur again ``q`` words later inside each such run (``k`` = 4 also serves the lags 1 to 4).
As ``k >= q``, no equal k-gram stands between the two, so only neighbouring occurrences are
seeds: one a position, however often a word is repeated.  The same argument leaves out multiples
of the smallest period.

The k-grams of doubled length get their numbers from pairs of numbers of the shorter ones, so
equality is exact, and only positions whose shorter grams recur are looked at again.  Seeds of a
lag are taken from left to right; one that the last stretch of its lag covers is not extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidra.functions.vectors import let
from lexidra.llm.crc import crc32_sql
from lexidra.llm.tables import by_bytes, named, utf8

WORD = r"[^\x20\x09-\x0D]+"
SHORTEST = 6
REPEATS = 4
FIRST_GRAM = 4

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and lags of neighbouring equal k-grams, for ``k`` = 4, 8, 16 and so on.

    ``words`` has a number for every word; different documents share none.
    """
    number, at, k = words.astype(np.int64), np.arange(len(words)), 1
    while len(at):
        recurs = np.zeros(len(words) + k, dtype=bool)
        recurs[at] = True
        at = at[recurs[at + k]]
        if not len(at):
            return
        pair = number[at] * (int(number.max()) + 1) + number[at + k]
        order = np.argsort(pair, kind="stable")
        at, pair, k = at[order], pair[order], 2 * k
        again = pair[1:] == pair[:-1]
        lag = at[1:] - at[:-1]
        if k >= FIRST_GRAM:
            seed = again & (lag <= k) & ((lag > k // 2) | (k == FIRST_GRAM))
            yield at[:-1][seed], lag[seed]
        number[at] = np.cumsum(np.append(0, ~again))
        at = np.sort(at[np.append(again, False) | np.append(False, again)])


def stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``lag`` apart are equal."""
    start, end, step = at, at + lag, 32
    while end < len(words):
        same = words[end : end + step] == words[end - lag : end - lag + step][: len(words) - end]
        end += len(same) if same.all() else int(np.argmin(same))
        if not same.all():
            break
        step *= 2
    step = 32
    while start > 0:
        low = max(0, start - step)
        same = (words[low:start] == words[low + lag : start + lag])[::-1]
        start -= len(same) if same.all() else int(np.argmin(same))
        if not same.all():
            break
        step *= 2
    return start, end


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    found = []
    for at, lag in seeds(words):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # A seed right behind another of its lag lies in the same stretch.
        head = np.append(True, (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]))[: len(at)]
        covered: dict[int, int] = {}
        for i, q in zip(at[head].tolist(), lag[head].tolist(), strict=True):
            if i + q < covered.get(q, 0):
                continue
            start, covered[q] = stretch(words, i, q)
            if covered[q] - start >= max(SHORTEST, REPEATS * q):
                found.append((start, covered[q] - start, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of every text, and a number for each word that no other text uses."""
    words, numbers, used = [text.split() for text in texts], [], 0
    for own in words:
        known: dict[bytes, int] = {}
        numbers += [used + known.setdefault(w, len(known)) for w in own]
        used += len(known)
    return words, np.array(numbers, dtype=np.int64)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, 1):
            words, numbers = _numbered(utf8(part.column(1)))
            bounds = np.cumsum([0, *map(len, words)])
            runs: list[list[dict[str, int]]] = [[] for _ in words]
            kept = np.ones(len(numbers), dtype=bool)
            for start, length, period in runs_of(numbers):
                doc = int(np.searchsorted(bounds, start, side="right")) - 1
                runs[doc].append({"start": start - int(bounds[doc]), "length": length, "period": period})
                kept[start + period : start + length] = False
            texts = [
                b" ".join([w for w, k in zip(own, kept[low : low + len(own)].tolist(), strict=True) if k] if has else own)
                for own, low, has in zip(words, bounds.tolist(), runs, strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(runs, _RUNS),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "text"],
            )


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, text)`` for every row of ``docs(doc_id, text)``; no shuffle.

    Words are maximal stretches without ASCII white space, numbered from 0.  ``runs`` has
    ``(start, length, period)`` of every maximal stretch of at least six words and four times its
    smallest period, by start and period; overlapping runs are all given.  ``text`` has the words
    that no run contains after its first period, with one space between them.

    A null or empty text has no words, no runs and an empty text.  Null ids and repeated rows are
    treated like others; other columns are ignored; an empty table gives an empty one.  A text
    is handled whole in the task that reads it, in memory in proportion to its words.
    """
    rows = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_find, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``, a tenth of the texts with a periodic tail that the ids determine.

    With ``h = crc32(decimal id)``, ``g = h // 10``, ``n`` words, ``a = g % n`` and ``p = 1 +
    (n - a) // (3 + g % 8)``, where ``h % 10 = 0``, each word from ``a`` on is the original word
    ``a + (i - a) % p``.  Rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        repeated = let(
            F.struct(words.alias("w"), a.alias("a"), p.alias("p")),
            lambda v: F.transform(v["w"], lambda w, i: F.when(i < v["a"], w).otherwise(v["w"][(v["a"] + (i - v["a"]) % v["p"]).cast("int")])),
        )
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return named(docs, "doc_id", "text").select("doc_id", F.when(h % 10 == 0, let(words, tail)).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """One digest row per document of ``collapse_runs``."""
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
        "n_words",
    )


# Pairs of equal 5-grams of a document, joined to stretches lag by lag; every run of six words or
# more agrees with itself over at least five.
SQL = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {crc32_sql("doc_id")} AS h,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    a AS (SELECT *, len(w)::BIGINT AS n, (h // 10) % greatest(len(w), 1) AS a FROM d),
    o AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
    w AS MATERIALIZED (SELECT r, doc_id, n, unnest(range(n)) AS i,
        unnest(CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda j: w[1 + CASE WHEN j < a THEN j ELSE a + (j - a) % p END]) ELSE w END) AS word
        FROM o),
    g AS MATERIALIZED (SELECT r, i, hash(word, lead(word, 1) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s) AS gram,
        lead(i, 4) OVER s AS last FROM w WINDOW s AS (PARTITION BY r ORDER BY i)),
    b AS (SELECT x.r, x.i, y.i - x.i AS q FROM g AS x JOIN g AS y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
        WHERE x.last IS NOT NULL AND y.last IS NOT NULL),
    c AS (SELECT r, q, min(i) AS start, max(i) + 5 + q - min(i) AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM b) GROUP BY r, q, island),
    l AS MATERIALIZED (SELECT * FROM c WHERE length >= greatest(6, 4 * q)),
    u AS MATERIALIZED (SELECT * FROM l WHERE NOT EXISTS (FROM l AS s WHERE s.r = l.r AND s.q < l.q
        AND s.start <= l.start AND s.start + s.length >= l.start + l.length)),
    m AS (SELECT r, count(*) AS n_runs, first(struct_pack(start := start, length := length, q := q) ORDER BY length DESC, start, q) AS best,
        string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM u GROUP BY r),
    k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w
        WHERE NOT EXISTS (FROM u WHERE u.r = w.r AND w.i >= u.start + u.q AND w.i < u.start + u.length) GROUP BY r)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period,
        CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
        sha256(coalesce(k.text, '')) AS collapsed_sha256, len(d.w)::BIGINT AS n_words
    FROM d LEFT JOIN m ON d.r = m.r LEFT JOIN k ON d.r = k.r"""
