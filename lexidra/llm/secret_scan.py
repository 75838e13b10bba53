"""Secret scan with multipart credential linking.

Base findings (assignments, access identifiers, long hexadecimal strings) stand on their own.
Weak candidates (account names, mixed-case random strings, endpoints) are reported only where
a complementary part lies in the same scope: an interval join of the parts of a document,
dealt by slices of its characters, so that a long document is many join keys.
Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexidra.llm.tables import named, stored

# Characters between the ends of two parts of one scope at most, and the slices parts are dealt by.
SCOPE = 256
SLICE = 1024

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "(" + "|".join(_any_case(w) for w in words) + ")"


#: Kinds in the order in which they are listed, with their patterns (fixed values: the first three).
PATTERNS = {
    "assign": _names("password", "passwd", "secret", "token", "api_?key") + _VALUE + r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "account": _names("user_?name", "user", "login", "client_?id", "account") + _VALUE + r"([A-Za-z0-9@+_.-]+)",
    "random": r"[A-Za-z0-9+/_-]{20,}",
    # A scheme has at most 20 characters, so that a long run of letters is not read again from each of them.
    "endpoint": r"[a-z][a-z0-9+.-]{0,19}://[A-Za-z0-9_.:@/?&=%~-]+",
}
KINDS = tuple(PATTERNS)
BASE = ("assign", "access", "hex")
LEAST = {"access": 16, "hex": 32}
# A weak kind is reported when one of these lies in its scope.
COMPLEMENTS = {
    "account": ("assign", "hex", "random", "endpoint"),
    "random": ("access", "account", "endpoint"),
    "endpoint": ("assign", "access", "hex", "random", "account"),
}
#: Every reported span lies in a text with a match of one of these, or of both of ``BOTH``.
ANY = "|".join(
    [PATTERNS["assign"].split(_VALUE)[0] + _VALUE, r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}", PATTERNS["account"].split(_VALUE)[0] + _VALUE]
)

BOTH = (r"[a-z0-9+.-]://", r"[A-Za-z0-9+/_-]{20}")


def _passes(kind: str) -> Callable[[Column], Column]:
    if kind == "assign":
        return lambda hit: F.length(F.regexp_extract(hit, PATTERNS["assign"], 2)) >= 8
    if kind == "random":
        return lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    return lambda hit: F.length(hit) >= LEAST.get(kind, 1)


def _matches(kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind: lengths of the gaps before them and of the hits."""
    pattern, passes = PATTERNS[kind], _passes(kind)
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.length(g))
    hits = F.transform(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
        lambda h: F.struct(F.length(h).alias("size"), passes(h).alias("ok")),
    )
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), gaps.alias("gaps"), hits.alias("hits"))


def _spans(docs: DataFrame) -> DataFrame:
    """``(r1, r2, kind, start, end)`` of all base findings and of the weak candidates beside them."""
    text = F.col("text")
    texts = docs.where(text.rlike(ANY) | (text.rlike(BOTH[0]) & text.rlike(BOTH[1]))).select("r1", "r2", "text")
    found = texts.select("r1", "r2", F.explode(F.array(*[_matches(k) for k in KINDS])).alias("m"))
    each = found.select("r1", "r2", "m.kind", "m.gaps", F.posexplode("m.hits").alias("no", "hit"))
    placed = each.select("r1", "r2", "kind", "no", F.get("gaps", F.col("no")).alias("gap"), "hit.size", "hit.ok")
    # Rows repeated whole have the same findings.
    placed = placed.dropDuplicates(["r1", "r2", "kind", "no"])
    so_far = W.partitionBy("r1", "r2", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return placed.select("r1", "r2", "kind", "ok", (end - F.col("size")).alias("start"), end.alias("end")).where("ok").drop("ok")


def _sliced(spans: DataFrame, margin: int) -> DataFrame:
    """A row for each slice of ``SLICE`` characters that the interval with its margin touches."""
    first, last = F.floor((F.col("start") - margin) / SLICE), F.floor((F.col("end") + margin) / SLICE)
    return spans.withColumn("slice", F.explode(F.sequence(first, last)))


def _kind(*names: str) -> Column:
    return F.col("kind").isin([KINDS.index(n) for n in names])


def _near(weak: DataFrame, others: DataFrame, margin: int) -> DataFrame:
    """``weak`` spans within ``margin`` characters of one of ``others`` (0: overlapping it)."""
    other = _sliced(others, margin).select(
        F.col("r1").alias("o1"), F.col("r2").alias("o2"), F.col("slice").alias("o_slice"), F.col("start").alias("low"), F.col("end").alias("high")
    )
    touching = (
        (F.col("r1") == F.col("o1"))
        & (F.col("r2") == F.col("o2"))
        & (F.col("slice") == F.col("o_slice"))
        & (F.col("start") < F.col("high") + margin)
        & (F.col("low") < F.col("end") + margin)
    )
    return _sliced(weak, 0).join(other, touching, "left_semi").drop("slice").distinct()


def linked_spans(docs: DataFrame) -> DataFrame:
    """Base spans and the weak ones that complementary parts support."""
    spans = stored(_spans(docs), "spans")
    base = spans.where(_kind(*BASE))
    weak = spans.where(~_kind(*BASE))
    key = ["r1", "r2", "kind", "start", "end"]
    free = stored(weak.join(_near(weak, base, 0), key, "left_anti"), "weak-spans")
    parts = base.unionByName(free)
    out = base
    for kind, complements in COMPLEMENTS.items():
        out = out.unionByName(_near(free.where(_kind(kind)), parts.where(_kind(*complements)), SCOPE))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs(doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then kind, and
    joined by commas; ``base_sha256`` is of the base spans only.  A null or empty text has no
    spans; rows that repeat and rows with a null id are scanned each; other columns are ignored;
    an empty table gives an empty one.
    """
    rows = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2"))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    by_row = linked_spans(rows).groupBy("r1", "r2").agg(listed.alias("found"))
    both = rows.select("doc_id", "r1", "r2").join(by_row, ["r1", "r2"], "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    both = both.select("doc_id", found.alias("found"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        number = KINDS.index(kind)
        return F.size(F.filter("found", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return both.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def _sql_kind(number: int, kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    passes = {
        "assign": f"length(regexp_extract(hit, '{pattern}', 2)) >= 8",
        "random": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')",
    }.get(kind, f"length(hit) >= {LEAST.get(kind, 1)}")
    return f"""SELECT doc_id, {number} AS kind, final - length(hit) AS start, final FROM (
        SELECT doc_id, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS final FROM (
            SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS no FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits, string_split_regex(text, '{pattern}') AS gaps
                FROM d WHERE regexp_matches(text, '{pattern}')))) WHERE {passes}"""


def sql() -> str:
    """The same over ``documents`` with unique ids."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    numbers = {k: ", ".join(str(KINDS.index(c)) for c in v) for k, v in COMPLEMENTS.items()}
    linked = " OR ".join(f"(w.kind = {KINDS.index(k)} AND p.kind IN ({v}))" for k, v in numbers.items())
    quoted = ANY.replace("'", "''")
    any_match = f"regexp_matches(text, '{quoted}') OR (regexp_matches(text, '{BOTH[0]}') AND regexp_matches(text, '{BOTH[1]}'))"
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE {any_match}),
        s AS MATERIALIZED ({" UNION ALL ".join(_sql_kind(i, k) for i, k in enumerate(KINDS))}),
        p AS MATERIALIZED (SELECT * FROM s WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM s AS b
            WHERE b.doc_id = s.doc_id AND b.kind < 3 AND b.start < s.final AND s.start < b.final)),
        r AS (SELECT * FROM p WHERE kind < 3 UNION SELECT w.* FROM p AS w JOIN p ON w.doc_id = p.doc_id
            WHERE ({linked}) AND w.start < p.final + {SCOPE} AND p.start < w.final + {SCOPE}),
        t AS (SELECT *, [{names}][kind + 1] || ':' || start || ':' || final AS span FROM r),
        g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
                count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
                string_agg(span, ',' ORDER BY start, kind) AS spans FROM t GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
            coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN g USING (doc_id)"""
