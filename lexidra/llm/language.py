"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs.  A trigram is bound from its letters' vectors:
the first moved round by two places, the second by one, all multiplied place by place.  A text
is the bundle, the sum, of its trigrams' vectors, and a language the bundle of its texts.  The
profile that all languages have in common, their mean direction, is taken off before a text is
given to the prototype with the greatest cosine.

Letters are those of Unicode, lower-cased; whatever stands between them counts as one space, so
words have a beginning and an end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidra.llm.tables import by_bytes, named, stored, strings

DIM = 1024
SEED = 11
GRAM = 3
UNKNOWN = "und"
# Letters of a text that are bundled at once, and trigrams whose vectors are held at once.
PIECE = 1 << 16
HELD_GRAMS = 4096
# Languages whose prototypes are shipped to the tasks in one pass over the documents.
SHIPPED = 1024
# Steps of one in the mean direction.
FINE = 1 << 40
# Languages whose sums a task holds before it hands them on.
OPEN_SUMS = 256


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=1 << 15)
def letter_vector(code: int) -> np.ndarray:
    """The signs of a code point, the same in every process."""
    bits = np.random.Philox(key=np.array([SEED, code], dtype=np.uint64)).random_raw(DIM // 64)
    return np.unpackbits(bits.astype("<u8").view(np.uint8)).astype(np.int8) * 2 - 1


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, a zero for every gap, at the beginning and at the end; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_is_letter()[codes], codes, 0)
    if not codes.any():
        return codes[:0]
    codes = np.concatenate([[0], codes, [0]])
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]


def bundles(pieces: list[np.ndarray]) -> np.ndarray:
    """The sum of the trigram vectors of each piece, one row a piece."""
    out = np.zeros((len(pieces), DIM))
    codes = np.concatenate(pieces)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    if len(codes) < GRAM:
        return out
    inside = owner[GRAM - 1 :] == owner[: 1 - GRAM]
    alphabet = np.flatnonzero(np.bincount(codes))
    place = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    own = place[codes]
    keys = ((own[:-2] * len(alphabet) + own[1:-1]) * len(alphabet) + own[2:])[inside]
    owner = owner[GRAM - 1 :][inside]
    grams, column = np.unique(keys, return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in alphabet])
    moved = [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]
    order = np.argsort(column // HELD_GRAMS, kind="stable") if len(grams) > HELD_GRAMS else np.arange(len(column))
    column, owner = column[order], owner[order]
    for low in range(0, len(grams), HELD_GRAMS):
        some = grams[low : low + HELD_GRAMS]
        first, rest = np.divmod(some, len(alphabet) ** 2)
        second, third = np.divmod(rest, len(alphabet))
        vectors = moved[0][first] * moved[1][second] * moved[2][third]
        begin, end = np.searchsorted(column // HELD_GRAMS, [low // HELD_GRAMS, low // HELD_GRAMS + 1])
        cells = owner[begin:end] * len(some) + (column[begin:end] - low)
        counts = np.bincount(cells, minlength=len(pieces) * len(some)).reshape(len(pieces), len(some))
        # Sums stay below 2^24 in a piece, so single precision is exact.
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out


def profiles(texts: list[str]) -> np.ndarray:
    """The bundle of every text, one row a text; a row of zeros without letters."""
    out = np.zeros((len(texts), DIM))
    pieces: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            np.add.at(out, owners, bundles(pieces))
        pieces.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        letters = letters_of(text)
        for start in range(0, max(0, len(letters) - GRAM + 1), PIECE):
            pieces.append(letters[start : start + PIECE + GRAM - 1])
            owners.append(i)
            held += len(pieces[-1])
            if held >= PIECE:
                flush()
    flush()
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used].astype(np.int64))],
                names=["lang", "place", "x"],
            )
        sums.clear()

    for batch in batches:
        for part in by_bytes(batch, 1):
            found = profiles(strings(part.column(1)))
            langs = part.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = found[[i for i, name in enumerate(langs) if name == lang]].sum(axis=0)
                sums[lang] = sums.get(lang, 0) + own
            if len(sums) > OPEN_SUMS:
                yield from flush()
    yield from flush()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Prototypes ``(lang, place, x)``: the bundle of all texts of each language, places with zero left out.

    Rows whose language is null are not learned from.  Tasks add up what they read, so the
    shuffle has ``DIM`` rows for a task and language at most, and these are added before it.
    """
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL")
    return known.mapInArrow(_sums, "lang string, place int, x long").groupBy("lang", "place").agg(F.sum("x").alias("x"))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _scorer(names: list[str], prototypes: np.ndarray, common: np.ndarray):
    """A pass that keeps the better of what a row has and these languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: i for i, name in enumerate(("text", "lang_pred", "score"))}
        for batch in batches:
            for part in by_bytes(batch, at["text"]):
                found = unit(profiles(strings(part.column(at["text"]))))
                lettered = found.any(axis=1)
                near = unit(found - common * lettered[:, None]) @ prototypes.T
                best = np.argmax(near, axis=1)
                score = np.clip(near[np.arange(len(best)), best], 0.0, 1.0)
                before = part.column(at["score"]).to_numpy(zero_copy_only=False)
                old = part.column(at["lang_pred"]).to_pylist()
                better = [s > b or (s == b and (o == UNKNOWN or names[k] < o)) for s, b, o, k in zip(score, before, old, best, strict=True)]
                better = np.array(better, dtype=bool) & lettered
                names_now = [names[k] if b else o for k, b, o in zip(best, better, old, strict=True)]
                columns = [pa.array(names_now, pa.string()), pa.array(np.where(better, score, before))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *part.columns[3:]], names=part.schema.names)

    return run


def identify(docs: DataFrame, training: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(*keep, lang_pred, score)`` for every row of ``docs(text, lang)``; learned where ``training`` holds and ``lang`` is not null.

    ``lang_pred`` is the learned language with the greatest cosine, of equal ones the smallest
    name, and ``score`` that cosine, at least 0.  A null text, a text without letters, and every
    text if nothing was learned, get ``und`` and 0.  The prediction uses the text alone.  Repeated
    rows are treated like others; ``keep`` names the columns that are handed through; an empty
    table gives an empty one.  Documents are not shuffled.  Prototypes are shipped to the tasks
    in slices of ``SHIPPED`` languages, each slice one more pass; one slice is usual.
    """
    rows = docs.select(F.col("text"), F.col("lang"), training.alias("fit"))
    sums = stored(learn(rows.where("fit")), "prototypes")
    langs = sums.select("lang").distinct().count()
    whole = sums.groupBy("lang").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("square"))
    scaled = sums.join(whole, "lang").select("lang", "place", (F.col("x") / F.sqrt("square")).alias("x"))
    mean = np.zeros(DIM)
    # Sums of integers do not depend on the order of the rows.
    steps = F.sum(F.round(F.col("x") * FINE).cast("long"))
    for r in scaled.groupBy("place").agg(steps.alias("x")).collect():
        mean[r["place"]] = r["x"] / FINE / max(1, langs)
    # With one language there is nothing to tell apart, and its profile is not taken off itself.
    common = mean if langs > 1 else np.zeros(DIM)
    found = docs.select(
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.lit(UNKNOWN).alias("lang_pred"),
        F.lit(0.0).alias("score"),
        *[c.alias(f"kept_{name}") for name, c in (keep or {}).items()],
    )
    slices = -(-langs // SHIPPED)
    for part in range(slices):
        own = scaled.where(F.pmod(F.xxhash64("lang"), F.lit(slices)) == part).toArrow()
        names = sorted(set(own.column("lang").to_pylist()))
        number = {name: i for i, name in enumerate(names)}
        prototypes = np.zeros((len(names), DIM))
        prototypes[[number[x] for x in own.column("lang").to_pylist()], own.column("place").to_numpy()] = own.column("x").to_numpy()
        if names:
            found = found.mapInArrow(_scorer(names, unit(prototypes - common), common), found.schema)
    return found.select(*[F.col(f"kept_{name}").alias(name) for name in keep or {}], "lang_pred", "score")
