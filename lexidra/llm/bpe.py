"""Token ids of a ``tokenizers`` JSON file, and where a text may be cut without changing them.

A byte-level BPE splits a text with a pattern whose matches are either white space only or an
optional single space followed by non-space characters.  No match therefore contains a
non-space character followed by white space: such a place is always a border between matches,
and the ids left and right of it do not depend on each other.  Special strings hold no white
space, so none of them spans such a place either.

Byte-level BPE files whose ids follow their merge order are encoded from the same vocabulary by
``tiktoken``, which gives the same ids about four times as fast (the tests compare every code
point and long runs); all other files, and texts that it refuses, are encoded by ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np

# A white-space character behind a character that is none.
STABLE = re.compile(r"(?<=\S)[ \t\r\n]")
STEP = 1 << 16

#: The pattern of byte-level BPE files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the ``tokenizers`` library gives them for a file, without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as file:
            self.fast = self._ranked(json.load(file))
        self.sizes = None
        if self.fast is not None:
            self.sizes = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)])

    @staticmethod
    def _ranked(spec: dict):
        """The same vocabulary as ranks, or None where ranks would not say the same."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
        )
        if not (
            plain
            and not model.get("ignore_merges")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and spec.get("normalizer") is None
        ):
            return None
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in added):
            return None
        symbols, special = _byte_symbols(), {t["content"]: t["id"] for t in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"][a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            return None
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        if sorted([*ranks.values(), *special.values()]) != list(range(len(ranks) + len(special))):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """All ids of ``text``."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except (ValueError, BaseExceptionGroup):
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def id_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the byte offset behind each of them."""
        if self.fast is not None:
            found = self.ids(text)
            return found, np.cumsum(self.sizes[found])
        encoded = self.slow.encode(text, add_special_tokens=False)
        places = np.cumsum([0] + [len(c.encode()) for c in text])
        return np.array(encoded.ids, dtype=np.uint32), places[np.array([e for _, e in encoded.offsets], dtype=np.int64)]

    def parts(self, text: str, step: int = STEP) -> Iterator[np.ndarray]:
        """The ids of ``text`` in parts, cut where they do not depend on each other."""
        for part in stable_parts(text, step):
            yield self.ids(part)


def stable_parts(text: str, step: int = STEP) -> Iterator[str]:
    """``text`` in parts of about ``step`` characters, cut at stable places only."""
    start = 0
    while len(text) - start > 2 * step:
        found = STABLE.search(text, start + step)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file.

    Functions travel to the workers by value, so a global of this module would last for one task.
    """
    kept = sys.modules.setdefault("lexidra_kept", ModuleType("lexidra_kept")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
