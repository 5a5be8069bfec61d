"""Cutting texts into chunks that a byte-level BPE tokenizer handles independently, and caches over them.

The split pattern of such tokenizers attaches one space to what follows it and keeps white space apart otherwise, so
a text can be cut before every space whose two neighbours are not both white space (or the end), and before every line
feed without white space around it. The few texts with another space are handed on whole, as are texts that hold a
special token.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space that may be one of those: quick to look for, as it starts with a plain character.
MAYBE = re.compile(f" (?![^{SPACES}\x1c-\x1f])")
#: A space before which no cut may be made (the C0 separators are included to be safe).
NO_CUT = re.compile(f"[{SPACES}\x1c-\x1f] (?:[{SPACES}\x1c-\x1f]|\\Z)")


#: What an entry of a cache takes besides its key and value: two objects and their places in a dictionary.
ENTRY = 200


#: A line feed before which no cut may be made.
NO_LINE = re.compile(f"\n(?:(?<=[{SPACES}\x1c-\x1f]\n)|[{SPACES}\x1c-\x1f]|\\Z)")


def cuttable(text: str, special: tuple[str, ...]) -> str | None:
    """The text with a space before every line feed where it may be cut, so that it may be cut at every space; None if it
    must stay whole."""
    if (MAYBE.search(text) and NO_CUT.search(text)) or any(s in text for s in special):
        return None
    if "\n" not in text:
        return text
    if text[0] == "\n" or NO_LINE.search(text):
        return None if " \n" in text else text
    return text.replace("\n", " \n")


@dataclass
class Pieces:
    """Texts cut at spaces. `firsts` are their first pieces, `values` the different others: each follows a space, unless
    it starts with a line feed. `which` has, for all pieces in order, a number of `values`, or len(values) + k for the
    first piece of text k; `heads` has the place in it of each text's first piece.
    """

    firsts: list[str]
    values: pa.Array
    which: np.ndarray
    heads: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Pieces:
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        heads = cut.offsets.to_numpy()[:-1]
        flat = cut.flatten()
        firsts = flat.take(pa.array(heads)).to_pylist()
        coded = flat.dictionary_encode()
        del cut, flat
        which = coded.indices.to_numpy(zero_copy_only=False).copy()
        values = coded.dictionary
        del coded
        which[heads] = len(values)
        used = np.zeros(len(values) + 1, bool)
        used[which] = True
        used[-1] = False
        which = (np.cumsum(used, dtype=np.int32) - 1)[which]
        values = values.filter(pa.array(used[:-1]))
        which[heads] = np.arange(len(values), len(values) + len(heads))
        return Pieces(firsts, values, which, heads)

    def all(self) -> list[str]:
        """`values` as they stand in the texts, then `firsts`."""
        return spaced(self.values) + self.firsts


def spaced(values: pa.Array) -> list[str]:
    return [w if w[:1] == "\n" else " " + w for w in values.to_pylist()]


class TwoGenerations(dict):
    """A cache with a bound in bytes: at half of it the entries become the old generation, from which hits come back.

    Keys of more than `longest` characters (texts without spaces, base64) are not kept.
    """

    def __init__(self, room: int, longest: int = 64):
        super().__init__()
        self.old: dict = {}
        self.half, self.held, self.longest = room // 2, 0, longest

    def values_of(self, keys: list, make) -> list:
        """The values of `keys`, which differ; `make` gets a list of those that aren't kept and returns their values."""
        if self.held > self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        out = list(map(self.get, keys))
        new = []
        for i, v in enumerate(out):
            if v is None and (v := self.old.get(keys[i])) is None:
                new.append(i)
            elif out[i] is None:
                out[i] = self[keys[i]] = v
                self.held += ENTRY + len(keys[i])
        for i, v in zip(new, make([keys[i] for i in new]) if new else ()):
            out[i] = v
            if len(keys[i]) <= self.longest:
                self[keys[i]] = v
                self.held += ENTRY + len(keys[i])
        return out


def release() -> None:
    """Hands freed memory back to the system: Python workers live on for other stages, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def releasing(task):
    """A function for mapInArrow that calls release() at its end."""

    @functools.wraps(task)
    def run(rows):
        try:
            yield from task(rows)
        finally:
            release()

    return run
