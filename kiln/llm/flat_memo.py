"""The ids of remembered chunks in one flat array, so that a text is a gather."""

from __future__ import annotations

import itertools
from array import array

import numpy as np

#: What a chunk costs besides its characters and ids (string, dictionary entry, number).
CHUNK_COST = 200


class FlatMemo:
    """Chunks to numbers, and all their ids one after another; ``held`` estimates its bytes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.values, self.ends, self.held = np.empty(1 << 16, np.int32), array("q", [0]), 0

    def put(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember chunks whose ids stand one after another."""
        used, n = self.ends[-1], len(ids)
        if used + n > len(self.values):
            self.values = np.concatenate([self.values, np.empty(max(n, len(self.values)), np.int32)])
        self.values[used : used + n] = ids
        first = len(self.ends) - 1
        self.ends.extend((used + np.cumsum(lengths, dtype=np.int64)).tolist())
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        self.held += CHUNK_COST * len(chunks) + sum(map(len, chunks)) + 4 * n

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts (every chunk is known), and where each text's begin and the last ends."""
        at = np.cumsum([0, *map(len, texts)])
        return np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, at[-1]), at

    def gather(self, numbers: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, but for the first ``skip`` of each, and the ends of the chunks' ids."""
        ends = np.array(self.ends, np.int64)
        begin, size = ends[numbers] + skip, ends[numbers + 1] - ends[numbers] - skip
        after = np.cumsum(size)
        return self.values[np.repeat(begin - after + size, size) + np.arange(after[-1] if len(after) else 0)], after
