"""Values of words that are computed once a worker, however often a word comes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from aislewatch.llm.words import Words


class Memo:
    """``compute`` maps words (bytes) to rows of ``width`` floats. The first ``limit`` words are kept; others are computed again."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], width: int, limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.at: dict[int, int] = {}
        self.kept = np.zeros((1024, width), np.float32)

    def __call__(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a row for each distinct word, the row's number for each word)."""
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.fromiter((self.at.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        out = np.empty((len(keys), self.kept.shape[1]), np.float32)
        out[at >= 0] = self.kept[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = self.compute([w.word(i) for i in first[new]])
            room = new[: max(0, self.limit - len(self.at))]
            n = len(self.at)
            if n + len(room) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.zeros((len(self.kept) + len(room), self.kept.shape[1]), np.float32)])
            self.kept[n : n + len(room)] = out[room]
            self.at.update(zip(keys[room].tolist(), range(n, n + len(room)), strict=True))
        return out, which


_WORKER: dict[str, Memo] = {}


def worker_memo(key: str, make: Callable[[], Memo]) -> Memo:
    """This worker's memo of the model ``key``; workers are used for many tasks. One model is kept at a time."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def forget() -> None:
    """Frees what this worker keeps, for tasks that value no words: workers are handed on from stage to stage."""
    _WORKER.clear()
