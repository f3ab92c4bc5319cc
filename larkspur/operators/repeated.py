"""The analysis of files, of which many hold one text: a text is analysed once, as long as it is remembered."""

from __future__ import annotations

import pickle
import sys
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa

from larkspur.operators.analysis import is_setup_name
from larkspur.operators.dealing import slices
from larkspur.operators.limits import Limited

#: Bytes of texts and answers that a task remembers, of one of them, of texts that the child is sent at once, and of answers in a batch of rows.
REMEMBERED, LARGEST, SENT, BATCH = 32 << 20, 1 << 20, 1 << 20, 32 << 20


class Repeated:
    """Answers of ``limited`` to (text, path), as columns of Arrow.

    An answer depends on the text and on whether the path is a setup file's,
    so files that share both share it.  ``made`` gives the columns of a list
    of answers, in which an exception stands for one that failed; a null text
    has the answer ``none``.  What failed is not remembered: another try may
    end in time.
    """

    def __init__(self, limited: Limited, made: Callable[[list], tuple[pa.Array, ...]], none: object):
        self.limited, self.made, self.none = limited, made, none
        self.known: OrderedDict[tuple[str, bool], bytes] = OrderedDict()
        self.bytes = 0

    def _remember(self, key: tuple[str, bool], held: bytes) -> None:
        size = sys.getsizeof(key[0]) + len(held)
        if size > LARGEST:
            return
        self.known[key] = held
        self.bytes += size
        while self.bytes > REMEMBERED:  # the one asked for longest ago goes first
            (text, _), old = self.known.popitem(last=False)
            self.bytes -= sys.getsizeof(text) + len(old)

    def answers(self, keys: list[tuple[str, bool] | None]) -> dict[tuple[str, bool] | None, tuple[object, int]]:
        """The answer to each of ``keys``, a text and whether it is a setup file's, and its bytes."""
        out, new = {None: (self.none, 0)}, {}
        for key in keys:
            if key in self.known:
                self.known.move_to_end(key)
                if key not in out:
                    out[key] = pickle.loads(self.known[key]), len(self.known[key])
            elif key not in out:
                new[key] = None
        for group in _groups(list(new)):
            asked = [(text, "setup.py" if is_setup else "a.py") for text, is_setup in group]
            for key, answer in zip(group, self.limited.run_each(asked)):
                if isinstance(answer, Exception):
                    out[key] = answer, 0
                else:
                    held = pickle.dumps(answer)
                    out[key] = answer, len(held)
                    self._remember(key, held)
        return out

    def batches(self, batches: Iterator[pa.RecordBatch], text_at: int, path_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """``batches`` with the answers as columns ``names``."""
        for batch in slices(batches):
            keys = [None if t is None else (t, is_setup_name(p)) for t, p in zip(batch.column(text_at).to_pylist(), batch.column(path_at).to_pylist())]
            answers = self.answers(keys)
            for start, end in _runs([answers[key][1] for key in keys]):
                place: dict[tuple[str, bool] | None, int] = {}
                at = pa.array([place.setdefault(key, len(place)) for key in keys[start:end]], pa.int32())
                made = [column.take(at) for column in self.made([answers[key][0] for key in place])]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, *made], names=[*batch.schema.names, *names])


def _groups(keys: list[tuple[str, bool]]) -> Iterator[list[tuple[str, bool]]]:
    """``keys`` in groups of about ``SENT`` bytes of text."""
    for start, end in _runs([sys.getsizeof(text) for text, _ in keys], SENT):
        yield keys[start:end]


def _runs(sizes: list[int], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of runs of at most ``most`` bytes (``BATCH``), or of one element."""
    most = BATCH if most is None else most
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
