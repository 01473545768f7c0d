"""Arrays that are exchanged as bytes: a row for each part of a shuffle, not for each number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

def emit(kind: int, part: np.ndarray, p: int, columns: list[np.ndarray], owner: tuple[np.ndarray, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each part that occurs: its number, the kind, and the bytes of four columns. With an owner (index of each
    entry, ids, needs), the index is made local to the part, and the ids and needs of those that occur are sent once."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if p < 1 << 16 else part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(p + 1))
    sent = [np.ascontiguousarray(c[order]) for c in columns]
    at = owner[0][order] if owner else None
    rows: list[tuple] = []
    for k in np.flatnonzero(np.diff(edges)):
        a, b = edges[k], edges[k + 1]
        row = [c[a:b].tobytes() for c in sent]
        if owner:
            seen = np.zeros(len(owner[1]), bool)
            seen[at[a:b]] = True
            row += [(np.cumsum(seen) - 1)[at[a:b]].astype(np.uint16).tobytes(), owner[1][seen].tobytes(), owner[2][seen].tobytes()]
        rows.append((int(k), kind, *row, *[None] * (4 - len(row))))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "kind", "c0", "c1", "c2", "c3"])


BLOBS = "part int, kind int, c0 binary, c1 binary, c2 binary, c3 binary"


def got_by_kind(batches: Iterator[pa.RecordBatch], kinds: dict[int, list]) -> dict[int, list[list[np.ndarray]]]:
    """By kind, the columns of each row that has come."""
    out: dict[int, list[list[np.ndarray]]] = {k: [] for k in kinds}
    for b in batches:
        for r, kind in enumerate(b.column(1).to_pylist()):
            out[kind].append([np.frombuffer(b.column(c + 2)[r].as_buffer(), t) for c, t in enumerate(kinds[kind])])
    return out


def together(rows: list[list[np.ndarray]], types: list) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, t) for t in types]
