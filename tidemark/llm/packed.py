"""Rows of a 64-bit key and whole numbers, shuffled in packed form so that all rows of a key meet."""

from collections.abc import Callable, Iterator
from itertools import count as count_from

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import release_memory, write_table

#: Rows a task gathers before it sends them, and rows of a range of keys.
CHUNK, ROWS = 1_000_000, 500_000

Rows = tuple[np.ndarray, list[np.ndarray]]


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: memoryview, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack(keys: np.ndarray, cols: list[np.ndarray], marks: np.ndarray) -> bytes:
    """Sorted keys as differences, each column as byte planes: most planes are nearly constant. ``marks`` are keys without rows."""
    import zstandard

    parts = [_planes(np.diff(keys, prepend=np.uint64(0))), *(_planes(c) for c in cols), marks.tobytes()]
    return np.array([len(keys), len(marks)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    import zstandard

    n, m = np.frombuffer(data[:8], "<u4").tolist()
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data[8:]))
    at = lambda i: raw[8 * n * i : 8 * n * (i + 1)]
    keys = np.cumsum(_unplanes(at(0), np.uint64), dtype=np.uint64) if n else np.zeros(0, np.uint64)
    cols = [_unplanes(at(i + 1), np.int64) if n else np.zeros(0, np.int64) for i in range(width)]
    return keys, cols, np.frombuffer(raw[8 * n * (width + 1) :], np.uint64, m)


def by_key(docs: DataFrame, rows_of: Callable[[Iterator[pa.RecordBatch]], Iterator[Rows]], names: list[str], total: int, name: str, reduce: Callable[..., dict[str, np.ndarray]], out: str) -> tuple[DataFrame, DataFrame]:
    """What ``reduce`` makes of all rows of a key, and the rows (key and ``names``) of frequent keys as they are.

    ``rows_of`` makes (keys, columns), some ``total`` rows, from Arrow batches of ``docs``. Keys go to ranges of some ROWS
    rows, each of which is reduced in one task: ``reduce(keys, *columns)`` returns the columns ``out`` (names and types), all long.
    A key whose share of a task's chunk is more than a quarter of what a range holds of all rows is frequent: its rows
    there take no part in that; a mark makes the rows of other chunks stay out as well. So all chunks together
    bring a quarter of a range's usual rows of one key at most (or a row each, where that is more). Rows of frequent
    keys are unpacked in pieces, each a group of its own, and left to Spark's own aggregates and joins, which combine rows before
    a shuffle and split skewed partitions. Both are read from one work table; ``drop_table`` of the first deletes it.
    """
    width, shift = len(names), np.uint64(64 - max(6, max(1, total // ROWS).bit_length()))
    share = ROWS / 4 / max(total, 1)
    made = [c.split()[0] for c in out.split(", ")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        n = 0
        pieces = count_from(TaskContext.get().partitionId() << 32)  # no two pieces of the table have one number

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            cols = [np.concatenate([c[i] for _, c in held]) for i in range(width)]
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, cols = keys[order], [c[order] for c in cols]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            counts = np.diff(np.append(first, len(keys)))
            much = counts > max(1, share * len(keys))
            heavy, marks = np.repeat(much, counts), keys[first[much]]
            sent = []
            at = np.flatnonzero(heavy)
            for lo in range(0, len(at), 100_000):
                i = at[lo : lo + 100_000]
                sent.append((-1 - next(pieces), _pack(keys[i], [c[i] for c in cols], marks[:0])))
            keys, cols = keys[~heavy], [c[~heavy] for c in cols]
            upto = np.arange(1 << int(64 - int(shift)), dtype=np.uint64)
            ends, mends = np.searchsorted(keys >> shift, upto, "right"), np.searchsorted(marks >> shift, upto, "right")
            lo = mlo = 0
            for b, (hi, mhi) in enumerate(zip(ends.tolist(), mends.tolist())):
                if hi > lo or mhi > mlo:
                    sent.append((b, _pack(keys[lo:hi], [c[lo:hi] for c in cols], marks[mlo:mhi])))
                lo, mlo = hi, mhi
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([x for x, _ in sent], pa.int64()), "data": pa.array([x for _, x in sent], pa.binary())})

        for keys, cols in rows_of(batches):
            held.append((keys, cols))
            n += len(keys)
            if n >= CHUNK:
                yield from flush()
                n = 0
        if n:
            yield from flush()
        release_memory()

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(x, width) for x in pdf["data"]]
        keys, cols = np.concatenate([g[0] for g in got]), [np.concatenate([g[1][i] for g in got]) for i in range(width)]
        marks = np.unique(np.concatenate([g[2] for g in got]))
        del got
        raw = np.ones(len(keys), bool) if key[0] < 0 else np.isin(keys, marks) if len(marks) else np.zeros(len(keys), bool)
        kept = reduce(keys[~raw], *[c[~raw] for c in cols])
        n, m = len(kept[made[0]]), int(raw.sum())
        frame = {"raw": np.repeat([False, True], [n, m]), "key": np.concatenate([np.zeros(n, np.int64), keys[raw].view(np.int64)])}
        frame |= {f"c_{c}": np.concatenate([np.zeros(n, np.int64), x[raw]]) for c, x in zip(names, cols)}
        release_memory()
        return pd.DataFrame(frame | {f"o_{c}": np.concatenate([kept[c], np.zeros(m, np.int64)]) for c in made})

    schema = ", ".join(["raw boolean, key long", *(f"c_{c} long" for c in names), *(f"o_{c} long" for c in made)])
    rows = write_table(docs.mapInArrow(send, "bucket long, data binary").groupBy("bucket").applyInPandas(meet, schema), name)
    light = rows.filter("not raw").selectExpr(*(f"o_{c} as {c}" for c in made))
    light._work_table = rows._work_table
    return light, rows.filter("raw").selectExpr("key", *(f"c_{c} as {c}" for c in names))
