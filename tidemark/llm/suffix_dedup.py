"""Removal of long repeated byte strings by refining buckets of suffixes on the identifiers of later offsets."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory, text_bytes, text_chunks, write_table
from tidemark.llm.packed import Rows, by_key

#: Repeated strings of this many bytes go. Suffixes start in buckets of their first GRAM bytes, and two of these, STEP apart, make up a string.
LENGTH, GRAM, STEP = 100, 51, 49
#: Bytes of text whose suffixes are looked at at a time: each takes some fifty bytes of memory meanwhile.
CHUNK = 1 << 20

_U = np.uint64
#: Odd multipliers of the two lanes of identifiers, each mixed on its own.
_LANES = [(_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))]


def _refined(own: np.ndarray, later: np.ndarray, lane: int = 0) -> np.ndarray:
    """The identifier of a bucket refined by the identifier of the bucket at a later offset."""
    m, n = _LANES[lane]
    x = own * m
    x ^= x >> _U(32)
    x = (x ^ later) * n
    x ^= x >> _U(29)
    return x * m ^ x


def identifiers(b: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Identifiers of the buckets of all suffixes of ``b`` by their first GRAM or LENGTH bytes.

    The first buckets are those of eight bytes, named by the bytes. Then each bucket is refined by the identifier at
    the suffix 8, 16 and 19 bytes later, each time with the refined identifiers of the step before: 8, 16, 32 and 51 bytes are
    decided; and, for LENGTH, by that 49 bytes later.
    """
    if len(b) < size:
        return np.zeros(0, _U)
    x = np.ndarray(len(b) - 7, "<u8", np.ascontiguousarray(b).data, strides=(1,))
    for step in (8, 16, GRAM - 32, *[STEP] * (size == LENGTH)):
        x = _refined(x[:-step], x[step:], lane)
    return x


def sampled(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes to start from: (places, identifiers of their buckets, and of these refined by the buckets before and after).

    In every string of LENGTH bytes within a text it is the one whose bucket of GRAM bytes has the least identifier (the leftmost of
    equal ones), so one suffix in some 25 stands for all strings around it, and equal strings have theirs in one bucket at one offset.
    The refinement is by the buckets STEP bytes earlier and later, nearer at a text's ends: together all
    bytes of all strings that the suffix can stand for.
    """
    h = identifiers(b, GRAM)
    if len(h) <= STEP:
        return np.zeros(0, np.int64), h[:0], h[:0]
    m = h >> _U(32) << _U(32) | np.arange(len(h)).astype(_U)
    width, want = 1, STEP + 1
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (want - width)], m[want - width :])
    size = np.diff(first)
    mark = np.zeros(len(b) + 1, np.int8)  # 1 from a text's begin to its last string of LENGTH bytes
    long = size >= LENGTH
    mark[first[:-1][long]] += 1
    mark[(first[1:] - LENGTH + 1)[long]] -= 1
    whole = np.cumsum(mark[: len(m)], dtype=np.int8) > 0
    at = (m[whole] & _U(0xFFFFFFFF)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    text = np.searchsorted(first, at, "right") - 1
    lo, hi = np.maximum(at - STEP, first[text]), np.minimum(at + STEP, first[text + 1] - GRAM)
    places = ((at - lo) << 8 | (hi - at)).astype(_U)
    return at, h[at], _refined(_refined(h[lo], h[at]), _refined(h[hi], places))


def _first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for rows, b, first in text_chunks(batch, "text", CHUNK):
            at, key, refined = sampled(b, first)
            text = np.searchsorted(first, at, "right") - 1
            # least identifiers are small ones: mixed again, they fill all ranges alike
            yield _refined(key, key), [refined.view(np.int64), ids[rows.start : rows.stop][text].astype(np.int64), at - first[text]]


def _later_and_open(key: np.ndarray, refined: np.ndarray, doc: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Places that are not the first of their refined bucket (later = 1), and the first ones of a bucket that fell into several (0)."""
    order = np.lexsort([at, doc, refined, key])
    key, refined, doc, at = key[order], refined[order], doc[order], at[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    part = new | (np.r_[True, refined[1:] != refined[:-1]] if len(key) else new)
    head = np.maximum.accumulate(np.where(part, np.arange(len(key)), 0))
    later = (doc != doc[head]) | (at != at[head])
    bucket = np.cumsum(new) - 1
    split = np.bincount(bucket, part)[bucket] > 1 if len(key) else part
    keep = later | split & part
    return {"doc": doc[keep], "at": at[keep], "later": later[keep].astype(np.int64)}


def _every_offset(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The strings of LENGTH bytes around unresolved suffixes: identifiers in two lanes."""
    for batch in batches:
        for doc, z, open_ in zip(batch.column("doc_id").to_pylist(), batch.column("z"), batch.column("open")):
            b = np.frombuffer(_unzip(z.as_buffer()), np.uint8)
            at = np.asarray(open_.as_py(), np.int64)
            mark = np.zeros(len(b) + 2, np.int64)
            np.add.at(mark, np.maximum(at - STEP, 0), 1)
            np.add.at(mark, np.minimum(at, len(b) - LENGTH) + 1, -1)
            i = np.flatnonzero(np.cumsum(mark) > 0)
            yield identifiers(b, LENGTH)[i], [identifiers(b, LENGTH, 1)[i].view(np.int64), np.full(len(i), doc, np.int64), i]


def _later(key: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    found = _later_and_open(key, check, doc, at)
    return {c: found[c][found["later"] == 1] for c in ("doc", "at")}


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [c.compress(b[i:j]) for _, b, first in text_chunks(batch, "text") for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "z": pa.array(z, pa.binary())})
    release_memory()


def _unzip(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, z, covered, strings in zip(pdf["doc_id"], pdf["z"], pdf["covered"], pdf["strings"]):
            raw = _unzip(z)
            at = np.asarray(covered if covered is not None else [], np.int64)
            lo, hi = np.maximum(at - STEP, 0), np.minimum(at + LENGTH, len(raw))
            i = np.asarray(strings if strings is not None else [], np.int64)
            lo, hi = np.r_[lo, i], np.r_[hi, i + LENGTH]
            mark = np.zeros(len(raw) + 1, np.int64)
            np.add.at(mark, lo, 1)
            np.add.at(mark, hi, -1)
            gone = np.r_[False, np.cumsum(mark[:-1]) > 0, False]
            edge = np.flatnonzero(gone[1:] != gone[:-1])
            kept = np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes()
            rows.append((doc, int(gone.sum()), len(edge) // 2, edge.tolist(), kept))
        yield pd.DataFrame(rows, columns=["doc_id", "n_removed", "n_spans", "edges", "kept"])
    release_memory()


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_spans, edges (begin and end of each removed run) and kept (bytes) of each document that loses bytes.

    A byte goes when it lies in a string of LENGTH bytes that also starts earlier (smaller doc_id, or
    the same document further left). Sampled suffixes are put in buckets by their first GRAM bytes; buckets of one
    are done. The rest are refined by the identifiers of the buckets around them, up to all bytes that
    a string of LENGTH bytes can hold: all but the first suffix of a refined bucket are
    repeats as a whole. Where a first bucket fell into several, the first suffixes of the parts are open, and the suffixes at
    every offset around them are refined to LENGTH bytes. Only identifiers (128 bits in all) and places leave a document.

    Null doc_ids take no part, nor do texts under LENGTH bytes. Rows of one doc_id count as one document and must have one
    text. No other column is read; an empty table gives an empty one.
    """
    rows = docs.filter(f"doc_id is not null and octet_length(text) >= {LENGTH}").select(F.col("doc_id").cast("long"), "text")
    place = F.struct("doc", "at")
    light, heavy = by_key(rows, _first_buckets, ["refined", "doc", "at"], text_bytes(rows) // 25, "buckets", _later_and_open, "doc long, at long, later long")
    # in a frequent bucket, all first suffixes of refined buckets count as open
    firsts = write_table(heavy.groupBy("key", "refined").agg(F.min(place).alias("first")), "firsts")
    held = heavy.join(firsts, ["key", "refined"]).select("doc", "at", (F.col("first") != place).cast("long").alias("later"))
    state = light.union(held)
    marks = state.groupBy("doc").agg(F.collect_set(F.when(F.col("later") == 1, F.col("at"))).alias("covered"), F.collect_set(F.when(F.col("later") == 0, F.col("at"))).alias("open"))
    marks = write_table(marks.withColumnRenamed("doc", "doc_id"), "marks")

    zipped = rows.mapInArrow(_zip, "doc_id long, z binary")
    open_ = zipped.join(marks.filter("size(open) > 0").select("doc_id", "open"), "doc_id").dropDuplicates(["doc_id"])
    n = marks.agg(F.sum(F.size("open"))).first()[0] or 0
    light, heavy = by_key(open_, _every_offset, ["check", "doc", "at"], n * 40, "offsets", _later, "doc long, at long")
    firsts = write_table(heavy.groupBy("key", "check").agg(F.min(place).alias("first")), "firsts")
    again = light.union(heavy.join(firsts, ["key", "check"]).filter(F.col("first") != place).select("doc", "at"))
    strings = again.groupBy("doc").agg(F.collect_set("at").alias("strings")).withColumnRenamed("doc", "doc_id")
    final = write_table(marks.select("doc_id", "covered").join(strings, "doc_id", "full").filter("size(covered) > 0 or size(strings) > 0"), "cuts")
    return zipped.join(final, "doc_id").dropDuplicates(["doc_id"]).mapInPandas(_cut, "doc_id long, n_removed long, n_spans long, edges array<long>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = repeated_strings(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"))
    out = whole.join(cut, "doc_id", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))
