"""Language identification by compression with one raw-content dictionary per language."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory, unused

#: The share of a document's block sizes by which the second language must be larger.
MIN_MARGIN = 0.002
#: The classifier is fitted on at most SLOTS texts of PIECE characters for each of the LANGS most frequent languages.
SLOTS, PIECE, LANGS = 64, 1500, 64
#: Texts are compressed in blocks of this many bytes, so that a long text can't stand in for the dictionary.
BLOCK = 4096
#: Compression level, and the shortest match it looks for.
LEVEL, MATCH = 6, 3


def fit_dictionaries(docs: DataFrame, slots: int = SLOTS, piece: int = PIECE, langs: int = LANGS) -> dict[str, bytes]:
    """Raw content per language from labelled rows (text, lang): a bounded sample, one piece for each hash slot.

    A piece is taken at a place drawn by the text's hash. Only the ``langs`` most frequent values of lang are
    learned (of equally frequent ones, the first in the alphabet), so a dirty column can't grow what is collected.
    """
    known = docs.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    most = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()]
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - piece + 1, F.lit(1)).cast("long")).cast("int") + 1
    cut = known.filter(F.col("lang").isin(most)).select("lang", "h", F.substring("text", begin, F.lit(piece)).alias("piece"))
    kept = cut.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(F.struct("h", "piece")).alias("m"))
    rows = kept.select("lang", "slot", "m.piece").orderBy("lang", "slot").collect()  # slots x langs at most
    out: dict[str, list[bytes]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(" ".join(r["piece"].lower().split()).encode())
    return {lang: b" ".join(pieces) for lang, pieces in out.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MIN_MARGIN, column: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected, or other ``names``, to ``docs``; input columns of these names are replaced, no other column but ``column`` is read.

    Texts are compared in lower case with single spaces. The language whose dictionary makes all
    blocks of the whole text smallest wins; its score is the share by which the next language's blocks are
    larger, through a fixed curve. A text is rejected when that share is under ``margin``. Null text, or text
    without a letter: ``und``, 0, rejected. With equal sizes the language first in the alphabet wins. Without
    dictionaries every text is ``und``. Repeated rows stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:  # the coders are made once for each task
        import zstandard

        coders = []
        for lang, content in shared.value:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=BLOCK, min_match=MATCH)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            coders.append((lang, zstandard.ZstdCompressor(compression_params=how, dict_data=held)))

        def one(text: str | None) -> tuple[str, float, bool]:
            if not text or not coders or not any(map(str.isalpha, text)):
                return "und", 0.0, True
            raw = " ".join(text.lower().split()).encode("utf-8", "replace")
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = sorted((sum(len(c.compress(x)) for x in blocks), lang) for lang, c in coders)
            share = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            return sizes[0][1], share / (share + 0.02), share < margin

        for s in batches:
            yield pd.DataFrame([one(x) for x in s], columns=["lang_pred", "score", "rejected"])
        release_memory()

    # not deterministic only in name: otherwise a filter on the result would make Spark compress every text twice
    told, at = F.pandas_udf(tell, "lang_pred string, score double, rejected boolean").asNondeterministic()(F.col(column)), unused(docs, "told")
    own = zip(("lang_pred", "score", "rejected"), names)
    return docs.withColumn(at, told).select(*[c for c in docs.columns if c not in names], *[F.col(at)[c].alias(name) for c, name in own])


def held_out() -> Column:
    """The documents that nothing is learned from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fitted = fit_dictionaries(docs.filter(~held_out()))
    told = identify(docs.select("doc_id", "text"), fitted)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
