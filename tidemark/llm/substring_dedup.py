"""Removal of repeated runs of sentences."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import unused, write_table

#: A sentence, with the white space after it.
SENTENCE = r"[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+"
#: Consecutive sentences of a run. Longer repeats are covered by runs that overlap.
RUN = 4


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def lowered(text: Column) -> Column:
    """Each letter's lower case on its own, as in the SQL. Spark's makes a final sigma of one at a word's end, and two characters of a dotted capital I."""
    for upper, lower in ("\u03a3", "\u03c3"), ("\u0130", "i"):
        text = F.replace(text, F.lit(upper), F.lit(lower))
    return F.lower(text)


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id and covered, the numbers of the sentences in a run that is not the first of its kind.

    Sentences are compared in lower case, spaces and tabs as one space, without white space at the
    ends. Every run of ``run`` sentences is hashed to 128 bits and joined globally; the first is that
    of the smallest doc_id, then of the smallest place. A document of fewer sentences is one run of all. Documents
    without a repeated run, null texts and rows with a null doc_id are left out.
    """
    plain = lowered(F.regexp_replace("text", r"[ \t]+", " "))
    parts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.transform(sentences(plain), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))).alias("s"))
    size = F.least(F.size("s"), F.lit(run))

    def hashed(i: Column) -> Column:
        of = F.slice("s", i + 1, size)
        return F.struct(i.alias("at"), size.alias("size"), F.xxhash64(of).alias("h"), F.xxhash64(F.lit(1), of).alias("g"))

    runs = F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(0), F.size("s") - size), hashed))
    rows = write_table(parts.select("doc_id", F.inline(runs)), "runs")
    kinds = rows.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g", "first")
    later = rows.join(kinds, ["h", "g"]).filter(F.struct("doc_id", "at") != F.col("first"))
    return later.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "size")), lambda r: F.sequence(r["at"], r["at"] + r["size"] - 1))))).alias("covered"))


def remove_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Every row of ``docs`` with its text without the sentences of repeated runs, and the numbers of those (``covered``).

    Runs are judged on the input, not on what is left. Null text stays null, rows with a null doc_id
    stay as they are, and rows of one doc_id count as one document. An input column named
    ``covered`` is replaced, all others stay. An empty table gives an empty one.
    """
    own = docs.drop("covered")
    parts = unused(own, "parts")
    out = own.join(repeated_runs(docs, run), "doc_id", "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "covered")
    out = out.withColumn(parts, F.when(F.col("covered").isNotNull(), sentences(F.col("text"))))
    out = out.withColumn("text", F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "")))
    return out.select(*own.columns, "covered")


def op1_sentence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated runs takes from each document, and a digest of what it leaves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.octet_length("text").alias("size"))
    out = remove_runs(docs)
    covered, text = F.coalesce("covered", F.array().cast("array<int>")), F.coalesce("text", F.lit(""))
    spans = F.size(F.array_except(covered, F.transform(covered, lambda i: i + 1)))
    return out.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("n_bytes"), (F.coalesce("size", F.lit(0)) - F.octet_length(text)).cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"), F.size(covered).cast("long").alias("n_sentences_removed"), F.sha2(text, 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+') AS parts,
    list_transform(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g')), '[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s
  FROM documents),
r AS (SELECT doc_id, i AS pos, s[i : i + 3] AS run FROM p, unnest(range(1, greatest(len(s) - 3, least(len(s), 1)) + 1)) AS t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM r),
c AS (SELECT doc_id, list_sort(list_distinct(flatten(list(CASE WHEN nth > 1 THEN range(pos, pos + len(run)) ELSE [] END)))) AS covered FROM k GROUP BY doc_id),
o AS (SELECT p.doc_id, p.text, parts, coalesce(covered, []) AS covered,
    list_aggregate(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(coalesce(covered, []), i)), lambda i: parts[i]), 'string_agg', '') AS kept
  FROM p LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(strlen(text) - strlen(coalesce(kept, '')) AS BIGINT) AS n_removed,
  CAST(len(list_filter(covered, lambda i: NOT list_contains(covered, i - 1))) AS BIGINT) AS n_spans, CAST(len(covered) AS BIGINT) AS n_sentences_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM o
"""
