"""Benchmark decontamination by templates of questions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, write_table

#: Plain words of a template window, however many names, numbers and units stand between them.
LITERALS = 8
#: Plain words from which a whole item of fewer may be found with other slots; with less it must be there word for word.
FEW = 4
#: Hashes of the benchmark's windows, eight bytes each, up to which they are sent to every task; beyond, the join is shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Names of units.
UNITS = "km|kg|cm|mm|mg|ml|mph|km/h|usd|eur|gbp|percent|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inches|pounds?|dollars?|euros?|cents?|grams?|liters?|litres?|m|g|l|h"

#: Punctuation, which a template leaves out. Only characters up to 255, which are quick to look for.
MARKS = r"[!-.:-?\[-`{-~\xA1\xAB\xB7\xBB\xBF]+"


def tokens(text: Column) -> Column:
    """The words of a text as they are."""
    return F.split(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")), " ")


def template(text: Column) -> Column:
    """The words of a text, one for one, in canonical form.

    A capitalised word is a name, ``@`` (also at the start of a sentence, where it can't be told from others); a number is ``0``;
    a unit after or at a number is ``u``. All else is in lower case without punctuation.
    """
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    t = F.lower(F.regexp_replace(t, r"(^| )([(\x22'\xAB\xBF\xA1]*)\p{Lu}\p{Ll}+", "$1$2@"))
    plain = F.regexp_replace(t, MARKS, "")
    full = F.regexp_replace(F.regexp_replace(t, r"[0-9]+([.,:][0-9]+)*", "0"), MARKS, "")
    full = F.regexp_replace(full, rf"( |^)0 ({UNITS})( |$)", r"$1\0 u$3")
    full = F.regexp_replace(full, rf"( |^)0({UNITS})( |$)", r"$1\0u$3")
    # most texts have no number, and need no look for units
    return F.split(F.when(text.rlike("[0-9]"), full).otherwise(plain), " ")


#: What stands in a template for anything but a word.
HOLES = ("", "@", "0", "u", "0u")


def _is_word(x: Column) -> Column:
    return ~x.isin(*HOLES)


def windows(rows: DataFrame, key: str, lengths: list[int], literals: int = LITERALS) -> DataFrame:
    """key, pos, len, h (hash of the window's canonical words) and the whole text; words are cut out of it again for hits only.

    A window begins and ends with a plain word and holds ``literals`` of them; besides, every stretch of each of ``lengths`` words is one,
    for items with fewer plain words.
    """
    holes = [F.xxhash64(F.lit(x)) for x in HOLES]
    cut = rows.select(key, "text", F.transform(template(F.col("text")), lambda x: F.xxhash64(x)).alias("hs"))
    places = F.filter(F.transform("hs", lambda x, i: F.when(~x.isin(*holes), i)), lambda i: i.isNotNull())
    cut = cut.select(key, "text", "hs", places.alias("at"))
    n, m = F.size("hs"), F.size("at")
    spans = F.when(m >= literals, F.transform(F.sequence(F.lit(0), m - literals), lambda j: F.struct(F.get("at", j).alias("pos"), (F.get("at", j + literals - 1) - F.get("at", j) + 1).alias("len"))))
    none = F.array().cast("array<struct<pos: int, len: int>>")

    def stretches(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda j: F.struct(j.alias("pos"), F.lit(size).alias("len")))).otherwise(none)

    spans = F.concat(F.coalesce(spans, none), *map(stretches, lengths))
    cut = cut.select(key, "text", "hs", F.explode(spans).alias("s"))
    return cut.select(key, F.col("s.pos").alias("pos"), F.col("s.len").alias("len"), F.xxhash64(F.slice("hs", F.col("s.pos") + 1, F.col("s.len"))).alias("h"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, literals: int = LITERALS, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_ids, n_windows of every document that holds a part of a benchmark item, as it is or re-parameterised.

    Windows of canonical words of documents and items are joined by hash; an item of fewer than ``literals`` plain words is one
    window as a whole. Matching windows on one line (same offset between document and item) are an alignment. A window whose
    names, numbers and units are the item's own counts. One with others counts if the slots of all such windows of its
    alignment are consistent: each word of the item always stands for the same word of the document,
    and different ones for different words; a short item of fewer than FEW plain words only counts as it is.

    Null texts are empty and match nothing. Null ids never match. Rows of one doc_id count as one document, rows of one item_id
    as one item each. Other columns are not read; empty tables give an empty result.
    """
    part = lambda a, at: F.slice(a, F.col(at) + 1, F.col("len"))
    known = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    words = template(F.col("text"))
    # of bounded number: an item of few plain words that is long all the same has many holes
    short = known.select(F.size(words).alias("n"), F.size(F.filter(words, _is_word)).alias("m")).filter(f"m < {literals} and n > 0")
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
    short_items = known.filter(F.size(F.filter(words, _is_word)) < literals).select("item_id", "text", F.lit(0).alias("pos"), F.size(words).alias("len"))
    short_items = short_items.filter(F.size(F.filter(words, lambda x: x != "")) > 0).select("item_id", "pos", "len", F.xxhash64(F.transform(words, lambda x: F.xxhash64(x))).alias("h"), "text")
    items = windows(known, "item_id", [], literals).unionByName(short_items)
    items = write_table(items.select("item_id", F.col("pos").alias("at"), "h", part(words, "pos").alias("ic"), part(tokens(F.col("text")), "pos").alias("iw")), "items")
    rows = windows(docs.filter("doc_id is not null").select("doc_id", "text"), "doc_id", lengths, literals)
    hashes = items.select("h").distinct()
    if items.count() <= limit:
        hits = rows.join(F.broadcast(hashes), "h", "left_semi")
    else:
        found = write_table(rows.select("doc_id", "pos", "len", "h").join(hashes, "h", "left_semi"), "found")
        hits = found.join(docs.select("doc_id", "text"), "doc_id")
    hits = write_table(hits.select("doc_id", "pos", "h", part(words, "pos").alias("c"), part(tokens(F.col("text")), "pos").alias("w")), "hits")
    hits = hits.join(items, "h").filter("c = ic")
    word = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", ""))
    pairs = F.zip_with("iw", "w", lambda a, b: F.struct(word(a).alias("a"), word(b).alias("b")))
    slots = F.filter(F.zip_with("ic", pairs, lambda c, p: F.when(c.isin(*HOLES[1:]), p)), lambda p: p.isNotNull())
    hits = hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("line"), "pos", F.size("c").alias("len"), F.size(F.filter("c", _is_word)).alias("m"), slots.alias("slots"))
    hits = hits.withColumn("same", ~F.exists("slots", lambda p: p["a"] != p["b"])).filter(F.col("same") | (F.col("m") >= FEW)).distinct()
    hits = write_table(hits, "aligned")
    line = hits.filter("not same").select("doc_id", "item_id", "line", F.explode("slots").alias("slot")).groupBy("doc_id", "item_id", "line")
    line = line.agg(F.count_distinct("slot").alias("both"), F.count_distinct("slot.a").alias("left"), F.count_distinct("slot.b").alias("right"))
    good = line.filter("both = left and both = right").select("doc_id", "item_id", "line", F.lit(True).alias("consistent"))
    kept = hits.join(good, ["doc_id", "item_id", "line"], "left").filter("same or consistent").select("doc_id", "item_id", "line", "pos", "len").distinct()
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_windows"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark questions, with the items and the number of matching windows."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _template_sql(text: str) -> str:
    t = f"trim(regexp_replace(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
    t = f"regexp_replace({t}, '(^| )([(\\x22''\\xAB\\xBF\\xA1]*)\\p{{Lu}}\\p{{Ll}}+', '\\1\\2@', 'g')"
    t = f"regexp_replace(lower({t}), '[0-9]+([.,:][0-9]+)*', '0', 'g')"
    t = f"regexp_replace({t}, '[!-.:-?\\[-`{{-~\\xA1\\xAB\\xB7\\xBB\\xBF]+', '', 'g')"
    t = f"regexp_replace({t}, '( |^)0 ({UNITS})( |$)', '\\10 u\\3', 'g')"
    return f"string_split(regexp_replace({t}, '( |^)0({UNITS})( |$)', '\\10u\\3', 'g'), ' ')"


def contaminated_sql(docs: str) -> str:
    holes = "('', '@', '0', 'u', '0u')"
    words = lambda t, k: f"SELECT {k}, c, w, list_filter(range(1, len(c) + 1), lambda i: c[i] NOT IN {holes}) AS at_ FROM (SELECT {k}, {_template_sql('text')} AS c, string_split(trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS w FROM {t} WHERE {k} IS NOT NULL AND text IS NOT NULL)"
    spans = lambda t, k: f"SELECT {k}, p AS pos, q - p + 1 AS len, c[p : q] AS c, w[p : q] AS w FROM (SELECT {k}, c, w, at_[j] AS p, at_[j + {LITERALS - 1}] AS q FROM {t}, unnest(range(1, len(at_) - {LITERALS - 2})) AS u(j))"
    word = lambda x: f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))"
    return f"""
WITH dw AS ({words(docs, 'doc_id')}), iw AS ({words('benchmark', 'item_id')}),
short AS (SELECT item_id, 1 AS pos, len(c) AS len, c, w FROM iw WHERE len(at_) < {LITERALS} AND len(list_filter(c, lambda x: x <> '')) > 0),
i AS ({spans('iw', 'item_id')} UNION ALL SELECT * FROM short),
d AS ({spans('dw', 'doc_id')} UNION ALL SELECT doc_id, p, n, c[p : p + n - 1], w[p : p + n - 1] FROM (SELECT DISTINCT len AS n FROM short), dw, unnest(range(1, len(c) - n + 2)) AS u(p)),
h AS (SELECT DISTINCT doc_id, item_id, d.pos - i.pos AS line, d.pos, d.len, len(list_filter(d.c, lambda x: x NOT IN {holes})) AS m, list_transform(list_filter(range(1, d.len + 1), lambda k: d.c[k] IN ('@', '0', 'u', '0u')), lambda k: {{'a': {word('i.w[k]')}, 'b': {word('d.w[k]')}}}) AS slots FROM d JOIN i ON d.c = i.c),
s AS (SELECT *, len(list_filter(slots, lambda p: p.a <> p.b)) = 0 AS same FROM h),
l AS (SELECT doc_id, item_id, line FROM (SELECT doc_id, item_id, line, unnest(slots) AS p FROM s WHERE NOT same AND m >= {FEW}) GROUP BY ALL HAVING count(DISTINCT p) = count(DISTINCT p.a) AND count(DISTINCT p) = count(DISTINCT p.b)),
k AS (SELECT DISTINCT doc_id, item_id, line, pos, len FROM s LEFT JOIN (SELECT *, true AS consistent FROM l) USING (doc_id, item_id, line) WHERE same OR (m >= {FEW} AND consistent))
SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, count(*) AS n_windows FROM k GROUP BY doc_id
"""


OP4_SQL = contaminated_sql("documents")
