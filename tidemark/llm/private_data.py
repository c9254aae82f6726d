"""Personal data: patterns, and terms that reveal them by co-occurrence."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import write_table

#: Kinds in their order, what to look for, and a part without which there is no match.
#: As plain patterns: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9]. Here they begin only where the first of overlapping
#: matches can, and don't step back where that finds nothing, so that long runs take linear time and no deep stack.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: A term's disclosure is judged in bits: how many it must tell about an entity, and what uncertainty about the entity is left
#: when the term is known, up to which it is generalised or, with less, removed.
GAIN, GENERALISE, REMOVE = 3.0, 1.0, 0.6
#: Documents without the entity that every estimate adds to a term's: a term met once leaves one bit.
PRIOR = 1.0
#: Terms or documents, eight bytes each, up to which all tasks get them to look for them in a table; beyond, that join is shuffled.
SENT_TERMS = 1_000_000
TERM = r"\p{L}+"

SPAN = "array<struct<start: int, end: int, value: string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches with their places in code points, end exclusive: what lies between matches tells where they are."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))).alias("out"))

    return F.aggregate(both, none, step)["out"]


#: Pieces of a text whose places are summed up together.
BLOCK = 256


def words(text: Column) -> Column:
    """All words with their places in code points, end exclusive.

    A text is cut into words and what lies between. Places are summed up within blocks of pieces, and over the blocks' lengths, so
    that a long text doesn't cost its square.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    blocks = F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    nowhere = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        own = F.when(x.rlike(r"^\p{L}"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("value")))).otherwise(acc["out"])
        return F.struct(end.alias("at"), own.alias("out"))

    def begin(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def moved(x: Column, first: Column) -> Column:
        return F.transform(x["out"], lambda s: F.struct((s["start"] + first).alias("start"), (s["end"] + first).alias("end"), s["value"].alias("value")))

    def joined_blocks(held: Column) -> Column:
        return F.flatten(F.zip_with(held, F.aggregate(held, nowhere, begin)["out"], moved))

    # within a transform over one element, so that the blocks are made once
    held = F.transform(blocks, lambda b: F.aggregate(b, none, place))
    return F.coalesce(F.get(F.transform(F.array(held), joined_blocks), 0), F.array().cast(SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda x: F.length(_digits(x)).between(16, 19) & _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds a column for each kind, its valid matches (start, end, value) in the whole text; null text has none. Input columns of these names are replaced."""
    none = F.array().cast(SPAN)
    text = F.coalesce("text", F.lit(""))
    raw = {}
    for kind, (pattern, part) in KINDS.items():
        may = F.contains(text, F.lit(part)) if part else text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
        raw[kind] = F.when(may, matches(text, pattern)).otherwise(none)
    out = docs.withColumns(raw)

    def valid(kind: str) -> Column:
        return F.filter(kind, lambda s: VALID[kind](s["value"]))

    return out.withColumns({kind: valid(kind) for kind in KINDS})


def joined(spans: list[tuple[str, Column]]) -> Column:
    def named(kind: str, c: Column) -> Column:
        return F.transform(c, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[named(kind, c) for kind, c in spans]), ",")


def entity(kind: str, value: Column) -> Column:
    """What a match stands for, however it is written."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def masked(text: Column, spans: Column) -> Column:
    """The text with spaces for all characters of the spans (start, end), so that places stay."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    done = F.aggregate(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), first, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def _few(df: DataFrame, term: Column, among: DataFrame) -> DataFrame:
    """Rows whose term may be in ``among``, while that is short enough to be sent to every task; else all rows."""
    if among.count() > SENT_TERMS:
        return df
    return df.join(F.broadcast(among.select(F.xxhash64("term").alias("_short"))), F.xxhash64(term) == F.col("_short"), "left_semi")


def _own_terms(column: str) -> Column:
    return F.explode(F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(TERM), F.lit(0)), F.lower))).alias("term")


def candidate_terms(docs: DataFrame, rows: DataFrame, owned: DataFrame) -> DataFrame:
    """term, n (documents that have it), m (of these, with entities), and what tells those m apart (kind, s1).

    ``docs`` has the texts of all documents, ``rows`` the texts of those with entities, and ``owned`` (doc_id, rest) each of these once, ``rest`` being
    the text without base spans: words inside these don't count. Only a term that is in few documents without entities can leave so little uncertainty; others
    are left out. All are counted in one pass, so that no text is shuffled.
    """
    nobody = F.lit(None).cast("long")
    everywhere = docs.select(_own_terms("text"), F.lit(1).alias("n"), nobody.alias("d"))
    inside = rows.select(_own_terms("text"), F.lit(-1).alias("n"), nobody.alias("d"))
    outside = owned.select(_own_terms("rest"), F.lit(1).alias("n"), F.col("doc_id").cast("long").alias("d"))
    doc = [F.bit_xor(F.when(F.col("d").isNotNull(), F.xxhash64(F.lit(k), "d"))).alias(f"s{k}") for k in (1, 2)]
    terms = everywhere.union(inside).union(outside).groupBy("term").agg(F.sum("n").alias("n"), F.count("d").alias("m"), *doc)
    terms = terms.filter((F.col("m") > 0) & (-F.log2((F.col("m") + PRIOR) / (F.col("n") + PRIOR)) <= GENERALISE))
    return terms.select("term", "n", "m", F.xxhash64("m", "s1", "s2", "n").alias("kind"), "s1")


def disclosures(uses: DataFrame, held: DataFrame, n_docs: int) -> DataFrame:
    """kind, s1, left: kinds of terms that reveal an entity, with the bits of uncertainty that they leave about it (the least of all entities).

    ``held`` has (doc_id, entity), each once, and ``uses`` (doc_id, kind, s1, n). Over all documents, n have the term, b of these the entity, and
    a share p of all documents has the entity. The term's estimate of the entity is (b + PRIOR p) / (n + PRIOR); it tells log2 of
    estimate / p bits and leaves -log2 of the estimate.

    Entities in the same documents give the same figures, and so do terms: they are counted as one, so a document with many of both
    doesn't cost their product.
    """
    doc = [F.bit_xor(F.xxhash64(F.lit(k), "doc_id")).alias(f"s{k}") for k in (1, 2)]
    owners = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *doc)
    owners = owners.select("entity", (F.col("n_entity") / F.lit(n_docs)).alias("p"), F.xxhash64("n_entity", "s1", "s2").alias("owner"), F.col("s1").alias("o1"))
    owners = owners.filter(-F.log2("p") >= GAIN)  # what everybody has can't be revealed
    of = held.join(owners, "entity").select("doc_id", "owner", "o1", "p").distinct()
    pairs = uses.distinct().join(of, "doc_id").groupBy("kind", "s1", "n", "owner", "o1", "p").agg(F.count(F.lit(1)).alias("b"))
    estimate = (F.col("b") + PRIOR * F.col("p")) / (F.col("n") + PRIOR)
    strong = pairs.select("kind", "s1", (-F.log2(estimate)).alias("left"), F.log2(estimate / F.col("p")).alias("gain")).filter((F.col("left") <= GENERALISE) & (F.col("gain") >= GAIN))
    return strong.groupBy("kind", "s1").agg(F.min("left").alias("left"))


def replacement(value: Column, left: Column) -> Column:
    """Nothing for a term to be removed, else the class of the word: a name, an acronym, or another word."""
    upper = F.upper(value) == value
    kind = F.when(upper & (F.length(value) > 1), "[acronym]").when(F.upper(F.substring(value, 1, 1)) == F.substring(value, 1, 1), "[name]").otherwise("[word]")
    return F.when(left <= REMOVE, "").otherwise(kind)


def private_spans(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, (with ``text``) text, the base kinds, and ``terms``: (start, end, value) of revealing terms, value being what replaces them.

    A term is a word, in lower case, outside of base spans. One that reveals an entity is marked wherever it stands in any document.
    Rows with a null doc_id have base spans, but take no part in the statistics of terms and have no terms. Rows of one doc_id count as one
    document and must have one text; only in counts of terms, rows of a document without entities count each. Null text is empty. Other
    columns are not read; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", "text")
    every = F.concat(*KINDS)
    found = base_spans(rows).withColumn("rest", F.when((F.size(every) > 0) & F.col("doc_id").isNotNull(), masked(F.col("text"), every)))
    found = write_table(found if text else found.withColumn("text", F.when(F.col("rest").isNotNull(), F.col("text"))), "base-spans")
    out = found.drop("rest") if text else found.drop("rest", "text")

    def entities(kind: str) -> Column:
        return F.transform(kind, lambda s: entity(kind, s["value"]))

    owned = found.filter("rest is not null").select("doc_id", "text", "rest", F.concat(*map(entities, KINDS)).alias("entities"))
    every_row, owned = owned, write_table(owned.drop("text").dropDuplicates(["doc_id"]), "owned")
    if owned.isEmpty():
        return out.withColumn("terms", F.array().cast(SPAN))

    def places(x: DataFrame, column: str) -> DataFrame:
        return x.select("doc_id", F.explode(words(F.col(column))).alias("w")).select("doc_id", F.lower("w.value").alias("term"), "w.*")

    known = rows.filter("doc_id is not null and text is not null")
    terms = write_table(candidate_terms(known, every_row, owned), "terms")
    near = write_table(_few(places(owned, "rest"), F.col("term"), terms).join(terms, "term"), "term-uses")
    held = owned.select("doc_id", F.explode("entities").alias("entity")).distinct()
    told = write_table(disclosures(near.select("doc_id", "kind", "s1", "n"), held, rows.filter("doc_id is not null").count()), "revealing")
    marks = near.join(told, ["kind", "s1"])
    spread = write_table(marks.filter("m < n").select("term", "left").distinct(), "spread")
    marks = marks.select("doc_id", "start", "end", "value", "left")
    if not spread.isEmpty():  # terms that also stand in documents without entities
        theirs = _few(known.select("doc_id", _own_terms("text")), F.col("term"), spread)
        where = write_table(theirs.join(spread, "term").select("doc_id").distinct().join(owned.select("doc_id"), "doc_id", "left_anti"), "spread-docs")
        more = known.join(F.broadcast(where) if where.count() <= SENT_TERMS else where, "doc_id").dropDuplicates(["doc_id"])
        marks = marks.unionByName(places(more, "text").join(spread, "term").select("doc_id", "start", "end", "value", "left"))
    marks = marks.select("doc_id", "start", "end", replacement(F.col("value"), F.col("left")).alias("value")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("terms"))
    return out.join(marks, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast(SPAN)))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text in which base spans are replaced by their kind, revealing terms by the class of the word or nothing."""
    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("by")))

    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("by")))
    rows = private_spans(docs).withColumn("all", F.array_sort(F.concat(*map(marked, KINDS), terms)))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], s["by"]).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    rows = rows.withColumn("done", F.aggregate("all", first, step))
    return rows.select("doc_id", F.concat("done.out", F.substring("text", F.col("done.at") + 1, F.length("text"))).alias("text"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, all spans with those of revealing terms, and what replaces the terms (start:end:replacement)."""
    rows = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)
    base = [(k, F.col(k)) for k in KINDS]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    done = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", s["start"], s["end"], s["value"])), ",")
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined([*base, ("term", F.col("terms"))]).alias("spans"), F.size("terms").cast("long").alias("n_terms"), done.alias("actions"))


#: The kinds' patterns as they are given.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def private_data_sql(docs: str) -> str:
    """The query's rows in DuckDB, whose patterns need no care for time and depth."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS v, unnest(string_split_regex(t, '{p}')[:-2]) AS b, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d WHERE regexp_matches(t, '{p}')" for k,(kind,p) in enumerate(PLAIN.items())
    )
    word = "\\p{L}+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
f AS ({found}),
q AS (SELECT doc_id, k, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS g, CAST(sum(length(b) + length(v)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM f),
s AS (SELECT doc_id, k, kind, e - length(v) AS a, e, kind || ':' || CASE WHEN k < 2 THEN lower(v) ELSE g END AS entity FROM q WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INT) > 255)) = 0
  WHEN 'card' THEN length(g) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[length(g) + 1 - i] AS INT) ELSE CAST(g[length(g) + 1 - i] AS INT) * 2 - CASE WHEN g[length(g) + 1 - i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(g) BETWEEN 8 AND 15 END),
o AS (SELECT doc_id, list(DISTINCT entity) AS entities, list({{'a': a, 'e': e}}) AS spans FROM s GROUP BY doc_id),
m AS (SELECT d.doc_id, entities, CASE WHEN entities IS NULL THEN t ELSE list_aggregate(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN len(list_filter(spans, lambda x: x.a < i AND i <= x.e)) > 0 THEN ' ' ELSE t[i] END), 'string_agg', '') END AS r FROM d LEFT JOIN o USING (doc_id)),
w AS (SELECT doc_id, lower(v) AS term, v, e - length(v) AS a, e FROM (SELECT doc_id, v, CAST(sum(length(b) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM
  (SELECT doc_id, unnest(regexp_extract_all(r, '{word}')) AS v, unnest(string_split_regex(r, '{word}')[:-2]) AS b, unnest(range(len(regexp_extract_all(r, '{word}')))) AS i FROM m WHERE regexp_matches(r, '{word}')))),
u AS (SELECT DISTINCT doc_id, term FROM w),
n AS (SELECT term, count(*) AS n FROM u GROUP BY term),
h AS (SELECT doc_id, unnest(entities) AS entity FROM o),
p AS (SELECT entity, count(*) / (SELECT count(*) FROM d) AS p FROM h GROUP BY entity),
x AS (SELECT term, entity, count(*) AS b FROM u JOIN h USING (doc_id) GROUP BY ALL),
y AS (SELECT term, p, (b + {PRIOR} * p) / (n + {PRIOR}) AS estimate FROM x JOIN n USING (term) JOIN p USING (entity) WHERE -log2(p) >= {GAIN}),
z AS (SELECT term, min(-log2(estimate)) AS left_ FROM y WHERE -log2(estimate) <= {GENERALISE} AND log2(estimate / p) >= {GAIN} GROUP BY term),
k AS (SELECT doc_id, a, e, CASE WHEN left_ <= {REMOVE} THEN '' WHEN upper(v) = v AND length(v) > 1 THEN '[acronym]' WHEN upper(v[1]) = v[1] THEN '[name]' ELSE '[word]' END AS done FROM w JOIN z USING (term)),
bs AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY k, a) AS base, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone FROM s GROUP BY doc_id),
ts AS (SELECT doc_id, string_agg('term:' || a || ':' || e, ',' ORDER BY a) AS terms, string_agg(a || ':' || e || ':' || done, ',' ORDER BY a) AS actions, count(*) AS n_terms FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, terms) AS spans, coalesce(n_terms, 0) AS n_terms, coalesce(actions, '') AS actions
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ts USING (doc_id)
"""


OP5_SQL = private_data_sql("documents")
