"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds a posting, document and position, for every occurrence of a benchmark term in the documents; a join with
the benchmark's terms keeps out all other words before anything is written. It is laid out by documents, as the scan found
them, so that building it needs no shuffle. Terms are counted from the index. A window of benchmark words is then sought
from its rarest term: that term's postings, moved back by its offset, are the list of places where the window might begin;
the list is intersected with the second-rarest term's, moved by its own offset, and what is left with those of all other
terms. The benchmark's terms and windows are broadcast as long as they are few (``BROADCAST_TERMS``,
``BROADCAST_WINDOWS``), and shuffled beyond that.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_name, written

WORDS = 10
#: Rows of the benchmark's side that may be broadcast: terms of a few bytes, windows of at most WORDS terms.
BROADCAST_TERMS, BROADCAST_WINDOWS = 1_000_000, 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of a row that each document has in the index beside its postings; it stands after the last word.
END = -1


def words(text: Column) -> Column:
    """The words of a text with A-Z put in lower case; none of a null text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``(item, terms)``: every run of ``size`` words of an item, or all its words if it has fewer. Null and wordless texts
    have none."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return w.select("item", "w", F.explode(starts).alias("s")).select("item", F.expr(f"slice(w, s, {size})").alias("terms")).distinct()


def benchmark_terms(wins: DataFrame) -> tuple[DataFrame, int]:
    """``(term, tid)`` of every term of the windows, and how many there are."""
    terms = written(wins.select(F.explode("terms").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), "decontamination-terms")
    return terms, terms.count()


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, text_col: str = "text", keep: tuple[str, ...] = (), rid: str | None = None) -> DataFrame:
    """The written index ``(rid, n_words, tid, pos, *keep)``: a posting for every occurrence of a row of ``terms(term, tid)``,
    and for every document a row with ``tid`` of ``END``, which alone has the columns ``keep``.

    ``rid`` names a column that tells documents apart; without it they are numbered as the index is written.
    """
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    d = docs.select(number.alias("rid"), *keep, words(F.col(text_col)).alias("w"))
    e = d.select("rid", *keep, F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit("\x00")))).alias("pos", "term"))
    marks = terms.union(docs.sparkSession.range(1).select(F.lit("\x00"), F.lit(END).cast("long")))
    hit = e.join(_small(marks, n_terms, BROADCAST_TERMS), "term")
    return written(hit.select("rid", "n_words", "tid", "pos", *[F.when(F.col("tid") == END, F.col(c)).alias(c) for c in keep]), "decontamination-index")


def rarest_first(wins: DataFrame, terms: DataFrame, index: DataFrame, n_terms: int) -> tuple[DataFrame, DataFrame, int]:
    """``(pattern, size, by)`` of the distinct windows, ``by`` being their ``(n, off, tid)`` from the rarest term on, how often
    each occurs in the index included; the items of each pattern; and how many patterns there are. A window with a term
    that no document has cannot occur and goes."""
    counts = index.where(F.col("tid") != END).groupBy("tid").agg(F.count("*").alias("n"))
    known = terms.join(_small(counts, n_terms, BROADCAST_TERMS), "tid")
    patterns = written(wins.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("pattern", F.monotonically_increasing_id()), "decontamination-windows")
    each = patterns.select("pattern", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term")).join(_small(known, n_terms, BROADCAST_TERMS), "term")
    ranked = each.groupBy("pattern").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "off", "tid"))).alias("by"))  # at most a window's words
    ranked = written(ranked.where(F.size("by") == F.col("size")), "decontamination-ranked")
    return ranked, patterns.select("pattern", F.explode_outer("items").alias("item")), ranked.count()


def _of_terms(index: DataFrame, ranked: DataFrame, rank: int, n_terms: int) -> DataFrame:
    """The postings of the terms that have that rank in some window."""
    asked = ranked.where(F.col("size") > rank).select(F.col("by")[rank]["tid"].alias("tid")).distinct()
    return index.join(_small(asked, n_terms, BROADCAST_TERMS), "tid", "left_semi")


def phrase_matches(index: DataFrame, ranked: DataFrame, n_patterns: int, n_terms: int) -> DataFrame:
    """``(rid, pattern, start, length)`` of every exact occurrence of a window, written.

    Lists of possible beginnings are intersected on document and place: the rarest term's with the second-rarest's, and
    those that are left with all others', which only the documents still in question are asked for.
    """
    entry = lambda rank, name: F.get(F.col("by"), F.lit(rank))[name]
    heads = ranked.select("pattern", "size", "by", entry(0, "tid").alias("tid"), entry(0, "off").alias("off"))
    places = index.join(_small(heads, n_patterns, BROADCAST_WINDOWS), "tid").withColumn("start", F.col("pos") - F.col("off"))
    places = places.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))).select("rid", "start", "pattern", "size", "by")
    single = places.where("size = 1").select("rid", "pattern", "start", F.lit(1).alias("length"))
    second = _of_terms(index, ranked, 1, n_terms).select("rid", "tid", "pos")
    pairs = places.where("size > 1").select("rid", "start", "pattern", entry(1, "tid").alias("tid"), (F.col("start") + entry(1, "off")).alias("pos"))
    left = written(pairs.join(second, ["rid", "tid", "pos"]).select("rid", "start", "pattern"), "decontamination-pairs")
    rids = left.select("rid").distinct()
    sought = left.join(_small(ranked, n_patterns, BROADCAST_WINDOWS), "pattern").select("rid", "start", "pattern", "size", F.explode_outer(F.expr("slice(by, 3, size)")).alias("x"))
    asked = index.join(_small(rids, left.count(), BROADCAST_TERMS), "rid", "left_semi").select("rid", "tid", "pos")
    two = sought.where("size = 2").select("rid", "pattern", "start", F.lit(2).alias("length"))
    found = sought.where("size > 2").select("rid", "start", "pattern", "size", F.col("x.tid").alias("tid"), (F.col("start") + F.col("x.off")).alias("pos")).join(asked, ["rid", "tid", "pos"])
    full = found.groupBy("rid", "start", "pattern").agg(F.count("*").alias("n"), F.first("size").alias("length")).where("n = length - 2")
    out = written(single.union(two).union(full.select("rid", "pattern", "start", "length")), "decontamination-matches")
    discard(left)
    return out


def proximity_matches(index: DataFrame, ranked: DataFrame, n_patterns: int, n_terms: int, slop: int) -> DataFrame:
    """``(rid, pattern, pos)`` of every occurrence of a window's rarest term around which all of the window's terms stand, in
    any order, among as many consecutive words as the window has and ``slop`` more. A term that the window repeats counts
    once."""
    heads = ranked.select("pattern", (F.col("size") + F.lit(slop - 1)).alias("width"), F.array_distinct(F.col("by.tid")).alias("tids"), F.col("by")[0]["tid"].alias("tid"))
    places = index.join(_small(heads, n_patterns, BROADCAST_WINDOWS), "tid").select("rid", F.col("pos").alias("at"), "pattern", "width", "tids")
    single = places.where(F.size("tids") == 1).select("rid", "pattern", F.col("at").alias("pos"))
    near = lambda other: F.abs(other["pos"] - F.col("at")) <= F.col("width")
    second = _of_terms(index, ranked, 1, n_terms).select("rid", "tid", "pos")
    more = places.where(F.size("tids") > 1).withColumn("second", F.col("tids")[1])
    left = more.join(second.withColumnRenamed("rid", "r"), (F.col("rid") == F.col("r")) & (F.col("second") == F.col("tid")) & near(second)).select("rid", "at", "pattern", "width", "tids").distinct()
    sought = left.select("*", F.explode("tids").alias("tid"))
    found = sought.join(index.select("rid", "tid", "pos"), ["rid", "tid"]).where(F.abs(F.col("pos") - F.col("at")) <= F.col("width"))
    around = found.groupBy("rid", "at", "pattern").agg(F.first("width").alias("width"), F.first("tids").alias("tids"), F.collect_set(F.struct("pos", "tid")).alias("all"))  # at most two windows of words
    within = F.expr("exists(`all`, x -> x.pos <= at and size(array_except(tids, transform(filter(`all`, y -> y.pos >= x.pos and y.pos <= x.pos + width), y -> y.tid))) = 0 and x.pos + width >= at)")
    return single.union(around.where(within).select("rid", "pattern", F.col("at").alias("pos")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row for each row of ``docs``.

    A word inside any occurrence of a window of ``size`` consecutive item words is hit; occurrences may overlap. Null
    texts have no words, and an item without words has no window; an item with a null id hits words but isn't counted or
    named; items that share an id count once. Null and repeated document ids keep their rows, each judged by its own text.
    Empty tables give an empty result, or one without hits. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wins = windows(benchmark, item_col, item_text_col, size)
    terms, n_terms = benchmark_terms(wins)
    index = build_index(rows, terms, n_terms, keep=("doc_id",))
    ranked, items, n_patterns = rarest_first(wins, terms, index, n_terms)
    hits = phrase_matches(index, ranked, n_patterns, n_terms)
    span = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    spans = hits.groupBy("rid").agg(F.sort_array(F.collect_set(span)).alias("spans"))  # no more than a text has words
    named = hits.select("rid", "pattern").distinct().join(items, "pattern").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))  # no more than the benchmark has items
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.to)), 'to', greatest(a.to, x.e)), a -> a.n)")
    per = spans.join(named, "rid").select("rid", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    every = index.where(F.col("tid") == END).select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    joined = every.join(per, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no window of the benchmark occurs.

    Rows are told apart by numbers that a written copy of ``docs`` gives them, so repeated rows are judged one by one, and
    ``docs`` may come from any plan. A null text, and one without words, stays; an item without words matches nothing; with
    an empty benchmark all rows stay, and an empty table gives an empty result. Columns keep their names, whatever they are.
    """
    rid = free_name(docs.columns, "rid")
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "decontamination-docs")
    wins = windows(benchmark, item_col, item_text_col, size)
    terms, n_terms = benchmark_terms(wins)
    index = build_index(rows, terms, n_terms, text_col, rid=rid)
    ranked, _, n_patterns = rarest_first(wins, terms, index, n_terms)
    hit = written(phrase_matches(index, ranked, n_patterns, n_terms).select(F.col("rid").alias(rid)).distinct(), "decontamination-hit")
    discard(index)
    return rows.join(_small(hit, hit.count(), BROADCAST_TERMS), rid, "left_anti").drop(rid)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: the whole ``documents`` table against the whole ``benchmark`` table."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, p FROM (
    SELECT item, least(10, len(w)) AS k, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') for i in range(1, greatest(2, len(w) - 8))]) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, x.s AS s, x.p AS p FROM (
    SELECT rid, k, unnest([{{'s': i, 'p': array_to_string(w[i:i + k - 1], ' ')}} for i in range(1, len(w) - k + 2)]) AS x FROM d, ks WHERE len(w) >= k)),
m AS (SELECT rid, s, k, item FROM dw JOIN win USING (k, p)),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(generate_series(s, s + k - 1)) AS pos FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
