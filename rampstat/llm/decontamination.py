"""Benchmark decontamination with a distributed positional inverted index.

The index stores, for the words that the benchmark uses, a posting (term,
document, position) for every place in the training documents. A window is a run
of words of a benchmark item. Its terms are ranked by their number of postings;
the lists of the rarest two, moved back by the terms' offsets in the window, are
intersected first, and only where both agree are the lists of the other terms
looked up. What remains after all terms are exact phrase matches; with ``slop``
over 0 every term may lie that many words from its place (proximity matches).

Postings are spread by document and place, never gathered by term, so a word or
passage that a third of all documents hold is no hot key. The window tables are
the benchmark's, small; they are broadcast after being counted and
joined by shuffle beyond ``BROADCAST_ROWS``.

Defined cases: a null or empty text has no words and no hits; an item of fewer
words than a window is one window, an item without words has none; items that repeat
a text are counted each; rows that repeat an id and a text give equal rows; rows
that share an id but not a text are kept apart; a null document id comes back
null; a null item id is named ``null``; empty tables give no rows, and an empty
benchmark leaves every document clean. Texts are indexed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rampstat.llm.common import ascii_lower, broadcast_below, given_id, known_id, save, table, text_of

WINDOW = 10
BROADCAST_ROWS = 1 << 20
#: What lies between words, once A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text as it came.
GAP_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ROW = ["did", "th"]


def pieces(text: Column, gap: str = GAP) -> Column:
    """Maximal runs of 0-9, letters a-z and characters beyond ASCII; the first piece is
    empty after a leading gap, the last one after a trailing gap."""
    return F.split(text, gap, -1)


def word_count(text: Column) -> Column:
    p = pieces(text, GAP_RAW)
    ends = (F.get(p, F.lit(0)) == "").cast("long") + ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("long")
    return F.size(p).cast("long") - ends


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``did`` and ``th`` (hash of the text) name a document, ``t`` is its lowered text."""
    return named(docs, id_col, text_col).withColumn("t", ascii_lower(F.col("t")))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(known_id(F.col(id_col)).alias("did"), text_of(F.col(text_col).cast("string")).alias("t"))
    return d.select("did", F.hash("t").alias("th"), "t")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as rows of their words (``win``, ``len``, ``off``, ``word``), and
    which items hold which window (``item``, ``win``)."""
    i = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                     F.filter(pieces(ascii_lower(text_of(F.col(text_col).cast("string")))), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    held = i.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda k: F.slice("w", k, size))).alias("words"))
    held = save(held.select("item", F.xxhash64(F.array_join("words", " ")).alias("win"), "words").distinct(), "windows")
    own = held.groupBy("win").agg(F.first("words").alias("words"))
    return own.select("win", F.size("words").alias("len"), F.posexplode("words").alias("off", "word")), held.select("item", "win")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``terms`` (``word``, ``term``), a saved table of postings:
    ``term``, ``did``, ``th``, ``pos``."""
    d = rows_of(docs, id_col, text_col).select(*ROW, pieces(F.col("t")).alias("p"))
    d = d.select(*ROW, (F.get("p", F.lit(0)) == "").cast("int").alias("lead"), F.posexplode("p").alias("at", "word")).select(
        *ROW, (F.col("at") - F.col("lead")).alias("pos"), "word")
    return save(d.join(broadcast_below(terms, BROADCAST_ROWS), "word").select("term", *ROW, "pos"), "postings")


def ranked(own: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """The windows' rows with ``term`` and ``rank`` (1: the fewest postings). A window
    with a word that no document holds occurs nowhere and is left out."""
    n = postings.groupBy("term").agg(F.count("*").alias("n"))
    t = own.join(terms, "word").join(n, "term").select("win", "len", "off", "term", "n")
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy("n", "off")))
    whole = t.groupBy("win").agg(F.count("*").alias("found"), F.first("len").alias("l")).where("found = l").select("win")
    return save(t.join(whole, "win").select("win", "len", "off", "term", "rank"), "ranked")


def at_places(candidates: DataFrame, rest: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """The candidates' other terms (``rest``) that ``lists`` has in their places:
    ``win``, the document, ``start``, ``off``."""
    # rows that repeat an id and text have each posting several times
    want = candidates.distinct().join(broadcast_below(rest, BROADCAST_ROWS), "win").withColumn("pos", F.col("start") + F.col("off"))
    if slop:
        want = want.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    found = want.join(lists.distinct(), [*ROW, "pos", "term"])
    return found.select("win", *ROW, "start", "off").distinct() if slop else found.select("win", *ROW, "start", "off")


def matches(postings: DataFrame, ranks: DataFrame, slop: int = 0) -> DataFrame:
    """Where windows occur: ``win``, ``len``, the document, and ``start``, the place of the
    window's first word as its rarest term has it. ``slop`` 0: exact phrases."""
    small = lambda df: broadcast_below(df, BROADCAST_ROWS)
    rarest = ranks.where("rank = 1").select("term", "win", "off")
    first = postings.join(small(rarest), "term").select("win", *ROW, (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second = ranks.where("rank = 2")
    lists = postings.join(small(second.select("term").distinct()), "term")
    both = save(at_places(first, second.select("win", "off", "term"), lists, slop).select("win", *ROW, "start"), "candidates")
    alone = first.distinct().join(small(ranks.where("len = 1").select("win")), "win")  # windows of one word
    rest = ranks.where("rank > 2").select("win", "off", "term")
    rows = save(both.select(*ROW).distinct(), "rows")
    lists = postings.join(broadcast_below(rows, BROADCAST_ROWS), ROW, "left_semi")
    full = at_places(both, rest, lists, slop).groupBy("win", *ROW, "start").agg(F.count("*").alias("more"))
    lengths = small(ranks.where("rank = 1").select("win", "len"))
    full = full.join(lengths, "win").where(F.col("more") == F.col("len") - 2)
    two = both.join(lengths, "win").where("len = 2")
    cols = ["win", "len", *ROW, "start"]
    return full.select(cols).union(two.select(cols)).union(alone.join(lengths, "win").select(cols))


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The matches of all windows, a saved table (see ``matches``), and which items
    hold which window."""
    own, held = windows(items, item_col, item_text_col, size)
    terms = save(own.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    postings = index(docs, terms, id_col, text_col)
    return save(matches(postings, ranked(own, terms, postings), slop), "matches"), held


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: ``did``, ``th``, ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``items`` (sorted ids, as strings, of the items that occur)."""
    found, held = find(docs, items, size, 0, id_col, text_col, item_col, item_text_col)
    places = found.select(*ROW, "start", "len").distinct().select(*ROW, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
    hit = places.distinct().groupBy(*ROW).agg(F.count("*").alias("n_hit"))
    own = found.select(*ROW, "win").distinct().join(broadcast_below(held, BROADCAST_ROWS), "win").groupBy(*ROW).agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    dirty = hit.join(own, ROW)
    d = named(docs, id_col, text_col).select(*ROW, word_count(F.col("t")).alias("n_words"))
    return d.join(dirty, ROW, "left").select(*ROW, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                                             F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """The rows without any occurrence of a window, all their columns as they are."""
    found = save(find(docs, items, WINDOW, 0, id_col, text_col, item_col, item_text_col)[0].select(*ROW).distinct(), "dirty")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, known_id(F.col(id_col)).alias("did"), F.hash(text_of(F.col(text_col).cast("string"))).alias("th"))
    return keyed.join(broadcast_below(found, BROADCAST_ROWS), ROW, "left_anti").select("row.*")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(given_id(F.col("did")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS x
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS x
      FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(k)),
m AS (SELECT g.doc_id, g.k, g.n, win.item_id FROM g JOIN win ON g.x = win.x AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
