"""Benchmark decontamination over a distributed positional inverted index.

1. The benchmark's terms are numbered; windows of ``WINDOW`` consecutive words (the whole item, if it
   has fewer) are its phrases.
2. ``build_index`` stores the postings (document, place) of every such term in the documents, and one
   mark per document at the place after its last word, so the index also knows every document's
   length. Texts are read once; nothing is shuffled for it.
3. A phrase's terms are ordered by how often the index holds them. Postings of the rarest one, moved
   by its offset in the phrase, are the places where the phrase may begin. They are intersected
   with the postings of the second rarest, moved likewise, and what is left with all the others.
   What every list holds is an exact occurrence.
4. Proximity: the ``NEAR_TERMS`` rarest terms of an item, all within ``NEAR_WORDS`` consecutive words.

All lists are rows (document, term, place), joined on all three, so neither a frequent term, nor a
passage that very many documents hold, nor a very long text is a group of its own. Only tables that
grow with the benchmark alone are small enough to be broadcast; they are written first, so the
planner knows their size and decides itself. Only built-in functions run.

Defined results: a null text has no words. Rows that share an id are documents of their own;
repeated rows give a row each, and a null id is kept. Items that share an id count as one, an item
without an id counts under an empty one, an item without words occurs nowhere. Empty tables give no
hits, or no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauframe.llm.text import table, whole
from tauframe.session import materialise

WINDOW = 10
NEAR_TERMS = 4
NEAR_WORDS = 20
#: Number of the mark that stands after a document's last word.
END = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-/:-`{-\\x7F]+"
KEY = ["own", "doc"]


def words(text: Column | str) -> Column:
    """Runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(whole(text), UPPER, LOWER), BETWEEN), "")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def numbered_terms(items: DataFrame) -> DataFrame:
    """``term, tid``: the distinct words of all items, and an empty word for the mark."""
    found = items.select(F.explode(words("text")).alias("term")).distinct()
    found = found.withColumn("tid", F.monotonically_increasing_id())
    mark = items.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(END).cast("long").alias("tid"))
    return materialise(found.unionByName(mark), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``doc_id, own, doc, tid, place`` of the numbered terms. ``own`` and ``doc`` (hashes of id
    and text) name a text; rows with both equal have equal postings. Marks alone carry the id."""
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("own"),
                       F.xxhash64(whole("text")).alias("doc"),
                       F.posexplode(F.concat(words("text"), F.array(F.lit("")))).alias("place", "term"))
    own_id = F.when(F.col("tid") == END, F.col("doc_id")).alias("doc_id")
    return materialise(rows.join(terms, "term").select(own_id, *KEY, "tid", "place"), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """``tid, held``: how often the index holds each term."""
    return materialise(index.groupBy("tid").agg(F.count(F.lit(1)).alias("held")), "held")


def _phrases(items: DataFrame, window: int) -> DataFrame:
    """``item, phrase``: the distinct windows of each item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (w.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("s"))
            .select("item", F.slice("w", F.col("s"), F.lit(window)).alias("phrase")).distinct())


def ordered_phrases(items: DataFrame, terms: DataFrame, held: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """``item, wid`` and ``wid, size, rank, offset, tid``: a phrase's terms by rank, rarest first."""
    found = materialise(_phrases(items, window), "phrases")
    each = materialise(found.select("phrase").distinct().withColumn("wid", F.monotonically_increasing_id()), "phrases")
    members = found.join(each, "phrase").select("item", "wid")
    rows = (each.select("wid", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
            .join(terms, "term").join(held, "tid", "left"))
    by = Window.partitionBy("wid").orderBy(F.coalesce("held", F.lit(0)), "term", "offset")
    rows = rows.select("wid", "size", (F.row_number().over(by) - 1).alias("rank"), "offset", "tid")
    return materialise(members, "members"), materialise(rows, "ranked")


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """``own, doc, wid, start, size``: every exact occurrence of every phrase, once."""
    lists = index.select(*KEY, "tid", "place")
    part = lambda which: ranked.where(which).select("wid", "size", "rank", "offset", "tid")
    moved = (lists.join(part("rank = 0").drop("rank"), "tid").select(*KEY, "wid", "size", (F.col("place") - F.col("offset")).alias("start"))
             .where("start >= 0"))

    def held(candidates: DataFrame, which: str, among: DataFrame) -> DataFrame:
        """Candidates with each of the wanted terms that stands at its place."""
        probe = candidates.join(part(which).drop("size"), "wid")
        probe = probe.withColumn("place", F.col("start") + F.col("offset")).drop("offset")
        return probe.join(among, [*KEY, "tid", "place"], "left_semi")

    short = moved.where("size < 2").drop_duplicates()
    # a term may be the second of many phrases: only its postings are wanted, and the table of such
    # terms is written, so the planner can broadcast it and no term is a group of its own
    seconds = materialise(part("rank = 1").select("tid").distinct(), "seconds")
    two = materialise(held(moved.where("size > 1"), "rank = 1", lists.join(seconds, "tid", "left_semi"))
                      .select(*KEY, "wid", "size", "start"), "candidates")
    full = (held(two, "rank > 1", lists).groupBy(*KEY, "wid", "size", "start")
            .agg(F.bit_or(_bit(F.col("rank"))).alias("bits"))
            .where(F.col("bits") == _bit(F.col("size")) - 4).drop("bits"))
    return short.unionByName(two.where("size = 2").drop_duplicates()).unionByName(full)


def proximity_matches(index: DataFrame, items: DataFrame, terms: DataFrame, held: DataFrame,
                      n_terms: int = NEAR_TERMS, within: int = NEAR_WORDS) -> DataFrame:
    """``own, doc, item``: texts that hold an item's ``n_terms`` rarest terms (all, if it has fewer)
    in some stretch of ``within`` words, in any order."""
    by = Window.partitionBy("item").orderBy(F.coalesce("held", F.lit(0)), "term")
    rare = (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         F.explode(words("text")).alias("term")).distinct()
            .join(terms, "term").join(held, "tid", "left")
            .select("item", "tid", F.row_number().over(by).alias("slot")).where(F.col("slot") <= n_terms)
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item"))))
    seen = index.select(*KEY, "tid", "place").join(materialise(rare, "rare"), "tid")
    ahead = Window.partitionBy(*KEY, "item").orderBy("place").rangeBetween(0, within - 1)
    return (seen.withColumn("bits", F.bit_or(_bit(F.col("slot") - 1)).over(ahead))
            .where(F.col("bits") == _bit(F.col("n")) - 1).select(*KEY, "item").distinct())


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items`` (sorted ids, as texts) and ``n_near`` of each row."""
    if not 1 <= window <= 62:
        raise ValueError("a window has 1 to 62 words")
    terms = numbered_terms(items)
    index = build_index(docs, terms)
    held = term_counts(index)
    members, ranked = ordered_phrases(items, terms, held, window)
    found = materialise(phrase_matches(index, ranked), "matches")
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")
    hits = (found.select(*KEY, place).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit")))
    which = (found.select(*KEY, "wid").distinct().join(members, "wid").groupBy(*KEY)
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    near = proximity_matches(index, items, terms, held).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near"))
    rows = index.where(F.col("tid") == END).select("doc_id", *KEY, F.col("place").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return (rows.join(hits, KEY, "left").join(which, KEY, "left").join(near, KEY, "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"), "n_near")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = {"op12_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item FROM places JOIN p USING (n, s)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, range(10) AS o(k) WHERE k < n GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
tok AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS place FROM d),
rare AS (SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY coalesce(held, 0), term) AS slot
         FROM (SELECT DISTINCT item, unnest(w) AS term FROM b) LEFT JOIN
           (SELECT term, count(*) AS held FROM tok GROUP BY term) USING (term) QUALIFY slot <= 4),
near AS (SELECT r, item, bit_or(1 << (slot - 1)) OVER (PARTITION BY r, item ORDER BY place
           RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS bits, n
         FROM tok JOIN rare USING (term) JOIN (SELECT item, count(*) AS n FROM rare GROUP BY item) USING (item)),
close AS (SELECT r, count(DISTINCT item) AS n_near FROM near WHERE bits = (1 << n) - 1 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r) LEFT JOIN close USING (r)"""}
