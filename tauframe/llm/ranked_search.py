"""Ranked lexical search: term-at-a-time scoring with limited accumulators.

1. ``build_index`` scans whole texts and cuts them into blocks of documents. A block holds the
   postings (document, occurrences) of every term that a query asks for, the number of terms of each
   of its documents, and its document frequencies; it is written once to the shared folder.
2. The collection's figures (documents, terms, document frequencies) are sums over the blocks.
3. ``_search`` scores the blocks of a partition one after the other. An item's terms are taken rarest
   first. A document met for the first time gets an accumulator as long as the largest scores of
   the terms left can still lift it to the k-th partial score (of this block, or of what the earlier
   blocks have given); after that no accumulator is made any more and those that exist are updated
   exactly. So every returned score is exact and nothing that belongs to the best k is missed.
4. Each partition gives at most k rows per item; they are ranked in two steps, the first within
   salted parts of an item, so no task holds an item's rows of the whole collection.

Items are asked in blocks of about ``QUERY_BYTES`` of text, which bounds what a task is sent (their
terms, as part of the task) whatever the number of items; all documents are read for each block.

Defined results: a null text has no terms. Rows that share an id are documents of their own, also
those without an id, which come last among equal scores. Items that share an id are one item with
the terms of all its rows; an item without terms, and one that no document answers, has no rows.
Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauframe.llm import tokens
from tauframe.llm.text import table, whole
from tauframe.session import materialise

BEST = 50
QUERY_BYTES = 4_000_000
#: Postings after which a block is closed.
BLOCK = 2_000_000
SALTS = 64
#: Bytes of terms in lower case, all other ASCII as a blank.
TERM = np.where(np.array([c > 0x7F or chr(c).isalnum() for c in range(256)]), tokens.LOWER, 0x20).astype(np.uint8)
INDEX = "doc_id array<bigint>, size array<bigint>, term array<int>, df array<int>, doc array<int>, tf array<int>"


class Vocabulary:
    """The terms of a block of items, found in texts by hash and then byte by byte."""

    def __init__(self, terms: list[bytes]):
        words = tokens.words_of(terms)
        order = np.argsort(words.hash, kind="stable")
        self.terms = [terms[k] for k in order]
        self.hash = words.hash[order]
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)
        self.size = np.array([len(t) for t in self.terms], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def number(self, w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``w`` that hold a term, and which."""
        if not len(self.terms) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        at = np.flatnonzero((self.hash[found] == w.hash) & (self.size[found] == w.end - w.start))
        term = found[at]
        size = self.size[term]
        ends = np.cumsum(size)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        same = w.buffer[np.repeat(w.start[at], size) + step] == self.bytes[np.repeat(self.begin[term], size) + step]
        wrong = np.unique(np.repeat(np.arange(len(at)), size)[~same])
        return np.delete(at, wrong), np.delete(term, wrong)


def _blocks(vocabulary: Vocabulary):
    def block(doc_ids, sizes, parts) -> pa.RecordBatch:
        doc, term, tf = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        used, df = np.unique(term, return_counts=True)
        row = [doc_ids, sizes, used, df, doc, tf]
        kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(row, kinds)],
            ["doc_id", "size", "term", "df", "doc", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sizes, parts, held = [], [], [], 0
        for part, texts in tokens.text_slices(batches):
            w = tokens.words_of(texts, TERM)
            n = w.count()
            at, term = vocabulary.number(w)
            doc = np.searchsorted(w.first, at, side="right") - 1
            key, tf = np.unique(doc * (len(vocabulary.terms) + 1) + term, return_counts=True)
            own = n > 0  # a document without terms is none of the collection
            place = np.cumsum(own) - 1 + len(doc_ids)
            doc_ids += [i for i, o in zip(part.column("doc_id").to_pylist(), own.tolist()) if o]
            sizes += n[own].tolist()
            parts.append((place[key // (len(vocabulary.terms) + 1)], key % (len(vocabulary.terms) + 1), tf))
            held += len(key)
            if held >= BLOCK:
                yield block(doc_ids, sizes, parts)
                doc_ids, sizes, parts, held = [], [], [], 0
        if doc_ids:
            yield block(doc_ids, sizes, parts)
    return run


def build_index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Blocks of documents (``INDEX``); terms are numbered as in ``vocabulary``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(_blocks(vocabulary), INDEX), "postings")


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def score_block(item_terms: list[np.ndarray], ranks: np.ndarray, first: dict[int, int], count: np.ndarray,
                doc: np.ndarray, gain: np.ndarray, n_docs: int, floors: list[int], best: int):
    """For each item the documents of a block that may be among its best, with exact scores.

    ``first`` and ``count``: a term's postings in ``doc`` and ``gain``. ``floors``: scores that the
    best of earlier blocks reach. A document below its item's floor, or below the block's k-th best, may
    be left out; equal ones are given.
    """
    top = {t: int(gain[lo:lo + n].max()) for (t, lo), n in zip(first.items(), count.tolist())}
    place = {t: k for k, t in enumerate(first)}
    for item, terms in enumerate(item_terms):
        here = [t for t in terms[np.argsort(ranks[terms], kind="stable")].tolist() if t in first]
        left = sum(top[t] for t in here)
        total = np.zeros(n_docs, np.int64)
        held = np.zeros(0, np.int64)  # documents with an accumulator
        limit, opening = floors[item], True
        for t in here:
            lo = first[t]
            at, add = doc[lo:lo + count[place[t]]], gain[lo:lo + count[place[t]]]
            if opening and left < limit:
                opening = False  # what is left cannot lift a new document to the k-th partial score
            if opening:
                new = at[(total[at] == 0) & (add > 0)]
                total[at] += add
                held = np.concatenate([held, new])
                if len(held) >= best:
                    limit = max(limit, int(np.partition(total[held], len(held) - best)[len(held) - best]))
            else:
                known = total[at] > 0
                total[at[known]] += add[known]
            left -= top[t]
        score = total[held]
        if len(held) > best:
            limit = max(limit, int(np.partition(score, len(held) - best)[len(held) - best]))
        keep = score >= max(limit, 1)
        yield item, held[keep], score[keep]


def _better(ids: np.ndarray, null: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` rows: highest score, then smallest id, rows without an id last."""
    return np.lexsort((ids, null, -score))[:best]


def _search(item_ids: list, item_terms: list[np.ndarray], weights: np.ndarray, df: np.ndarray,
            n_docs: int, n_terms: int, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in item_ids]
        floors = [1] * len(item_ids)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].values for n in batch.schema.names}
                null = row["doc_id"].is_null().to_numpy(zero_copy_only=False)
                ids = row["doc_id"].fill_null(0).to_numpy()
                term, count, doc, tf = (row[c].to_numpy().astype(np.int64) for c in ("term", "df", "doc", "tf"))
                size = row["size"].to_numpy()
                if 50 * int(size.max()) * n_docs < 2**63:
                    length = 50 + 50 * size * n_docs // n_terms
                else:
                    length = np.array([50 + 50 * s * n_docs // n_terms for s in size.tolist()], np.int64)
                gain = np.repeat(weights[term], count) * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc]))
                first = dict(zip(term.tolist(), (np.cumsum(count) - count).tolist()))
                for item, at, score in score_block(item_terms, df, first, count, doc, gain, len(ids), floors, best):
                    rows = [np.concatenate(x) for x in zip(held[item], (ids[at], null[at], score))]
                    order = _better(*rows, best)
                    held[item] = tuple(x[order] for x in rows)
                    if len(order) == best:
                        floors[item] = int(held[item][2][-1])
        size = [len(h[0]) for h in held]
        if sum(size):
            ids, null, score = (np.concatenate(x) for x in zip(*held))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(size)), size), pa.int32()),
                pa.array(ids, pa.int64(), mask=null), pa.array(score)], ["item", "doc_id", "score"])
    return run


def parsed_items(items: DataFrame) -> DataFrame:
    """``item_id, terms``: the distinct terms of all rows of each item."""
    word = F.explode(F.split(F.translate(whole("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                             "[\\x00-/:-`{-\\x7F]+"))
    return (items.select("item_id", word.alias("term")).where("term <> ''")
            .groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")))


def _ranked(rows: DataFrame, best: int, *more: str) -> DataFrame:
    order = Window.partitionBy("item", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each item."""
    kind = items.schema["item_id"].dataType
    parsed = materialise(parsed_items(items), "items")
    size = parsed.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
    n_blocks = 1 + size // QUERY_BYTES
    found = [_search_items(docs, parsed.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b), best)
             for b in range(n_blocks)]
    return reduce(DataFrame.unionAll, found).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _search_items(docs: DataFrame, items: DataFrame, best: int) -> DataFrame:
    """One block of items, small enough for every task to hold."""
    spark = docs.sparkSession
    asked = [(r.item_id, r.terms) for r in items.collect()]
    vocabulary = Vocabulary(sorted({t.encode() for _, ts in asked for t in ts}))
    index = build_index(docs, vocabulary)
    one = index.agg(F.sum(F.size("doc_id")).alias("n"),
                    F.sum(F.aggregate("size", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("terms")).first()
    df = np.zeros(len(vocabulary.terms) + 1, np.int64)
    for r in (index.select(F.explode(F.arrays_zip("term", "df")).alias("t")).groupBy("t.term")
              .agg(F.sum("t.df").alias("df")).collect()):
        df[r.term] = r.df
    number = {t.decode(): k for k, t in enumerate(vocabulary.terms)}
    item_terms = [np.array([number[t] for t in ts], np.int64) for _, ts in asked]
    rows = index.mapInArrow(_search([i for i, _ in asked], item_terms, term_weights(one.n or 0, df), df, one.n or 0,
                                    one.terms or 1, best), "item int, doc_id bigint, score bigint")
    rows = _ranked(rows.withColumn("salt", F.spark_partition_id() % SALTS), best, "salt").drop("rank")
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(asked)], items.select(
        F.lit(0).alias("item"), "item_id").schema)
    return _ranked(rows, best).join(names, "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = {"op11_ranked_search": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY r, term),
t AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, c GROUP BY term),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN t USING (term), c GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""}
