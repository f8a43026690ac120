"""Substring dedup: words in passages that an earlier document holds are removed.

A window is ``WINDOW`` consecutive words. Each window is routed by its minimizer (the least hash
among the ``GRAM``-word sequences in it), so equal windows meet in one shard whatever surrounds them;
windows in a row with one minimizer form a segment and travel together.

1. Minimizers seen in one document only cannot belong to a shared window. They are found by sorting
   packed hashes (about 12 bytes a segment); what repeats inside a slice of texts is sent once, so a
   passage in very many documents weighs no more than the number of slices.
2. Segments with a shared minimizer are sent, as distinct contents with their smallest document, to
   the shard of the minimizer. A shard holds a compressed FM-index (wavelet matrix) over its
   contents. Contents are streamed through it by backward search; sliding one word to the left drops
   the last word through the parent interval, so each window costs one step. A window's interval
   gives the smallest document that holds it.
3. Those numbers go back to the segments' documents, which remove every word under a window whose
   smallest document is not their own.

Texts move once, by document; the exchange serves all three uses. Nothing is gathered by key but
what a document holds itself.

Defined results: a null text has no words. Rows with equal ids are documents of one place in the
order: they do not remove words from each other. A row with a null id has no place in the order: it
neither loses words nor makes others lose any. Repeated rows give a row each. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm import tokens
from tauframe.llm.fm_index import FMIndex
from tauframe.llm.text import table, whole
from tauframe.session import materialise

WINDOW = 13
GRAM = 4
SLICE = 3_000_000
#: Index shards per partition; one is built at a time.
SHARDS = 4
_PLACE = np.uint64((1 << 28) - 1)


def segments(w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a slice: text, first word within the text, number of windows, minimizer."""
    n_words, empty = len(w.hash), np.zeros(0, np.int64)
    n = n_words - WINDOW + 1
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    if n_words > int(_PLACE):
        raise ValueError("a text of more than 268 million words")
    gram = tokens.sequences(w.hash, GRAM)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    reach, want = 1, WINDOW - GRAM + 1
    while reach < want:  # minima over growing runs of grams
        step = min(reach, want - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    inside = np.zeros(n, bool)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        inside[lo:max(lo, hi - WINDOW + 1)] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, np.zeros(0, np.uint64)
    home = (least[at] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], (home[1:] != home[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    text = np.searchsorted(w.first, at[first], side="right") - 1
    return text, at[first] - w.first[text], size, gram[home[first]]


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; equal lengths are not needed."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    body = b"".join([head, *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return np.int64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes) -> list[memoryview]:
    body = memoryview(pa.decompress(blob[8:], int(np.frombuffer(blob[:8], "<i8")[0]), codec="zstd", asbytes=True))
    n = int(np.frombuffer(body[:8], "<i8")[0])
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(body[8:8 * (n + 1)], "<i8")])
    return [body[lo:hi] for lo, hi in zip(ends, ends[1:])]


def _packed(g, doc, start, ids) -> bytes:
    """Minimizers (48 bits), places and the documents they are in (sorted), as one value."""
    used, doc = np.unique(doc, return_inverse=True)
    six = (g & np.uint64(2**48 - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return _squeezed(six, np.diff(doc, prepend=0).astype("<u4"), np.diff(start, prepend=0).astype("<i4"),
                     np.diff(ids[used], prepend=0).astype("<i8"))


def _unpacked(blob: bytes):
    six, doc, start, ids = _unsqueezed(blob)
    six = np.frombuffer(six, np.uint8).reshape(-1, 6)
    g = np.zeros((len(six), 8), np.uint8)
    g[:, :6] = six
    ids = np.cumsum(np.frombuffer(ids, "<i8"))
    return (g.view("<u8").ravel(), ids[np.cumsum(np.frombuffer(doc, "<u4").astype(np.int64))],
            np.cumsum(np.frombuffer(start, "<i4").astype(np.int64)))


def _spread(order: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the value differs anywhere among the entries with an equal key."""
    k, v = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    differs = np.minimum.reduceat(v, first) != np.maximum.reduceat(v, first)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(differs, np.diff(np.append(first, len(k))))
    return out


def _minimizers(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.text_slices(batches, size=SLICE):
            text, start, _, g = segments(tokens.words_of(texts))
            if not len(g):
                continue
            ids = part.column("doc_id").to_numpy()
            order = np.argsort(g, kind="stable")
            known = _spread(order, g, ids[text])
            # of what is known to repeat, the first is sent on; all are marked already
            lead = np.zeros(len(g), bool)
            lead[order] = np.concatenate([[True], g[order][1:] != g[order][:-1]])
            out = []
            if known.any():
                out.append((int(g[0] % np.uint64(parts)), True,
                            _packed(g[known], text[known], start[known], ids)))
            send = np.flatnonzero(lead | ~known)
            shard = (g[send] >> np.uint64(50)) % np.uint64(parts)
            by = np.argsort(shard, kind="stable")
            for piece in np.split(by, np.flatnonzero(np.diff(shard[by].astype(np.int64))) + 1):
                rows = np.sort(send[piece])
                out.append((int(shard[piece[0]]), False, _packed(g[rows], text[rows], start[rows], ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()),
                 pa.array([x[2] for x in out], pa.binary())], ["shard", "known", "blob"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose minimizer is in several documents."""
    held, marked = [], []
    for batch in batches:
        for known, blob in zip(batch.column("known").to_pylist(), batch.column("blob").to_pylist()):
            (marked if known else held).append(_unpacked(blob))
    if held:
        g, ids, start = (np.concatenate(x) for x in zip(*held))
        keep = _spread(np.argsort(g, kind="stable"), g, ids)
        marked.append((g[keep], ids[keep], start[keep]))
    if not sum(len(x[0]) for x in marked):
        return
    ids, start = (np.concatenate([x[k] for x in marked]) for k in (1, 2))
    for lo in range(0, len(ids), 200_000):
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[lo:lo + 200_000]), pa.array(start[lo:lo + 200_000].astype(np.int32))], ["doc_id", "start"])


def _wanted(batches: Iterator[pa.RecordBatch]):
    """Segments at the wanted places: part, texts' words, and arrays of the segments."""
    for part, texts in tokens.text_slices(batches, size=SLICE):
        text, start, size, g = segments(tokens.words_of(texts))
        lists = part.column("starts")
        keep = np.zeros(len(g), bool)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            lo, hi = bounds[k], bounds[k + 1]
            if hi > lo:
                want = lists[k].values.to_numpy() if lists[k].is_valid else []
                keep[lo:hi] = np.isin(start[lo:hi], want)
        split, contents, last = None, [], -1
        for t, s, n in zip(text[keep].tolist(), start[keep].tolist(), size[keep].tolist()):
            if t != last:
                split, last = texts[t].split(), t
            contents.append(b" ".join(split[s:s + n + WINDOW - 1]))
        yield part, text[keep], start[keep], g[keep], contents


def _keys(contents: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """96 bits of a digest of each content, as two numbers."""
    raw = b"".join([hashlib.blake2b(c, digest_size=12).digest() for c in contents])
    raw = np.frombuffer(raw, np.uint8).reshape(-1, 12)
    return (pa.array(np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()),
            pa.array(np.ascontiguousarray(raw[:, 8:]).view("<i4").ravel()))


def _contents(parts: int):
    """Distinct contents of a slice with their smallest document, a value per slice and shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, _, g, contents in _wanted(batches):
            ids, least, home = part.column("doc_id").to_numpy()[text].tolist(), {}, {}
            shard = ((g >> np.uint64(20)) % np.uint64(parts)).tolist()
            for c, i, k in zip(contents, ids, shard):
                if i < least.get(c, i + 1):
                    least[c] = i
                    home[c] = k
            by: dict[int, list[bytes]] = {}
            for c, k in home.items():
                by.setdefault(k, []).append(c)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(by), pa.int32()), pa.array([_squeezed(
                    np.frombuffer(b"\n".join(cs), np.uint8), np.array([least[c] for c in cs], "<i8"))
                    for cs in by.values()], pa.binary())], ["shard", "blob"])
    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's content key, document and first word."""
    for part, text, start, _, contents in _wanted(batches):
        at = pa.array(text)
        yield pa.RecordBatch.from_arrays([
            *_keys(contents), part.column("doc_id").take(at), part.column("tag").take(at),
            pa.array(start.astype(np.int32))], ["k1", "k2", "doc_id", "tag", "start"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of a partition, sorted: the smallest document of each window of each content."""
    least: dict[bytes, int] = {}
    last = None
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob")):
            if shard != last and least:
                yield from _search_shard(least)
                least = {}
            last = shard
            body, ids = _unsqueezed(blob.as_py())
            for c, i in zip(bytes(body).split(b"\n"), np.frombuffer(ids, "<i8").tolist()):
                if i < least.get(c, i + 1):
                    least[c] = i
    if least:
        yield from _search_shard(least)


def _search_shard(least: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    contents = list(least)
    w = tokens.words_of(contents)
    symbol = np.unique(w.hash, return_inverse=True)[1].astype(np.int64) + 1
    n = w.count()
    begin = w.first[:-1] + np.arange(len(n))  # one end mark after each content
    text = np.zeros(len(symbol) + len(n), np.int64)
    owner = np.repeat(np.arange(len(n)), n + 1)
    text[np.arange(len(symbol)) + np.repeat(np.arange(len(n)), n)] = symbol
    index = FMIndex(text, owner, np.fromiter(least.values(), np.int64, len(n)), WINDOW)
    for lo in range(0, len(n), 100_000):
        hi = min(lo + 100_000, len(n))
        found = index.least_of(text, begin[lo:hi], n[lo:hi] - WINDOW + 1)
        yield pa.RecordBatch.from_arrays([
            *_keys(contents[lo:hi]), pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))],
            ["k1", "k2", "least"])


def _cut(batches: Iterator[pa.RecordBatch], text_out: bool) -> Iterator[pa.RecordBatch]:
    for part, texts in tokens.text_slices(batches, size=SLICE):
        lists, own = part.column("covered"), part.column("tag").to_pylist()
        n_words, n_removed, out = [], [], []
        for k, t in enumerate(texts):
            split = t.split()
            n_words.append(len(split))
            begin = np.zeros(0, np.int32)
            if lists[k].is_valid:
                tags, runs = (lists[k].values.field(c) for c in ("tag", "begin"))
                mine = np.flatnonzero(tags.to_numpy() == own[k]).tolist()
                begin = np.concatenate([begin, *[runs[m].values.to_numpy() for m in mine]])
            if len(begin):
                turn = np.zeros(len(split) + 1, np.int64)
                np.add.at(turn, begin, 1)
                np.add.at(turn, begin + WINDOW, -1)
                gone = np.cumsum(turn)[:-1] > 0
                n_removed.append(int(gone.sum()))
                split = [w for w, g in zip(split, gone.tolist()) if not g]
            else:
                n_removed.append(0)
            kept = b" ".join(split)
            out.append(kept.decode() if text_out else hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text" if text_out else "kept_sha256"])


def remove_shared(docs: DataFrame, text_out: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed`` and ``kept_text`` (or ``kept_sha256``) of each row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if dict(docs.dtypes)["doc_id"] != "bigint":  # else left alone: a cast keeps exchanges from being shared
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # the tag tells rows with equal ids apart
    rows = docs.select("doc_id", whole("text").alias("text"), F.hash(whole("text")).alias("tag"))
    apart, rows = rows.where("doc_id is null"), rows.where("doc_id is not null")
    blobs = rows.select("doc_id", "text").mapInArrow(_minimizers(parts), "shard int, known boolean, blob binary")
    shared = materialise(
        blobs.repartition(parts, "shard").mapInArrow(_shared, "doc_id bigint, start int")
        .groupBy("doc_id").agg(F.collect_list("start").alias("starts")), "shared")
    hit = rows.join(shared, "doc_id")
    found = (hit.mapInArrow(_contents(SHARDS * parts), "shard int, blob binary")
             .repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_search, "k1 bigint, k2 int, least array<bigint>"))
    places = hit.mapInArrow(_places, "k1 bigint, k2 int, doc_id bigint, tag int, start int")
    covered = (places.join(found, ["k1", "k2"])
               .select("doc_id", "tag", F.filter(F.transform("least", lambda m, i: F.when(
                   m < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull()).alias("begin"))
               .groupBy("doc_id").agg(F.collect_list(F.when(F.size("begin") > 0, F.struct("tag", "begin")))
                                      .alias("covered")))
    full = rows.join(covered, "doc_id", "left").unionByName(apart, allowMissingColumns=True)
    name = "kept_text" if text_out else "kept_sha256"
    return full.select("doc_id", "text", "tag", "covered").mapInArrow(
        lambda b: _cut(b, text_out), f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared(table(spark, sf_dir, "documents", "doc_id", "text"), text_out=False)


SQL = {"op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(13) AS r(k)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""}
