"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a public model file form a lattice over each text. A piece's score is a whole number,
``-round(1000000 ln(1 + rank))`` with the rank of the piece in the file (Zipf's law as a unigram
model), so sums are exact. A character no piece holds is written in byte pieces, each far below any
other piece. N-best segmentation is a backward A* search whose heuristic is exact: the forward
Viterbi score of every place. A place need be left at most N times.

No piece crosses from a visible character to a following space mark, and line ends stand alone, so
a text is a row of independent units ("words"), and its lattice is their product. The forward and
backward scores of the distinct units of a batch are found together, column by column in numpy.
They also give each unit's gap to its second-best path (the best path over an edge off the best
one). Only the N - 1 units with the smallest gaps can differ in the N best segmentations of a text,
and only those are searched; their alternatives are then merged. The result is that of one search
over the whole text.

Decoding joins the pieces' bytes, turns space marks into spaces and drops the leading one. A space
mark that is really in a text is written in byte pieces, so every text comes back as it was.

One pass over the table in Arrow batches, cut into slices of bounded size; no shuffle. A worker
keeps a bounded table of units (emptied when full), so memory does not grow with the corpus.

Defined results: a null or empty text has no pieces, score 0 and one segmentation. Equal scores are
ordered by the search, always the same way. Repeated rows give a row each; other columns are not
read; an empty table gives an empty result. Fewer than N segmentations are returned where there are
no more.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tauframe.llm.text import table

MODEL = os.environ.get("TAUFRAME_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
NONE = np.int64(-(2**60))
SCALE = 1_000_000
BYTE_PENALTY = 20 * SCALE
#: A stand-in for a space mark that is really in the text (a code point no text can hold).
TRUE_MARK = "\ud800"
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_CHARS = 600_000
TABLE_UNITS = 300_000
TABLE_FOUND = 10_000


class Vocabulary:
    """Pieces, their scores, and a table from substring hashes to pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        # kinds in a model file: 1 ordinary piece, 6 byte
        self.index = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.byte = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * len(pieces)
        self.score = np.full(len(pieces), NONE, np.int64)
        for i, (p, s, kind) in enumerate(pieces):
            if kind == 6:
                self.byte[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
                self.score[i] = -round(SCALE * math.log(1 + len(pieces))) - BYTE_PENALTY
            elif kind == 1:
                self.bytes_of[i] = p.replace(MARK, " ").encode()
                self.score[i] = -round(SCALE * math.log(1 + min(-s, len(pieces))))
        self.score = np.append(self.score, NONE)  # at -1: no piece
        self.longest = max(map(len, self.index))
        self.crossing = [p for p in self.index if "\n" in p and len(p) > 1
                         or re.search(f"[^{MARK}]{MARK}", p)]
        if self.crossing:
            raise ValueError(f"pieces cross unit borders: {self.crossing[:5]}")
        keys = np.array([self._hash(p) for p in self.index], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(self.index.values(), np.int64)[order]
        top = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << 20) + 1))
        self.probes = int(np.diff(self.first).max())
        self.keys = np.append(self.keys, np.zeros(self.probes, np.uint64))
        self.ids = np.append(self.ids, np.zeros(self.probes, np.int64))
        self.start = np.cumsum([0, *map(len, self.bytes_of)])
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for none."""
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = self.first[(h >> np.uint64(44)).astype(np.int64)]
        out = np.full(h.shape, -1, np.int64)
        for k in range(self.probes):
            np.copyto(out, self.ids[at + k], where=self.keys[at + k] == h)
        return out

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[list((MARK if char == TRUE_MARK else char).encode("utf-8", "surrogatepass"))])

    def edges(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end: ``(begin, score, ids)`` of the pieces that end there."""
        out: list[list] = [[] for _ in range(len(unit) + 1)]
        for end in range(1, len(unit) + 1):
            for begin in range(max(0, end - self.longest), end):
                i = self.index.get(unit[begin:end])
                if i is not None:
                    out[end].append((begin, int(self.score[i]), (i,)))
            if unit[end - 1] not in self.index:
                ids = self.fallback(unit[end - 1])
                out[end].append((end - 1, int(self.score[list(ids)].sum()), ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a text's pieces."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        n = self.start[ids + 1] - self.start[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.blob[at].tobytes()[1:].decode("utf-8", "surrogatepass")


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return Vocabulary([(p.piece, p.score, p.type) for p in model.pieces])


def units(text: str) -> list[str]:
    """The independent parts of a text, with space marks; joined they are the marked text."""
    if not text:
        return []
    return UNIT.findall(MARK + text.replace(MARK, TRUE_MARK).replace(" ", MARK))


def search(vocab: Vocabulary, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best ``(score, ids)``: backward A*, forward Viterbi scores as heuristic."""
    edges = vocab.edges(unit)
    ahead = [0] + [int(NONE)] * len(unit)
    for end in range(1, len(unit) + 1):
        ahead[end] = max((ahead[b] + s for b, s, _ in edges[end]), default=int(NONE))
    heap, made, out, left = [(-ahead[-1], 0, len(unit), 0, None)], 1, [], [0] * (len(unit) + 1)
    while heap and len(out) < n:
        _, _, at, done, tail = heapq.heappop(heap)
        left[at] += 1
        if at == 0:
            ids: list[int] = []
            while tail is not None:
                ids.extend(tail[0])
                tail = tail[1]
            out.append((done, tuple(ids)))
        elif left[at] <= n:  # further ways through this place cannot be among the n best
            for begin, s, piece in edges[at]:
                if ahead[begin] > NONE:
                    heapq.heappush(heap, (-(ahead[begin] + done + s), made, begin, done + s, (piece, tail)))
                    made += 1
    return out


def viterbi(vocab: Vocabulary, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``score, gap, n_ids`` of each unit and all ids in a row; the gap to the second-best path is -1
    when there is none."""
    by_length: dict[int, list[int]] = {}
    for k, u in enumerate(batch):
        by_length.setdefault(len(u), []).append(k)
    order, got = [], []
    for size, members in by_length.items():
        rows = max(1, 100_000 // size)  # stays in cache
        for lo in range(0, len(members), rows):
            part = members[lo:lo + rows]
            order += part
            got.append(_columns(vocab, [batch[k] for k in part], size))
    if not order:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    score, gap, n, ids = (np.concatenate(x) for x in zip(*got))
    back = np.argsort(order)
    return score[back], gap[back], n[back], ids[_ragged((np.cumsum(n) - n)[back], n[back])]


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin[0] .. begin[0] + n[0] - 1, begin[1] .. in a row."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def _columns(vocab: Vocabulary, batch: list[str], size: int):
    """``viterbi`` for units of one length: a row per place, a column per unit."""
    codes = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.ascontiguousarray(codes.reshape(len(batch), size).T).astype(np.uint64) + np.uint64(1)
    most = min(vocab.longest, size)
    ids = np.full((most, size, len(batch)), -1, np.int32)
    scores, h = [], np.zeros_like(codes)
    bare = None
    for n in range(1, most + 1):
        h = h[:size - n + 1] * BASE + codes[n - 1:]
        got = vocab.look_up(h)
        score = vocab.score[got]  # the last one stands for no piece
        if n == 1:
            bare = got < 0
            for i, j in zip(*np.nonzero(bare)):
                score[i, j] = vocab.score[list(vocab.fallback(batch[j][i]))].sum()
        ids[n - 1, :size - n + 1] = got
        scores.append(score)
    ahead = np.full((size + 1, len(batch)), NONE, np.int64)
    behind = ahead.copy()
    ahead[0] = 0
    behind[size] = 0
    for end in range(1, size + 1):
        for n in range(1, min(most, end) + 1):
            np.maximum(ahead[end], ahead[end - n] + scores[n - 1][end - n], out=ahead[end])
    for begin in range(size - 1, -1, -1):
        for n in range(1, min(most, size - begin) + 1):
            np.maximum(behind[begin], behind[begin + n] + scores[n - 1][begin], out=behind[begin])
    best = ahead[size]
    second = np.full(len(batch), NONE, np.int64)
    on_best = np.zeros(len(batch), np.int64)
    # the longest piece at each place that lies on a best path, for the way back
    take = np.zeros((size, len(batch)), np.int8)
    for n in range(1, most + 1):
        total = ahead[:size - n + 1] + scores[n - 1] + behind[n:]
        hit = total == best
        on_best += hit.sum(0)
        take[:size - n + 1][hit] = n
        total[hit] = NONE
        np.maximum(second, total.max(0), out=second)
    lanes = np.arange(len(batch))
    at, path = np.zeros(len(batch), np.int64), np.full((size, len(batch)), -1, np.int32)
    used = np.zeros(len(batch), np.int64)
    go = lanes
    while len(go):
        n = take[at[go], go]
        got = ids[n - 1, at[go], go]
        path[at[go], go] = np.where(got < 0, -2, got)
        used[go] += 1
        at[go] += n
        go = go[at[go] < size]
    gap = np.where(on_best > used, 0, np.where(second > NONE // 2, best - second, -1))
    path = path.T
    flat, n_ids = path[path != -1].astype(np.int64), used.copy()
    if bare.any():  # write out the characters in bytes
        parts, lo = [], 0
        for j in range(len(batch)):
            own = flat[lo:lo + used[j]]
            lo += used[j]
            if (own == -2).any():
                place, full = np.flatnonzero(path[j] != -1), []
                for i, p in zip(own.tolist(), place.tolist()):
                    full.extend(vocab.fallback(batch[j][p]) if i == -2 else (i,))
                own = np.array(full, np.int64)
                n_ids[j] = len(own)
            parts.append(own)
        flat = np.concatenate(parts)
    return best, gap, n_ids, flat


class Encoder:
    """Encodes texts slice by slice with a bounded table of units."""

    def __init__(self, vocab: Vocabulary, n: int):
        self.vocab, self.n = vocab, n
        self.place: dict[str, int] = {}
        self.names: list[str] = []
        none = np.zeros(0, np.int64)
        self.score, self.gap, self.begin, self.size, self.uses = none, none, none, none, none
        self.pool = np.zeros(0, np.int32)
        self.found: dict[str, list] = {}

    def _shrink(self):
        """Keeps the half of the units that were used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:TABLE_UNITS // 2])
        self.names = [self.names[k] for k in keep.tolist()]
        self.place = {u: k for k, u in enumerate(self.names)}
        self.pool = self.pool[_ragged(self.begin[keep], self.size[keep])]
        self.score, self.gap, self.size = self.score[keep], self.gap[keep], self.size[keep]
        self.begin, self.uses = np.cumsum(self.size) - self.size, self.uses[keep] // 2
        self.found = {}

    def _learn(self, fresh: list[str]):
        score, gap, n, ids = viterbi(self.vocab, fresh)
        self.names += fresh
        self.score = np.append(self.score, score)
        self.gap = np.append(self.gap, np.where(gap < 0, np.iinfo(np.int64).max, gap))
        self.begin = np.append(self.begin, len(self.pool) + np.cumsum(n) - n)
        self.size = np.append(self.size, n)
        self.uses = np.append(self.uses, np.zeros(len(n), np.int64))
        self.pool = np.append(self.pool, ids.astype(np.int32))

    def _others(self, unit: str, score: int, ids: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
        """Other segmentations of a unit: ``(loss, ids)``, best first."""
        if unit not in self.found:
            if len(self.found) >= TABLE_FOUND:
                self.found = {}
            self.found[unit] = [(score - s, i) for s, i in search(self.vocab, unit, self.n) if i != ids]
        return self.found[unit]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, list]]]]:
        """``(ids, score, others)`` of each text; others: ``(score, [(begin, end, ids), ...])``,
        the pieces that replace ``ids[begin:end]``, best first, at most n - 1."""
        if len(self.place) > TABLE_UNITS:
            self._shrink()
        split = [units(t) for t in texts]
        place, fresh = self.place, []
        for u in set().union(*split) if split else ():
            if u not in place:
                fresh.append(u)
        if fresh:
            fresh.sort()
            place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
            self._learn(fresh)
        sizes = [len(us) for us in split]
        idx = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        self.uses += np.bincount(idx, minlength=len(self.uses))
        n = self.size[idx]
        ids = self.pool[_ragged(self.begin[idx], n)]
        ends, scores, gaps, lo = np.cumsum(n), self.score[idx], self.gap[idx], 0
        for size in sizes:
            hi = lo + size
            first = int(ends[lo] - n[lo]) if size else 0
            own = ids[first:int(ends[hi - 1])] if size else ids[:0]
            score = int(scores[lo:hi].sum())
            yield own, score, self._merge(idx[lo:hi], gaps[lo:hi], own, score, ends[lo:hi] - first, n[lo:hi])
            lo = hi

    def _merge(self, idx, gaps, ids, score, ends, n):
        want = self.n - 1
        if not want or not len(idx):
            return []
        near = range(len(idx)) if len(idx) <= want else np.sort(np.argpartition(gaps, want - 1)[:want]).tolist()
        best = [(0, ())]
        for k in near:
            if gaps[k] == np.iinfo(np.int64).max:
                continue
            begin, end = int(ends[k] - n[k]), int(ends[k])
            own = tuple(ids[begin:end].tolist())
            ways = self._others(self.names[idx[k]], int(self.score[idx[k]]), own)
            more = [(loss + d, ch + ((begin, end, i),)) for loss, ch in best for d, i in ways]
            best = sorted(best + more)[:self.n]
        return [(score - loss, list(ch)) for loss, ch in best[1:]]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut into slices of about ``SLICE_CHARS`` characters of text (column ``text``)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
        lo, held = 0, 0
        for k, s in enumerate(sizes):
            held += s
            if held >= SLICE_CHARS or k == len(sizes) - 1:
                part = batch.slice(lo, k + 1 - lo)
                yield part, [t or "" for t in part.column("text").to_pylist()]
                lo, held = k + 1, 0
        pa.default_memory_pool().release_unused()  # workers outlive their tasks


_WORKER: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, n: int) -> Encoder:
    """One per worker process: the vocabulary and its unit table outlive a task."""
    if (path, n) not in _WORKER:
        _WORKER[path, n] = Encoder(load(path), n)
    return _WORKER[path, n]


def encode_documents(docs: DataFrame, n: int = 4, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, score, others``: the best segmentation and how the next ones differ from it."""
    def run(batches):
        encoder = _encoder(path, n)
        change = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
        other = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(change))]))
        for part, texts in slices(batches):
            ids, score, others, ends = [], [], [], [0]
            for i, s, o in encoder.encode(texts):
                ids.append(i)
                ends.append(ends[-1] + len(i))
                score.append(s)
                others.append([{"score": v, "changes": [
                    {"begin": b, "end": e, "ids": list(w)} for b, e, w in ch]} for v, ch in o])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))),
                pa.array(score, pa.int64()), pa.array(others, other)],
                ["doc_id", "ids", "score", "others"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, score bigint, others array<struct<score:bigint,"
             "changes:array<struct<begin:int,end:int,ids:array<int>>>>>")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    def run(batches):
        vocab = _encoder(path, 1).vocab
        for batch in batches:
            lists = batch.column("ids")
            texts = [vocab.decode(lists[k].values.to_numpy()) if lists[k].is_valid else "" for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def describe_documents(docs: DataFrame, n: int = 4, path: str = MODEL) -> DataFrame:
    """Encodes and decodes every text where it stands and returns digests of the result:
    ``doc_id, n_pieces, score, ids_sha256`` (32-bit little-endian ids), ``n_best, scores`` (of all
    segmentations, comma-joined), ``others_sha256, round_trip``."""
    def run(batches):
        encoder = _encoder(path, n)
        for part, texts in slices(batches):
            cols = [[] for _ in range(7)]
            for text, (ids, score, others) in zip(texts, encoder.encode(texts)):
                full = []
                for _, changes in others:
                    w, at = [], 0
                    for b, e, new in sorted(changes):
                        w += [ids[at:b], np.array(new, np.int32)]
                        at = e
                    full.append(np.concatenate([*w, ids[at:]]).astype("<i4").tobytes())
                for c, v in zip(cols, (
                        len(ids), score, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), len(others) + 1,
                        ",".join(str(s) for s in (score, *(o[0] for o in others))),
                        hashlib.sha256(b"".join(full)).hexdigest(), encoder.vocab.decode(ids) == text)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()))]],
                ["doc_id", "n_pieces", "score", "ids_sha256", "n_best", "scores", "others_sha256", "round_trip"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_pieces bigint, score bigint, ids_sha256 string, n_best bigint, scores string, "
             "others_sha256 string, round_trip boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
