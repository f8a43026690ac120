"""Fill-in-middle transformation by block rotation in place.

A text is cut into units (lines); prefix, middle and suffix end at two unit borders that a hash of
the document's id picks. The three sentinels are inserted in front of the segments in one bytearray,

    <P>prefix<M>middle<S>suffix

and one rotation (two adjacent blocks exchanged by three reversals) gives either form:

    psm   <P>prefix<S>suffix<M>middle     the last two blocks exchanged
    spm   <S>suffix<P>prefix<M>middle     the last block moved to the front

``restore`` finds the sentinels, turns the rotation back and takes the sentinels out. Reversals
swap mirrored pieces of at most ``PIECE`` bytes, so a text of any length needs one buffer and two pieces.

Rows are independent: one scan, no shuffle, and a lost executor costs its own tasks.

Defined results: a null text counts as empty. An empty text, and one that holds a sentinel itself,
stays as it is (form ``plain``). A null id is hashed as an empty one; rows that share an id are cut
by the same hash, repeated rows give a row each. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tauframe.llm import tokens
from tauframe.llm.text import table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PIECE = 1 << 16


@dataclass(frozen=True)
class Choice:
    """Seed and rates (percent) of the transformation."""

    seed: int = 7
    changed: int = 100
    spm: int = 50


def numbers(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide a document's cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))


def line_ends(text: bytearray) -> np.ndarray:
    """Where each line ends, its newline included."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    return ends


def reverse(buffer: np.ndarray, lo: int, hi: int) -> None:
    """Turns ``buffer[lo:hi]`` round in place."""
    while hi - lo > 1:
        k = min(PIECE, (hi - lo) // 2)
        left = buffer[lo:lo + k].copy()
        buffer[lo:lo + k] = buffer[hi - k:hi][::-1]
        buffer[hi - k:hi] = left[::-1]
        lo, hi = lo + k, hi - k


def rotate(data: bytearray, lo: int, cut: int, hi: int) -> None:
    """Exchanges the adjacent blocks ``[lo, cut)`` and ``[cut, hi)``."""
    buffer = np.frombuffer(data, np.uint8)
    reverse(buffer, lo, cut)
    reverse(buffer, cut, hi)
    reverse(buffer, lo, hi)


def transform(text: bytes, doc_id: int | None, choice: Choice = Choice()) -> tuple[bytearray, int, str, int, int]:
    """Output, number of lines, form, and where the middle begins and ends in ``text``."""
    data = bytearray(text)
    ends = line_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = numbers(choice.seed, doc_id)
    if not n or h3 % 100 >= choice.changed or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return data, n, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    begin, end = (int(ends[k - 1]) if k else 0 for k in (a, b))
    data[end:end] = SUFFIX
    data[begin:begin] = MIDDLE
    data[0:0] = PREFIX
    middle, suffix = len(PREFIX) + begin, len(PREFIX) + end + len(MIDDLE)
    form = "spm" if h4 % 100 < choice.spm else "psm"
    rotate(data, 0 if form == "spm" else middle, suffix, len(data))
    return data, n, form, begin, end


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``output`` was made from."""
    data = bytearray(output)
    if form == "plain":
        return data
    prefix, suffix, middle = (data.index(s) for s in (PREFIX, SUFFIX, MIDDLE))
    total = len(data)
    if form == "psm":  # back from prefix, suffix, middle
        rotate(data, suffix, middle, total)
        middle, suffix = suffix, suffix + total - middle
    else:  # back from suffix, prefix, middle
        rotate(data, 0, prefix, total)
        middle, suffix = middle - prefix, total - prefix
    del data[suffix:suffix + len(SUFFIX)]
    del data[middle:middle + len(MIDDLE)]
    del data[:len(PREFIX)]
    return data


def _chars(data: memoryview) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _transform(choice: Choice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.text_slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                out, n, form, begin, end = transform(text, doc_id, choice)
                own = memoryview(text)
                chars = (None, None) if form == "plain" else (_chars(own[:begin]), _chars(own[begin:end]))
                rows.append((doc_id, n, form, *chars, bytes(out)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                made, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in tokens.text_slices(batches, "output"):
        made = pa.array([bytes(restore(t, f)) for t, f in zip(texts, part.column("form").to_pylist())], pa.binary())
        yield part.append_column("restored", made.cast(pa.string()))


def fill_in_middle(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """``doc_id, n`` (lines), ``form, prefix_chars, middle_chars`` and ``output`` of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_transform(choice), SCHEMA)


def restore_texts(made: DataFrame) -> DataFrame:
    """``made`` (with ``form`` and ``output``) and the text each row was made from, ``restored``."""
    return made.mapInArrow(_restore, StructType([*made.schema, StructField("restored", StringType())]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore_texts(fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = {"op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
             sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, [list_reduce(list_transform(range(1, 9),
        lambda k: instr('0123456789abcdef', s[8 * g + k]) - 1), lambda a, b: 16 * a + b) FOR g IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
               OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
        array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""}
