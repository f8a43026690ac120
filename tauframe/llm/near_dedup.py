"""Near-duplicate documents by an LSH forest, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles (ASCII lower case). Its signature is ``HASHES``
minima over the set. Each of ``TREES`` trees sorts the documents by its own run of signature values
(``MIN_DEPTH`` of them make a bucket, the following ones refine the order), so neighbours share the
longest prefixes. Links have a Jaccard index of 3/4 or more; one of exactly 3/4 meets in no tree with
probability (1 - 0.75^3)^32 = 2.4e-8.

Documents with equal sets are one node from the start (found by a 128-bit digest of the set), numbered
by its smallest id; where sets share that id, all but one are numbered above all ids.
Components need no pair within a component twice, so candidates are confirmed in three steps:

1. each node goes to its most crowded bucket; buckets are cut along the sorted order into runs of
   ``RUN`` nodes, which share one node with the next run, and each run is linked inside one task;
2. each component in a bucket sends one delegate; delegates next to each other in the sorted order
   are confirmed, until nothing more is joined;
3. the nodes of buckets of at most ``DENSE`` nodes that still hold several components come together
   with their texts; all signatures of different components are compared, and every pair agreeing in
   ``LEAST_AGREE`` values or more (a link agrees in fewer with probability under 1e-6) is confirmed.
   Only links leave a task;
4. in larger buckets every node outside the largest component is compared likewise with all other
   components of the whole bucket, in cells of two blocks of about ``BLOCK`` nodes. Pairs that met in
   a bucket of an earlier tree are left to it.

So a link meets with the probability of ``MIN_DEPTH`` values everywhere. No partner or candidate is
dropped. The work of step 4 is the nodes outside the largest component times the bucket. Texts travel
for candidates only. What gathers by key is bounded: runs by ``RUN``, buckets by ``DENSE``, cells by
two blocks, delegates by components per bucket; everything else is combined before its shuffle.

Defined results: fewer than 5 words are one shingle; no words (or a null text) have an empty set and
are linked with nothing. Rows sharing an id are one document, also with different texts: their sets
are linked from the start. A row with a null id is linked with nothing, has a null component and is
kept. An empty table gives an empty result. Other columns are not read. Ids are below 2^62.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauframe.llm import tokens
from tauframe.llm.components import components, saved
from tauframe.llm.text import table
from tauframe.session import materialise

SHINGLE = 5
TREES = 32
MIN_DEPTH = 3
HASHES = TREES * MIN_DEPTH
LABEL = 6
RUN = 256
DENSE = 8192
BLOCK = 4096
LEAST_AGREE = 51
_FACTORS = tokens.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = tokens.words_of(texts, tokens.LOWER)
    full, out = tokens.sequences(w.hash, SHINGLE), []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        n = hi - lo
        if n >= SHINGLE:
            out.append(np.unique(full[lo:hi - SHINGLE + 1]))
        elif n:
            out.append(tokens.sequences(w.hash[lo:hi], n) ^ np.uint64(n))
        else:
            out.append(full[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of ``HASHES`` hash functions over sets that are not empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    lo = 0
    while lo < len(sets):  # groups that stay in cache
        hi, held = lo + 1, len(sets[lo])
        while hi < len(sets) and held + len(sets[hi]) <= 40_000:
            held += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo:hi - 1])])
        y = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _FACTORS[k], out=y)
            out[lo:hi, k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        lo = hi
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in tokens.text_slices(batches):
        sets = shingle_sets(texts)
        some = [k for k, s in enumerate(sets) if len(s)]
        sig = signatures([sets[k] for k in some])
        sigs: list[bytes | None] = [None] * len(sets)
        for row, k in enumerate(some):
            sigs[k] = sig[row].tobytes()
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "set_key", "sig"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _tree_values(sig: np.ndarray, tree: int, n: int) -> np.ndarray:
    """The first ``n`` values of a tree's order (further ones are those of the next trees)."""
    return sig[:, (tree * MIN_DEPTH + np.arange(n)) % HASHES]


def _bucket(values: np.ndarray, tree: int) -> np.ndarray:
    h = tokens.sequences(np.array([tree], np.uint64), 1).repeat(len(values))
    for k in range(values.shape[1]):
        h = tokens.mix(h * np.uint64(31) + values[:, k].astype(np.uint64))
    return ((h & ~np.uint64(31)) | np.uint64(tree)).view(np.int64)  # the tree can be read back


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = _matrix(batch.column("sig"))
            keys = [_bucket(_tree_values(sig, t, MIN_DEPTH), t) for t in range(TREES)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys)), pa.concat_arrays([batch.column("node")] * TREES)], ["bucket", "node"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place in the sorted order of the bucket's tree, as bytes that sort alike."""
    for batch in batches:
        if batch.num_rows:
            sig = _matrix(batch.column("sig"))
            trees = batch.column("bucket").to_numpy() & 31
            at = (trees[:, None] * MIN_DEPTH + np.arange(LABEL)) % HASHES
            label = np.take_along_axis(sig, at, 1).astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("bucket", "node")]
                + [pa.array([r.tobytes() for r in label], pa.binary())], ["bucket", "node", "label"])


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and label become runs; a full run's last node begins the next one."""
    bucket, run, n, last = None, 0, 0, None
    for batch in batches:
        runs, nodes = [], []
        for b, v in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist()):
            if b != bucket:
                bucket, run, n = b, hash((b, v)), 0
            elif n == RUN:
                run, n = hash((b, v)), 1
                runs.append(run)
                nodes.append(last)
            runs.append(run)
            nodes.append(v)
            n, last = n + 1, v
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(nodes, pa.int64())], ["run", "node"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 times the intersection reaches 75 times the union."""
    if min(len(a), len(b)) * 4 < max(len(a), len(b)) * 3:
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


class _Sets:
    """Union-find over a run's places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int):
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, "run"):
        sets = shingle_sets([t.encode() for t in group.column("text").to_pylist()])
        sig, nodes = _matrix(group.column("sig")), group.column("node").to_pylist()
        found, union = [], _Sets(len(nodes))
        for i in range(1, len(nodes)):
            agree = (sig[:i] == sig[i]).sum(1)
            for j in np.argsort(-agree, kind="stable").tolist():  # likeliest first
                if agree[j] < LEAST_AGREE:
                    break
                if union.top(i) != union.top(j) and linked(sets[i], sets[j]):
                    union.join(i, j)
                    found.append((nodes[i], nodes[j]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            one, two = (shingle_sets([t.encode() for t in part.column(c).to_pylist()]) for c in ("ta", "tb"))
            keep = [k for k in range(len(one)) if linked(one[k], two[k])]
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], ["a", "b"])


def _link_mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components of a bucket (enough of them to join what can be joined)."""
    for group in _groups(batches, "bucket"):
        sig, nodes = _matrix(group.column("sig")), group.column("node").to_pylist()
        _, comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)
        texts, sets, union, found = group.column("text"), {}, _Sets(int(comp.max()) + 1), []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets([texts[i].as_py().encode()])[0]
            return sets[i]

        for i in range(1, len(nodes)):
            others = np.flatnonzero(comp[:i] != comp[i])
            if not len(others):
                continue
            agree = (sig[others] == sig[i]).sum(1)
            for k in np.argsort(-agree, kind="stable").tolist():  # likeliest first
                if agree[k] < LEAST_AGREE:
                    break
                j = int(others[k])
                if union.top(comp[i]) != union.top(comp[j]) and linked(shingles(i), shingles(j)):
                    union.join(int(comp[i]), int(comp[j]))
                    found.append((nodes[i], nodes[j]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _met_before(sig: np.ndarray, one: np.ndarray, tree: int) -> np.ndarray:
    """Which rows share a bucket with ``one`` in a tree before ``tree``."""
    alike = (sig[:, :tree * MIN_DEPTH] == one[:tree * MIN_DEPTH]).reshape(len(sig), tree, MIN_DEPTH)
    return alike.all(2).any(1)


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a cell's guests and its hosts of other components."""
    for group in _groups(batches, "cell"):
        sig, node = _matrix(group.column("sig")), group.column("node").to_numpy()
        _, comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)
        guest, minor = (np.array(group.column(c).to_pylist(), bool) for c in ("guest", "minor"))
        bucket, hosts = group.column("bucket").to_numpy(), np.flatnonzero(~guest)
        texts, sets, union, found = group.column("text"), {}, _Sets(int(comp.max()) + 1), []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets([texts[i].as_py().encode()])[0]
            return sets[i]

        for i in np.flatnonzero(guest).tolist():
            # two nodes outside the largest component are guest and host once
            others = hosts[(comp[hosts] != comp[i]) & (bucket[hosts] == bucket[i])
                           & (~minor[hosts] | (node[hosts] > node[i]))]
            agree = (sig[others] == sig[i]).sum(1)
            others, agree = others[agree >= LEAST_AGREE], agree[agree >= LEAST_AGREE]
            fresh = ~_met_before(sig[others], sig[i], int(bucket[i]) & 31)
            others, agree = others[fresh], agree[fresh]
            for k in np.argsort(-agree, kind="stable").tolist():  # likeliest first
                j = int(others[k])
                if union.top(comp[i]) != union.top(comp[j]) and linked(shingles(i), shingles(j)):
                    union.join(int(comp[i]), int(comp[j]))
                    found.append((int(node[i]), int(node[j])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one, two = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(
        _check_pairs, "a bigint, b bigint")


def _numbered_sets(signed: DataFrame) -> DataFrame:
    """``set_key, node, low, text_key``: each distinct set with its number, its smallest id, and a text of
    that id which has the set."""
    lows = (signed.where("sig is not null and doc_id is not null").groupBy("set_key")
            .agg(F.min("doc_id").alias("low"), F.min_by("text_key", "doc_id").alias("text_key"))
            .withColumn("key", F.xxhash64("set_key")))
    firsts = lows.groupBy("low").agg(F.min("key").alias("first"))
    above = F.col("key").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    return lows.join(firsts, "low").select(
        "set_key", F.when(F.col("key") == F.col("first"), F.col("low")).otherwise(above).alias("node"), "low", "text_key")


def _shared_ids(places: DataFrame) -> DataFrame:
    """Links between the nodes that have rows of one id."""
    several = places.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    return places.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    signed = materialise(docs.mapInArrow(
        _sign, "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, sig binary"), "signatures")
    sets = materialise(_numbered_sets(signed), "sets")
    nodes = materialise(
        signed.join(sets, (signed["set_key"] == sets["set_key"]) & (F.col("doc_id") == F.col("low")))
        .select("node", "sig").dropDuplicates(["node"]), "nodes")
    # a row without words is a node of its own under its id
    places = materialise(signed.select("doc_id", "n_shingles", "set_key").join(sets.select("set_key", "node"), "set_key", "left")
                         .select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")), "places")
    met = materialise(nodes.mapInArrow(_plant, "bucket bigint, node bigint")
                      .withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"), "buckets")

    # 1. runs of the most crowded buckets
    home = met.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("h")).select("node", "h.bucket")
    texts = materialise(
        home.select("node").join(nodes, "node").join(sets.select("node", "low", "text_key"), "node")
        .join(docs.withColumnRenamed("doc_id", "low"), ["low", "text_key"])
        .dropDuplicates(["low", "text_key", "node"]).select("node", "sig", "text"), "texts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("bucket", "label", "node")
    runs = (home.join(nodes, "node").select("bucket", "node", "sig")
            .mapInArrow(_label, "bucket bigint, node bigint, label binary")
            .repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .mapInArrow(_cut_runs, "run bigint, node bigint"))
    links = saved(
        runs.join(texts, "node").repartition(parts, "run").sortWithinPartitions("run", "node")
        .mapInArrow(_link_runs, "a bigint, b bigint").unionByName(_shared_ids(places)), "linked")
    comp = components(links)

    # 2. delegates of components, next to each other in a bucket's order
    tried = None

    def placed(buckets: DataFrame) -> DataFrame:
        """Rows with components, of the buckets that hold more than one."""
        rows = buckets.select("bucket", "node").join(comp, "node", "left").withColumn(
            "comp", F.coalesce("comp", "node"))
        mixed = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
        return rows.join(mixed.select("bucket"), "bucket")

    def accept(found: DataFrame) -> bool:
        """Joins components by the links found; whether there were any."""
        nonlocal comp
        found = saved(found, "linked")
        if found.isEmpty():
            return False
        # components are the nodes of what has been found so far
        joined = components(
            found.join(comp.alias("p"), F.col("a") == F.col("p.node"), "left").select(
                F.coalesce("p.comp", "a").alias("a"), "b")
            .join(comp.alias("q"), F.col("b") == F.col("q.node"), "left").select(
                "a", F.coalesce("q.comp", "b").alias("b")))
        fresh = joined.join(comp.select("node"), "node", "left_anti")
        comp = saved(
            comp.join(joined.withColumnRenamed("comp", "up").withColumnRenamed("node", "comp"), "comp", "left")
            .select("node", F.coalesce("up", "comp").alias("comp")).unionByName(fresh), "components")
        return True

    def confirm(pairs: DataFrame) -> bool:
        """Confirms pairs not tried before; whether any was a link."""
        nonlocal tried
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        return accept(_confirmed(pairs, texts))

    while True:
        delegates = placed(met).groupBy("bucket", "comp").agg(F.min("node").alias("node"))
        labelled = delegates.join(nodes, "node").select("bucket", "node", "sig").mapInArrow(
            _label, "bucket bigint, node bigint, label binary")
        beside = Window.partitionBy("bucket").orderBy("label", "node")
        pairs = (labelled.withColumn("p", F.lag("node").over(beside)).where("p is not null")
                 .select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")))
        if not confirm(pairs):
            break

    # 3. all pairs of different components that agree enough
    mixed = (placed(met.where(F.col("n") <= DENSE)).join(nodes, "node").join(texts.select("node", "text"), "node")
             .select("bucket", "node", "comp", "sig", "text")
             .repartition(parts, "bucket").sortWithinPartitions("bucket", "node"))
    accept(mixed.mapInArrow(_link_mixed, "a bigint, b bigint"))

    # 4. the whole of dense buckets: nodes outside the largest component with all the others
    dense = met.where(F.col("n") > DENSE)
    if not dense.isEmpty():
        wide = materialise(placed(dense), "dense")
        shares = (wide.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
                  .groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("n")))
        blocks = materialise(shares.select(
            "bucket", F.col("most.comp").alias("largest"), F.ceil(F.col("n") / BLOCK).alias("across"),
            F.ceil((F.col("n") - F.col("most.k")) / BLOCK).alias("down")), "blocks")
        rows = wide.join(blocks, "bucket").withColumn("minor", F.col("comp") != F.col("largest"))

        def seats(rows: DataFrame, guest: bool) -> DataFrame:
            own, other = ("down", "across") if guest else ("across", "down")
            places = rows.select(
                "bucket", "node", "comp", "minor", F.lit(guest).alias("guest"),
                F.pmod(F.xxhash64("node"), F.col(own)).alias("mine"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("theirs"))
            cell = ("mine", "theirs") if guest else ("theirs", "mine")
            return places.select("bucket", "node", "comp", "minor", "guest", F.xxhash64("bucket", *cell).alias("cell"))

        cells = (seats(rows.where("minor"), True).unionByName(seats(rows, False))
                 .join(nodes, "node").join(texts.select("node", "text"), "node")
                 .select("cell", "bucket", "node", "comp", "minor", "guest", "sig", "text")
                 .repartition(parts, "cell").sortWithinPartitions("cell", "node"))
        accept(cells.mapInArrow(_link_cells, "a bigint, b bigint"))

    rows = places.join(comp, "node", "left")
    same = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("comp", "node", "doc_id"))
    return rows.select("doc_id", "n_shingles", same.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs``, columns unchanged, without the documents that are not the first of their group."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = {"op9_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (s)
         WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM meet JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
         WHERE 100 * k >= 75 * (p.n + q.n - k)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM documents
         UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a) c USING (doc_id)"""}
