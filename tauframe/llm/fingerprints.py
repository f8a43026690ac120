"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs (lines); a line is cut after its punctuation marks, so that an edit touches a
small branch. What is still longer than ``LONG`` code points is cut after words whose digest starts
with 0 or 1, and a word of that length after such characters, so texts without punctuation or blanks
have small branches too. Concatenated leaves give back the text exactly. A section is a run of
leaves that ends after a leaf whose digest starts with 0 or 1, so cuts follow content and an
insertion moves no later section. Section digests are SHA-256 over their leaves' digests, and the
root is SHA-256 over the sections' digests: equal roots mean equal texts.

A fingerprint is one string, ``root/section:leaf,leaf/section:leaf...``, with the root in full, 16
hexadecimal digits per section and 8 per leaf. Two fingerprints are compared from the root down:
only branches whose digests differ are entered.

Only built-in functions run. The one join on texts (``pair_with_next``) moves each text once and a
quarter: the text exchange is shared by both uses, and only the wanted beginning of a neighbour
travels to its reader. Neighbours are found on ids alone, by a range partitioning and one row per
partition, never by one global window.

Defined results: a null text counts as empty (no leaves; the root of nothing). Repeated rows give
one result row each. The next document of an id is the next larger id; where several rows share
that id, the one with the least beginning, then the least fingerprint, counts. A null id has no
neighbour: the next text is then empty and its likeness null. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauframe.llm.text import settled, span, table, whole
from tauframe.session import materialise

CUT = "(?<=\n)|(?<=[.!?,;:|] )|(?<=[。！？、，；：])"
#: A digest below it (one in eight) ends a run.
SECTION_END = "2"
LONG = 200


def _ends(items: Column, digest: Callable[[Column], Column]) -> Column:
    """Places of the items after which a run ends: those whose digest says so, and the last."""
    return F.filter(span(F.size(items) - 1), lambda i: (digest(F.get(items, i)) < SECTION_END)
                    | (i == F.size(items) - 1))


def _runs(items: Column, ends: Column) -> Column:
    start = lambda j: F.coalesce(F.get(ends, j - 1) + 1, F.lit(0))
    return F.transform(ends, lambda e, j: F.slice(items, start(j) + 1, e - start(j) + 1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.flatten(F.transform(F.array(value), use))


def _pieces(part: Column) -> Column:
    """A long part, cut after the words (in a long word: the characters) whose digest says so."""
    units = F.flatten(F.transform(F.split(part, "(?<= )"), lambda w: F.when(
        F.char_length(w) > LONG, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))
    digest = lambda u: F.sha2(u, 256)
    return _let(units, lambda u: _let(_ends(u, digest), lambda ends: F.transform(
        _runs(u, ends), lambda run: F.array_join(run, ""))))


def leaves(text: Column | str) -> Column:
    """The text's leaves, in order."""
    return F.filter(F.flatten(F.transform(F.split(whole(text), CUT), lambda s: F.when(
        F.char_length(s) > LONG, _pieces(s)).otherwise(F.array(s)))), lambda s: s != "")


def with_fingerprint(df: DataFrame, text: str, name: str = "fingerprint", settle: bool = True) -> DataFrame:
    """``df`` with the fingerprint of a text column. ``settle`` keeps later filters from being
    rewritten below it."""
    own = [c for c in df.columns if c != name]
    df = df.select(F.col(text).alias("_text"), F.struct(*own).alias("_row"))
    df = df.withColumn("_leaf", F.transform(leaves("_text"), lambda s: F.sha2(s, 256)))
    df = df.withColumn("_end", _ends(F.col("_leaf"), lambda d: d))
    df = df.withColumn("_part", _runs(F.col("_leaf"), F.col("_end")))
    df = df.withColumn("_node", F.transform(
        "_part", lambda p: F.sha2(F.array_join(p, ""), 256)))
    body = F.zip_with("_node", "_part", lambda n, p: F.concat(
        F.substring(n, 1, 16), F.lit(":"),
        F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), ",")))
    made = F.array_join(F.concat(F.array(F.sha2(F.array_join("_node", ""), 256)), body), "/")
    return df.select(*[F.col(f"_row.`{c}`") for c in own], (settled(made) if settle else made).alias(name))


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def sections(fingerprint: Column) -> Column:
    """``digest:leaf,leaf...`` of each section."""
    return F.filter(F.split(F.substring(fingerprint, 66, 2**31 - 1), "/"), lambda s: s != "")


def _leaves(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda s: F.split(F.substring(s, 18, 2**31 - 1), ",")))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the shared leaves over both sides' leaves. Sections that both sides
    hold count with all their leaves; only the others are opened and compared leaf by leaf."""
    def compared(s: Column) -> Column:
        alike = F.size(F.array_distinct(_leaves(F.array_intersect(s["a"], s["b"]))))
        own = lambda x, y: F.array_distinct(_leaves(F.array_except(s[x], s[y])))
        return _let(F.struct(alike.alias("same"), own("a", "b").alias("a"), own("b", "a").alias("b")), lambda f: F.array(
            2.0 * (f["same"] + F.size(F.array_intersect(f["a"], f["b"]))) / (2 * f["same"] + F.size(f["a"]) + F.size(f["b"]))))

    both = F.struct(sections(a).alias("a"), sections(b).alias("b"))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.get(_let(both, compared), F.lit(0)))


def differing(a: Column, b: Column) -> Column:
    """The branches of ``a`` that ``b`` lacks: section and leaf numbers, counted from 0.

    Sections found unchanged in ``b`` are not entered.
    """
    sa, sb = sections(a), sections(b)
    there = _leaves(sb)
    missing = F.filter(F.transform(sa, lambda s, i: F.struct(i.alias("section"), s.alias("s"))),
                       lambda x: ~F.array_contains(sb, x["s"]))
    leaves = F.flatten(F.transform(missing, lambda x: F.transform(
        F.split(F.substring(x["s"], 18, 2**31 - 1), ","),
        lambda d, k: F.struct(x["section"].alias("section"), k.alias("leaf"), d.alias("digest")))))
    return F.when(root(a) == root(b), F.filter(leaves, lambda x: F.lit(False))).otherwise(
        F.filter(leaves, lambda x: ~F.array_contains(there, x["digest"])))


def next_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each distinct id with the next larger one; the largest is followed by the smallest."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).alias("id")).where("id is not null").distinct()
    ids = materialise(ids.repartitionByRange(parts, "id")
                      .withColumn("part", F.spark_partition_id()), "ids")
    # one row per range partition: their first ids close the gaps between partitions
    firsts = ids.groupBy("part").agg(F.min("id").alias("first"))
    order = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(
        F.lead("first").over(order),
        F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).alias("after"))
    inside = Window.partitionBy("part").orderBy("id")
    return (ids.withColumn("follows", F.lead("id").over(inside)).join(after, "part")
            .select("id", F.coalesce("follows", "after").alias("next_id")))


def edited_text(text: Column, beginning: Column) -> Column:
    """The last quarter of the code points replaced by as many (or all) of ``beginning``."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, 1, n - k), F.substring(beginning, 1, k))


def pair_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint, beginning, next_fingerprint`` for each row of ``docs``."""
    # rows without an id apart, so that both uses below have the same filter and share one exchange
    texts = docs.select("doc_id", whole("text").alias("text"))
    apart, rows = (with_fingerprint(texts.where(f"doc_id is {x}"), "text", settle=False)
                   for x in ("null", "not null"))
    wanted = (docs.select("doc_id", F.floor(F.char_length(whole("text")) / 4).cast("int").alias("k"))
              .groupBy("doc_id").agg(F.max("k").alias("k"))
              .join(next_ids(docs), F.col("doc_id") == F.col("id"))
              .select(F.col("doc_id").alias("reader"), F.col("next_id").alias("doc_id"), "k"))
    ahead = (rows.join(wanted, "doc_id")
             .select("reader", F.struct(F.substring("text", F.lit(1), F.col("k")).alias("beginning"),
                                        F.col("fingerprint").alias("next_fingerprint")).alias("n"))
             .groupBy(F.col("reader").alias("doc_id")).agg(F.min("n").alias("n")))
    paired = rows.join(ahead, "doc_id", "left").select(
        "doc_id", "text", "fingerprint", F.coalesce("n.beginning", F.lit("")).alias("beginning"),
        "n.next_fingerprint")
    return paired.unionByName(apart.select("*", F.lit("").alias("beginning"),
                                           F.lit(None).cast("string").alias("next_fingerprint")))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_with_next(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        edited_text(F.col("text"), F.col("beginning")).alias("edited"), "fingerprint",
        "next_fingerprint")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint",
        F.round(likeness(F.col("fingerprint"), F.col("edited_fingerprint")), 9).alias("near_edited"),
        F.round(likeness(F.col("fingerprint"), F.col("next_fingerprint")), 9).alias("near_next"),
        F.size(differing(F.col("edited_fingerprint"), F.col("fingerprint"))).cast("long")
        .alias("n_new_leaves"))


#: Leaves by a mark set after each cut, everything else as lists.
_CUT = r"""string_split(regexp_replace(replace({t}, chr(10), chr(10) || chr(1)), '([.!?,;:|] |[。！？、，；：])', '\1' || chr(1), 'g'), chr(1))"""
_UNITS = r"""flatten(list_transform(string_split(replace(s, ' ', ' ' || chr(1)), chr(1)), lambda w: CASE WHEN length(w) > 200
  THEN string_split(w, '') ELSE [w] END))"""
_TREE = rf"""list_transform(list_filter(flatten(list_transform({_CUT}, lambda s: CASE WHEN length(s) > 200 THEN string_split(
  array_to_string(list_transform({_UNITS}, lambda u: u || CASE WHEN sha256(u)[1] IN ('0', '1') THEN chr(1) ELSE '' END), ''), chr(1))
  ELSE [s] END)), lambda s: s <> ''), lambda s: sha256(s))"""
_OPENED = "list_distinct(flatten(list_transform({s}, lambda s: string_split(s[18:], ','))))"


def _near(a: str, b: str) -> str:
    same, ra, rb = (_OPENED.format(s=s) for s in (
        f"list_intersect({a}, {b})", f"list_filter({a}, lambda x: NOT list_contains({b}, x))",
        f"list_filter({b}, lambda x: NOT list_contains({a}, x))"))
    return f"2.0 * (len({same}) + len(list_intersect({ra}, {rb}))) / (2 * len({same}) + len({ra}) + len({rb}))"


SQL = {"op4_document_fingerprints": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt,
        coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nxt_id
      FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, text[:length(text) - length(text) // 4] || nxt[:length(text) // 4] AS edited FROM n),
l AS (SELECT doc_id, 0 AS side, {_TREE.format(t='text')} AS l FROM e
      UNION ALL SELECT doc_id, 1, {_TREE.format(t='edited')} FROM e),
leaf AS (SELECT doc_id, side, unnest(l) AS h, unnest(range(len(l))) AS i FROM l),
sec AS (SELECT *, coalesce(sum((h[1] IN ('0', '1'))::INT) OVER (PARTITION BY doc_id, side ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM leaf),
node AS (SELECT doc_id, side, s, sha256(string_agg(h, '' ORDER BY i)) AS node,
         string_agg(h[:8], ',' ORDER BY i) AS ls FROM sec GROUP BY ALL),
fp AS (SELECT doc_id, side, sha256(string_agg(node, '' ORDER BY s)) AS root,
       list(node[:16] || ':' || ls ORDER BY s) AS secs,
       sha256(string_agg(node, '' ORDER BY s)) || '/'
       || string_agg(node[:16] || ':' || ls, '/' ORDER BY s) AS fp FROM node GROUP BY ALL),
f AS (SELECT l.doc_id, l.side, list_transform(l.l, lambda x: x[:8]) AS leaves, coalesce(secs, []) AS secs,
      coalesce(root, sha256('')) AS root, coalesce(fp, sha256('')) AS fp
      FROM l LEFT JOIN fp USING (doc_id, side)),
j AS (SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
      a.fp AS fingerprint, b.fp AS edited_fingerprint, a.root AS ra, b.root AS rb, c.root AS rc,
      a.leaves AS la, b.leaves AS lb, a.secs AS sa, b.secs AS sb, c.secs AS sc
      FROM e JOIN f a ON a.doc_id = e.doc_id AND a.side = 0
      JOIN f b ON b.doc_id = e.doc_id AND b.side = 1
      JOIN f c ON c.doc_id = e.nxt_id AND c.side = 0)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  round(CASE WHEN ra = rb THEN 1.0 ELSE {_near('sa', 'sb')} END::DOUBLE, 9)
    AS near_edited,
  round(CASE WHEN ra = rc THEN 1.0 ELSE {_near('sa', 'sc')} END::DOUBLE, 9)
    AS near_next,
  len(list_filter(lb, lambda x: NOT list_contains(la, x)))::BIGINT AS n_new_leaves
FROM j"""}
