"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose
bit ``i`` is set when rule ``i`` failed. Policies are named bit masks over the ledger: applying a
new version, or asking what a policy would do without one of its rules, is integer arithmetic on
that one column and never reads a text again.

Only built-in functions run; nothing is shuffled but the counts per distinct bit pattern. Within a
text, repeated windows are found by sorting packed 64-bit keys (36 hash bits, 28 position bits) and
comparing neighbours; the few keys that meet are then compared as strings, so the result is exact.

Defined results: a null or empty text has no words and measures 0 everywhere; it fails
``too_few_words``. Repeated rows and ties give one ledger row each. An empty table gives an empty
ledger. Columns other than ``doc_id`` and ``text`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm.text import SPACE, settled, span, table, whole, words

WINDOW = 5
POSITION_BITS = 28
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper",
            "n_longest")


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; ``bit`` is its place in the mask."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules that reject, and how many of them may fail."""

    version: str
    rules: tuple[str, ...]
    tolerated: int = 0

    def mask(self, rules: Sequence[Rule]) -> int:
        known = {r.name: r.mask for r in rules}
        missing = [n for n in self.rules if n not in known]
        if missing:
            raise ValueError(f"policy {self.version} names unknown rules {missing}")
        return sum(known[n] for n in dict.fromkeys(self.rules))


#: Bits never change their meaning; new rules take new bits.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "capitals", "100 * n_upper > 45 * word_chars"),
    Rule(6, "run_on", "n_longest > 1000"),
)
POLICIES = (
    Policy("v1", ("too_few_words", "repeated_windows")),
    Policy("v2", ("too_few_words", "repeated_windows", "symbols", "repeated_lines")),
    Policy("v3", ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "word_length",
                  "capitals", "run_on")),
)
CURRENT = POLICIES[-1]


def _beside(keys: Column, x: Column, i: Column, same) -> Column:
    """Whether the neighbour before or after place ``i`` of a sorted array matches ``x``."""
    return F.coalesce(same(F.get(keys, i - 1), x), F.lit(False)) | F.coalesce(
        same(F.get(keys, i + 1), x), F.lit(False))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns plus ``MEASURES`` and ``n_lines`` (input columns of these names go)."""
    own = [c for c in docs.columns if c not in (*MEASURES, "n_lines")]
    low = (1 << POSITION_BITS) - 1
    # the row goes into one column, so no name of it can meet one used here
    docs = docs.select(F.col(text).alias("_text"), F.struct(*own).alias("_row"))
    body = whole("_text")
    df = docs.select("_row", "_text", words("_text").alias("_w"),
                     F.filter(F.split(body, "\n"), lambda s: s.rlike("[^ \\t-\\r]")).alias("_l"))
    # a window per word that has WINDOW - 1 words after it
    df = df.withColumn("_keys", F.sort_array(F.transform(
        span(F.size("_w") - WINDOW),
        lambda i: F.xxhash64(F.slice("_w", i + 1, WINDOW)).bitwiseAND(~low).bitwiseOR(
            i.cast("long")))))
    met = F.filter("_keys", lambda x, i: _beside(
        F.col("_keys"), x, i, lambda a, b: a.bitwiseAND(~low) == b.bitwiseAND(~low)))
    df = df.withColumn("_met", F.sort_array(F.transform(met, lambda x: F.struct(
        F.array_join(F.slice("_w", x.bitwiseAND(low).cast("int") + 1, WINDOW), " ").alias("s"),
        x.bitwiseAND(low).alias("p")))))
    twice = F.filter("_met", lambda x, i: _beside(
        F.col("_met"), x, i, lambda a, b: a["s"] == b["s"]))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(
            F.lit(WINDOW).cast("long"), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW).cast("long")))),
        F.lit(0).cast("long"), lambda a, b: a + b)

    def left(drop: str) -> Column:
        return F.char_length(F.regexp_replace(body, drop, "")).cast("long")

    n_lines = F.size("_l").cast("long")
    return df.select(
        *[F.col(f"_row.`{c}`") for c in own], F.size("_w").cast("long").alias("n_words"), left(f"{SPACE}+").alias("word_chars"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        settled(covered).alias("n_repeat_words"), left("[^A-Z]+").alias("n_upper"),
        F.coalesce(F.array_max(F.transform("_w", lambda w: F.char_length(w))), F.lit(0))
        .cast("long").alias("n_longest"), n_lines.alias("n_lines"))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``failed_bits``."""
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need distinct bits from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(r.mask).cast("long"))
                              .otherwise(F.lit(0).cast("long")))
    # measurements are made in a projection of their own, so each is computed once
    return measure(docs, text).withColumn("failed_bits", bits)


def rejected(policy: Policy, rules: Sequence[Rule] = RULES, without: int = 0) -> Column:
    """Whether the policy, without the bits in ``without``, rejects a ledger row."""
    mask = F.lit(policy.mask(rules) & ~without).cast("long")
    return F.bit_count(F.col("failed_bits").bitwiseAND(mask)) > policy.tolerated


def apply_policies(rows: DataFrame, policies: Sequence[Policy] = POLICIES,
                   rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows with a column ``kept_<version>`` for each policy."""
    return rows.withColumns({f"kept_{p.version}": ~rejected(p, rules) for p in policies})


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES,
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and rule of it: documents failing the rule, rejected by the policy, kept
    once the rule is left out, and the rules that ever failed beside it (bitwise or).

    Counts are taken once per distinct bit pattern (combined before the shuffle); there are at most
    2^rules patterns, whatever the number of documents.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    plans = [(p, r) for p in policies for r in rules if r.name in p.rules]
    hit = lambda r: F.col("failed_bits").bitwiseAND(F.lit(r.mask).cast("long")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    cells = [F.struct(
        F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
        total(hit(r)).alias("n_failed"), total(rejected(p, rules)).alias("n_rejected"),
        total(rejected(p, rules) & ~rejected(p, rules, r.mask)).alias("n_saved"),
        F.coalesce(F.bit_or(F.when(hit(r), F.col("failed_bits"))), F.lit(0).cast("long"))
        .alias("beside_bits")) for p, r in plans]
    return patterns.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def keep_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that the policy keeps."""
    boxed = docs.select(F.col("text"), F.struct(*docs.columns).alias("_row"))
    return ledger(boxed).where(~rejected(policy)).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policies(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    base = rejected(POLICIES[0])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.col(f"kept_{CURRENT.version}").alias("kept"), "n_upper",
        "n_longest", "failed_bits", *(f"kept_{p.version}" for p in POLICIES[:-1]))


#: Words, windows and lines as rows; nothing shared with the operator.
MEASURE_SQL = r"""
w AS (SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM {docs}),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM win
        QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS n_longest
      FROM w LEFT JOIN cov USING (doc_id)),
bits AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
        + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
        + 32 * (100 * n_upper > 45 * word_chars)::BIGINT + 64 * (n_longest > 1000)::BIGINT
        AS failed_bits FROM m)
"""
SQL = {"op1_quality_rules": "WITH " + MEASURE_SQL.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, n_upper, n_longest, failed_bits,
  failed_bits & 3 = 0 AS kept_v1, failed_bits & 15 = 0 AS kept_v2 FROM bits"""}
