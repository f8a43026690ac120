"""Personal data: generators propose spans, boosted trees choose among them.

Base spans come from four fixed patterns with a check each (e-mail, IP address, card number, phone
number) and always count. Three wider generators (loose addresses, number runs, keyed secrets)
propose further, overlapping candidates. Each candidate has seven categorical features of its form
and its left context; trees are boosted on the counts per feature pattern over all documents (at
most ``PATTERNS`` rows reach the driver). A candidate's label is that a base span covers it, or a
rule of its form and left context (``_sure``: keyed random values, spelled-out addresses, numbers of
7 to 15 digits after a phone word), for kinds that base spans cannot cover. The threshold is
calibrated on a fifth of the documents. Candidates above it that overlap no base span, and no
better candidate, are added.

Only built-in functions run; nothing is shuffled but the pattern counts. Patterns are written with
possessive quantifiers and start guards, so matching is linear and needs no stack; they find the
same leftmost, non-overlapping matches as the plain forms in ``BASE``. Places are code points,
found by two-level sums over the pieces between matches.

Defined results: a null text counts as empty. Repeated rows give a row each. A table without
candidates of both kinds (or an empty one) has no model, and base spans alone are returned. Ties in
score go to the earlier, then the longer span. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm import boosting
from tauframe.llm.text import settled, span, table, whole

KINDS = ("email", "ip", "card", "phone")
#: What the patterns mean, in plain form.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "mail_like": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?(?:@|\(at\)|\[at\]| at ) ?{_LABEL}++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?{_LABEL}++)++",
    "number": r"\+?\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+",
    "secret": r"(?i)\b(?:pass(?:word|wd)?|token|secret|api[_-]?key)\b ?[=:] ?[\"']?[0-9A-Za-z_+/-]{8,}+",
}
WIDE = ("mail_like", "number", "secret")
#: Kind of an added span, by generator.
ADDED = {"mail_like": "email", "number": "phone", "secret": "secret"}
ORDER = (*KINDS, "secret")
#: A value of 16 characters or more that ends the match and has letters and three digits or more.
RANDOM = "[=:] ?[\"']?(?=[0-9_+/-]*[A-Za-z])(?=(?:[^0-9]*[0-9]){3})[0-9A-Za-z_+/-]{16,}$"
CONTEXT = 24
CHUNK = 64
FEATURES = ("digits", "separators", "lead", "luhn", "dotted", "context", "letters")
PATTERNS = 5 * 3 * 6 * 2 * 2 * 4 * 4 * 2
FOLDS = 5


def _needs(name: str, text: Column) -> Column:
    """A cheap test that a text without it cannot match."""
    if name == "email":
        return F.contains(text, F.lit("@"))
    if name == "mail_like":
        return F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(
            text, F.lit("[at]")) | F.contains(text, F.lit(" at "))
    if name == "phone":
        return F.contains(text, F.lit("+"))
    if name == "secret":
        return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return text.rlike("[0-9]")


def located(df: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """Adds ``_at_<name>``: ``start, end, s, before`` of each match, code points, end exclusive."""
    body = F.col(text)
    none = F.lit(None).cast("array<string>")
    df = df.withColumns({f"_go_{n}": _needs(n, body) for n in names})
    df = df.withColumns(
        {f"_gap_{n}": F.when(F.col(f"_go_{n}"), F.split(body, PATTERN[n])).otherwise(none) for n in names}
        | {f"_hit_{n}": F.when(F.col(f"_go_{n}"), F.regexp_extract_all(body, F.lit(PATTERN[n]), F.lit(0)))
           .otherwise(none) for n in names})

    def sums(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def lengths(n: str) -> Column:
        return F.transform(f"_gap_{n}", lambda g, i: F.char_length(g) + F.coalesce(
            F.char_length(F.get(f"_hit_{n}", i)), F.lit(0)))

    def chunks(n: str) -> Column:
        return F.transform(span(F.size(f"_len_{n}") / CHUNK),
                           lambda c: sums(F.slice(f"_len_{n}", c * CHUNK + 1, CHUNK)))

    df = df.withColumns({f"_len_{n}": lengths(n) for n in names})
    df = df.withColumns({f"_sum_{n}": chunks(n) for n in names})

    def place(n: str, s: Column, i: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        gap = F.get(f"_gap_{n}", i)
        start = (sums(F.slice(f"_sum_{n}", 1, chunk)) + F.char_length(gap)
                 + sums(F.slice(f"_len_{n}", chunk * CHUNK + 1, i % CHUNK)))
        return F.struct(start.alias("start"), (start + F.char_length(s)).alias("end"), s.alias("s"),
                        F.lower(F.right(gap, F.lit(CONTEXT))).alias("before"))

    def places(n: str) -> Column:
        return F.coalesce(F.transform(f"_hit_{n}", lambda s, i: place(n, s, i)), F.array().cast(
            "array<struct<start:int,end:int,s:string,before:string>>"))

    df = df.withColumns({f"_at_{n}": places(n) for n in names})
    return df.drop(*[f"_{k}_{n}" for k in ("go", "gap", "hit", "len", "sum") for n in names])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(span(n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _small_parts(s: Column) -> Column:
    plain = F.transform(F.split(s, "\\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(plain, lambda p: (F.char_length(p) <= 3) & (
        F.coalesce(F.when(F.char_length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))


def passes(kind: str, s: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return _small_parts(s)
    if kind == "card":
        d = _digits(s)
        return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(s)).between(9, 15)
    return F.lit(True)


def _base(df: DataFrame) -> DataFrame:
    """Adds ``_base``: ``start, rank, end, kind`` of the base spans, sorted."""
    def of(rank: int, kind: str) -> Column:
        return F.transform(F.filter(f"_at_{kind}", lambda x: passes(kind, x["s"])), lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
            F.lit(kind).alias("kind")))
    return df.withColumn("_base", F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(KINDS)])))


def _traits(s: Column, before: Column) -> list[Column]:
    d = _digits(s)
    n = F.char_length(d)
    dots = F.char_length(F.regexp_replace(s, "[^.]", ""))
    link = "(?:[^a-z]+(?:number|no|nr|num|address|me|us|at|on|is|or))*"
    words = lambda *w: before.rlike("(?:^|[^a-z])(?:" + "|".join(w) + f"){link}[^a-z]*$")
    spelled = s.rlike(r"\(at\)|\[at\]")
    return [
        F.when(n < 9, 0).when(n < 12, 1).when(n < 16, 2).when(n < 20, 3).otherwise(4),
        F.when(~s.rlike("[ ().-]"), 0).when(~s.rlike("[ ()-]"), 1).otherwise(2),
        F.when(s.startswith("+"), 1).when(F.contains(s, F.lit("@")), 2).when(s.rlike("[=:]"), 3)
        .when(spelled & s.rlike("[A-Za-z]$"), 4).when(s.rlike(" at ") & s.rlike(" dot |[(\\[]dot[)\\]]"), 5)
        .otherwise(0),
        F.when(n.between(12, 19), luhn(d)).otherwise(False).cast("int"),
        F.when((dots == 3) & s.rlike("^[0-9.]+$"), _small_parts(s)).otherwise(False).cast("int"),
        F.when(words("(?:tele|smart)?phone", "tel", "mobile", "cell", "fax", "call"), 1).when(words("card", "visa", "iban"), 2)
        .when(words("e?mail", "contact", "write to"), 3).otherwise(0),
        F.when(~s.rlike("[A-Za-z]"), 0).when(s.rlike("[0-9a-f]{16}|[0-9A-F]{16}"), 1)
        .when(s.rlike(RANDOM), 3).otherwise(2),
    ]


def _sure(generator: str, traits: dict[str, Column]) -> Column:
    """Whether form and context alone settle that a candidate is personal data.

    Base spans are found by their own patterns, so they never cover these kinds.
    """
    if generator == "secret":
        return traits["letters"].isin(1, 3)
    if generator == "mail_like":
        return (traits["lead"] == 4) | ((traits["lead"] == 5) & (traits["context"] == 3))
    return (traits["context"] == 1) & (traits["digits"] <= 2) & traits["lead"].isin(0, 1)


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``_wide``: the wide generators' spans with features and label."""
    def of(g: str) -> Column:
        # form and context first, so that the label reads them and does not compute them again
        seen = F.transform(f"_at_{g}", lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            *[t.alias(f) for t, f in zip(_traits(x["s"], x["before"]), FEATURES)]))
        return F.transform(seen, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(ADDED[g]).alias("kind"),
            F.exists("_base", lambda b: (b["start"] <= x["start"] + 1) & (b["end"] >= x["end"] - 1)
                     & (b["end"] > b["start"])).alias("covered"),
            F.exists("_base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])).alias("met"),
            _sure(g, {f: x[f] for f in FEATURES}).alias("sure"), *[x[f].alias(f) for f in FEATURES]))
    return df.withColumn("_wide", F.concat(*[of(g) for g in WIDE]))


def prepare(docs: DataFrame) -> DataFrame:
    df = docs.withColumn("_text", whole("text"))
    return candidates(_base(located(df, "_text", (*KINDS, *WIDE))))


def fit(docs: DataFrame, precision: float = 0.95) -> boosting.Model | None:
    """Boosted trees from every candidate of every document, through counts per pattern.

    Label: a base span covers the candidate to within a character, or it meets none and ``_sure``
    holds. Documents whose id hashes to
    fold 0 of ``FOLDS`` calibrate; the others fit.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    # the outer form: the inner one would put a filter on the list, computed anew, below everything
    rows = (prepare(docs.select("doc_id", "text")).select(held.alias("held"), F.inline_outer("_wide"))
            .where("digits is not null")
            .withColumn("passed", F.expr("covered or (sure and not met)"))
            .groupBy(*FEATURES, "held").agg(F.count("*").alias("n"), F.count_if("passed").alias("k")))
    got = [(tuple(r[f] for f in FEATURES), r["held"], r["n"], r["k"]) for r in rows.collect()]
    return boosting.fit(FEATURES, got, precision=precision)


def find(docs: DataFrame, model: boosting.Model | None) -> DataFrame:
    """``docs`` plus ``base_spans`` and ``spans`` (``start, rank, end, kind``, sorted)."""
    own = docs.columns
    df = prepare(docs.select("doc_id", "text", F.struct(*own).alias("_row")))
    spans = "array<struct<start:int,rank:int,end:int,kind:string>>"
    if model is None or math.isinf(model.threshold):
        added = F.array().cast(spans)
    else:
        df = df.withColumn("_new", F.sort_array(F.transform(
            F.filter("_wide", lambda x: ~x["met"] & (
                model.score_of([x[f] for f in FEATURES]) >= model.threshold)),
            lambda x: F.struct((-model.score_of([x[f] for f in FEATURES])).alias("worse"),
                               x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind")))))
        added = F.transform(F.filter("_new", lambda x, i: ~F.exists(
            F.slice("_new", 1, i), lambda y: (y["start"] < -x["less"]) & (-y["less"] > x["start"]))),
            lambda x: F.struct(
                x["start"].alias("start"),
                F.array_position(F.array(*map(F.lit, ORDER)), x["kind"]).cast("int").alias("rank"),
                (-x["less"]).alias("end"), x["kind"].alias("kind")))
        added = F.transform(added, lambda x: F.struct(
            x["start"].alias("start"), (x["rank"] - 1).alias("rank"), x["end"].alias("end"),
            x["kind"].alias("kind")))
    return df.select(*[F.col(f"_row.`{c}`") for c in own], settled(F.col("_base")).alias("base_spans"),
                     settled(F.sort_array(F.concat("_base", added))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in capitals; overlapping spans become one."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(
            F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["),
                     F.upper(x["kind"]), F.lit("]")).alias("out"), x["end"].alias("at"))).otherwise(
            F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs``, columns unchanged, with personal data in ``text`` replaced; null texts stay null."""
    boxed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    found = find(boxed, fit(docs)).withColumn("_out", F.when(
        F.col("text").isNotNull(), redacted(F.col("text"), F.col("spans"))))
    return found.select(*[F.col("_out").alias(c) if c == "text" else F.col(f"_row.{c}") for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = find(docs, fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
                       written(F.col("spans")).alias("spans"),
                       (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"))
