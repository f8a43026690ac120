import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import SCHEMA, documents, words

from tauframe.llm import boosting, chat, fingerprints, mixing, pii, quality_rules, warc


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# quality rules -----------------------------------------------------------------------------------

def measured(text):
    w, t = words(text), text or ""
    win = {}
    for i in range(len(w) - 4):
        win.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in win.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [s for s in t.split("\n") if words(s)]
    return (len(w), len(b"".join(w).decode()), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(covered))


def test_measures_equal_brute_force(docs):
    df = quality_rules.ledger(docs)
    assert no_python(df)
    rows = df.collect()
    assert len(rows) == docs.count() and df.columns[:len(docs.columns)] == docs.columns
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measured(r.text), r.text
        assert bool(r.failed_bits & 1) == (r.n_words < 10)


def test_policies_and_ablations(docs):
    led = quality_rules.ledger(docs)
    rows = quality_rules.apply_policies(led).collect()
    for p in quality_rules.POLICIES:
        mask = p.mask(quality_rules.RULES)
        assert all(r[f"kept_{p.version}"] == (r.failed_bits & mask == 0) for r in rows)
    for a in quality_rules.ablations(led).collect():
        p = next(p for p in quality_rules.POLICIES if p.version == a.version)
        rule = next(r for r in quality_rules.RULES if r.name == a.rule)
        mask = p.mask(quality_rules.RULES)
        assert a.n_failed == sum(bool(r.failed_bits & rule.mask) for r in rows)
        assert a.n_rejected == sum(bool(r.failed_bits & mask) for r in rows)
        assert a.n_saved == sum(r.failed_bits & mask == rule.mask for r in rows)
    with pytest.raises(ValueError):
        quality_rules.Policy("x", ("no_such_rule",)).mask(quality_rules.RULES)
    with pytest.raises(ValueError):
        quality_rules.ledger(docs, [quality_rules.RULES[0]] * 2)


def test_kept_documents_and_empty_table(docs):
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    none = docs.where("false")
    assert quality_rules.ledger(none).count() == quality_rules.keep_documents(none).count() == 0
    assert {r.n_rejected for r in quality_rules.ablations(quality_rules.ledger(none)).collect()} == {0}


# fingerprints ------------------------------------------------------------------------------------

def test_roots_test_equality(docs):
    df = fingerprints.with_fingerprint(docs, "text")
    assert no_python(df)
    by = {}
    for r in df.collect():
        by.setdefault(r.fingerprint[:64], set()).add(r.text or "")
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({r[1] or "" for r in documents()})


def test_edits_are_located(spark):
    lines = [f"This is line number {k} of the text." for k in range(200)]
    other = list(lines)
    other[77] = "An edited line."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    r = df.select("fa", "fb", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near"),
                  fingerprints.likeness(F.col("fa"), F.col("fa")).alias("same"),
                  fingerprints.differing(F.col("fb"), F.col("fa")).alias("d")).first()
    assert r.same == 1 and r.near == 199 / 200 and len(r.d) == 1
    assert r.d[0].digest == hashlib.sha256(b"An edited line.\n").hexdigest()[:8]


def test_texts_without_punctuation_have_small_branches(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    glyph = lambda: chr(rnd.randint(0x4E00, 0x9FA5))
    texts = [" ".join(word() for _ in range(400)), "".join(glyph() + ("。" if k % 12 == 0 else "") for k in range(480)),
             "".join(glyph() for _ in range(480)), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000)),
             " ".join(word() for _ in range(20_000)), "🙂" * 50 + "".join(chr(0x1F300 + rnd.randint(0, 400)) for _ in range(400))]
    rows = []
    for k, t in enumerate(texts):
        cut = len(t) - len(t) // 4
        rows.append((k, t, t[:cut] + "".join(rnd.choice("klmnopq ") for _ in range(len(t) // 4)), "new words first " + t))
    df = spark.createDataFrame(rows, "doc_id int, a string, b string, c string")
    for name in "abc":
        df = fingerprints.with_fingerprint(df, name, f"f{name}")
    got = df.select("doc_id", "a", fingerprints.leaves("a").alias("l"),
                    fingerprints.likeness(F.col("fa"), F.col("fb")).alias("edited"),
                    fingerprints.likeness(F.col("fa"), F.col("fc")).alias("moved"))
    assert no_python(got)
    for r in got.collect():
        assert "".join(r.l) == r.a and len(r.l) > 10
        assert 0.5 <= r.edited < 1 and 0.9 <= r.moved < 1, r.doc_id
    # one character over and over: nothing or everything is a cut, the text is whole either way
    same = spark.createDataFrame([("x" * 500,), ("y" * 500,), ("a " * 300,), ("",), (None,)], "t string")
    assert all("".join(r.l) == (r.t or "") for r in same.select("t", fingerprints.leaves("t").alias("l")).collect())


def test_pairs_with_the_next_document(docs):
    rows = fingerprints.pair_with_next(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in documents():
        by.setdefault(r[0], []).append(r[1] or "")
    ids = sorted(i for i in by if i is not None)
    for r in rows:
        if r.doc_id is None:
            assert r.beginning == "" and r.next_fingerprint is None
            continue
        nxt = by[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        k = max(len(t) for t in by[r.doc_id]) // 4
        assert r.beginning == min(t[:k] for t in nxt)
    assert fingerprints.pair_with_next(docs.where("false")).count() == 0
    one = fingerprints.pair_with_next(docs.where("doc_id = 0").limit(1)).first()
    assert one.beginning == one.text[:len(one.text) // 4]


# mixing ------------------------------------------------------------------------------------------

def test_targets_fill_up_by_weight(spark):
    rng = np.random.default_rng(3)
    for trial in range(6):
        sizes = [int(x) for x in rng.integers(0, 1000, 7)]
        df = spark.createDataFrame([(f"s{k}", v) for k, v in enumerate(sizes)], "source string, size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        w, cap = [(5, 2, 1)[k % 3] for k in range(7)], [2 * v for v in sizes]
        want, held = [0.0] * 7, set()
        while True:  # give what is left by weight, hold what is above, again
            rest = 1.5 * sum(sizes) - sum(cap[k] for k in held)
            free = [k for k in range(7) if k not in held]
            want = [cap[k] if k in held else rest * w[k] / sum(w[j] for j in free) for k in range(7)]
            over = {k for k in free if want[k] > cap[k]}
            if not over:
                break
            held |= over
        assert np.allclose([got[f"s{k}"] for k in range(7)], want), trial


def test_mix_takes_the_targets(docs):
    df = mixing.assign(docs, carry=docs.columns)
    assert no_python(df)
    rows = df.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.size == len(words(r.carry_text)) and 0 <= r.taken <= 2 * r.size
        assert sum(x.words for x in r.reads) == r.taken
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert sum(r.taken for r in own) == int(own[0].target)
    again = {(r.doc_id, r.carry_text, r.taken, str(r.reads)) for r in mixing.assign(docs, docs.columns).collect()}
    assert again == {(r.doc_id, r.carry_text, r.taken, str(r.reads)) for r in rows}


def test_training_order_follows_the_schedules(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * 10), f"s{k % 3}") for k in range(300)],
                                 "doc_id bigint, text string, source string")
    rows = mixing.training_order(mixing.assign(docs)).collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    early = [sum(r.position < 0.5 for r in rows if r.source == f"s{k}") / sum(r.source == f"s{k}" for r in rows)
             for k in range(3)]
    assert abs(early[0] - 0.5) < 0.05 and early[1] < 0.4 and early[2] > 0.6
    # inverting the integral gives the demand back
    for k, knots in enumerate(mixing.SCHEDULES):
        own = sorted((r.position for r in rows if r.source == f"s{k}"))
        shape = mixing.integrated(knots)
        for n, t in enumerate(own):
            p = [q for q in shape if q[0] <= t][-1]
            share = p[3] + p[1] * (t - p[0]) + p[2] * (t - p[0]) ** 2 / 2
            assert abs(share - n / len(own)) < 0.02


def test_mixed_documents_and_errors(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix_documents(docs.where("false")).count() == 0
    for knots in (((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0))):
        with pytest.raises(ValueError):
            mixing.integrated(knots)
    with pytest.raises(ValueError):
        mixing.source_targets(docs.selectExpr("source", "1L as size"), share=3)


# chat --------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    P = chat.PART
    rows = [(1, 1, "user", [("text", "a <b> \\l \\b </turn>\n", None, None, None, None, None),
                            ("image", None, "img\"1", 57, 28, None, None), ("text", "end", None, None, None, None, None)]),
            (1, 2, "assistant", [("text", 'yes "<turn role="x">', None, None, None, None, None)]),
            (1, 2, "assistant", [("text", 'yes "<turn role="x">', None, None, None, None, None)]),
            (1, None, None, None), (2, 0, 'we"ird<\n', [("audio", None, "s", None, None, 1001, None),
                                                        ("document", None, None, None, None, None, 3), None]),
            (None, 1, "user", [("text", None, None, None, None, None, None)]), (None, 1, "user", [])]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], f"conv_id bigint, turn bigint, role string, parts array<{P}>, mask int, piece int")
    out = chat.read_back(chat.format_conversations(turns))
    assert no_python(out)
    got = out.collect()
    assert sorted(r.conv_id if r.conv_id is not None else -1 for r in got) == [-1, -1, 1, 2]
    one = next(r for r in got if r.conv_id == 1)
    assert [(t.role, t.text) for t in one.turns] == [
        ("", ""), ("user", "a <b> \\l \\b </turn>\nend"), ("assistant", 'yes "<turn role="x">'),
        ("assistant", 'yes "<turn role="x">')]
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in one.attachments] == [(2, 1, "image", 'img"1', 3)]
    for m, t in zip(one.mask, one.turns):
        assert m.trained == (t.role == "assistant")
        if t.role == "assistant":
            plain = one.formatted[m.start:m.end].replace("\\l", "<").replace("\\b", "\\")
            assert plain == t.text
    two = next(r for r in got if r.conv_id == 2)
    assert two.turns[0].role == 'we"ird<\n' and [a.tokens for a in two.attachments] == [26, 1536]
    assert two.n_tokens == 26 + 1536
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_a_false_mask_is_an_error(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts("text").alias("parts")))
    bad = made.withColumn("formatted", F.concat(F.lit("<"), "formatted"))
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(bad).collect()


# personal data -----------------------------------------------------------------------------------

def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c))
               for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    return sorted((m.start(), i, m.end(), k) for i, k in enumerate(pii.KINDS)
                  for m in re.finditer(pii.BASE[k], text or "") if ok(k, m[0]))


TRICKY = ["a@b.c_d@e.f", "x@y", "a@b.c.d@e.f.g 1.2.3.4.5.6.7.8.9", "000255.1.1.1 256.1.1.1 1.1.1.1.1",
          "+1 (436) 555-8670)( +12 +1----------2 + 3", "4111-1111 1111 1111 4111  1111", "9" * 5000, "1 " * 5000,
          "é🙂a@b.co 🙂+44 20 7946 0958", "a" * 20000 + "@", ".".join(["1"] * 3000), "%_+-@a.b-.c-", "",
          " ".join(f"u{k}@h{k}.org" for k in range(300))]


def test_base_spans_equal_brute_force(spark, docs):
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(100 + k, r[1]) for k, r in enumerate(documents())]
    df = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"), None)
    assert no_python(df)
    for r in df.collect():
        assert [(x.start, x.rank, x.end, x.kind) for x in r.base_spans] == base_spans(r.text), r.text
        assert r.spans == r.base_spans


def test_model_adds_no_overlap_and_keeps_base(spark):
    rows = [(k, f"call me at +1 (436) 555-{k:04d} or a{k}@b.org; tel: 436 555 {k:04d} 12 token = \"ab12cd34ef{k:04d}\"")
            for k in range(60)] + [(100 + k, f"order 12-34-56-78-{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.fit(df)
    assert model is not None
    loose = boosting.Model(model.features, model.base, model.trees, -1e9)
    for r in pii.find(df, loose).collect():
        spans = sorted((x.start, x.end) for x in r.spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert {(x.start, x.end) for x in r.base_spans} <= set(spans)
        if r.doc_id < 60:
            assert len(spans) > len(r.base_spans)
    text = pii.redact_documents(df).where("doc_id = 7").first().text
    assert "[PHONE]" in text and "[EMAIL]" in text and "a7@b.org" not in text


def test_calibrated_model_adds_kinds_without_a_base_check(spark):
    rnd = np.random.default_rng(4)
    key = lambda n, of: "".join(rnd.choice(list(of), n))
    rows, planted = [], {}
    for k in range(400):
        kind = k % 8
        value = [f'token = "{key(40, "0123456789abcdef")}"', f"TOKEN = {key(40, '0123456789ABCDEF')}",
                 f"api_key: a7{key(30, 'ghijKLMN0123456789')}", f"436 555 {k:04d}", f"5551{k:03d}",
                 f"user{k}(at)host.org", f"order 12-34-56-78-{k:04d} and password: authentication",
                 f"mail a{k}@b.org, card 4111 1111 1111 1111, hotel 5552{k:03d}, arrived at noon. then"][kind]
        before = {3: "phone number: ", 4: "Call me at ", 5: "write to "}.get(kind, "some words ")
        rows.append((k, f"{before}{value} and more"))
        planted[k] = (kind, value)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.fit(df)
    assert np.isfinite(model.threshold)
    added = {r.doc_id: [(x.kind, r.text[x.start:x.end]) for x in r.spans if x not in r.base_spans]
             for r in pii.find(df, model).collect()}
    for k, (kind, value) in planted.items():
        want = {0: "secret", 1: "secret", 2: "secret", 3: "phone", 4: "phone", 5: "email"}.get(kind)
        assert added[k] == ([(want, value.rstrip('"'))] if want else []), (k, rows[k])
    for r in pii.redact_documents(df).where("doc_id % 8 < 6").collect():
        assert planted[r.doc_id][1].rstrip('"') not in r.text


def test_redaction_of_awkward_rows(docs):
    out = pii.redact_documents(docs)
    assert out.columns == docs.columns
    got = sorted(map(str, out.where("text not like '%[%]%' or text is null").collect()))
    assert got == sorted(str(r) for r in docs.collect() if not base_spans(r.text))
    assert pii.redact_documents(docs.where("false")).count() == 0


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(2)
    patterns = [((a, b, c), out, 50.0, 50.0 * ((a == 1) == (b == 2)) if c else 25.0)
                for a in range(2) for b in range(3) for c in range(2) for out in (False, True)]
    rng.shuffle(patterns)
    m = boosting.fit(("a", "b", "c"), patterns, rounds=30)
    for p, _, n, k in patterns:
        if p[2]:
            assert (m.score_one(p) >= m.threshold) == (k == n)
        else:
            assert m.score_one(p) < m.threshold
    assert boosting.fit(("a",), [((1,), False, 5.0, 5.0)]) is None and boosting.fit(("a",), []) is None


# warc --------------------------------------------------------------------------------------------

def test_warc_records_round_trip(spark):
    pages = [(1, "http://a/é", "<html lang='fr'><title> A &amp; B</title><p>x &lt;b&gt; &#233;&#x1F642; &unknown; &#0;</p>"
                               "<script>if (a<b) '</p>'</script><!-- <p>no</p> --><p title='a>b'>q</p><a href=\"/l\">l</a>"),
             (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "<p>unclosed <!-- x"), (5, "w", "a < b\r\n\r\nc   d")]
    df = spark.createDataFrame([(*p, "b", "t") for p in pages], "page_id bigint, url string, html string, block string, _text string")
    made = warc.derive(warc.responses(df))
    assert no_python(made)
    rows = made.collect()
    assert len(rows) == 2 * len(pages)
    text = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert text[1] == "A & B\nx <b> é🙂 &unknown; &#0;\nq\nl"
    assert text[2] == text[3] == "" and text[None] == "unclosed" and text[5] == "a < b\nc d"
    meta = {r.page_id: r for r in rows if r.record_type == "metadata"}
    for r in rows:
        if r.record_type == "conversion":
            assert r.refers_to == meta[r.page_id].refers_to and r.concurrent_to == meta[r.page_id].record_id
        assert re.fullmatch("<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
    assert "language: fr" in meta[1].block and "outlink: /l" in meta[1].block and "source-header: HTTP/1.1 200 OK" in meta[1].block
    back = warc.parsed(warc.serialised(made)).collect()
    assert all(r.sound for r in back)
    assert sorted((r.record_id, r.block) for r in back) == sorted((r.record_id, r.block) for r in rows)
    assert warc.derive(warc.responses(df.where("false"))).count() == 0
