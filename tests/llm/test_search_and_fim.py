import hashlib
import math
import random
import re

import numpy as np
import pytest
from rows import SCHEMA, documents

from tauframe.llm import fill_middle, ranked_search, tokens


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# ranked search -----------------------------------------------------------------------------------

def ranked_by_hand(rows, items, best):
    bags = [(i, w) for i, w in ((i, terms(t)) for i, t in rows) if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, w in bags:
            m = 50 + 50 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in ts if t in w)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:best])]
    return sorted(out, key=str)


ITEMS = [(1, "one a line of it"), (2, "Mail A.B@c.org"), (2, "password"), (3, None), (4, ""), (5, "zzz qqq"),
         (None, "one 10 300"), (6, "中 é 🙂"), (7, "x" * 3000 + " one")]


def test_search_equals_brute_force(spark, docs):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id bigint, text string, score int")
    rows = [(r[0], r[1]) for r in documents()]
    for best in (1, 3, 50):
        got = ranked_search.search(docs, items, best).collect()
        assert sorted([tuple(r) for r in got], key=str) == ranked_by_hand(rows, ITEMS, best)
    assert ranked_search.search(docs.where("false"), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0


def test_limits_and_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = [f"t{k}" for k in range(60)]
    weight = [1 / (k + 1) for k in range(60)]
    say = lambda n: " ".join(rnd.choices(vocab, weight, k=n))
    rows = [(k // 2, say(rnd.randint(1, 80))) for k in range(700)] + [(k, "t1 t2 t3") for k in range(40)]
    items = [(f"i{k}", say(8)) for k in range(12)]
    want = ranked_by_hand(rows, items, 7)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    for size, query in ((2_000_000, 4_000_000), (100, 40)):  # small blocks; several blocks of items
        monkeypatch.setattr(ranked_search, "BLOCK", size)
        monkeypatch.setattr(ranked_search, "QUERY_BYTES", query)
        monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
        got = ranked_search.search(df, asked, 7).collect()
        assert sorted([tuple(r) for r in got], key=str) == want


def test_accumulators_are_limited_and_exact():
    """A rare term settles the best two; the common term opens no accumulator."""
    doc = np.array([3, 5, *range(100)])
    gain = np.array([900, 800, *([10] * 100)])
    (item, at, score), = ranked_search.score_block(
        [np.array([0, 1])], np.array([100, 2]), {1: 0, 0: 2}, np.array([2, 100]), doc, gain, 100, [1], 2)
    opened = dict(zip(at.tolist(), score.tolist()))
    assert item == 0 and opened == {3: 910, 5: 810}
    # equal scores must stay: the common term can still lift others to the second place
    gain[:2] = 900, 10
    (_, at, score), = ranked_search.score_block(
        [np.array([0, 1])], np.array([100, 2]), {1: 0, 0: 2}, np.array([2, 100]), doc, gain, 100, [1], 2)
    assert dict(zip(at.tolist(), score.tolist())) == {3: 910, 5: 20}
    # a floor from earlier blocks shuts everything below it out
    assert [len(a) for _, a, _ in ranked_search.score_block(
        [np.array([0, 1])], np.array([100, 2]), {1: 0, 0: 2}, np.array([2, 100]), doc, gain, 100, [911], 2)] == [0]


def test_equal_hashes_are_told_apart():
    vocabulary = ranked_search.Vocabulary([b"abc", b"xyz"])
    w = tokens.words_of([b"abc q xyz"], ranked_search.TERM)
    w.hash[1] = vocabulary.hash[0]
    w.hash[2] = vocabulary.hash[[t == b"abc" for t in vocabulary.terms].index(True)]
    at, term = vocabulary.number(w)
    assert [(a, vocabulary.terms[t]) for a, t in zip(at.tolist(), term.tolist())] == [(0, b"abc")]


# fill in the middle ------------------------------------------------------------------------------

def transformed_by_hand(doc_id, text, choice):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    s = hashlib.sha256(f"{choice.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= choice.changed:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, q = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < choice.spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{q}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{q}<M>{m}"


def test_fill_in_middle_equals_definition_and_comes_back(spark, docs, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 5)
    more = [(1000 + k, "".join(random.Random(k).choice("ab\n\né中🙂<P") for _ in range(k))) for k in range(120)]
    more += [(k, "é\n中\n\n" * 4 + "end") for k in range(2000, 2040)] + [(7, "a <S> b\nc"), (8, "\n"), (9, "a" * 200_000 + "\nb")]
    df = docs.select("doc_id", "text", "n_chars").unionByName(
        spark.createDataFrame([(*r, 0) for r in more], "doc_id bigint, text string, n_chars bigint"))
    rows = [(r[0], r[1]) for r in documents()] + more
    for choice in (fill_middle.Choice(), fill_middle.Choice(seed=3, changed=60, spm=0), fill_middle.Choice(spm=100)):
        got = fill_middle.restore_texts(fill_middle.fill_in_middle(df, choice)).collect()
        assert sorted([tuple(r)[:6] for r in got], key=str) == sorted((transformed_by_hand(i, t, choice) for i, t in rows), key=str)
        assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
        assert {"psm", "spm"} & {r.form for r in got}
    assert fill_middle.restore_texts(fill_middle.fill_in_middle(df.where("false"))).count() == 0


def test_rotation_exchanges_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 3)
    data = bytes(range(40))
    for lo in range(0, 12):
        for cut in range(lo, 25):
            for hi in range(cut, 40, 5):
                made = bytearray(data)
                fill_middle.rotate(made, lo, cut, hi)
                assert made == data[:lo] + data[cut:hi] + data[lo:cut] + data[hi:]
