import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from rows import SCHEMA, documents, words

from tauframe.llm import licenses, near_dedup, pieces, substring_dedup, tokens
from tauframe.llm.components import components
from tauframe.llm.fm_index import FMIndex


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def test_words_equal_split():
    texts = [(r[1] or "").encode() for r in documents()] + [b"\xc2\xa0a \x1c b\x0bc\x0c"]
    w = tokens.words_of(texts)
    seen = {}
    for k, t in enumerate(texts):
        own = t.split()
        assert w.first[k + 1] - w.first[k] == len(own)
        for x, h in zip(own, w.hash[w.first[k]:w.first[k + 1]].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


# licenses ----------------------------------------------------------------------------------------

def test_licenses_equal_exact_search(spark):
    rnd = random.Random(1)
    noise = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet the of version license".split()) for _ in range(n))
    texts, want = [None, "", "All rights", "ALL RIGHTS -- reserved!"], {(3, "LicenseRef-all-rights-reserved", "notice")}
    for name, part, text in licenses.TEMPLATES:
        want.add((len(texts), name, part))
        texts.append(noise(rnd.randint(0, 200)) + "\n" + text + "\n" + noise(rnd.randint(0, 90)))
    mit = licenses.TEMPLATES[3][2].split()
    cut = mit[:30] + mit[36:]  # six words less: over three quarters of the shingles are left
    want.add((len(texts), "MIT", "permission"))
    texts += [noise(50) + " " + " ".join(cut), " ".join(mit[:30]), noise(3000)]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[3:5], "doc_id bigint, text string, license int")
    got = licenses.scan(df).collect()
    # the long Apache notice begins with the short one
    want.add((next(k for k, n, p in want if (n, p) == ("Apache-2.0", "header")), "Apache-2.0", "notice"))
    assert {(r.doc_id, r.license, r.part) for r in got} == want
    assert len(got) == len(want) + 2 and all(r.n_places >= 1 for r in got)
    assert licenses.scan(df.where("false")).count() == 0


def test_licenses_that_differ_in_a_few_words(spark):
    """The version, Lesser, Affero or NC decides, also next to another licence's notice."""
    program = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    later = "General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    given = {
        0: (program + later.format(2), {"GPL-2.0-or-later"}), 1: (program + later.format(3), {"GPL-3.0-or-later"}),
        2: (program + "Lesser " + later.format(3), {"LGPL-3.0-or-later"}),
        3: (program.replace("program", "library") + "Lesser " + later.format("2.1"), {"LGPL-2.1-or-later"}),
        4: (program + "Affero " + later.format(3), {"AGPL-3.0-or-later"}),
        5: ("The text is under the GNU General Public License, version 2. This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        6: ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        7: ("Licensed under CC BY-NC-SA 4.0. Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", {"CC-BY-NC-SA-4.0", "CC-BY-4.0", "CC-BY-SA-4.0"}),
        8: (program + later.format(2) + " Released under the MIT License. " + program + later.format(3),
            {"GPL-2.0-or-later", "MIT", "GPL-3.0-or-later"}),
        9: ((program + later.format(2) + " ") * 300, {"GPL-2.0-or-later"}),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in given.items()], "doc_id int, text string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {k: names for k, (_, names) in given.items()}


def test_bands_keep_the_miss_small():
    compiled = licenses.compiled()
    for size, block, members in licenses.scan_groups(compiled):
        for k in members:
            need = int(np.ceil(licenses.CONTAINMENT * compiled[k].count))
            j = need / (2 * block + compiled[k].count - need)
            assert (1 - j) ** licenses.bands_for(compiled[k].count, block) <= licenses.MISS
    with pytest.raises(ValueError):
        licenses.compiled([("x", "y", "...")])


# substring dedup ---------------------------------------------------------------------------------

def cut_by_hand(rows):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                s = tuple(w[k:k + 13])
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and least[tuple(w[k:k + 13])] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark, docs):
    rows = [(r[0], r[1]) for r in documents()]
    got = substring_dedup.remove_shared(docs, text_out=False).collect()
    assert sorted([tuple(r) for r in got], key=str) == cut_by_hand(rows)
    rnd = random.Random(9)
    few = [f"w{k}" for k in range(4)]
    rows = [(rnd.randint(0, 60), " ".join(rnd.choice(few) for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    rows += [(99, "a " * 500), (98, "a " * 40), (97, "a\n" * 13), (96, "a " * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.remove_shared(df, text_out=False).collect()
    assert sorted([tuple(r) for r in got], key=str) == cut_by_hand(rows)
    assert substring_dedup.remove_shared(df.where("false")).count() == 0
    kept = {r.doc_id: r.kept_text for r in substring_dedup.remove_shared(df.where("doc_id >= 96")).collect()}
    assert kept[96] == " ".join(["a"] * 12) and kept[99] == "" and kept[97] == " ".join(["a"] * 13)


def test_fm_index_finds_every_window():
    rng = np.random.default_rng(4)
    for sigma, depth in ((2, 3), (4, 5), (30, 13)):
        seqs = [rng.integers(1, sigma + 1, rng.integers(depth, 40)) for _ in range(50)]
        text = np.concatenate([np.append(s, 0) for s in seqs])
        owner = np.repeat(np.arange(50), [len(s) + 1 for s in seqs])
        value = rng.permutation(50)
        index = FMIndex(text, owner, value, depth)
        probes = np.array([s[:depth] for s in seqs] + [rng.integers(1, sigma + 1, depth) for _ in range(50)])
        lo, hi = index.windows(probes)
        places = {}
        for k, s in enumerate(seqs):
            for i in range(len(s) - depth + 1):
                places.setdefault(tuple(s[i:i + depth]), []).append(k)
        assert (hi - lo).tolist() == [len(places.get(tuple(p), ())) for p in probes]
        begin = np.cumsum([0] + [len(s) + 1 for s in seqs[:-1]])
        n = np.array([len(s) - depth + 1 for s in seqs])
        for s, got in zip(seqs, index.least_of(text, begin, n)):
            assert got.tolist() == [min(value[k] for k in places[tuple(s[i:i + depth])]) for i in range(len(s) - depth + 1)]


# near-duplicates ---------------------------------------------------------------------------------

def shingles(text):
    w = [bytes(tokens.LOWER[np.frombuffer(x, np.uint8)]) for x in words(text)]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups_by_hand(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [(i, len(shingles(t)), None if i is None else top(i)) for i, t in rows]


def check_groups(df, rows):
    got = near_dedup.near_duplicates(df).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(groups_by_hand(rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_equal_brute_force(spark, docs):
    # rows that share an id and have different texts are one document
    check_groups(docs, [(r[0], r[1]) for r in documents()])
    rnd = random.Random(3)
    rows, base = [], [[f"{b}x{rnd.randint(0, 10**6)}" for _ in range(80)] for b in range(6)]
    for k in range(260):
        w = list(base[k % 6])
        for _ in range(rnd.randint(0, 6)):  # chains of copies around the threshold
            w[rnd.randrange(80)] = f"n{rnd.randint(0, 10**6)}"
        if k % 10 == 0:
            base[k % 6] = w
        rows.append((k, " ".join(w)))
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_small_runs_and_dense_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RUN", 3)
    rows = [(k, " ".join([f"a{j}" for j in range(100)] + [f"b{k}x{j}" for j in range(k % 9)])) for k in range(60)]
    table = pa.record_batch([pa.array([5, 5, 5, 5, 5, 7]), pa.array(range(6))], ["bucket", "node"])
    cut = next(near_dedup._cut_runs(iter([table])))
    assert cut.column("node").to_pylist() == [0, 1, 2, 2, 3, 4, 5] and len(set(cut.column("run").to_pylist())) == 3
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
    monkeypatch.setattr(near_dedup, "DENSE", 20)  # buckets above it are compared in cells
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_links_at_the_fringe_of_a_dense_family(spark, monkeypatch):
    """Each fringe text is linked with one member of a family in dense buckets, hardly above 3/4."""
    monkeypatch.setattr(near_dedup, "RUN", 8)
    monkeypatch.setattr(near_dedup, "DENSE", 120)
    monkeypatch.setattr(near_dedup, "BLOCK", 90, raising=False)
    rnd, rows = random.Random(8), []
    for k in range(300):
        w = [f"a{j}" for j in range(200)]
        w[rnd.randrange(5, 150)] = f"m{k}"
        rows.append((k, " ".join(w)))
    for k in range(0, 40):
        w = rows[7 * k][1].split()
        rows.append((1000 + k, " ".join(w[:172] + [f"f{k}x{j}" for j in range(25)])))
    links = sum(100 * len(a & b) >= 75 * len(a | b) for a in [shingles(t) for i, t in rows if i >= 1000]
                for b in [shingles(t) for i, t in rows if i < 300])
    assert 40 <= links < 2000  # nearly all other members are below 3/4
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_rows_of_one_id_lose_no_link(spark):
    """Different texts under one id are one document, linked with what either is linked with."""
    rnd = random.Random(12)
    say = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    a, b, c, d = (say(60) for _ in range(4))
    rows = [(4, a), (4, b), (9, b + " x"), (10, a + " y"), (9, c), (2, c + " z"), (30, d), (31, d), (31, None), (31, ""),
            (40, None), (40, say(3)), (41, d + " q"), (50, a), (50, say(40)), (51, say(40)), (51, say(50))]
    for turn in range(3):
        rnd.shuffle(rows)
        check_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(turn + 1), rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got if r.doc_id in (2, 4, 9, 10, 50)} == {2}


def test_representatives_stay(docs):
    out = near_dedup.keep_representatives(docs)
    assert out.columns == docs.columns
    gone = {i for i, _, c in groups_by_hand([(r[0], r[1]) for r in documents()]) if i != c}
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in gone)
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(70)]
    up = {n: n for e in links for n in e if e[0] != e[1]}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {(r.node, r.comp) for r in got.collect()} == {(n, top(n)) for n in up}


# pieces ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocab():
    return pieces.load()


def all_ways(vocab, unit):
    edges = vocab.edges(unit)

    def back(end):
        if end == 0:
            yield 0, ()
        for b, s, i in edges[end]:
            for t, w in back(b):
                yield t + s, w + i
    return sorted(back(len(unit)), key=lambda x: -x[0])


def test_n_best_equals_all_segmentations(vocab):
    rnd = random.Random(1)
    batch = [pieces.MARK * rnd.randint(0, 2) + "".join(rnd.choice("theané中🙂.") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    score, gap, n, ids = pieces.viterbi(vocab, batch)
    lo = 0
    for k, u in enumerate(batch):
        ways, best = all_ways(vocab, u), pieces.search(vocab, u, 4)
        assert [s for s, _ in best] == [s for s, _ in ways[:4]] and len(set(best)) == len(best) and set(best) <= set(ways)
        own = tuple(ids[lo:lo + n[k]].tolist())
        lo += n[k]
        assert (score[k], own) in ways and score[k] == ways[0][0]
        assert gap[k] == (ways[0][0] - ways[1][0] if len(ways) > 1 else -1)


def test_text_n_best_equals_all_segmentations(vocab):
    encoder = pieces.Encoder(vocab, 4)
    for text in ("the tea", "a\nb ea", "néa 中", "ee ee ee", "", "a"):
        (ids, score, others), = encoder.encode([text])
        marked = "".join(pieces.units(text))
        ways = all_ways(vocab, marked)
        assert [score, *(s for s, _ in others)] == [s for s, _ in ways[:4]]
        made = {tuple(ids.tolist())}
        for s, changes in others:
            w, at = [], 0
            for b, e, new in sorted(changes):
                w += ids[at:b].tolist() + list(new)
                at = e
            w = tuple(w + ids[at:].tolist())
            assert (s, w) in ways
            made.add(w)
        assert len(made) == min(4, len(ways))


def test_texts_come_back(spark, docs, vocab, monkeypatch):
    encoded = pieces.encode_documents(docs)
    back = sorted(map(str, pieces.decode_documents(encoded).collect()))
    assert back == sorted(str(r) for r in docs.selectExpr("doc_id", "coalesce(text, '') as text").collect())
    rows = pieces.describe_documents(docs).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert pieces.describe_documents(docs.where("false")).count() == 0
    monkeypatch.setattr(pieces, "TABLE_UNITS", 40)  # the bounded table changes nothing
    small, large = pieces.Encoder(vocab, 4), pieces.Encoder(vocab, 4)
    texts = [r[1] or "" for r in documents()]
    full = list(large.encode(texts))
    for t, (i, s, o) in zip(texts, full):
        (j, u, p), = small.encode([t])
        assert i.tolist() == j.tolist() and s == u and [x[0] for x in o] == [x[0] for x in p]


def test_crossing_pieces_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary([("a▁b", -1.0, 1)])
