import random
import re

import pytest
from rows import SCHEMA, documents

from tauframe.llm import decontamination as dc


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(rows, items, window):
    bags = [(i, words(t)) for i, t in rows]
    held = {}
    for _, w in bags:
        for x in w:
            held[x] = held.get(x, 0) + 1
    asked, rare = {}, {}
    for i, t in items:
        w, name = words(t), "" if i is None else str(i)
        if w:
            asked.setdefault(name, set()).update(tuple(w[k:k + window]) for k in range(max(1, len(w) - window + 1)))
            rare.setdefault(name, set()).update(w)
    rare = {n: sorted(ts, key=lambda x: (held.get(x, 0), x))[:dc.NEAR_TERMS] for n, ts in rare.items()}
    out = []
    for i, w in bags:
        hit, found, near = set(), set(), 0
        for name, phrases in asked.items():
            for p in phrases:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k:k + len(p)]) == p:
                        hit.update(range(k, k + len(p)))
                        found.add(name)
            near += any(set(rare[name]) <= set(w[k:k + dc.NEAR_WORDS]) for k in range(len(w)))
        out.append((i, len(w), len(hit), len(found), sorted(found), near))
    return sorted(out, key=str)


def check(df, items, rows, given, window=dc.WINDOW):
    got = dc.contaminated(df, items, window).collect()
    assert sorted([tuple(r) for r in got], key=str) == by_hand(rows, given, window)


def test_awkward_rows(spark, docs):
    rows = [(r[0], r[1]) for r in documents()]
    base, copied = words(rows[0][1]), words(rows[11][1])
    given = [(1, " ".join(base[20:34])), (2, "one"), (2, "Mail A.B@C.org!"), (3, None), (4, "..."), (None, "a line"),
             (5, " ".join(copied[100:109])), (6, " ".join(base[20:30])), (7, "nowhere at all"), (8, " ".join(["line"] * 12)),
             (9, "OF it\nA Line of It a Line of it a line")]
    items = spark.createDataFrame([(*r, 0, 0) for r in given], "item_id bigint, text string, own int, place int")
    check(docs, items, rows, given)
    check(docs, items, rows, given, 3)
    assert dc.contaminated(docs.where("false"), items).count() == 0
    none = dc.contaminated(docs, items.where("false")).collect()
    assert len(none) == len(rows) and not any(r.n_hit or r.n_items or r.n_near for r in none)
    with pytest.raises(ValueError):
        dc.contaminated(docs, items, 63)


def test_few_words_in_many_orders(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    rows = [(k % 50, say(rnd.randint(0, 60))) for k in range(90)] + [(7, "a " * 300)] * 2
    given = [(f"i{k}", say(n)) for k, n in enumerate((1, 2, 3, 4, 4, 5, 6, 7, 9, 12))]
    check(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(given, "item_id string, text string"),
          rows, given, 4)


def test_no_python_on_the_way(spark, docs):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    df = dc.contaminated(docs, items)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
