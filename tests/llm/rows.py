"""Small tables with awkward rows, shared by the tests of this folder."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _w int, node string, key string"


def documents():
    """Nulls, empty and long texts, ties, repeated rows, copies, and columns with names used inside."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghé中") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, shared = say(120), say(20)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base.upper(), say(3), say(3), "", None, " \t\n", "one", "one",
             say(200) + "\n" + shared + "\n" + say(30), say(50) + " " + shared, shared,
             " ".join([say(9)] * 12), "\n".join(["a line of it"] * 8), say(4000), "x" * 3000, "#*$ | <> " * 9,
             "mail a.b@c.org, 10.0.0.255 and 300.1.1.1; +1 (436) 555-8670, 4111 1111 1111 1111 or 4111111111111112",
             "password=abc123def456 ▁ a b c 🙂"]
    rows = [(k, t, "en", f"src{k % 4}" if k % 7 else None, 0, k, "x", "y") for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base, None, "src1", None, None, None, None), (4, say(6), "en", "src0", 1, 1, "", "")]


def words(text):
    return [w for w in (text or "").encode().split()]
