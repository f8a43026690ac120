"""The queries of ``catalog`` as SQL over the given tables, written independently.

Lags are self-joins here, matrix algebra is done on row-major lists, inverses by Newton-Schulz
iteration, eigenvalues by repeated squaring, linear systems by fixed-point recursion.
"""

from __future__ import annotations

EV = """ev AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id
    ORDER BY ts, event_id) - 1 AS frame, event_type AS state, value, props, event_id FROM events)"""
MI = """mi AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id
    ORDER BY ts, event_id) - 1 AS frame, event_type || ':' || CASE WHEN value < 15 THEN '0'
    WHEN value < 35 THEN '1' WHEN value < 70 THEN '2' ELSE '3' END AS state FROM events)"""
OD = """od AS (SELECT o_custkey AS traj_id, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey) - 1 AS frame, o_orderstatus AS state FROM orders)"""
VE = """ve AS (SELECT vec_id, label AS traj_id, row_number() OVER (PARTITION BY label
    ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS x FROM embeddings)"""

VC = """vc AS (SELECT vec_id, traj_id, frame, list_concat(x, [0.0, 0.0]) AS x FROM ve)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def r6(expr: str) -> str:
    return f"CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END"


def lags(values) -> str:
    return "lags(lag) AS (VALUES " + ", ".join(f"({v}::INTEGER)" for v in values) + ")"


def counts(source: str, values, name: str = "cnt", extra: str = "") -> list[str]:
    by = f"a.{extra}, " if extra else ""
    return [lags(values), f"""{name} AS (SELECT {by}l.lag, a.state AS i, b.state AS j,
    count(*)::BIGINT AS n FROM {source} a CROSS JOIN lags l
    JOIN {source} b ON b.traj_id = a.traj_id AND b.frame = a.frame + l.lag
    GROUP BY {by}l.lag, a.state, b.state)"""]


SYM = """sym AS (SELECT lag, i, j, sum(n) / 2.0 AS n FROM (SELECT lag, i, j, n FROM cnt
    UNION ALL SELECT lag, j, i, n FROM cnt) GROUP BY lag, i, j)"""


def series(source: str = "ev", length: int = 12) -> list[str]:
    """``ser(k, i, j, p)`` with zeros, ``mats(k, m)`` row-major."""
    return [*counts(source, range(1, length + 1)),
            f"st AS (SELECT DISTINCT state AS s FROM {source})",
            f"""ser AS (SELECT (l.lag - 1)::INTEGER AS k, a.s AS i, b.s AS j,
    coalesce(c.n / sum(c.n) OVER (PARTITION BY l.lag, a.s), 0.0)::DOUBLE AS p
    FROM lags l CROSS JOIN st a CROSS JOIN st b
    LEFT JOIN cnt c ON c.lag = l.lag AND c.i = a.s AND c.j = b.s)""",
            "mats AS (SELECT k, list(p ORDER BY i, j) AS m FROM ser GROUP BY k)"]


# -- row-major list algebra ----------------------------------------------------------------

def mm(a: str, b: str, d: int) -> str:
    return (f"list_transform(range({d * d}), lambda x: list_sum(list_transform(range({d}), "
            f"lambda q: {a}[(x // {d}) * {d} + q + 1] * {b}[q * {d} + x % {d} + 1])))")


def lin(d: int, *terms: tuple[float, str]) -> str:
    total = " + ".join(f"({w}) * {m}[x + 1]" for w, m in terms)
    return f"list_transform(range({d * d}), lambda x: {total})"


def eye(d: int) -> str:
    return "[" + ", ".join("1.0" if k % (d + 1) == 0 else "0.0" for k in range(d * d)) + "]"


def transposed(m: str, d: int) -> str:
    return f"list_transform(range({d * d}), lambda x: {m}[(x % {d}) * {d} + x // {d} + 1])"


def trace(m: str, d: int) -> str:
    return "(" + " + ".join(f"{m}[{k * (d + 1) + 1}]" for k in range(d)) + ")"


def inverse(name: str, source: str, matrix: str, d: int, keys: str = "", steps: int = 70
            ) -> list[str]:
    """CTE ``name(keys, inv)`` from ``source(keys, matrix)``."""
    k = f"{keys}, " if keys else ""
    norm1 = f"list_max(list_transform(range({d}), lambda c: list_sum(list_transform(range({d}), lambda q: abs(a[q * {d} + c + 1])))))"
    norm8 = f"list_max(list_transform(range({d}), lambda c: list_sum(list_transform(range({d}), lambda q: abs(a[c * {d} + q + 1])))))"
    return [
        f"{name}_a AS (SELECT {k}{matrix} AS a FROM {source})",
        f"{name}_b AS (SELECT {k}a, {norm1} * {norm8} AS z FROM {name}_a)",
        f"""{name}_r AS (SELECT {k}0 AS step, a, list_transform({transposed('a', d)},
    lambda v: v / z) AS inv FROM {name}_b
    UNION ALL SELECT {k}step + 1, a, {lin(d, (2, 'inv'), (-1, 'y'))} FROM (
      SELECT {k}step, a, inv, {mm('inv', 'w', d)} AS y FROM (
        SELECT {k}step, a, inv, {mm('a', 'inv', d)} AS w FROM {name}_r WHERE step < {steps})))""",
        f"{name} AS (SELECT {k}inv FROM {name}_r WHERE step = {steps})"]


def top_eigenvalues(source: str, keys: str, d: int, n: int) -> list[str]:
    """``eig(keys, k, mu)``: the n largest eigenvalues of ``source(keys, b)``, whose eigenvalues
    are real and not negative. Squaring sends b to the projector on its top direction."""
    out, current = [], source
    for k in range(n):
        out += [
            f"""sq{k} AS (SELECT {keys}, 0 AS step, b AS s FROM {current}
    UNION ALL SELECT {keys}, step + 1, list_transform(s2, lambda v: v / tr) FROM (
      SELECT {keys}, step, s2, {trace('s2', d)} AS tr FROM (
        SELECT {keys}, step, {mm('s', 's', d)} AS s2 FROM sq{k} WHERE step < 45)))""",
            f"pr{k} AS (SELECT {keys}, s FROM sq{k} WHERE step = 45)",
            f"""bp{k} AS (SELECT c.{keys}, c.b, {mm('c.b', 'p.s', d)} AS bs
    FROM {current} c JOIN pr{k} p USING ({keys}))""",
            f"ei{k} AS (SELECT {keys}, {k} AS k, {trace('bs', d)} AS mu FROM bp{k})",
            f"de{k} AS (SELECT {keys}, {lin(d, (1, 'b'), (-1, 'bs'))} AS b FROM bp{k})"]
        current = f"de{k}"
    out.append("eig AS (" + " UNION ALL ".join(f"SELECT * FROM ei{k}" for k in range(n)) + ")")
    return out


class Steps:
    """One row to which named matrix expressions are added one after another."""

    def __init__(self, first: str):
        self.ctes, self.n = [f"w0 AS ({first})"], 0

    def add(self, **named: str) -> "Steps":
        cols = ", ".join(f"{e} AS {c}" for c, e in named.items())
        self.ctes.append(f"w{self.n + 1} AS (SELECT *, {cols} FROM w{self.n})")
        self.n += 1
        return self

    @property
    def last(self) -> str:
        return f"w{self.n}"


D5 = 5


def row_of_matrices(length: int = 12) -> str:
    cols = ", ".join(f"any_value(m) FILTER (WHERE k = {k}) AS t{k}" for k in range(length))
    return f"SELECT {cols} FROM mats"


def kernel(steps: int = 8, dt: float = 1.0, d: int = D5, given: list[str] | None = None, length: int = 12
           ) -> tuple[list[str], Steps]:
    """Matrices t0.., kernel k0.. and rate ``g`` in one row, of the event series or of ``mats`` in ``given``."""
    pre = [*([EV, *series()] if given is None else given), "t0s AS (SELECT m FROM mats WHERE k = 0)",
           *inverse("ti", "t0s", "m", d)]
    s = Steps(f"SELECT a.*, ti.inv FROM ({row_of_matrices(length)}) a CROSS JOIN ti")
    s.add(h0=lin(d, (1 / dt, "t1"), (-1 / dt, "t0")))
    s.add(g=mm("inv", "h0", d))
    for n in range(steps):
        s.add(**{f"v{n}": mm(f"t{n}", "g", d)})
        terms = [(1 / dt / dt, f"t{n + 1}"), (-1 / dt / dt, f"t{n}"), (-1 / dt, f"v{n}")]
        for m in range(n):
            s.add(**{f"q{n}_{m}": mm(f"t{n - m}", f"k{m}", d)})
            terms.append((-1, f"q{n}_{m}"))
        s.add(**{f"f{n}": lin(d, *terms)})
        s.add(**{f"k{n}": mm("inv", f"f{n}", d)})
    return pre, s


def predict(s: Steps, tau: int, end: int, dt: float = 1.0, tag: str = "p") -> None:
    """Adds matrices ``{tag}0 .. {tag}{end}``."""
    d = D5
    s.add(**{f"{tag}{k}": f"t{k}" for k in range(tau - 1)})
    names = {k: f"{tag}{k}" for k in range(tau - 1)}
    names[tau - 1] = f"t{tau - 1}"       # used as input of no product before it is replaced
    for n in range(tau - 2, end):
        s.add(**{f"{tag}g{n}": mm(f"{tag}{n}", "g", d)})
        terms = [(1, f"{tag}{n}"), (dt, f"{tag}g{n}")]
        for m in range(tau - 1):
            s.add(**{f"{tag}c{n}_{m}": mm(f"{tag}{n - m}", f"k{m}", d)})
            terms.append((dt * dt, f"{tag}c{n}_{m}"))
        s.add(**{f"{tag}{n + 1}": lin(d, *terms)})


CELLS = "cells AS (SELECT a.s AS i, b.s AS j, row_number() OVER (ORDER BY a.s, b.s) AS pos FROM st a CROSS JOIN st b)"


def unpack(s: Steps, names: dict[int, str], index: str, value: str, more: str = "") -> str:
    """Rows (index, i, j, value) of some matrices in the row of ``s``."""
    picks = " UNION ALL ".join(f"SELECT {n}::INTEGER AS {index}, {m} AS m FROM {s.last}"
                               for n, m in names.items())
    return (f"SELECT z.{index}, {more}c.i, c.j, {r6('z.m[c.pos]')} AS {value} "
            f"FROM ({picks}) z CROSS JOIN cells c")


def power_names(s: Steps, base: str, count: int, tag: str) -> dict[int, str]:
    names = {1: base}
    for r in range(2, count + 1):
        s.add(**{f"{tag}{r}": mm(names[r - 1], base, D5)})
        names[r] = f"{tag}{r}"
    return names


def rmse(compat: bool, end: int = 7, pi_step: int = 10) -> str:
    pre, s = kernel()
    d = D5
    pi = f"list_transform(range({d}), lambda x: z{pi_step}[x + 1])"
    # a stochastic matrix squared many times has its stationary vector in every row
    s.add(**{f"z{pi_step}": f"t{pi_step}"})
    for _ in range(12):
        s.add(**{f"z{pi_step}x": mm(f"z{pi_step}", f"z{pi_step}", d)})
        s.ctes[-1] = s.ctes[-1].replace("SELECT *,", f"SELECT * EXCLUDE (z{pi_step}),").replace(
            f"AS z{pi_step}x FROM", f"AS z{pi_step} FROM")
    s.add(pi=pi)
    out = []
    for tau in range(2, end):
        predict(s, tau, end, tag=f"m{tau}_")
        count = end // tau
        names = power_names(s, f"t{tau if compat else tau - 1}", count, f"y{tau}_")
        weighted = lambda a, b: (f"list_sum(list_transform(range({d * d}), lambda x: "
                                 f"pow(pi[x // {d} + 1] * ({a}[x + 1] - {b}[x + 1]), 2)))")
        mem = " + ".join(weighted(f"m{tau}_{k}", f"t{k}") for k in range(end))
        # in whole steps the published index, time/dt - 1, is r * tau - 1
        mar = " + ".join(weighted(names[r], f"t{r * tau - 1}") for r in names)
        rows = end + 1 if compat else end
        out.append(f"""SELECT {tau}::INTEGER AS tau, {float(tau)}::DOUBLE AS time,
    {r6(f'100 * sqrt(({mem}) / {d * d * rows})')} AS memory_rmse,
    {r6(f'100 * sqrt(({mar}) / {d * d * count})')} AS markov_rmse FROM FINAL""")
    body = " UNION ALL ".join(out).replace("FINAL", s.last)
    return with_(*pre, *s.ctes) + body


def passage(rows: str, keys: str, lag: float, d: int = 5, steps: int = 1500) -> list[str]:
    """``mf(keys, m)`` from ``rows(keys, t)``: m[i,j] = lag + sum over k <> j of t[i,k] m[k,j]."""
    step = (f"list_transform(range({d * d}), lambda x: CASE WHEN x // {d} = x % {d} THEN 0.0 ELSE "
            f"{lag} + list_sum(list_transform(range({d}), lambda q: "
            f"t[(x // {d}) * {d} + q + 1] * m[q * {d} + x % {d} + 1])) END)")
    zero = "[" + ", ".join(["0.0"] * (d * d)) + "]::DOUBLE[]"
    return [f"""mfr AS (SELECT {keys}, 0 AS step, t, {zero} AS m FROM {rows}
    UNION ALL SELECT {keys}, step + 1, t, {step} FROM mfr WHERE step < {steps})""",
            f"mf AS (SELECT {keys}, m FROM mfr WHERE step = {steps})"]


def mle(values) -> list[str]:
    """``ml(lag, i, j, n, p, pi)`` for the 3 order states."""
    return [OD, *counts("od", values), "st AS (SELECT DISTINCT state AS s FROM od)", *mle_fit()]


def mle_fit(d: int = 3) -> list[str]:
    """``ml`` from ``cnt`` between the d states of ``st``, by fixed-point iteration."""
    row = lambda m, x: "(" + " + ".join(f"{m}[({x}) * {d} + {q + 1}]" for q in range(d)) + ")"
    step = (f"list_transform(range({d * d}), lambda x: (c[x + 1] + c[(x % {d}) * {d} + x // {d} + 1])"
            f" / ({row('c', f'x // {d}')} / {row('f', f'x // {d}')}"
            f" + {row('c', f'x % {d}')} / {row('f', f'x % {d}')}))")
    return ["cells AS (SELECT a.s AS i, b.s AS j, row_number() OVER (ORDER BY a.s, b.s) AS pos FROM st a CROSS JOIN st b)",
            """cm AS (SELECT l.lag, list(coalesce(n, 0)::DOUBLE ORDER BY c.pos) AS c FROM lags l
    CROSS JOIN cells c LEFT JOIN cnt ON cnt.lag = l.lag AND cnt.i = c.i AND cnt.j = c.j
    GROUP BY l.lag)""",
            f"""fl AS (SELECT lag, 0 AS step, c, {lin(d, (0.5, 'c'))} AS f FROM cm
    UNION ALL SELECT lag, step + 1, c, list_transform(g, lambda v: v / list_sum(g)) FROM (
      SELECT lag, step, c, {step} AS g FROM fl WHERE step < 400))""",
            f"""ml AS (SELECT fl.lag, c.i, c.j, fl.c[c.pos] AS n,
    fl.f[c.pos] / {row('fl.f', f'(c.pos - 1) // {d}')} AS p,
    {row('fl.f', f'(c.pos - 1) // {d}')} AS pi FROM fl CROSS JOIN cells c WHERE step = 400)"""]


def one_way(n_lags: int) -> list[str]:
    """``cnt`` of three macrostates and three states without a way back; ``st``: states in the
    largest strongly connected set at every lag."""
    return [MI, """ow AS (SELECT traj_id, frame, CASE WHEN frame = 0 THEN 8
    WHEN frame = max(frame) OVER (PARTITION BY traj_id) THEN 9 WHEN frame = 2 AND traj_id % 3 = 0 THEN 7
    WHEN state LIKE '%0' THEN 0 WHEN state LIKE '%3' THEN 2 ELSE 1 END::INTEGER AS state FROM mi)""",
            *counts("ow", range(1, n_lags + 1)),
            """rc AS (SELECT lag, i AS a, i AS b FROM cnt UNION SELECT lag, j, j FROM cnt
    UNION SELECT rc.lag, rc.a, c.j FROM rc JOIN cnt c ON c.lag = rc.lag AND c.i = rc.b)""",
            """mu AS (SELECT x.lag, x.a, min(x.b) AS comp FROM rc x
    JOIN rc y ON y.lag = x.lag AND y.a = x.b AND y.b = x.a GROUP BY x.lag, x.a)""",
            """we AS (SELECT lag, s, sum(n) AS w FROM (SELECT lag, i AS s, n FROM cnt UNION ALL SELECT lag, j, n FROM cnt)
    GROUP BY lag, s)""",
            """be AS (SELECT mu.lag, comp FROM mu JOIN we ON we.lag = mu.lag AND we.s = mu.a GROUP BY mu.lag, comp
    QUALIFY row_number() OVER (PARTITION BY mu.lag ORDER BY sum(w) DESC, comp) = 1)""",
            f"st AS (SELECT a AS s FROM mu JOIN be USING (lag, comp) GROUP BY a HAVING count(*) = {n_lags})"]


def md5int(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '0', {', '.join(parts)})), 1, 15))::BIGINT"


def draws(source: str, boots: int) -> list[str]:
    return [f"ids AS (SELECT DISTINCT traj_id FROM {source})",
            "nu AS (SELECT traj_id, row_number() OVER (ORDER BY md5(concat_ws('|', '0', traj_id)), traj_id) - 1 AS idx FROM ids)",
            f"bo AS (SELECT unnest(range({boots}))::INTEGER AS boot_id)",
            f"""pk AS (SELECT boot_id, {md5int('boot_id', 'idx')} % (SELECT count(*) FROM ids) AS idx
    FROM nu CROSS JOIN bo)""",
            """dr AS (SELECT boot_id, traj_id, count(*)::BIGINT AS weight FROM pk JOIN nu USING (idx)
    GROUP BY boot_id, traj_id)"""]


# both eigenvalues below 1 of a 3-state matrix: their sum is trace - 1, their product is det
def two_eigenvalues(cells: str, keys: str) -> list[str]:
    """``ev2(keys, l1, l2, ...)`` from reversible ``cells(keys, m)`` with m = 9 probabilities."""
    return [f"""es AS (SELECT {keys}, m, m[1] + m[5] + m[9] - 1 AS s,
    m[1] * (m[5] * m[9] - m[6] * m[8]) - m[2] * (m[4] * m[9] - m[6] * m[7])
      + m[3] * (m[4] * m[8] - m[5] * m[7]) AS det FROM {cells})""",
            f"""ev2 AS (SELECT *, (s + sqrt(greatest(s * s - 4 * det, 0))) / 2 AS l1,
    (s - sqrt(greatest(s * s - 4 * det, 0))) / 2 AS l2 FROM es)"""]


def sym3(counts_cte: str, keys: str, value: str = "n") -> list[str]:
    """``sf(keys, f)`` symmetrised counts and ``sm(keys, m)`` their transition matrix."""
    return ["st AS (SELECT DISTINCT state AS s FROM od)",
            "cells AS (SELECT a.s AS i, b.s AS j, row_number() OVER (ORDER BY a.s, b.s) AS pos FROM st a CROSS JOIN st b)",
            f"ky AS (SELECT DISTINCT {keys} FROM {counts_cte})",
            f"""de AS (SELECT ky.*, c.pos, coalesce(x.{value}, 0)::DOUBLE AS n FROM ky CROSS JOIN cells c
    LEFT JOIN {counts_cte} x ON x.i = c.i AND x.j = c.j AND {' AND '.join(f'x.{k.strip()} = ky.{k.strip()}' for k in keys.split(','))})""",
            f"ra AS (SELECT {keys}, list(n ORDER BY pos) AS c FROM de GROUP BY {keys})",
            f"""sf AS (SELECT {keys}, list_transform(range(9), lambda x:
    (c[x + 1] + c[(x % 3) * 3 + x // 3 + 1]) / 2) AS f FROM ra)""",
            f"""sm AS (SELECT {keys}, f, list_transform(range(9), lambda x: f[x + 1]
    / (f[(x // 3) * 3 + 1] + f[(x // 3) * 3 + 2] + f[(x // 3) * 3 + 3])) AS m FROM sf)"""]


def boot_its() -> list[str]:
    return [OD, *draws("od", 20), *counts("od", [1, 2, 3], "pt", "traj_id"),
            """bc AS (SELECT boot_id, lag, i, j, sum(n * weight) AS n FROM pt JOIN dr USING (traj_id)
    GROUP BY boot_id, lag, i, j)""",
            *sym3("bc", "boot_id, lag"), *two_eigenvalues("sm", "boot_id, lag"),
            """its AS (SELECT boot_id, lag, k::INTEGER AS k, e AS eigenvalue,
    CASE WHEN e > 0 AND e < 1 THEN -lag / ln(e) END AS t FROM (
      SELECT boot_id, lag, 0 AS k, l1 AS e FROM ev2 UNION ALL
      SELECT boot_id, lag, 1, l2 FROM ev2))"""]


def folds(source: str = "od", base: str = OD, repeats: int = 3) -> list[str]:
    return [base,
            f"""fo AS (SELECT repeat, traj_id, (ntile(6) OVER (PARTITION BY repeat
    ORDER BY md5(concat_ws('|', '0', repeat, traj_id)), traj_id) - 1)::INTEGER AS fold
    FROM (SELECT DISTINCT traj_id FROM {source})
    CROSS JOIN (SELECT unnest(range({repeats}))::INTEGER AS repeat))""",
            *counts(source, [1], "pt", "traj_id"),
            """te AS (SELECT repeat, fold, i, j, sum(n) AS n FROM pt JOIN fo USING (traj_id)
    GROUP BY repeat, fold, i, j)""",
            """tn AS (SELECT f.repeat, p.fold, i, j, sum(n) AS n FROM te f
    JOIN (SELECT DISTINCT fold FROM te) p ON p.fold <> f.fold GROUP BY f.repeat, p.fold, i, j)""",
            """fc AS (SELECT repeat, fold, i, j, coalesce(te.n, 0)::BIGINT AS n_test,
    coalesce(tn.n, 0)::BIGINT AS n_train FROM te FULL JOIN tn USING (repeat, fold, i, j))"""]


def scores_micro() -> str:
    """Three slow processes of 20 states. The right eigenvectors are columns of the projectors
    found by repeated squaring; the score is tr(A B^-1) with A = V'FV and B = V'WV."""
    d = 20
    row = lambda m, x: f"list_sum(list_transform(range({d}), lambda q: {m}[({x}) * {d} + q + 1]))"
    best = (f"list_position(list_transform(range({d}), lambda c: abs(s[c * {d + 1} + 1])), "
            f"list_max(list_transform(range({d}), lambda c: abs(s[c * {d + 1} + 1]))))")
    vectors = " UNION ALL ".join(
        [f"SELECT g, 0 AS k, list_transform(range({d}), lambda x: 1.0) AS v FROM tr"]
        + [f"SELECT g, {k + 1} AS k, list_transform(range({d}), lambda x: s[x * {d} + {best}]) AS v FROM pr{k}"
           for k in range(3)])
    return with_(
        *folds("mi", MI, 10), "st AS (SELECT DISTINCT state AS s FROM mi)",
        "cells AS (SELECT a.s AS i, b.s AS j, row_number() OVER (ORDER BY a.s, b.s) AS pos FROM st a CROSS JOIN st b)",
        "gk AS (SELECT DISTINCT repeat, fold, repeat * 6 + fold AS g FROM fc)",
        """ra AS (SELECT g, list(coalesce(n_train, 0)::DOUBLE ORDER BY pos) AS a,
    list(coalesce(n_test, 0)::DOUBLE ORDER BY pos) AS b FROM gk CROSS JOIN cells c
    LEFT JOIN fc ON fc.repeat = gk.repeat AND fc.fold = gk.fold AND fc.i = c.i AND fc.j = c.j
    GROUP BY g)""",
        f"sy AS (SELECT g, {lin(d, (0.5, 'a'), (0.5, 'ta'))} AS f, {lin(d, (0.5, 'b'), (0.5, 'tb'))} AS e FROM (SELECT *, {transposed('a', d)} AS ta, {transposed('b', d)} AS tb FROM ra))",
        f"rs AS (SELECT *, list_transform(range({d}), lambda x: {row('f', 'x')}) AS w, list_sum(f) AS z FROM sy)",
        f"tr AS (SELECT g, list_transform(range({d * d}), lambda x: f[x + 1] / w[x // {d} + 1] + CASE WHEN x // {d} = x % {d} THEN 1 ELSE 0 END - 2 * w[x % {d} + 1] / z) AS b FROM rs)",
        *top_eigenvalues("tr", "g", d, 3),
        f"vs AS ({vectors})",
        # each vector scaled to unit length so that B is well conditioned
        "vu AS (SELECT g, k, list_transform(v, lambda e: e / sqrt(list_sum(list_transform(v, lambda h: h * h)))) AS v FROM vs)",
        f"tw AS (SELECT g, list_transform(e, lambda h: h / list_sum(e)) AS e, list_transform(range({d}), lambda x: {row('e', 'x')} / list_sum(e)) AS w FROM rs)",
        f"""ab AS (SELECT g, x.k AS ka, y.k AS kb,
    list_sum(list_transform(range({d * d}), lambda c: x.v[c // {d} + 1] * e[c + 1] * y.v[c % {d} + 1])) AS a,
    list_sum(list_transform(range({d}), lambda c: x.v[c + 1] * w[c + 1] * y.v[c + 1])) AS b
    FROM vu x JOIN vu y USING (g) JOIN tw USING (g))""",
        "ml AS (SELECT g, list(a ORDER BY ka, kb) AS a, list(b ORDER BY ka, kb) AS b FROM ab GROUP BY g)",
        *inverse("bi", "ml", "b", 4, "g", 90),
        f"ts AS (SELECT g, {trace('q', 4)} AS score FROM (SELECT g, {mm('a', 'inv', 4)} AS q FROM ml JOIN bi USING (g)))",
        "tn2 AS (SELECT g, 1 + sum(mu - 1) AS score FROM eig GROUP BY g)") + f"""
SELECT repeat, fold, {r6('tn2.score')} AS train_score, {r6('ts.score')} AS test_score
FROM gk JOIN ts USING (g) JOIN tn2 USING (g)"""


def scores(base: str = OD) -> list[str]:
    """One slow process of 3 states. The second eigenvector is a column of (T - l2)(T - 1);
    with v and the test flux F: score = 1 + (vFv - (pi v)^2) / (pi vv - (pi v)^2)."""
    dot = lambda a, b: " + ".join(f"{a.format(k)} * {b.format(k)}" for k in range(3))
    pi = "(f[{0} * 3 + 1] + f[{0} * 3 + 2] + f[{0} * 3 + 3]) / list_sum(f)"
    prod = ("list_transform(range(9), lambda x: list_sum(list_transform(range(3), lambda q: "
            "(m[(x // 3) * 3 + q + 1] - CASE WHEN x // 3 = q THEN l2 ELSE 0 END) * "
            "(m[q * 3 + x % 3 + 1] - CASE WHEN q = x % 3 THEN 1 ELSE 0 END))))")
    size = lambda c: f"(abs(w[{c + 1}]) + abs(w[{c + 4}]) + abs(w[{c + 7}]))"
    return [*folds(base=base), *sym3("fc", "repeat, fold", "n_train"),
            *two_eigenvalues("sm", "repeat, fold"),
            f"vw AS (SELECT repeat, fold, l1, {prod} AS w FROM ev2)",
            f"""vv AS (SELECT repeat, fold, l1, CASE WHEN {size(0)} >= {size(1)} AND {size(0)} >= {size(2)}
    THEN [w[1], w[4], w[7]] WHEN {size(1)} >= {size(2)} THEN [w[2], w[5], w[8]]
    ELSE [w[3], w[6], w[9]] END AS v FROM vw)""",
            """tl AS (SELECT repeat, fold, list_transform(range(9), lambda x:
    (c[x + 1] + c[(x % 3) * 3 + x // 3 + 1]) / 2) AS f FROM (SELECT k.repeat, k.fold,
      list(coalesce(x.n_test, 0)::DOUBLE ORDER BY c.pos) AS c FROM ky k CROSS JOIN cells c
      LEFT JOIN fc x ON x.repeat = k.repeat AND x.fold = k.fold AND x.i = c.i AND x.j = c.j
      GROUP BY k.repeat, k.fold))""",
            f"""ab AS (SELECT repeat, fold, l1, {dot(pi, 'v[{0} + 1]')} AS a,
    {dot(pi, 'pow(v[{0} + 1], 2)')} AS b,
    list_sum(list_transform(range(9), lambda x: v[x // 3 + 1] * f[x + 1] * v[x % 3 + 1]))
      / list_sum(f) AS c FROM vv JOIN tl USING (repeat, fold))""",
            """sc AS (SELECT repeat, fold, 1 + l1 AS train_score,
    1 + (c - a * a) / (b - a * a) AS test_score FROM ab)"""]


def moments(values, columns: int = 64, base: tuple = (VE,)) -> list[str]:
    return [*base, lags(values),
            """pp AS (SELECT l.lag, a.x AS x, b.x AS y FROM ve a CROSS JOIN lags l
    JOIN ve b ON b.traj_id = a.traj_id AND b.frame = a.frame + l.lag)""",
            f"""mo AS (SELECT lag, i, j, count(*)::BIGINT AS n, sum(x[i + 1]) AS sx, sum(y[i + 1]) AS sy,
    sum(x[i + 1] * x[j + 1] + y[i + 1] * y[j + 1]) AS same, sum(x[i + 1] * y[j + 1]) AS cross_
    FROM pp CROSS JOIN (SELECT unnest(range({columns}))::INTEGER AS i)
    CROSS JOIN (SELECT unnest(range({columns}))::INTEGER AS j) GROUP BY lag, i, j)""",
            """cv AS (SELECT a.lag, a.i, a.j, a.n,
    a.same / (2 * a.n) - (a.sx + a.sy) / (2 * a.n) * (b.sx + b.sy) / (2 * b.n) AS c0,
    (a.cross_ + b.cross_) / (2 * a.n) - (a.sx + a.sy) / (2 * a.n) * (b.sx + b.sy) / (2 * b.n) AS ct
    FROM mo a JOIN mo b ON b.lag = a.lag AND b.i = a.j AND b.j = a.i)"""]


def tica_sql(d: int = 64, n: int = 4) -> str:
    return with_(
        *moments([1, 2]),
        "cl AS (SELECT lag, list(c0 ORDER BY i, j) AS c0, list(ct ORDER BY i, j) AS ct FROM cv GROUP BY lag)",
        *inverse("ci", "cl", "c0", d, "lag"),
        f"ba AS (SELECT lag, {mm('inv', 'ct', d)} AS a FROM cl JOIN ci USING (lag))",
        # adding the identity makes every eigenvalue non-negative and keeps their order
        f"bb AS (SELECT lag, {lin(d, (1, 'a'), (1, eye(d)))} AS b FROM ba)",
        *top_eigenvalues("bb", "lag", d, n)) + f"""
SELECT lag, k::INTEGER AS k, {r6('mu - 1')} AS eigenvalue,
  {r6('CASE WHEN mu > 1 AND mu < 2 THEN -lag / ln(mu - 1) END')} AS t FROM eig"""


def distance_vectors(pairs) -> tuple[str, str]:
    """``ve`` with the distances of the given pairs as ``x``."""
    listed = "[" + ", ".join(f"[{i}, {j}]" for i, j in pairs) + "]"
    step = lambda c: f"pow(x[3 * q[1] + {c}] - x[3 * q[2] + {c}], 2)"
    return VE.replace("ve AS", "vx AS"), f"""ve AS (SELECT vec_id, traj_id, frame, list_transform({listed},
    lambda q: sqrt({step(1)} + {step(2)} + {step(3)})) AS x FROM vx)"""


def greedy_selection(values, pairs, sizes: int) -> str:
    """Features chosen one by one: what all chosen ones leave unexplained by elimination, times the
    leading eigenvector of what they explain, found by repeated squaring."""
    d = len(pairs)
    base = distance_vectors(pairs)
    at = lambda m, i, j: f"{m}[({i}) * {d} + ({j}) + 1]"
    cells, line = f"range({d * d})", f"range({d})"
    ctes = [*moments(values, d, base),
            "cl AS (SELECT lag, list(c0 ORDER BY i, j) AS c0, list(ct ORDER BY i, j) AS ct FROM cv GROUP BY lag)",
            f"""r0 AS (SELECT lag, c0, ct, g, g AS r, [('0x' || substr(md5('0|' || lag), 1, 15))::BIGINT % {d}] AS s
    FROM (SELECT *, list_transform({cells}, lambda x: ct[x + 1] / sqrt({at('c0', f'x // {d}', f'x // {d}')}
      * {at('c0', f'x % {d}', f'x % {d}')})) AS g FROM cl))"""]
    out = []
    for k in range(1, sizes + 1):
        e = f"s[{k}]"
        ctes.append(f"""r{k} AS (SELECT lag, c0, ct, g, s, list_transform({cells}, lambda x: r[x + 1]
    - {at('r', f'x // {d}', e)} * {at('r', e, f'x % {d}')} / {at('r', e, e)}) AS r FROM {f'n{k - 1}' if k > 1 else 'r0'})""")
        n, pick = k, lambda m, k=k: (f"list_transform(range({k * k}), lambda x: {m}[s[x // {k} + 1] * {d} + s[x % {k} + 1] + 1])")
        ctes.append(f"cc{n} AS (SELECT lag, s, {pick('c0')} AS c, {pick('ct')} AS t FROM r{k})")
        ctes += inverse(f"iv{n}", f"cc{n}", "c", n, "lag")
        ctes.append(f"pb{n} AS (SELECT lag, {lin(n, (1, 'a'), (1, eye(n)))} AS b FROM (SELECT lag, {mm('inv', 't', n)} AS a FROM cc{n} JOIN iv{n} USING (lag)))")
        ctes.append(f"""pq{n} AS (SELECT lag, 0 AS step, b AS p FROM pb{n} UNION ALL SELECT lag, step + 1,
    list_transform(p2, lambda v: v / {trace('p2', n)}) FROM (SELECT lag, step, {mm('p', 'p', n)} AS p2 FROM pq{n} WHERE step < 45))""")
        ctes.append(f"ev{n} AS (SELECT lag, {trace('z', n)} - 1 AS l FROM (SELECT lag, {mm('b', 'p', n)} AS z FROM pb{n} JOIN pq{n} USING (lag) WHERE step = 45))")
        out.append(f"""SELECT lag, {n}::INTEGER AS n_cols, k::INTEGER AS rank, s[k + 1]::INTEGER AS feature_id,
    {r6('CASE WHEN l > 0 AND l < 1 THEN -lag / ln(l) END')} AS t FROM cc{n} JOIN ev{n} USING (lag) CROSS JOIN (SELECT unnest(range({n})) AS k)""")
        if k < sizes:
            ctes.append(f"""sq{n} AS (SELECT lag, 0 AS step, list_transform({cells}, lambda x: g[x + 1] - r[x + 1]) AS a FROM r{k}
    UNION ALL SELECT lag, step + 1, list_transform(a2, lambda v: v / tr) FROM (SELECT lag, step, a2, {trace('a2', d)} AS tr
      FROM (SELECT lag, step, {mm('a', 'a', d)} AS a2 FROM sq{n} WHERE step < 40)))""")
            # the projector's diagonal holds the squares of the eigenvector
            gain = (f"list_transform({line}, lambda x: CASE WHEN list_contains(s, x) THEN -1 ELSE "
                    f"abs({at('r', 'x', 'x')}) * sqrt(abs({at('a', 'x', 'x')})) END)")
            ctes.append(f"""n{k} AS (SELECT lag, c0, ct, g, r, list_append(s, list_position(gain, list_max(gain)) - 1) AS s
    FROM (SELECT r{k}.*, {gain} AS gain FROM r{k} JOIN sq{n} USING (lag) WHERE step = 40))""")
    return with_(*ctes) + " UNION ALL ".join(out)


def selection(width: int) -> list[str]:
    """``sel``: column 0, then the column that one rank-1 update explains worst along its own
    direction; timescales from the 1 x 1 and 2 x 2 problems in closed form."""
    return [*moments([1, 2], width),
            """di AS (SELECT lag, i, c0, ct FROM cv WHERE i = j)""",
            """sc AS (SELECT cv.lag, cv.i, cv.j, cv.ct / sqrt(a.c0 * b.c0) AS g FROM cv
    JOIN di a ON a.lag = cv.lag AND a.i = cv.i JOIN di b ON b.lag = cv.lag AND b.i = cv.j)""",
            """f0 AS (SELECT lag, i, g AS g0 FROM sc WHERE j = 0)""",
            """ga AS (SELECT f.lag, f.i, abs(d.g - f.g0 * f.g0 / z.g0) * abs(f.g0) AS gain FROM f0 f
    JOIN sc d ON d.lag = f.lag AND d.i = f.i AND d.j = f.i
    JOIN f0 z ON z.lag = f.lag AND z.i = 0 WHERE f.i <> 0)""",
            "pi AS (SELECT lag, arg_max(i, gain) AS second FROM ga GROUP BY lag)",
            """ab AS (SELECT pi.lag, second, a.c0 AS c00, a.ct AS t00, b.c0 AS c01, b.ct AS t01,
    d.c0 AS c11, d.ct AS t11 FROM pi
    JOIN cv a ON a.lag = pi.lag AND a.i = 0 AND a.j = 0
    JOIN cv b ON b.lag = pi.lag AND b.i = 0 AND b.j = second
    JOIN cv d ON d.lag = pi.lag AND d.i = second AND d.j = second)""",
            # det(T - l C) = qa l^2 - qb l + qc
            """qd AS (SELECT *, c00 * c11 - c01 * c01 AS qa,
    t00 * c11 + t11 * c00 - 2 * t01 * c01 AS qb, t00 * t11 - t01 * t01 AS qc FROM ab)""",
            """la AS (SELECT lag, second, t00 / c00 AS l1,
    (qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS l2 FROM qd)""",
            """sel AS (SELECT lag, n_cols::INTEGER AS n_cols, rank::INTEGER AS rank,
    feature_id::INTEGER AS feature_id, CASE WHEN l > 0 AND l < 1 THEN -lag / ln(l) END AS t FROM (
      SELECT lag, 1 AS n_cols, 0 AS rank, 0 AS feature_id, l1 AS l FROM la UNION ALL
      SELECT lag, 2, 0, 0, l2 FROM la UNION ALL SELECT lag, 2, 1, second, l2 FROM la))"""]


def projection(lag: int = 1, d: int = 64, n: int = 2, base: tuple = (VE,)) -> list[str]:
    """``ys(vec_id, traj_id, frame, k, y)``. Eigenvectors as columns of the projectors, scaled to unit
    variance, largest entry positive; projections scaled by their eigenvalue."""
    size = f"list_transform(range({d}), lambda c: abs(s[c * {d + 1} + 1]))"
    column = f"list_transform(range({d}), lambda x: s[x * {d} + list_position({size}, list_max({size}))])"
    parts = " UNION ALL ".join(
        f"SELECT {k} AS k, {column} AS v, mu - 1 AS l FROM pr{k} JOIN ei{k} USING (lag)"
        for k in range(n))
    return [
        *moments([lag], d, base),
        "cl AS (SELECT lag, list(c0 ORDER BY i, j) AS c0, list(ct ORDER BY i, j) AS ct FROM cv GROUP BY lag)",
        *inverse("ci", "cl", "c0", d, "lag"),
        f"bb AS (SELECT lag, {lin(d, (1, 'a'), (1, eye(d)))} AS b FROM (SELECT lag, {mm('inv', 'ct', d)} AS a FROM cl JOIN ci USING (lag)))",
        *top_eigenvalues("bb", "lag", d, n),
        f"vs AS ({parts})",
        f"vn AS (SELECT k, l, v, list_sum(list_transform(range({d * d}), lambda x: v[x // {d} + 1] * c0[x + 1] * v[x % {d} + 1])) AS var FROM vs CROSS JOIN cl)",
        """vf AS (SELECT k, list_transform(v, lambda e: e * l / sqrt(var) * CASE WHEN list_max(v) >= -list_min(v)
    THEN 1 ELSE -1 END) AS w FROM vn)""",
        "me AS (SELECT list((sx + sy) / (2 * n) ORDER BY i) AS m FROM mo WHERE j = 0)",
        f"""ys AS (SELECT vec_id, traj_id, frame, k, list_sum(list_transform(range({d}), lambda c:
    (x[c + 1] - m[c + 1]) * w[c + 1])) AS y FROM ve CROSS JOIN vf CROSS JOIN me)"""]


def two_macrostates(d: int = 20, base: list[str] | None = None, cnt: str = "cnt", states: str = "mi",
                    kept: str = "SELECT DISTINCT state AS s FROM mi") -> list[str]:
    """``lu(state, macrostate, membership)`` of the kept ones among d states. With two macrostates the
    memberships are the second eigenvector, moved and scaled to 0 .. 1. States that are not kept have
    empty rows and columns, which leaves the eigenvector alone."""
    size = f"list_transform(range({d}), lambda c: abs(s[c * {d + 1} + 1]))"
    return [*([MI, *counts("mi", [1])] if base is None else base), f"kp AS ({kept})",
            f"""sy AS (SELECT i, j, sum(n) / 2.0 AS n FROM (SELECT i, j, n FROM {cnt} UNION ALL SELECT j, i, n FROM {cnt})
    WHERE i IN (SELECT s FROM kp) AND j IN (SELECT s FROM kp) GROUP BY i, j)""",
            """tr AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p,
    sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS pi FROM sy)""",
            f"ms AS (SELECT DISTINCT state AS s FROM {states})",
            """bm AS (SELECT 1 AS one, list(CASE WHEN x.s IS NULL OR y.s IS NULL THEN 0 ELSE coalesce(p, 0)
      + CASE WHEN a.s = b.s THEN 1 ELSE 0 END - 2 * w.pi END ORDER BY a.s, b.s) AS b
    FROM ms a CROSS JOIN ms b LEFT JOIN kp x ON x.s = a.s LEFT JOIN kp y ON y.s = b.s LEFT JOIN tr ON tr.i = a.s AND tr.j = b.s
    LEFT JOIN (SELECT DISTINCT j, pi FROM tr) w ON w.j = b.s)""",
            *[c.replace("sq0", "ls0").replace("pr0", "lp0").replace("bp0", "lb0").replace("ei0", "le0").replace("de0", "ld0")
              .replace("eig ", "leig ") for c in top_eigenvalues("bm", "one", d, 1)],
            f"ve2 AS (SELECT list_transform(range({d}), lambda x: s[x * {d} + list_position({size}, list_max({size}))]) AS v FROM lp0)",
            """rv AS (SELECT m.s AS state, v[r] AS v FROM ve2 CROSS JOIN (SELECT s, row_number() OVER (ORDER BY s) AS r FROM ms) m
    JOIN kp USING (s))""",
            "ch AS (SELECT state, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS c FROM rv)",
            """lu AS (SELECT state, CASE WHEN (c > 0.5) = (SELECT c > 0.5 FROM ch ORDER BY state LIMIT 1) THEN 0 ELSE 1 END::INTEGER AS macrostate,
    greatest(c, 1 - c) AS membership FROM ch)"""]


def chain_sql(k: int = 8, n_lags: int = 6, kernel_steps: int = 4) -> str:
    """Distances, projection, clustering, trimming, lumping, macrostate series, memory kernel."""
    renamed = lambda rows, tag: [c.replace("lags", f"lags{tag}").replace("cnt", f"cnt{tag}") for c in rows]
    given = [*projection(2, 45, 3, distance_vectors(PAIRS)),
             "yv AS (SELECT traj_id, frame, list(y ORDER BY k) AS x FROM ys GROUP BY traj_id, frame)",
             *k_centers_from("yv", k, HASHED), f"dt AS (SELECT traj_id, frame, state::INTEGER AS state FROM g{k - 1})",
             *renamed(counts("dt", [1]), 8),
             """wr AS (SELECT i AS a, i AS b FROM cnt8 UNION SELECT j, j FROM cnt8
    UNION SELECT wr.a, c.j FROM wr JOIN cnt8 c ON c.i = wr.b)""",
             "wm AS (SELECT x.a, min(x.b) AS comp FROM wr x JOIN wr y ON y.a = x.b AND y.b = x.a GROUP BY x.a)",
             """wb AS (SELECT comp FROM wm JOIN (SELECT s, sum(n) AS w FROM (SELECT i AS s, n FROM cnt8 UNION ALL SELECT j, n FROM cnt8)
    GROUP BY s) ON s = wm.a GROUP BY comp ORDER BY sum(w) DESC, comp LIMIT 1)""",
             *two_macrostates(k, [], "cnt8", "dt", "SELECT a AS s FROM wm WHERE comp = (SELECT comp FROM wb)"),
             "ma AS (SELECT traj_id, frame, macrostate AS state FROM dt JOIN lu USING (state))",
             *renamed(counts("ma", range(1, n_lags + 1)), 9),
             "ser AS (SELECT (lag - 1)::INTEGER AS k, i, j, n / sum(n) OVER (PARTITION BY lag, i) AS p FROM cnt9)",
             "mats AS (SELECT k, list(p ORDER BY i, j) AS m FROM ser GROUP BY k)"]
    pre, s = kernel(kernel_steps, 1.0, 2, given, n_lags)
    cells = "cells AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS pos FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j))"
    return with_(*pre, cells, *s.ctes) + f"SELECT 'series' AS part, k, i, j, {r6('p')} AS value FROM ser UNION ALL " + unpack(
        s, {n: f"k{n}" for n in range(kernel_steps)}, "k", "value").replace("SELECT z.k", "SELECT 'kernel', z.k", 1)


def timescales_sql() -> str:
    d = D5
    return with_(
        EV, *counts("ev", [1, 2, 5]), SYM,
        "tr AS (SELECT lag, i, j, n, n / sum(n) OVER (PARTITION BY lag, i) AS p, sum(n) OVER (PARTITION BY lag, j) / sum(n) OVER (PARTITION BY lag) AS pi FROM sym)",
        # (T + 1) minus its part along the stationary direction, whose eigenvalue was 2
        "bb AS (SELECT lag, list(p + CASE WHEN i = j THEN 1 ELSE 0 END - 2 * pi ORDER BY i, j) AS b FROM tr GROUP BY lag)",
        *top_eigenvalues("bb", "lag", d, 4)) + f"""
SELECT lag, k::INTEGER AS k, {r6('mu - 1')} AS eigenvalue,
  {r6('CASE WHEN mu > 1 AND mu < 2 THEN -lag / ln(mu - 1) END')} AS t FROM eig"""


def k_centers_from(source: str, k: int, start: str = "traj_id, frame") -> list[str]:
    """``g{k-1}``: every point of ``source(traj_id, frame, x)`` with its distance to, and number of, its
    nearest center."""
    out = [f"c0 AS (SELECT traj_id, frame, x FROM {source} ORDER BY {start} LIMIT 1)",
           f"g0 AS (SELECT v.traj_id, v.frame, v.x, list_distance(v.x, c0.x) AS distance, 0 AS state FROM {source} v CROSS JOIN c0)"]
    for s in range(1, k):
        out += [f"c{s} AS (SELECT traj_id, frame, x FROM g{s - 1} ORDER BY distance DESC, traj_id, frame LIMIT 1)",
                f"""h{s} AS (SELECT g.*, list_distance(g.x, c.x) AS e FROM g{s - 1} g CROSS JOIN c{s} c)""",
                f"""g{s} AS (SELECT traj_id, frame, x, CASE WHEN e < distance THEN e ELSE distance END AS distance,
    CASE WHEN e < distance THEN {s} ELSE state END AS state FROM h{s})"""]
    return out


def k_centers_ctes(k: int = 6, width: int = 64, start: str = "traj_id, frame") -> list[str]:
    return [VE.replace("embedding::DOUBLE[]", f"embedding[1:{width}]::DOUBLE[]"), *k_centers_from("ve", k, start)]


HASHED = "md5(concat_ws('|', '0', traj_id, frame)), traj_id, frame"


def distances(pairs) -> str:
    rows = ", ".join(f"({f}::INTEGER, {i}, {j})" for f, (i, j) in enumerate(pairs))
    square = " + ".join(f"pow(x[3 * i + {c}] - x[3 * j + {c}], 2)" for c in (1, 2, 3))
    return with_(VE, f"pa(feature_id, i, j) AS (VALUES {rows})") + (
        f"SELECT traj_id, frame, feature_id, {r6(f'sqrt({square})')} AS d FROM ve CROSS JOIN pa")


def ergodic() -> list[str]:
    return [MI, *counts("mi", [1]),
            "lim AS (SELECT quantile_cont(n, 0.9) AS z FROM cnt)",
            "nodes AS (SELECT i AS s FROM cnt UNION SELECT j FROM cnt)",
            """rc AS (SELECT s AS a, s AS b FROM nodes
    UNION SELECT rc.a, c.j FROM rc JOIN cnt c ON c.i = rc.b WHERE c.n > (SELECT z FROM lim))""",
            "mu AS (SELECT x.a, min(x.b) AS comp FROM rc x JOIN rc y ON y.a = x.b AND y.b = x.a GROUP BY x.a)",
            "we AS (SELECT s, sum(n) AS w FROM (SELECT i AS s, n FROM cnt UNION ALL SELECT j, n FROM cnt) GROUP BY s)",
            "be AS (SELECT comp FROM mu JOIN we ON we.s = mu.a GROUP BY comp ORDER BY sum(w) DESC, comp LIMIT 1)",
            """ke AS (SELECT a AS state, (row_number() OVER (ORDER BY a) - 1)::INTEGER AS new_state
    FROM mu WHERE comp = (SELECT comp FROM be))"""]


def samples(n: int, source: str = "ev", base: tuple = (EV,)) -> list[str]:
    """``sa``: for each state and sample the frame whose rank by hash was drawn."""
    return [*base, f"""rk AS (SELECT *, row_number() OVER (PARTITION BY state
      ORDER BY md5(concat_ws('|', '0', traj_id, frame)), traj_id, frame) - 1 AS rank FROM {source})""",
            f"""dw AS (SELECT state, s::INTEGER AS sample_no, {md5int('state', 's')} % n AS rank
    FROM (SELECT state, count(*) AS n FROM {source} GROUP BY state) CROSS JOIN (SELECT unnest(range({n})) AS s))""",
            "sa AS (SELECT * FROM dw JOIN rk USING (state, rank))"]


PAIRS = [(i, j) for i in range(10) for j in range(i + 1, 10)]


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    pos = "row_number() OVER (ORDER BY s) - 1"

    # sources and sinks
    out["index_list_read"] = "SELECT DISTINCT (p_size - 1)::INTEGER AS atom FROM part"
    out["path_number_order"] = "SELECT page_id, page_id AS traj_id FROM pages"
    out["features_parquet_roundtrip"] = with_(VE) + f"""SELECT vec_id, traj_id, frame,
  k::INTEGER AS pos, {r6('x[k + 1]')} AS v FROM ve CROSS JOIN (SELECT unnest(range(64)) AS k)"""
    out["load_one_frame"] = with_(VE, VC) + f"""SELECT vec_id, traj_id, frame, k::INTEGER AS pos,
  {r6('x[k + 1]')} AS v FROM vc CROSS JOIN (SELECT unnest(range(66)) AS k)
  WHERE traj_id = 3 AND frame = 2"""
    out["matrix_text_roundtrip"] = with_(EV, *series(),
                                         f"nr AS (SELECT s, ({pos})::INTEGER AS r FROM st)") + f"""
SELECT k, a.r AS i, b.r AS j, {r6('p')} AS p FROM ser JOIN nr a ON a.s = i JOIN nr b ON b.s = j"""
    out["general_number_tsv"] = "SELECT c_custkey, printf('%g', c_acctbal) AS c_acctbal FROM customer"
    out["manifest_tsv"] = with_(*samples(10)) + """SELECT state AS macro_state,
  'macro' || state || '_sample' || sample_no || '.pdb' AS output_filename, traj_id AS traj_index,
  frame AS frame_index FROM sa"""
    out["resample_choices"] = with_(EV, *draws("ev", 5)) + "SELECT boot_id, traj_id, weight FROM dr"

    out["frames_text_roundtrip"] = with_(EV) + """SELECT traj_id, frame, value AS psi,
  json_extract_string(props, '$.k')::DOUBLE AS phi FROM ev"""
    out["trajectory_files"] = "SELECT DISTINCT o_custkey AS traj_id FROM orders"
    at = lambda k: f"printf('%.3f', x[3 * s - {3 - k}])::DOUBLE"
    out["structure_files"] = with_(*samples(10, "vs", (VE, VC, "vs AS (SELECT *, vec_id % 4 AS state FROM vc)"))) + f"""
SELECT 'macro' || state || '_sample' || sample_no || '.pdb' AS output_filename, s::INTEGER AS serial, 'A' || s AS name,
  {at(1)} AS x, {at(2)} AS y, {at(3)} AS z FROM sa CROSS JOIN (SELECT unnest(range(1, 23))::INTEGER AS s)"""

    # sequences and counts
    out["frame_index"] = with_(EV) + "SELECT traj_id, frame, state FROM ev"
    out["frame_index_orders"] = with_(OD) + "SELECT traj_id, frame, state FROM od"
    out["frame_index_split"] = with_(EV) + "SELECT traj_id, frame, event_id FROM ev"
    out["distinct_states"] = with_(MI) + "SELECT DISTINCT state FROM mi"
    out["state_positions"] = with_(EV) + "SELECT traj_id, frame FROM ev WHERE state = 'purchase'"
    out["strided_frames"] = with_(EV) + "SELECT traj_id, frame, state FROM ev WHERE frame % 10 = 0"
    out["stride_join"] = with_(EV) + """SELECT traj_id, frame, value AS psi,
  json_extract_string(props, '$.k')::DOUBLE AS phi, state AS macrostate FROM ev WHERE frame % 10 = 0"""
    out["union_trajectories"] = with_(EV, OD) + """SELECT source, state, count(*)::BIGINT AS n,
  max(frame) AS last_frame FROM (SELECT 'events' AS source, state, frame FROM ev UNION ALL
  SELECT 'orders', state, frame FROM od) GROUP BY source, state"""
    out["lagged_pairs"] = with_(EV) + """SELECT a.traj_id, a.frame, 3::INTEGER AS lag, a.state AS i,
  b.state AS j FROM ev a JOIN ev b ON b.traj_id = a.traj_id AND b.frame = a.frame + 3"""
    plain = "SELECT lag, i, j, n FROM cnt"
    out["transition_counts"] = with_(EV, *counts("ev", [1, 2, 5])) + plain
    out["transition_counts_orders"] = with_(OD, *counts("od", [1, 2, 5])) + plain
    out["transition_counts_micro"] = with_(MI, *counts("mi", [1, 10])) + plain
    out["counts_per_trajectory"] = with_(EV, *counts("ev", [1], extra="traj_id")) + \
        "SELECT traj_id, lag, i, j, n FROM cnt"
    out["lag_sweep_counts"] = with_(EV, *counts("ev", range(1, 41))) + plain
    out["lag_equality_filter"] = with_(EV, *counts("ev", [1, 10])) + plain + " WHERE lag = 10"
    out["tpm_lag"] = with_(EV, *counts("ev", [2])) + \
        f"SELECT i, j, n, {r6('p')} AS p FROM (SELECT *, n / sum(n) OVER (PARTITION BY i) AS p FROM cnt)"
    out["tpm_transpose"] = with_(EV, *counts("ev", [1, 2, 5]), SYM) + \
        f"SELECT lag, i, j, n::DOUBLE AS n, {r6('p')} AS p FROM (SELECT *, n / sum(n) OVER (PARTITION BY lag, i) AS p FROM sym)"
    out["tpm_reversible_mle"] = with_(*mle([1, 2])) + \
        f"SELECT lag, i, j, n, {r6('p')} AS p, {r6('pi')} AS pi FROM ml"
    out["populations_transpose"] = with_(EV, *counts("ev", [1, 2, 5]), SYM) + f"""
SELECT lag, i, {r6('p')} AS p FROM (SELECT lag, i, sum(n) / sum(sum(n)) OVER (PARTITION BY lag) AS p
  FROM sym GROUP BY lag, i)"""
    power = mm("m", "m", D5)
    out["populations_stationary"] = with_(
        EV, *counts("ev", [1, 2, 5]),
        "tp AS (SELECT lag, i, j, n / sum(n) OVER (PARTITION BY lag, i) AS p FROM cnt)",
        "tm AS (SELECT lag, list(p ORDER BY i, j) AS m FROM tp GROUP BY lag)",
        f"pw AS (SELECT lag, 0 AS step, m FROM tm UNION ALL SELECT lag, step + 1, {power} FROM pw WHERE step < 12)",
        f"nr AS (SELECT s, {pos} AS r FROM (SELECT DISTINCT state AS s FROM ev))") + f"""
SELECT lag, s AS i, {r6('m[r + 1]')} AS p FROM pw CROSS JOIN nr WHERE step = 12"""
    out["ergodic_trimming"] = with_(*ergodic()) + \
        "SELECT 1::INTEGER AS lag, state, new_state FROM ke"
    out["trimmed_counts"] = with_(*ergodic()) + """SELECT c.lag, a.new_state AS i, b.new_state AS j, c.n
  FROM cnt c JOIN ke a ON a.state = c.i JOIN ke b ON b.state = c.j"""

    # series
    ser = [EV, *series()]
    out["tpm_series"] = with_(*ser) + f"SELECT k, i, j, {r6('p')} AS p FROM ser"
    out["tpm_series_mle"] = with_(*mle([1, 2, 3])) + \
        f"SELECT (lag - 1)::INTEGER AS k, i, j, {r6('p')} AS p FROM ml"
    slope = lambda dt: f"""SELECT a.k, a.i, a.j, (b.p - a.p) / {dt} AS dp FROM ser a
  JOIN ser b ON b.k = a.k + 1 AND b.i = a.i AND b.j = a.j"""
    out["tpm_derivative"] = with_(*ser) + f"SELECT k, i, j, {r6('dp')} AS dp FROM ({slope(0.1)})"
    out["tpm_normalisation_check"] = with_(*ser) + """
SELECT (SELECT bool_and(abs(s - 1) < 1e-3) FROM (SELECT sum(p) AS s FROM ser GROUP BY k, i)) AS row_ok,
  (SELECT bool_and(abs(s - 1) < 1e-3) FROM (SELECT sum(p) AS s FROM ser GROUP BY k, j)) AS col_ok"""
    out["tpm_column_oriented"] = out["tpm_series"]
    out["tpm_flattened"] = with_(*ser) + f"""SELECT k, p::INTEGER AS pos,
  {r6('CASE WHEN p = 0 THEN k * 0.1::DOUBLE ELSE m[p] END')} AS v
  FROM mats CROSS JOIN (SELECT unnest(range(26)) AS p)"""
    out["tpm_last"] = with_(*ser) + f"SELECT i, j, {r6('p')} AS p FROM ser WHERE k = 11"
    out["negatives_clipped"] = with_(*ser) + \
        f"SELECT k, i, j, {r6('greatest(dp, 0)')} AS p FROM ({slope(1.0)})"
    out["state_dropped"] = with_(*ser) + \
        f"SELECT k, i, j, {r6('p')} AS p FROM ser WHERE i <> 'error' AND j <> 'error'"

    # memory models
    pre, s = kernel()
    out["initial_rate"] = with_(*pre, CELLS, *s.ctes) + \
        f"SELECT c.i, c.j, {r6('g[c.pos]')} AS rate FROM {s.last} CROSS JOIN cells c"
    out["memory_kernel"] = with_(*pre, CELLS, *s.ctes) + unpack(
        s, {n: f"k{n}" for n in range(5)}, "n", "kernel", "(z.n + 1) * 1.0::DOUBLE AS time, ")
    pre, s = kernel()
    s.add(i0="k0")
    for n in range(1, 6):
        s.add(**{f"i{n}": lin(D5, (1, f"i{n - 1}"), (1, f"k{n}"))})
    norm = lambda n: f"sqrt(list_sum(list_transform(i{n}, lambda v: v * v))) / {D5}"
    out["mean_integral_kernel"] = with_(*pre, *s.ctes) + " UNION ALL ".join(
        f"SELECT {n}::INTEGER AS n, {n + 1}.0::DOUBLE AS time, {r6(norm(n))} AS mik FROM {s.last}"
        for n in range(6))
    pre, s = kernel()
    predict(s, 4, 8)
    out["memory_prediction"] = with_(*pre, CELLS, *s.ctes) + unpack(
        s, {n: f"p{n}" for n in range(9)}, "idx", "p",
        "(z.idx + 1) * 1.0::DOUBLE AS lag, z.idx * 1.0::DOUBLE AS time, ")
    s2 = Steps(row_of_matrices())
    names = power_names(s2, "t2", 4, "y")
    timed = lambda lag, time: f"z.r * {lag}::DOUBLE AS lag, z.r * {time}::DOUBLE AS time, "
    out["markov_prediction"] = with_(*ser, CELLS, *s2.ctes) + unpack(
        s2, names, "r", "p", timed("(3 * 0.1::DOUBLE)", "(3 * 0.1::DOUBLE)"))
    s3 = Steps(row_of_matrices())
    s3.add(y0=eye(D5))
    names = {0: "y0", **power_names(s3, "t3", 4, "y")}
    out["markov_prediction_compat"] = with_(*ser, CELLS, *s3.ctes) + unpack(
        s3, names, "r", "p", timed("(4 * 0.1::DOUBLE)", "(3 * 0.1::DOUBLE)"))
    pre, s = kernel()
    predict(s, 4, 8)
    powers = power_names(s, "t3", 2, "y")
    at = {4 * r - 1: m for r, m in powers.items()}
    picks = " UNION ALL ".join(
        f"SELECT {k}::INTEGER AS k, t{k} AS o, p{k} AS f, {at.get(k, 'NULL::DOUBLE[]')} AS y FROM {s.last}"
        for k in range(9))
    out["comparison_table"] = with_(*pre, CELLS, *s.ctes) + f"""SELECT k, c.i, c.j,
  {r6('o[c.pos]')} AS observed, {r6('f[c.pos]')} AS memory, {r6('y[c.pos]')} AS markov
  FROM ({picks}) CROSS JOIN cells c"""
    thinned = " UNION ALL ".join(
        f"SELECT {k}::INTEGER AS k, {f't{k}' if k % 2 == 0 else 'NULL::DOUBLE[]'} AS o, p{k} AS f, "
        f"{at.get(k, 'NULL::DOUBLE[]')} AS y FROM {s.last}" for k in range(9))
    out["tpm_slow_mle"] = with_(EV, """sl AS (SELECT traj_id, frame,
    CASE WHEN (frame // 10) % 4 = 3 THEN 1 ELSE (frame // 10) % 4 END::INTEGER AS state FROM ev)""",
        *counts("sl", [1])) + f"""SELECT i, j, {r6('n / sum(n) OVER (PARTITION BY i)')} AS p FROM cnt"""
    out["frames_left_out"] = """SELECT CASE WHEN o_custkey % 7 = 0 THEN 'traj' ELSE 'day' END AS reason,
  count(*) AS n FROM orders WHERE o_custkey % 7 = 0 OR o_orderkey % 5 = 0 GROUP BY 1"""
    out["comparison_thinned"] = with_(*pre, CELLS, *s.ctes) + f"""SELECT k, c.i, c.j,
  {r6('o[c.pos]')} AS observed, {r6('f[c.pos]')} AS memory, {r6('y[c.pos]')} AS markov
  FROM ({thinned}) CROSS JOIN cells c
UNION ALL SELECT -1, c.i, c.j, (c.i = c.j)::DOUBLE, (c.i = c.j)::DOUBLE, (c.i = c.j)::DOUBLE FROM cells c"""
    out["rmse_sweep"] = rmse(False)
    out["rmse_from_flat"] = rmse(False)
    out["rmse_sweep_compat"] = rmse(True)
    out["mean_first_passage"] = with_(
        *ser, CELLS, "tm AS (SELECT k, m AS t FROM mats)",
        *passage("tm", "k", 200.0)) + \
        f"SELECT k, c.i, c.j, {r6('m[c.pos]')} AS mfpt FROM mf CROSS JOIN cells c"
    pre, s = kernel()
    predict(s, 4, 8)
    clip = ("list_transform(range(25), lambda x: greatest(p8[x + 1], 0) / list_sum(list_transform("
            "range(5), lambda q: greatest(p8[(x // 5) * 5 + q + 1], 0))))")
    out["mean_first_passage_predicted"] = with_(
        *pre, CELLS, *s.ctes, f"tm AS (SELECT 8 AS k, {clip} AS t FROM {s.last})",
        *passage("tm", "k", 8.0)) + \
        f"SELECT c.i, c.j, {r6('m[c.pos]')} AS mfpt FROM mf CROSS JOIN cells c"

    # timescales, resampling, scores
    out["implied_timescales"] = timescales_sql()
    out["bootstrap_draws"] = with_(EV, *draws("ev", 5)) + "SELECT boot_id, traj_id, weight FROM dr"
    out["resampled_frames"] = with_(EV, *draws("ev", 5)) + """SELECT boot_id, state,
  sum(weight)::BIGINT AS n FROM ev JOIN dr USING (traj_id) GROUP BY boot_id, state"""
    out["bootstrap_timescales"] = with_(*boot_its()) + \
        f"SELECT boot_id, lag, k, {r6('eigenvalue')} AS eigenvalue, {r6('t')} AS t FROM its"
    out["bootstrap_summary"] = with_(*boot_its()) + f"""SELECT lag, k, {r6('avg(t)')} AS mean_t,
  {r6('stddev_pop(t)')} AS std_t, count(t)::BIGINT AS n_finite FROM its GROUP BY lag, k"""
    out["fold_assignment"] = with_(*folds()) + "SELECT repeat, traj_id, fold FROM fo"
    out["fold_counts"] = with_(*folds()) + "SELECT repeat, fold, i, j, n_test, n_train FROM fc"
    out["rayleigh_scores"] = with_(*scores()) + f"""SELECT repeat, fold,
  {r6('train_score')} AS train_score, {r6('test_score')} AS test_score FROM sc"""
    by_key = OD.replace("o_orderstatus AS state", "'k' || (o_orderkey % 3) AS state")
    out["rayleigh_sweep"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS run_id, {r6('median(test_score)')} AS test_median,
  {r6('avg(train_score)')} AS train_mean, {r6('stddev_pop(train_score)')} AS train_std,
  count(*)::BIGINT AS n_scores FROM ({with_(*scores(base))} SELECT * FROM sc)"""
        for name, base in (("status", OD), ("key", by_key)))
    out["rayleigh_scores_micro"] = scores_micro()
    q = lambda p: r6(f"quantile_cont(test_score, {p})")
    out["rayleigh_summary"] = with_(*scores()) + f"""SELECT {q(0.25)} AS test_q1,
  {q(0.5)} AS test_median, {q(0.75)} AS test_q3, {r6('min(test_score)')} AS test_min,
  {r6('max(test_score)')} AS test_max, {r6('avg(train_score)')} AS train_mean,
  {r6('stddev_pop(train_score)')} AS train_std, count(*)::BIGINT AS n_scores FROM sc"""
    out["sampled_states"] = with_(*samples(10)) + "SELECT state, sample_no, traj_id, frame FROM sa"
    out["sampled_states_distinct"] = with_(EV) + """SELECT state, sample_no, traj_id, frame FROM (
  SELECT state, traj_id, frame, (row_number() OVER (PARTITION BY state ORDER BY
    md5(concat_ws('|', '0', traj_id, frame)), traj_id, frame) - 1)::INTEGER AS sample_no FROM ev)
  WHERE sample_no < 10"""
    out["sampled_structures"] = with_(*samples(5, "vs", (
        VE, VC, "vs AS (SELECT *, vec_id % 4 AS state FROM vc)"))) + """SELECT state, sample_no, traj_id, frame, vec_id,
  array_to_string(list_transform(x, lambda v: round(v * 1000)::INT::VARCHAR), ' ') AS xyz FROM sa"""

    out["structure_lines"] = with_(VE, VC) + """SELECT 'v' || vec_id AS output_filename, s AS serial,
  printf('ATOM  %5d %-4s %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00', s, 'A' || s, 'MOL', 1,
         x[3 * s - 2], x[3 * s - 1], x[3 * s]) AS line
  FROM vc CROSS JOIN (SELECT unnest(range(1, 23))::INTEGER AS s)"""

    # features
    out["atom_pairs"] = """WITH a AS (SELECT DISTINCT (p_size - 1)::INTEGER AS atom FROM part)
SELECT (row_number() OVER (ORDER BY x.atom, y.atom) - 1)::INTEGER AS feature_id, x.atom AS i,
  y.atom AS j FROM a x JOIN a y ON x.atom < y.atom"""
    out["pair_distances"] = distances(PAIRS)
    out["pair_distances_long"] = distances(PAIRS)
    out["selected_columns"] = with_(VE) + \
        f"SELECT vec_id, {r6('x[6]')} AS x0, {r6('x[1]')} AS x1, {r6('x[18]')} AS x2 FROM ve"
    out["leading_columns"] = with_(VE) + f"""SELECT vec_id, k::INTEGER AS pos, {r6('x[k + 1]')} AS v
  FROM ve CROSS JOIN (SELECT unnest(range(3)) AS k)"""
    out["lagged_moments"] = with_(*moments([1, 2], 64)) + f"""SELECT lag, i, j, n, {r6('sx')} AS sx,
  {r6('sy')} AS sy, {r6('same')} AS same, {r6('cross_')} AS "cross" FROM mo"""
    out["lagged_comoments"] = with_(*moments([1, 5])) + f"""SELECT a.lag, a.i, a.j, a.n,
  {r6('a.sx / a.n')} AS mx_i, {r6('a.sy / a.n')} AS my_i, {r6('b.sx / b.n')} AS mx_j, {r6('b.sy / b.n')} AS my_j,
  {r6('a.same - (a.sx * b.sx + a.sy * b.sy) / a.n')} AS same, {r6('a.cross_ - a.sx * b.sy / a.n')} AS "cross"
  FROM mo a JOIN mo b ON b.lag = a.lag AND b.i = a.j AND b.j = a.i"""
    out["feature_selection_small"] = greedy_selection([2, 4, 6], PAIRS, 4)
    start = lambda seed: f"(('0x' || substr(md5('{seed}|' || lag), 1, 15))::BIGINT % 45)::INTEGER AS seed{seed}"
    out["feature_start"] = with_(EV, *counts("ev", range(1, 7))) + \
        f"SELECT DISTINCT lag, {start(0)}, {start(1)} FROM cnt"
    out["covariance_matrices"] = with_(*moments([2], 64)) + \
        f"SELECT lag, i, j, n, {r6('c0')} AS c0, {r6('ct')} AS ct FROM cv"
    out["tica_timescales"] = tica_sql()

    out["feature_selection_pairs"] = with_(*selection(64)) + f"""
SELECT lag, n_cols, rank, feature_id, {r6('t')} AS t FROM sel"""
    out["timescale_curve"] = with_(
        *selection(64),
        "cl AS (SELECT lag, list(c0 ORDER BY i, j) AS c0, list(ct ORDER BY i, j) AS ct FROM cv GROUP BY lag)",
        *inverse("ci", "cl", "c0", 64, "lag"),
        f"bb AS (SELECT lag, {lin(64, (1, 'a'), (1, eye(64)))} AS b FROM (SELECT lag, {mm('inv', 'ct', 64)} AS a FROM cl JOIN ci USING (lag)))",
        *top_eigenvalues("bb", "lag", 64, 1)) + f"""
SELECT lag, n_cols, {r6('t * 0.1')} AS t FROM sel WHERE rank = 0 UNION ALL
SELECT lag, 64::INTEGER, {r6('CASE WHEN mu > 1 AND mu < 2 THEN -lag / ln(mu - 1) END * 0.1')} FROM eig"""
    out["tica_projection_few"] = with_(*projection()) + f"""
SELECT vec_id, traj_id, frame, {r6('max(y) FILTER (WHERE k = 0)')} AS y0,
  {r6('max(y) FILTER (WHERE k = 1)')} AS y1 FROM ys GROUP BY vec_id, traj_id, frame"""
    out["tica_projection"] = with_(*projection(2, 45, 10, distance_vectors(PAIRS))) + \
        f"SELECT traj_id, frame, k::INTEGER AS k, {r6('y')} AS y FROM ys"
    out["kinetic_chain"] = chain_sql()
    out["macrostates_two"] = with_(*two_macrostates()) + \
        f"SELECT 1::INTEGER AS lag, state, macrostate, {r6('membership')} AS membership FROM lu"
    # detailed balance binds nothing between two states: the reversible maximum is row-normalised
    out["macrostate_series_two"] = with_(
        *two_macrostates(), "ma AS (SELECT traj_id, frame, macrostate AS state FROM mi JOIN lu USING (state))",
        *[c.replace("lags", "lags2").replace("cnt", "cnt2") for c in counts("ma", range(1, 11))]) + f"""
SELECT (lag - 1)::INTEGER AS k, i, j, {r6('n / sum(n) OVER (PARTITION BY lag, i)')} AS p FROM cnt2"""

    # clustering and lumping
    out["k_centers"] = with_(*k_centers_ctes()) + \
        f"SELECT traj_id, frame, {r6('distance')} AS distance, state::INTEGER AS state FROM g5"
    out["k_centers_found"] = with_(*k_centers_ctes()) + " UNION ALL ".join(
        f"SELECT {k}::INTEGER AS state, traj_id, frame FROM c{k}" for k in range(6))
    runs = [("no_components", v, v, 6) for v in (2, 3, 5)] + [("no_clusters", v, 3, v) for v in (6, 9, 12)]
    out["clustering_sweep"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS parameter, {value}::INTEGER AS value, state::INTEGER AS state,
  count(*)::BIGINT AS n FROM ({with_(*k_centers_ctes(k, width, HASHED))} SELECT state FROM g{k - 1})
  GROUP BY state""" for name, value, width, k in runs)
    axes = {"no_features": (20, 24, 28), "no_components": (2, 3, 4), "no_clusters": (700, 800, 900), "tica_lagtime": (2, 4, 6)}
    base = {"no_features": 24, "no_components": 3, "no_clusters": 800, "tica_lagtime": 2}
    named = ", ".join(str((name, v, *{**base, name: v}.values(), "-".join(map(str, {**base, name: v}.values()))))
                      for name, vs in axes.items() for v in vs)
    out["settings_table"] = f"""SELECT s.parameter, s.value::INTEGER AS value, s.no_features::INTEGER AS no_features,
  s.no_components::INTEGER AS no_components, s.no_clusters::INTEGER AS no_clusters, s.tica_lagtime::INTEGER AS tica_lagtime,
  s.run_id, (SELECT count(*) FROM embeddings) AS frames
FROM (VALUES {named}) s(parameter, value, no_features, no_components, no_clusters, tica_lagtime, run_id)"""
    out["nearest_center"] = with_(
        VE, "ce AS (SELECT traj_id AS s, x AS c FROM ve WHERE frame = 0 AND traj_id < 4)",
        """nd AS (SELECT traj_id, frame, list_distance(x, c) AS d, s, row_number() OVER (
    PARTITION BY traj_id, frame ORDER BY list_distance(x, c), s) AS rn FROM ve CROSS JOIN ce)""") + \
        f"SELECT traj_id, frame, {r6('d')} AS distance, s::INTEGER AS state FROM nd WHERE rn = 1"
    out["macrostate_series_trimmed"] = with_(*one_way(4), *mle_fit()) + \
        f"SELECT (lag - 1)::INTEGER AS k, i, j, {r6('p')} AS p FROM ml"
    out["macrostates_trimmed"] = with_(*one_way(4)) + """SELECT lag, s AS state, sum(n)::BIGINT AS n FROM (
  SELECT lag, i AS s, n FROM cnt UNION ALL SELECT lag, j, n FROM cnt WHERE j <> i)
  WHERE s NOT IN (SELECT s FROM st) GROUP BY lag, s"""
    out["macrostate_map"] = with_(
        MI, """ma AS (SELECT traj_id, frame, CASE WHEN state LIKE '%0' THEN 0 WHEN state LIKE '%3'
    THEN 2 ELSE 1 END AS state FROM mi)""", *counts("ma", [1, 2, 5])) + plain
    return out
