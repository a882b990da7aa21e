"""DuckDB SQL for the registered queries, written in relational form: rows x features x components, one block per iteration."""

from __future__ import annotations

TYPES = ("spherical", "diag", "tied", "full")
WIDE = {"spherical": "emb64", "diag": "emb64", "tied": "li2", "full": "li2"}
FITTED = {"spherical": "li4", "diag": "li4", "tied": "li2", "full": "li2"}
REG, FLOOR = "1e-6", "1e-8"
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
#: table, key columns, features, number of features and components, batch
SOURCES = {
    "emb64": ("embeddings", "vec_id", "list_transform(embedding, lambda x: CAST(x AS DOUBLE))", 64, 10, "''"),
    "li4": ("lineitem", LINE, "[CAST(l_quantity AS DOUBLE) / 10, CAST(l_extendedprice AS DOUBLE) / 10000, CAST(l_discount AS DOUBLE) * 10, CAST(l_tax AS DOUBLE) * 10]", 4, 5, "''"),
    "li2": ("lineitem", LINE, "[CAST(l_quantity AS DOUBLE) / 10, CAST(l_extendedprice AS DOUBLE) / 10000]", 2, 3, "''"),
    "li4b": ("lineitem", LINE, "[CAST(l_quantity AS DOUBLE) / 10, CAST(l_extendedprice AS DOUBLE) / 10000, CAST(l_discount AS DOUBLE) * 10, CAST(l_tax AS DOUBLE) * 10]", 4, 2, "l_returnflag"),
    "ev1": ("events", "event_id", "[CAST(value AS DOUBLE)]", 1, 3, "''"),
    "ord1y": ("orders", "o_orderkey", "[CAST(o_totalprice AS DOUBLE) / 100000]", 1, 2, "CAST(year(o_orderdate) AS VARCHAR)"),
    "ev1u": ("events", "event_id", "[CAST(value AS DOUBLE)]", 1, 2, "CAST(user_id AS VARCHAR)"),
}


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


class Sql:
    """Common table expressions for one source and covariance type; step t makes l{t}, r{t} and the parameters m, w, c of t + 1."""

    def __init__(self, name: str, kind: str):
        table, self.keys, features, self.d, self.k, batch = SOURCES[name]
        self.kind, self.flat = kind, kind in ("spherical", "diag")
        self.ctes = [
            f"base AS (SELECT row_number() OVER (ORDER BY {self.keys}) AS rid, {self.keys}, {batch} AS b, {features} AS f FROM {table})",
            f"x AS (SELECT rid, b, unnest(range(1, {self.d + 1})) AS d, unnest(f) AS v FROM base)",
            f"first AS (SELECT rid, row_number() OVER (PARTITION BY b ORDER BY {self.keys}) AS place FROM base)",
            f"start AS (SELECT rid, place - 1 AS k FROM first WHERE place <= {self.k})",
            f"m0 AS (SELECT x.b, k, d, v AS m FROM x JOIN start ON x.rid = start.rid)",
            f"w0 AS (SELECT DISTINCT b, k, CAST(1 AS DOUBLE) / {self.k} AS w FROM m0)",
        ]
        if kind == "spherical":
            self.add("g AS (SELECT b, greatest(avg(s), 1e-6) AS s FROM (SELECT b, d, var_pop(v) AS s FROM x GROUP BY b, d) GROUP BY b)")
            self.add("c0 AS (SELECT m0.b, k, d, s FROM m0 JOIN g ON m0.b = g.b)")
        elif kind == "diag":
            self.add("g AS (SELECT b, d, greatest(var_pop(v), 1e-6) AS s FROM x GROUP BY b, d)")
            self.add("c0 AS (SELECT m0.b, k, m0.d, s FROM m0 JOIN g ON m0.b = g.b AND m0.d = g.d)")
        else:
            self.add(f"g AS (SELECT b, var_pop(f[1]) + {REG} AS s11, covar_pop(f[1], f[2]) AS s12, var_pop(f[2]) + {REG} AS s22 FROM base GROUP BY b)")
            self.add("c0 AS (SELECT w0.b, k, s11, s12, s22 FROM w0 JOIN g ON w0.b = g.b)")

    def add(self, cte: str) -> None:
        self.ctes.append(cte)

    def e_step(self, t: int = 0, mode: str = "soft", top: int | None = None) -> None:
        if self.flat:
            self.add(f"e{t} AS (SELECT m.b, m.k, m.d, m.m, c.s, w.w FROM m{t} m JOIN c{t} c ON c.b = m.b AND c.k = m.k AND c.d = m.d JOIN w{t} w ON w.b = m.b AND w.k = m.k)")
            self.add(f"""l{t} AS (SELECT x.rid, x.b, e.k, ln(any_value(e.w)) - 0.5 * (sum((x.v - e.m) * (x.v - e.m) / e.s + ln(e.s)) + {self.d} * ln(2 * pi())) AS l
                FROM x JOIN e{t} e ON x.b = e.b AND x.d = e.d GROUP BY x.rid, x.b, e.k)""")
        else:
            self.add(f"mw{t} AS (SELECT b, k, max(m) FILTER (d = 1) AS m1, max(m) FILTER (d = 2) AS m2 FROM m{t} GROUP BY b, k)")
            self.add(f"e{t} AS (SELECT m.b, m.k, m1, m2, w, s11, s12, s22 FROM mw{t} m JOIN c{t} c ON c.b = m.b AND c.k = m.k JOIN w{t} w ON w.b = m.b AND w.k = m.k)")
            self.add(f"""l{t} AS (SELECT rid, b, k, ln(w) - 0.5 * ((s22 * d1 * d1 - 2 * s12 * d1 * d2 + s11 * d2 * d2) / (s11 * s22 - s12 * s12) + 2 * ln(2 * pi()) + ln(s11 * s22 - s12 * s12)) AS l
                FROM (SELECT rid, base.b, e.k, f[1] - m1 AS d1, f[2] - m2 AS d2, w, s11, s12, s22 FROM base JOIN e{t} e ON base.b = e.b))""")
        order = f"row_number() OVER (PARTITION BY rid ORDER BY l DESC, k)"
        kept = f"(SELECT *, {order} AS place FROM l{t} QUALIFY {order} <= {top})" if top else f"(SELECT *, {order} AS place FROM l{t})"
        norm = f"top + ln(sum(exp(l - top)) OVER (PARTITION BY rid))"
        share = "CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END" if mode == "hard" else f"exp(l - ({norm}))"
        self.add(f"r{t} AS (SELECT rid, b, k, place, l, {norm} AS lp, CAST({share} AS DOUBLE) AS r FROM (SELECT *, max(l) OVER (PARTITION BY rid) AS top FROM {kept}))")

    def sums(self, t: int = 0) -> None:
        self.add(f"n{t} AS (SELECT w.b, w.k, coalesce(sum(r), 0) AS n FROM w{t} w LEFT JOIN r{t} r ON r.b = w.b AND r.k = w.k GROUP BY w.b, w.k)")
        self.add(f"s{t} AS (SELECT r.b, r.k, x.d, sum(r * v) AS s1, sum(r * v * v) AS s2 FROM r{t} r JOIN x ON x.rid = r.rid GROUP BY r.b, r.k, x.d)")

    def m_step(self, t: int = 0) -> None:
        self.sums(t)
        u = t + 1
        self.add(f"t{t} AS (SELECT b, count(DISTINCT rid) AS rows FROM r{t} GROUP BY b)")
        self.add(f"m{u} AS (SELECT m.b, m.k, m.d, CASE WHEN n > {FLOOR} THEN s1 / n ELSE m END AS m FROM m{t} m JOIN n{t} n ON n.b = m.b AND n.k = m.k LEFT JOIN s{t} s ON s.b = m.b AND s.k = m.k AND s.d = m.d)")
        self.add(f"w{u} AS (SELECT b, k, w / sum(w) OVER (PARTITION BY b) AS w FROM (SELECT n.b, k, greatest(n / rows, {FLOOR}) AS w FROM n{t} n JOIN t{t} t ON n.b = t.b))")
        joined = f"FROM c{t} c JOIN n{t} n ON n.b = c.b AND n.k = c.k"
        if self.kind == "diag":
            self.add(f"c{u} AS (SELECT c.b, c.k, c.d, CASE WHEN n > {FLOOR} THEN greatest(s2 / n - m.m * m.m, {REG}) ELSE c.s END AS s {joined} JOIN m{u} m ON m.b = c.b AND m.k = c.k AND m.d = c.d LEFT JOIN s{t} s ON s.b = c.b AND s.k = c.k AND s.d = c.d)")
        elif self.kind == "spherical":
            self.add(f"q{t} AS (SELECT m.b, m.k, sum(s2) AS s2, sum(m.m * m.m) AS mm FROM m{u} m JOIN s{t} s ON s.b = m.b AND s.k = m.k AND s.d = m.d GROUP BY m.b, m.k)")
            self.add(f"c{u} AS (SELECT c.b, c.k, c.d, CASE WHEN n > {FLOOR} THEN greatest(greatest(s2 - n * mm, 0) / (n * {self.d}), {REG}) ELSE c.s END AS s {joined} LEFT JOIN q{t} q ON q.b = c.b AND q.k = c.k)")
        else:
            self.add(f"p{t} AS (SELECT b, k, max(m) FILTER (d = 1) AS m1, max(m) FILTER (d = 2) AS m2 FROM m{u} GROUP BY b, k)")
            if self.kind == "full":
                self.add(f"q{t} AS (SELECT r.b, r.k, sum(r * f[1] * f[1]) AS q11, sum(r * f[1] * f[2]) AS q12, sum(r * f[2] * f[2]) AS q22 FROM r{t} r JOIN base ON base.rid = r.rid GROUP BY r.b, r.k)")
                cells = ", ".join(f"CASE WHEN n > {FLOOR} THEN q{i}{j} / n - m{i} * m{j}{' + ' + REG if i == j else ''} ELSE c.s{i}{j} END AS s{i}{j}" for i, j in ((1, 1), (1, 2), (2, 2)))
                self.add(f"c{u} AS (SELECT c.b, c.k, {cells} {joined} JOIN p{t} p ON p.b = c.b AND p.k = c.k LEFT JOIN q{t} q ON q.b = c.b AND q.k = c.k)")
            else:
                self.add(f"q{t} AS (SELECT base.b, sum(f[1] * f[1]) AS q11, sum(f[1] * f[2]) AS q12, sum(f[2] * f[2]) AS q22 FROM base WHERE rid IN (SELECT rid FROM r{t}) GROUP BY base.b)")
                cells = ", ".join(f"(any_value(q{i}{j}) - sum(n * m{i} * m{j})) / any_value(rows){' + ' + REG if i == j else ''} AS s{i}{j}" for i, j in ((1, 1), (1, 2), (2, 2)))
                self.add(f"h{t} AS (SELECT p.b, {cells} FROM p{t} p JOIN n{t} n ON n.b = p.b AND n.k = p.k JOIN q{t} q ON q.b = p.b JOIN t{t} t ON t.b = p.b GROUP BY p.b)")
                self.add(f"c{u} AS (SELECT p.b, p.k, h.s11, h.s12, h.s22 FROM p{t} p JOIN h{t} h ON h.b = p.b)")

    def run(self, steps: int, mode: str = "soft", top: int | None = None) -> Sql:
        for t in range(steps):
            self.e_step(t, mode, top)
            self.m_step(t)
        return self

    def select(self, body: str) -> str:
        return "WITH " + ",\n".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in self.ctes) + "\n" + body

    def pair_cells(self, t: int, weights: bool, means: bool) -> str:
        """The same for two features with tied or full covariance, each component unfolded from one row."""
        cell = lambda part, k, i, j, v: f"{{'part': '{part}', 'k': {k}, 'i': {i}, 'j': {j}, 'v': {v}}}"
        own = [cell("weight", "k", -1, -1, "w")] if weights else []
        own += [cell("mean", "k", i, -1, f"m{i + 1}") for i in (0, 1)] if means else []
        cov = [cell("cov", "-1" if self.kind == "tied" else "k", i, j, f"s{min(i, j) + 1}{max(i, j) + 1}") for i in (0, 1) for j in (0, 1)]
        source = f"w{t} w JOIN c{t} c ON c.b = w.b AND c.k = w.k"
        if means:
            self.add(f"last AS (SELECT b, k, max(m) FILTER (d = 1) AS m1, max(m) FILTER (d = 2) AS m2 FROM m{t} GROUP BY b, k)")
            source += " JOIN last ON last.b = w.b AND last.k = w.k"
        columns = "w.b, CAST(w.k AS INT) AS k, w, s11, s12, s22" + (", m1, m2" if means else "")
        every = f"list_concat([{', '.join(own)}], CASE WHEN k = 0 OR {self.kind == 'full'} THEN [{', '.join(cov)}] END)"
        return self.select(f"SELECT nullif(b, '') AS batch_id, u.part AS part, CAST(u.k AS INT) AS k, CAST(u.i AS INT) AS i, CAST(u.j AS INT) AS j, {r6('u.v')} AS value FROM (SELECT b, unnest({every}) AS u FROM (SELECT {columns} FROM {source}))")

    def cells(self, t: int, weights: bool = True, means: bool = True) -> str:
        """The parameters of step t as rows."""
        row = "SELECT nullif(b, '') AS batch_id, '{}' AS part, CAST({} AS INT) AS k, CAST({} AS INT) AS i, CAST({} AS INT) AS j, " + r6("{}") + " AS value FROM {}"
        parts = [row.format("weight", "k", "-1", "-1", "w", f"w{t}")] if weights else []
        parts += [row.format("mean", "k", "d - 1", "-1", "m", f"m{t}")] if means else []
        c = f"c{t}"
        if self.kind == "spherical":
            parts.append(row.format("cov", "k", "-1", "-1", "s", f"(SELECT b, k, any_value(s) AS s FROM {c} GROUP BY b, k)"))
        elif self.kind == "diag":
            parts.append(row.format("cov", "k", "d - 1", "-1", "s", c))
        else:
            return self.pair_cells(t, weights, means)
        return self.select(" UNION ALL ".join(parts))


def stats_sql(s: Sql, log_likelihood: bool = True) -> str:
    row = "SELECT '{}' AS part, CAST({} AS INT) AS k, CAST({} AS INT) AS i, CAST({} AS INT) AS j, " + r6("{}") + " AS value FROM {}"
    s.sums()
    parts = [row.format("nk", "k", "-1", "-1", "n", "n0"), row.format("sum_x", "k", "d - 1", "-1", "s1", "s0")]
    if s.kind == "spherical":
        parts.append(row.format("second", "k", "-1", "-1", "s2", "(SELECT k, sum(s2) AS s2 FROM s0 GROUP BY k)"))
    elif s.kind == "diag":
        parts.append(row.format("second", "k", "d - 1", "-1", "s2", "s0"))
    else:
        s.add("z0 AS (SELECT k, sum(r * f[1] * f[1]) AS q11, sum(r * f[1] * f[2]) AS q12, sum(r * f[2] * f[2]) AS q22 FROM r0 r JOIN base ON base.rid = r.rid GROUP BY k)")
        parts += [row.format("second", "k", i, j, f"q{min(i, j) + 1}{max(i, j) + 1}", "z0") for i in (0, 1) for j in (0, 1)]
    if log_likelihood:
        parts.append(row.format("log_likelihood", "-1", "-1", "-1", "v", "(SELECT sum(lp) AS v FROM (SELECT DISTINCT rid, lp FROM r0))"))
    return s.select(" UNION ALL ".join(parts))


def stepped(name: str, kind: str, mode: str = "soft", top: int | None = None) -> Sql:
    s = Sql(name, kind)
    s.e_step(0, mode, top)
    return s


def hard_stats_sql(kind: str) -> str:
    s = stepped(WIDE[kind], kind, "hard")
    s.add("y AS (SELECT k AS label, base.* FROM r0 JOIN base ON base.rid = r0.rid WHERE place = 1)")
    cols = [f"f[{i + 1}]" for i in range(s.d)]
    if kind == "spherical":
        second = ["sum(" + " + ".join(f"{c} * {c}" for c in cols) + ")"]
    elif kind == "diag":
        second = [f"sum({c} * {c})" for c in cols]
    else:
        second = [f"sum({a} * {c})" for a in cols for c in cols]
    every = ", ".join(["CAST(count(*) AS DOUBLE)", *[f"sum({c})" for c in cols], *second])
    s.add(f"v AS (SELECT label, [{every}] AS a FROM y GROUP BY label)")
    n = 1 + s.d + len(second)
    return s.select(f"SELECT CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, {r6('value')} AS value FROM (SELECT label, unnest(range(0, {n})) AS pos, unnest(a) AS value FROM v)")


def finalize_sql(kind: str) -> str:
    s = stepped(FITTED[kind], kind, "hard")
    s.ctes[-1] = s.ctes[-1].replace("r0 AS (", "ra AS (", 1)
    s.add("r0 AS (SELECT * FROM ra WHERE place = 1 AND k > 0)")
    s.m_step(0)
    return s.cells(1)


def init_stats_sql(kind: str) -> str:
    """Nearest first row for each row; spreads around these rows."""
    s = Sql(FITTED[kind], kind)
    s.add("dist AS (SELECT x.rid, k, sum((v - m) * (v - m)) AS q FROM x JOIN m0 ON x.d = m0.d GROUP BY x.rid, k)")
    s.add("near AS (SELECT rid, k FROM dist QUALIFY row_number() OVER (PARTITION BY rid ORDER BY q, k) = 1)")
    s.add("n AS (SELECT w0.k, greatest(count(rid), 1) AS n, count(rid) AS c FROM w0 LEFT JOIN near ON near.k = w0.k GROUP BY w0.k)")
    s.add("w1 AS (SELECT '' AS b, k, n / sum(n) OVER () AS w FROM n)")
    if s.flat:
        s.add("e AS (SELECT near.k, x.d, avg((v - m) * (v - m)) AS s FROM near JOIN x ON x.rid = near.rid JOIN m0 ON m0.k = near.k AND m0.d = x.d GROUP BY near.k, x.d)")
        inner = "avg(e.s) OVER (PARTITION BY c0.k)" if kind == "spherical" else "e.s"
        s.add(f"c1 AS (SELECT b, c0.k, c0.d, CASE WHEN e.s IS NULL THEN c0.s ELSE greatest({inner}, {REG}) END AS s FROM c0 LEFT JOIN e ON e.k = c0.k AND e.d = c0.d)")
    else:
        s.add("mw AS (SELECT k, max(m) FILTER (d = 1) AS m1, max(m) FILTER (d = 2) AS m2 FROM m0 GROUP BY k)")
        s.add("o AS (SELECT near.k, f[1] - m1 AS d1, f[2] - m2 AS d2 FROM near JOIN base ON base.rid = near.rid JOIN mw ON mw.k = near.k)")
        group = "" if kind == "tied" else " GROUP BY k"
        who = "0 AS k" if kind == "tied" else "k"
        s.add(f"e AS (SELECT {who}, avg(d1 * d1) + {REG} AS s11, avg(d1 * d2) AS s12, avg(d2 * d2) + {REG} AS s22 FROM o{group})")
        s.add("c1 AS (SELECT c0.b, c0.k, coalesce(e.s11, c0.s11) AS s11, coalesce(e.s12, c0.s12) AS s12, coalesce(e.s22, c0.s22) AS s22 FROM c0 LEFT JOIN e ON e.k = c0.k)")
    return s.cells(1, means=False)


def lloyd_sql(steps: int) -> str:
    s = Sql("emb64", "diag")
    for t in range(steps):
        s.add(f"dist{t} AS (SELECT x.rid, k, sum((v - m) * (v - m)) AS q FROM x JOIN m{t} m ON x.d = m.d GROUP BY x.rid, k)")
        s.add(f"near{t} AS (SELECT rid, k FROM dist{t} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY q, k) = 1)")
        s.add(f"a{t} AS (SELECT k, d, avg(v) AS v FROM near{t} JOIN x USING (rid) GROUP BY k, d)")
        s.add(f"m{t + 1} AS (SELECT m.b, m.k, m.d, coalesce(v, m) AS m FROM m{t} m LEFT JOIN a{t} a ON a.k = m.k AND a.d = m.d)")
    return s.select(f"SELECT nullif(b, '') AS batch_id, 'mean' AS part, CAST(k AS INT) AS k, CAST(d - 1 AS INT) AS i, CAST(-1 AS INT) AS j, {r6('m')} AS value FROM m{steps}")


def criteria_sql(kind: str, what: str) -> str:
    s = stepped(WIDE[kind], kind)
    cov = {"spherical": s.k, "diag": s.k * s.d, "tied": s.d * (s.d + 1) // 2, "full": s.k * s.d * (s.d + 1) // 2}[kind]
    p = s.k * s.d + cov + s.k - 1
    value = {"score": "sum(lp) / count(*)", "aic": f"-2 * sum(lp) + 2 * {p}", "bic": f"-2 * sum(lp) + {p} * ln(count(*))"}[what]
    return s.select(f"SELECT {r6(value)} AS {what} FROM r0 WHERE place = 1")


def bounds_sql(steps: int) -> str:
    s = Sql("li4", "spherical").run(steps)
    return s.select(" UNION ALL ".join(f"SELECT CAST({t + 1} AS INT) AS iteration, {r6('avg(lp)')} AS lower_bound FROM r{t} WHERE place = 1" for t in range(steps)))


def rows_sql(s: Sql, columns: str, where: str = "") -> str:
    return s.select(f"SELECT {', '.join('base.' + k.strip() for k in s.keys.split(','))}, {columns} FROM r0 JOIN base ON base.rid = r0.rid {where}")


def many_sql(body: str) -> str:
    """Logits l of each vector under 8192 components (see queries.many_components), and body on them."""
    return f"""
WITH base AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f, row_number() OVER (ORDER BY vec_id) - 1 AS place, least(count(*) OVER (), 8192) AS n FROM embeddings),
comp AS MATERIALIZED (SELECT k, list_transform(range(0, 64), lambda d: f[(d + k // n) % 64 + 1]) AS m, (1.0 + k % 7) / sum(1.0 + k % 7) OVER () AS w, CAST(0.01 AS DOUBLE) + CAST(k % 5 AS DOUBLE) / 500 AS s FROM range(8192) AS r(k) JOIN base ON place = k % n),
l AS MATERIALIZED (SELECT vec_id, f, k, ln(w) - 0.5 * (list_distance(f, m) * list_distance(f, m) / s + 64 * ln(s) + 64 * ln(2 * pi())) AS l FROM base, comp),
best AS MATERIALIZED (SELECT vec_id, f, k, l, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, k) AS place FROM l QUALIFY place <= 3)
{body}"""


MANY_STATS = """,
r AS (SELECT f, k, lp, exp(l - lp) AS r, place FROM (SELECT *, max(l) OVER q + ln(sum(exp(l - top)) OVER q) AS lp FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM best) WINDOW q AS (PARTITION BY vec_id))),
e AS (SELECT k, unnest(range(0, 64)) AS d, r, unnest(f) AS v FROM r),
cells AS (SELECT 'nk' AS part, k, -1 AS i, sum(r) AS v FROM r GROUP BY k UNION ALL SELECT 'sum_x', k, d, sum(r * v) FROM e GROUP BY k, d UNION ALL SELECT 'second', k, -1, sum(r * v * v) FROM e GROUP BY k
    UNION ALL SELECT 'log_likelihood', -1, -1, sum(lp) FROM r WHERE place = 1)
SELECT part, CAST(k AS INT) AS k, CAST(i AS INT) AS i, CAST(-1 AS INT) AS j, round(v, 6) + 0.0 AS value FROM cells WHERE round(v, 6) <> 0"""


def keyed_score_sql() -> str:
    s = Sql("ev1u", "diag").run(3)
    s.e_step(3)
    return s.select(f"SELECT event_id, CAST(k AS INT) AS label, {r6('lp')} AS log_prob FROM r3 JOIN base ON base.rid = r3.rid WHERE place = 1")


def density_sql(x: str, m: str, s: str, w: str) -> str:
    return f"ln({w}) - 0.5 * (({x} - {m}) * ({x} - {m}) / {s} + ln({s}) + ln(2 * pi()))"


def dated_sql() -> str:
    s = Sql("ord1y", "diag").run(3)
    s.add("models AS (SELECT m.b, m.k, m.m, c.s, w.w FROM m3 m JOIN c3 c ON c.b = m.b AND c.k = m.k JOIN w3 w ON w.b = m.b AND w.k = m.k)")
    s.add("versions AS (SELECT DISTINCT b, make_timestamp(CAST(b AS INT) + 1, 1, 1, 0, 0, 0.0) AS since FROM models)")
    s.add("met AS (SELECT o.o_orderkey, CAST(o.o_totalprice AS DOUBLE) / 100000 AS v, b FROM orders o ASOF LEFT JOIN versions ON o.o_orderdate >= since)")
    s.add(f"scored AS (SELECT o_orderkey, met.b, k, {density_sql('v', 'm', 's', 'w')} AS l FROM met LEFT JOIN models ON models.b = met.b)")
    s.add("tops AS (SELECT o_orderkey, max(l) AS top FROM scored GROUP BY o_orderkey)")
    return s.select(f"SELECT o_orderkey, CAST(any_value(b) AS INT) AS model_year, CAST(arg_min(k, struct_pack(a := -l, b := k)) AS INT) AS label, {r6('any_value(top) + ln(sum(exp(l - top)))')} AS log_prob FROM scored JOIN tops USING (o_orderkey) GROUP BY o_orderkey")


def levels_sql(sets: str) -> str:
    s = stepped("li4", "diag")
    s.add("wide AS (SELECT rid, any_value(lp) AS lp, " + ", ".join(f"max(r) FILTER (k = {i}) AS r{i}" for i in range(s.k)) + " FROM r0 GROUP BY rid)")
    s.add(f"flags AS (SELECT row_number() OVER (ORDER BY {LINE}) AS rid, l_returnflag, l_linestatus FROM lineitem)")
    shares = ", ".join(f"{r6(f'sum(r{i}) / count(*)')} AS share_{i}" for i in range(s.k))
    p = 2 * s.k * s.d + s.k - 1
    return s.select(f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS level, count(*) AS n, {r6('sum(lp)')} AS log_likelihood, {r6(f'-2 * sum(lp) + {2 * p}')} AS aic, {r6(f'-2 * sum(lp) + {p} * ln(count(*))')} AS bic, {shares} FROM wide JOIN flags USING (rid) GROUP BY {sets} (l_returnflag, l_linestatus)")


def runs_sql() -> str:
    s = stepped("ev1", "diag")
    s.add("seen AS (SELECT event_id, user_id, ts, k AS label, lp FROM r0 JOIN base USING (rid) JOIN events USING (event_id) WHERE place = 1)")
    s.add("flagged AS (SELECT *, CASE WHEN label = lag(label) OVER q THEN 0 ELSE 1 END AS starts FROM seen WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id))")
    s.add("numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM flagged)")
    s.add("runs AS (SELECT user_id, run, any_value(label) AS label, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, avg(lp) AS mean FROM numbered GROUP BY user_id, run)")
    return s.select(f"SELECT user_id, CAST(run AS BIGINT) AS run, CAST(label AS INT) AS label, first, last, n, micros, {r6('mean')} AS mean_score, {r6('mean - lag(mean) OVER (PARTITION BY user_id ORDER BY run)')} AS change FROM runs")


#: The replayed events: value, week, and the start parameters of three components.
REPLAY = """x AS MATERIALIZED (SELECT event_id, ts, event_type, CAST(value AS DOUBLE) / 100 AS v, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week FROM events),
p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, v AS m, CAST(1 AS DOUBLE) AS s, CAST(1 AS DOUBLE) / 3 AS w FROM x ORDER BY event_id LIMIT 3)"""


def windows_sql() -> str:
    return f"""WITH {REPLAY},
l AS (SELECT event_id, ts, event_type, k, {density_sql('v', 'm', 's', 'w')} AS l FROM x, p0),
t AS (SELECT event_id, max(l) AS top, arg_min(k, struct_pack(a := -l, b := k)) AS label FROM l GROUP BY event_id),
e AS (SELECT event_id, any_value(ts) AS ts, any_value(event_type) AS event_type, any_value(label) AS label, any_value(top) + ln(sum(exp(l - top))) AS lp FROM l JOIN t USING (event_id) GROUP BY event_id)
SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, count(*) AS n, {r6('sum(lp)')} AS log_likelihood, {r6('avg(lp)')} AS mean_score,
       count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (label = 2) AS n_2
FROM e GROUP BY event_type, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM x) - INTERVAL 1 DAY"""


def stepwise_sql(steps: int = 5) -> str:
    """One block for each week; weeks are numbered by their order, and one without events leaves all as it is."""
    ctes = [REPLAY, "weeks AS MATERIALIZED (SELECT week, row_number() OVER (ORDER BY week) - 1 AS step FROM (SELECT DISTINCT week FROM x))"]
    for t in range(steps):
        ctes += [
            f"l{t} AS MATERIALIZED (SELECT event_id, v, k, {density_sql('v', 'm', 's', 'w')} AS l FROM x JOIN weeks USING (week), p{t} WHERE step = {t})",
            f"r{t} AS MATERIALIZED (SELECT v, k, exp(l - max(l) OVER (PARTITION BY event_id)) AS u, event_id FROM l{t})",
            f"q{t} AS MATERIALIZED (SELECT v, k, u / sum(u) OVER (PARTITION BY event_id) AS r FROM r{t})",
            f"s{t} AS MATERIALIZED (SELECT k, sum(r) / (SELECT count(DISTINCT event_id) FROM l{t}) AS n, sum(r * v) / (SELECT count(DISTINCT event_id) FROM l{t}) AS a, sum(r * v * v) / (SELECT count(DISTINCT event_id) FROM l{t}) AS b FROM q{t} GROUP BY k)",
        ]
        moved = f"s{t}" if t == 0 else f"(SELECT p.k, coalesce(0.5 * o.n + 0.5 * s.n, o.n) AS n, coalesce(0.5 * o.a + 0.5 * s.a, o.a) AS a, coalesce(0.5 * o.b + 0.5 * s.b, o.b) AS b FROM p{t} p JOIN o{t} o USING (k) LEFT JOIN s{t} s USING (k))"
        ctes += [
            f"o{t + 1} AS MATERIALIZED (SELECT * FROM {moved})",
            f"p{t + 1} AS MATERIALIZED (SELECT k, a / n AS m, greatest(b / n - (a / n) * (a / n), {REG}) AS s, greatest(n, {FLOOR}) / sum(greatest(n, {FLOOR})) OVER () AS w FROM o{t + 1})",
        ]
    row = "SELECT '{}' AS part, CAST(k AS INT) AS k, CAST({} AS INT) AS i, CAST(-1 AS INT) AS j, " + r6("{}") + f" AS value FROM p{steps}"
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join([row.format("weight", -1, "w"), row.format("mean", 0, "m"), row.format("cov", 0, "s")])


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for kind in TYPES:
        found[f"logits_{kind}"] = rows_sql(stepped(WIDE[kind], kind), f"CAST(k AS INT) AS k, {r6('l')} AS logit")
        found[f"assign_{kind}"] = rows_sql(stepped(WIDE[kind], kind), "CAST(k AS INT) AS label", "WHERE place = 1")
        found[f"score_samples_{kind}"] = rows_sql(stepped(WIDE[kind], kind), f"{r6('lp')} AS log_prob", "WHERE place = 1")
        found[f"predict_proba_{kind}"] = rows_sql(stepped(WIDE[kind], kind), f"CAST(k AS INT) AS k, {r6('r')} AS p")
        found[f"global_moments_{kind}"] = Sql(FITTED[kind], kind).cells(0)
        found[f"init_stats_{kind}"] = init_stats_sql(kind)
        found[f"finalize_{kind}"] = finalize_sql(kind)
        found[f"em_{kind}"] = Sql(FITTED[kind], kind).run(3).cells(3)
        found[f"em_topk_{kind}"] = Sql(FITTED[kind], kind).run(3, top=2).cells(3)
        last = Sql(FITTED[kind], kind).run(3)
        last.e_step(3)
        found[f"fit_predict_{kind}"] = last.select("SELECT CAST(k AS INT) AS label, count(*) AS n FROM r3 WHERE place = 1 GROUP BY k")
        for what in ("aic", "bic"):
            found[f"{what}_{kind}"] = criteria_sql(kind, what)
    for kind in ("spherical", "diag", "full"):
        found[f"soft_stats_{kind}"] = stats_sql(stepped(FITTED[kind], kind))
        found[f"hard_stats_{kind}"] = hard_stats_sql(kind)
    xx = Sql("li2", "full")
    found |= {
        "soft_stats_columns": found["soft_stats_diag"],
        "score_mean": criteria_sql("diag", "score"),
        "assign_counts": stepped("emb64", "spherical").select("SELECT CAST(k AS INT) AS label, count(*) AS n FROM r0 WHERE place = 1 GROUP BY k"),
        "xx_total": xx.select(" UNION ALL ".join(f"SELECT 'xx' AS part, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, {r6(f'sum(f[{i + 1}] * f[{j + 1}])')} AS value FROM base" for i in (0, 1) for j in (0, 1))),
        "weighted_update": stats_sql(stepped("li4", "spherical"), False),
        "topk_components": rows_sql(stepped("emb64", "diag"), f"CAST(place - 1 AS INT) AS place, CAST(k AS INT) AS k, {r6('l')} AS logit", "WHERE place <= 2"),
        "topk_stats": stats_sql(stepped("emb64", "diag", top=2)),
        "em_lower_bound_history": bounds_sql(3),
        "em_early_stop": bounds_sql(2),
        "em_hard_spherical": Sql("li4", "spherical").run(3, "hard").cells(3),
        "em_hard_diag": Sql("li4", "diag").run(3, "hard").cells(3),
        "em_batched_spherical": Sql("li4b", "spherical").run(3).cells(3),
        "em_events": Sql("ev1", "diag").run(3).cells(3),
        "em_keyed_spherical": Sql("ev1u", "spherical").run(3).cells(3),
        "em_keyed_diag": Sql("ev1u", "diag").run(3).cells(3),
        "score_keyed": keyed_score_sql(),
        "assign_many": many_sql(", t AS (SELECT vec_id, max(l) AS top FROM l GROUP BY vec_id), p AS (SELECT vec_id, any_value(top) + ln(sum(exp(l - top))) AS lp FROM l JOIN t USING (vec_id) GROUP BY vec_id)"
                                f" SELECT vec_id, CAST(k AS INT) AS label, {r6('lp')} AS log_prob FROM best JOIN p USING (vec_id) WHERE place = 1"),
        "topk_many": many_sql(f"SELECT vec_id, CAST(place - 1 AS INT) AS place, CAST(k AS INT) AS k, {r6('l')} AS logit FROM best"),
        "topk_stats_many": many_sql(MANY_STATS),
        "second_moments": f"SELECT label, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {r6('sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE))')} AS value FROM embeddings, range(64) AS a(i), range(64) AS c(j) WHERE i <= j GROUP BY label, i, j",
        "score_dated": dated_sql(),
        "fit_cube": levels_sql("CUBE"),
        "fit_rollup": levels_sql("ROLLUP"),
        "label_runs": runs_sql(),
        "stream_windows": windows_sql(),
        "stream_stepwise": stepwise_sql(),
        "lloyd_fixed_start": lloyd_sql(3),
        "standard_scaled": f"SELECT {LINE}, {r6('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS z_quantity, {r6('(l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER ()')} AS z_discount FROM lineitem",
    }
    # facts that hold of whatever is drawn
    found |= {
        "random_init": "SELECT CAST(k AS INT) AS k, true AS is_row, CAST(0.2 AS DOUBLE) AS weight FROM range(5) AS r(k)",
        "kmeanspp_init": "SELECT CAST(k AS INT) AS k, true AS is_row, CAST(1 AS BIGINT) AS same FROM range(10) AS r(k)",
        "sampled_init": "SELECT CAST(5 AS INT) AS components, CAST(1 AS DOUBLE) AS weights, true AS sound, true AS tight, CASE WHEN count(*) > 4096 THEN 'kmeans_parallel' ELSE 'kmeans' END AS source FROM lineitem",
        "kmeans_parallel_init": "SELECT CAST(k AS INT) AS k, true AS is_row, CAST(1 AS BIGINT) AS same FROM range(20) AS r(k)",
        "blobs": "SELECT CAST(k AS INT) AS component, CAST(1000 AS BIGINT) AS n, true AS at_centre FROM range(3) AS r(k)",
        "anisotropic_blobs": "SELECT CAST(k AS INT) AS component, CAST(1000 AS BIGINT) AS n, true AS at_centre FROM range(3) AS r(k)",
    }
    return found
