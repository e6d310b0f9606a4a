"""DuckDB SQL for the fitted models: normal equations by elimination, Newton steps unrolled."""

from __future__ import annotations

Z95 = "1.959963984540054::DOUBLE"


def two_sided_p(z: str) -> str:
    """P(|Z| > z) from the all-positive series of the error function."""
    half = f"least(abs({z}) / sqrt(2.0::DOUBLE), 6.0::DOUBLE)"
    terms = (
        f"list_transform(range(0, 160), lambda n: exp(n * ln(4.0::DOUBLE) + (2 * n + 1) * ln({half})"
        " + lgamma(n + 1) - lgamma(2 * n + 2)))"
    )
    return (
        f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(-{half} * {half})"
        f" * list_sum({terms})) END"
    )


def design(source: str, outcome: str, categories: dict[str, str | None], numeric: str) -> tuple[str, str]:
    """SQL of (terms, rows): labels of the terms in order, and rows (x, y) with a vector of them each."""
    lists, columns = [], []
    for c, baseline in categories.items():
        first = f"'{baseline}'" if baseline else f"(SELECT min({c}) FROM {source})"
        levels = f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL AND {c} <> {first}))"
        lists.append(f"list_transform({levels}, lambda v: '{c}=' || v::VARCHAR)")
        columns.append(f"list_transform({levels}, lambda v: CASE WHEN {c} = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
    terms = f"SELECT ['intercept'] || {' || '.join(lists)} || ['{numeric}'] AS terms"
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*categories, numeric, outcome])
    rows = (
        f"SELECT [1.0::DOUBLE] || {' || '.join(columns)} || [{numeric}::DOUBLE] AS x, {outcome}::DOUBLE AS y"
        f" FROM {source} WHERE {known}"
    )
    return terms, rows


def _products(rows: str, weight: str = "1.0::DOUBLE") -> str:
    """Sums of weight * x_i * x_j as (i, j, v)."""
    return (
        f"SELECT i, j, sum(w * x[i] * x[j]) AS v FROM (SELECT x, {weight} AS w FROM {rows}),"
        " LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) a, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) b"
        " GROUP BY i, j"
    )


def inverse(products: str) -> str:
    """(i, j, v) of the inverse of a matrix, by elimination on it beside the identity."""
    return f"""
SELECT i, j - p AS j, m[i][j] AS v FROM (
  WITH RECURSIVE wide AS (
    SELECT count(*) AS p, list(r ORDER BY i) AS m FROM (
      SELECT i, list(v ORDER BY j) || list_transform(range(1, (SELECT max(i) FROM {products}) + 1),
        lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r
      FROM {products} GROUP BY i)
  ), steps(k, p, m) AS (
    SELECT 1, p, m FROM wide
    UNION ALL
    SELECT k + 1, p, list_transform(m, lambda r, i:
      CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
           ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END)
    FROM steps WHERE k <= p
  )
  SELECT p, m FROM steps WHERE k = p + 1
), LATERAL (SELECT unnest(range(1, p + 1)) AS i) a, LATERAL (SELECT unnest(range(p + 1, 2 * p + 1)) AS j) b"""


def _effects(estimates: str, terms: str) -> str:
    """(term, effect, std_err, ci_low, ci_high, p_value) of estimates (i, effect, variance)."""
    z = "(effect / sqrt(variance))"
    return (
        f"SELECT (SELECT terms FROM {terms})[i] AS term, effect, sqrt(variance) AS std_err,"
        f" effect - {Z95} * sqrt(variance) AS ci_low, effect + {Z95} * sqrt(variance) AS ci_high,"
        f" {two_sided_p(z)} AS p_value FROM {estimates}"
    )


def ols_hc1(source: str, outcome: str, categories: dict[str, str | None], numeric: str) -> str:
    """Least squares with HC1 errors: (term, effect, std_err, ci_low, ci_high, p_value)."""
    terms, rows = design(source, outcome, categories, numeric)
    return f"""
SELECT * FROM (
  WITH tm AS ({terms}), rw AS MATERIALIZED ({rows}),
  gram AS MATERIALIZED ({_products('rw')}), inv AS MATERIALIZED ({inverse('gram')}),
  xy AS (SELECT i, sum(x[i] * y) AS v FROM rw, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) a GROUP BY i),
  beta AS MATERIALIZED (SELECT inv.i, sum(inv.v * xy.v) AS v FROM inv JOIN xy ON inv.j = xy.i GROUP BY inv.i),
  er AS MATERIALIZED (SELECT x, y - list_dot_product(x, (SELECT list(v ORDER BY i) FROM beta)) AS e FROM rw),
  meat AS MATERIALIZED ({_products('er', 'e * e')}),
  half AS (SELECT inv.i, meat.j, sum(inv.v * meat.v) AS v FROM inv JOIN meat ON inv.j = meat.i GROUP BY inv.i, meat.j),
  var AS (SELECT half.i, sum(half.v * inv.v) AS v FROM half JOIN inv ON half.j = inv.i AND half.i = inv.j GROUP BY half.i),
  est AS (
    SELECT beta.i, beta.v AS effect,
      greatest(var.v, 0) * (SELECT count(*) FROM rw) / ((SELECT count(*) FROM rw) - (SELECT count(*) FROM beta)) AS variance
    FROM beta JOIN var USING (i))
  {_effects('est', 'tm')}
)"""


def _inverses(products: str) -> str:
    """(s, i, j, v): the inverse of the matrix of each stratum; a term without rows stands alone."""
    return f"""
SELECT s, i, j - p AS j, m[i][j] AS v FROM (
  WITH RECURSIVE wide AS (
    SELECT s, count(*) AS p, list(r ORDER BY i) AS m FROM (
      SELECT s, i, list(CASE WHEN i = j AND v = 0 THEN 1.0::DOUBLE ELSE v END ORDER BY j)
        || list_transform(range(1, (SELECT max(i) FROM {products}) + 1),
        lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r
      FROM {products} GROUP BY s, i)
    GROUP BY s
  ), steps(s, k, p, m) AS (
    SELECT s, 1, p, m FROM wide
    UNION ALL
    SELECT s, k + 1, p, list_transform(m, lambda r, i:
      CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
           ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END)
    FROM steps WHERE k <= p
  )
  SELECT s, p, m FROM steps WHERE k = p + 1
), LATERAL (SELECT unnest(range(1, p + 1)) AS i) a, LATERAL (SELECT unnest(range(p + 1, 2 * p + 1)) AS j) b"""


def logit_ame(source: str, outcome: str, categories: dict[str, str | None], numeric: str, steps: int = 9,
              stratum: str = "0") -> str:
    """Average marginal effects of a logit in each stratum, delta-method errors, intercept left out.

    (stratum, term, effect, std_err, ci_low, ci_high, p_value, n, moved); the last is
    the largest move of the last step.
    """
    terms, rows = design(source, outcome, categories, numeric)
    each = "LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) a"
    ctes = [f"tm AS ({terms})", f"rw AS MATERIALIZED ({rows.replace('SELECT [1.0', f'SELECT {stratum} AS s, [1.0', 1)})",
            "b0 AS (SELECT DISTINCT s, list_transform(terms, lambda t: 0.0::DOUBLE) AS b FROM rw, tm)"]

    def information(f: str) -> str:
        return (
            f"SELECT s, i, j, sum(mu * (1 - mu) * x[i] * x[j]) AS v FROM {f}, {each},"
            " LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) c GROUP BY s, i, j"
        )

    for k in range(steps):
        ctes += [
            f"f{k} AS MATERIALIZED (SELECT s, x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS mu FROM rw JOIN b{k} USING (s))",
            f"h{k} AS MATERIALIZED ({information(f'f{k}')})",
            f"v{k} AS MATERIALIZED ({_inverses(f'h{k}')})",
            f"g{k} AS (SELECT s, i, sum(x[i] * (y - mu)) AS v FROM f{k}, {each} GROUP BY s, i)",
            f"b{k + 1} AS MATERIALIZED (SELECT s, list(b[i] + d ORDER BY i) AS b, max(abs(d)) AS moved FROM"
            f" (SELECT v{k}.s, v{k}.i, sum(v{k}.v * g{k}.v) AS d FROM v{k} JOIN g{k} ON v{k}.s = g{k}.s AND v{k}.j = g{k}.i"
            f" GROUP BY ALL) JOIN b{k} USING (s) GROUP BY s)",
        ]
    z = "(effect / sqrt(variance))"
    ctes += [
        f"ff AS MATERIALIZED (SELECT s, x, b, moved, 1 / (1 + exp(-list_dot_product(x, b))) AS mu FROM rw JOIN b{steps} USING (s))",
        f"hh AS MATERIALIZED ({information('ff')})",
        f"cov AS MATERIALIZED ({_inverses('hh')})",
        "slope AS (SELECT s, any_value(b) AS b, any_value(moved) AS moved, avg(mu * (1 - mu)) AS w, count(*) AS n FROM ff GROUP BY s)",
        f"curve AS (SELECT s, i, avg(x[i] * mu * (1 - mu) * (1 - 2 * mu)) AS c FROM ff, {each} GROUP BY s, i)",
        # d(b_i w) / d b_j
        "jac AS MATERIALIZED (SELECT a.s, a.i, curve.i AS j, (CASE WHEN a.i = curve.i THEN w ELSE 0 END)"
        " + b[a.i] * c AS v FROM (SELECT s, i FROM curve) a JOIN curve USING (s) JOIN slope USING (s))",
        "half AS (SELECT jac.s, jac.i, cov.j, sum(jac.v * cov.v) AS v FROM jac JOIN cov ON jac.s = cov.s AND jac.j = cov.i GROUP BY ALL)",
        "var AS (SELECT half.s, half.i, sum(half.v * jac.v) AS v FROM half"
        " JOIN jac ON half.s = jac.s AND half.j = jac.j AND half.i = jac.i GROUP BY ALL)",
        "est AS (SELECT s, i, n, moved, b[i] * w AS effect, greatest(v, 0) AS variance FROM var JOIN slope USING (s) WHERE i > 1)",
    ]
    return (
        f"\nSELECT * FROM (\n  WITH {', '.join(ctes)}\n  SELECT s AS stratum, (SELECT terms FROM tm)[i] AS term, effect,"
        f" sqrt(variance) AS std_err, effect - {Z95} * sqrt(variance) AS ci_low, effect + {Z95} * sqrt(variance) AS ci_high,"
        f" {two_sided_p(z)} AS p_value, n, moved FROM est\n)"
    )
