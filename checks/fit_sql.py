"""Linear models fitted in SQL: accelerated proximal steps of constant momentum, all models side by side.

Another optimiser than the engine's, run until nothing moves, as an independent answer for the registered fits.
"""

from __future__ import annotations

MOMENTUM = 0.95  # any value below 1 leads to the same optimum
STEPS = 800

# loss -> (slope by margin m with sign s, greatest curvature)
LOSSES = {
    "logistic": ("-1.0::DOUBLE / (1.0::DOUBLE + exp(least(s * m, 500.0::DOUBLE)))", 0.25),
    "sq_hinge": ("-2.0::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - s * m)", 2.0),
}

COUNTS = """count(*) FILTER (y = 1 AND m >= 0)::DOUBLE AS tp, count(*) FILTER (y = 0 AND m >= 0)::DOUBLE AS fp,
  count(*) FILTER (y = 1 AND m < 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND m < 0)::DOUBLE AS tn"""

METRICS = """round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
  WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END, 6) AS bacc,
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def fits(loss: str, l1: str, l2: str, balanced: bool = True) -> str:
    """CTEs from ``train`` (model, id, y, x) to ``fitted`` (model, w: weights and intercept last, off: largest miss of the
    condition of the optimum); ``l1`` and ``l2`` may use ``n``, the rows of a model."""
    slope, bend = LOSSES[loss]
    share = "1.0::DOUBLE / (2.0::DOUBLE * count(*) OVER (PARTITION BY model, y))" if balanced else "1.0::DOUBLE / count(*) OVER (PARTITION BY model)"
    return f"""
weighted AS MATERIALIZED (SELECT model, id, y, 2 * y - 1 AS s, list_append(x, 1.0::DOUBLE) AS x, {share} AS sw FROM train),
fit_sizes AS MATERIALIZED (
  SELECT model, {l1} AS l1, {l2} AS l2, p, 1.0::DOUBLE / ({bend}::DOUBLE * bound + {l2}) AS step
  FROM (SELECT model, count(*) AS n, any_value(len(x)) AS p, sum(sw * list_dot_product(x, x)) AS bound FROM weighted GROUP BY 1)),
fit_steps AS (
  SELECT model, 0 AS k, list_transform(range(p), lambda i: 0.0::DOUBLE) AS w, list_transform(range(p), lambda i: 0.0::DOUBLE) AS v FROM fit_sizes
  UNION ALL
  SELECT model, k + 1, new, list_transform(list_zip(new, w), lambda t: t[1] + {MOMENTUM}::DOUBLE * (t[1] - t[2]))
  FROM (
    SELECT c.model, f.k, f.w, list(CASE WHEN c.i = c.p THEN u ELSE sign(u) * greatest(abs(u) - c.step * c.l1, 0.0::DOUBLE) END ORDER BY c.i) AS new
    FROM (
      SELECT g.model, g.i, q.p, q.step, q.l1, f.v[g.i] - q.step * (g.g + CASE WHEN g.i < q.p THEN q.l2 * f.v[g.i] ELSE 0.0::DOUBLE END) AS u
      FROM (
        SELECT model, i, sum(pull * e) AS g FROM (
          SELECT model, pull, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM (
            SELECT r.model, r.x, r.s * r.sw * ({slope}) AS pull
            FROM (SELECT a.*, list_dot_product(a.x, b.v) AS m FROM weighted a JOIN fit_steps b ON a.model = b.model WHERE b.k < {STEPS}) r))
        GROUP BY 1, 2) g
      JOIN fit_sizes q ON q.model = g.model JOIN fit_steps f ON f.model = g.model) c
    JOIN fit_steps f ON f.model = c.model GROUP BY 1, 2, 3)),
fitted AS MATERIALIZED (SELECT l.model, l.w, list_max(list_transform(list_zip(l.w, b.w), lambda t: abs(t[1] - t[2]))) / step AS off
  FROM fit_steps l JOIN fit_steps b ON b.model = l.model AND b.k = l.k - 1 JOIN fit_sizes q ON q.model = l.model WHERE l.k = {STEPS}),
decided AS (SELECT r.model, r.y, list_dot_product(r.x, f.w) AS m FROM weighted r JOIN fitted f ON f.model = r.model)"""
