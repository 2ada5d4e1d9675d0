"""SQL twins of the registered queries, for a second engine to run on the same tables."""

from __future__ import annotations

import re

def pyround(expr: str, places: int) -> str:
    """Round by the exact binary value, ties to even (``round_half_even`` in SQL)."""
    power = float(10**places)
    scaled = power * 134217729.0
    ph = scaled - (scaled - power)
    pl = power - ph
    d = "CAST({} AS DOUBLE)".format
    xh = f"(x * {d(134217729.0)} - (x * {d(134217729.0)} - x))"
    xl = f"(x - {xh})"
    p = f"(x * {d(power)})"
    err = f"((({xh} * {d(ph)} - {p}) + {xh} * {d(pl)} + {xl} * {d(ph)}) + {xl} * {d(pl)})"
    beyond = f"(({p} - (floor({p}) + {d(0.5)})) + {err})"
    up = f"({beyond} > 0 OR ({beyond} = 0 AND floor({p}) % 2 = 1))"
    body = f"(floor({p}) + CASE WHEN {up} THEN 1 ELSE 0 END) / {d(power)}"
    return f"list_transform([CAST({expr} AS DOUBLE)], lambda x: {body})[1]"


def expand(sql: str) -> str:
    """Replace every ``pyround(expression, places)`` by its plain SQL."""
    while (start := sql.find("pyround(")) >= 0:
        depth, at, comma = 1, start + 8, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        sql = sql[:start] + pyround(sql[start + 8 : comma], int(sql[comma + 1 : at - 1])) + sql[at:]
    return sql


SCORED = """
scored AS (
  SELECT 'E' || (l_suppkey % 2 + 1) AS experiment_id,
         l_orderkey % 10 + 1 AS fold,
         'P' || (l_partkey % 200) AS identity1,
         CASE WHEN l_linenumber % 4 = 0 THEN 'P' || (l_partkey % 200)
              ELSE 'P' || ((l_partkey + 1 + l_suppkey % 198) % 200) END AS identity2,
         CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS is_same,
         round(CAST(0.64 AS DOUBLE) * CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END
               + ((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 1000 - 500)
                 / CAST(1000.0 AS DOUBLE), 4) AS raw_score
  FROM lineitem)"""

SCORE_COUNTS = """
sc AS (SELECT raw_score, CAST(sum(is_same) AS BIGINT) AS pos, CAST(sum(1 - is_same) AS BIGINT) AS neg
       FROM scored GROUP BY raw_score)"""


def sweep_ctes(low: float, high: float, step: float, weights: str, keys: str = "") -> str:
    """CTEs ``grid`` and ``sweep`` over ``weights`` (columns: keys, raw_score, is_same, w)."""
    size = round((high - low) / step)
    comma = f"{keys}," if keys else ""
    group = f"GROUP BY {comma} g.tau"
    return f"""
grid AS (SELECT round({low} + i * CAST({step} AS DOUBLE), 4) AS tau FROM range({size + 1}) t(i)),
cells AS (
  SELECT {comma} g.tau AS threshold,
         coalesce(sum(w) FILTER (WHERE raw_score >= g.tau AND is_same = 1), 0) AS tp,
         coalesce(sum(w) FILTER (WHERE raw_score < g.tau AND is_same = 0), 0) AS tn,
         coalesce(sum(w) FILTER (WHERE raw_score >= g.tau AND is_same = 0), 0) AS fp,
         coalesce(sum(w) FILTER (WHERE raw_score < g.tau AND is_same = 1), 0) AS fn
  FROM {weights} CROSS JOIN grid g {group}),
rates AS (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fn) AS rec,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1.0 END AS prec
  FROM cells),
sweep AS (
  SELECT {comma} threshold, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
         CAST(fn AS BIGINT) AS fn,
         pyround(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 4) AS accuracy,
         pyround(CAST(fp AS DOUBLE) / (fp + tn), 6) AS far,
         pyround(CAST(fn AS DOUBLE) / (fn + tp), 6) AS frr,
         pyround(prec, 4) AS precision, pyround(rec, 4) AS recall,
         pyround(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 4) AS f1,
         pyround(CAST(tp + fp AS DOUBLE) / (tp + tn + fp + fn), 4) AS acceptance_rate
  FROM rates)"""


WEIGHTS = """
weighted AS (SELECT raw_score, is_same, count(*) AS w FROM scored GROUP BY raw_score, is_same)"""


def roc_ctes(source: str, key: str = "") -> str:
    """CTE ``roc`` with kept points from ``source`` (key, raw_score, pos, neg)."""
    part = f"PARTITION BY {key}" if key else ""
    comma = f"{key}," if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
cum AS (
  SELECT {comma} raw_score, pos, neg,
         sum(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn,
         lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS rn
  FROM {source} WINDOW w AS ({part} ORDER BY raw_score DESC)),
roc AS (
  SELECT {comma} raw_score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
         CAST(tp AS DOUBLE) / np AS tpr, CAST(fp AS DOUBLE) / nn AS fpr
  FROM cum WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL
  SELECT {comma} CAST('inf' AS DOUBLE), 0, 0, 0.0, 0.0 FROM {source} {group}{'' if key else 'HAVING count(*) > 0'}),
auc AS (
  SELECT {comma} sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0)) / (CAST(max(np) AS DOUBLE) * max(nn)) AS roc_auc
  FROM cum {group}),
eer AS (
  SELECT {comma} (fpr + (1 - tpr)) / 2 AS eer, threshold AS eer_threshold
  FROM (SELECT *, row_number() OVER ({part} ORDER BY abs(fpr - (1 - tpr)), threshold DESC) AS k FROM roc)
  WHERE k = 1)"""


SQL: dict[str, str] = {}

SQL["confusion_at_threshold"] = f"""
WITH {SCORED}, c AS (
  SELECT experiment_id, count(*) FILTER (WHERE raw_score >= 0.24 AND is_same = 1) AS tp,
         count(*) FILTER (WHERE raw_score < 0.24 AND is_same = 0) AS tn,
         count(*) FILTER (WHERE raw_score >= 0.24 AND is_same = 0) AS fp,
         count(*) FILTER (WHERE raw_score < 0.24 AND is_same = 1) AS fn
  FROM scored GROUP BY experiment_id)
SELECT experiment_id, tp, tn, fp, fn, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
       round(CAST(fp AS DOUBLE) / (fp + tn), 6) AS far, round(CAST(fn AS DOUBLE) / (fn + tp), 6) AS frr
FROM c"""

SQL["threshold_sweep"] = f"WITH {SCORED}, {WEIGHTS}, {sweep_ctes(-0.2, 0.95, 0.001, 'weighted')} SELECT * FROM sweep"

SQL["roc_curve"] = f"""
WITH {SCORED}, {SCORE_COUNTS}, {roc_ctes('sc')}
SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc"""

SQL["roc_auc"] = f"WITH {SCORED}, {SCORE_COUNTS}, {roc_ctes('sc')} SELECT round(roc_auc, 6) AS roc_auc FROM auc"

SQL["eer"] = f"""
WITH {SCORED}, {SCORE_COUNTS}, {roc_ctes('sc')}
SELECT round(eer, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM eer"""

SQL["roc_distance"] = f"""
WITH {SCORED}, neg AS (SELECT fold, -raw_score AS raw_score, is_same FROM
       (SELECT fold, round(2 - raw_score, 4) AS raw_score, is_same FROM scored)),
sc AS (SELECT fold, raw_score, CAST(sum(is_same) AS BIGINT) AS pos, CAST(sum(1 - is_same) AS BIGINT) AS neg
       FROM neg GROUP BY fold, raw_score), {roc_ctes('sc', 'fold')}
SELECT fold, round(roc_auc, 6) AS roc_auc, round(eer, 6) AS eer, round(-eer_threshold, 6) AS eer_threshold
FROM auc JOIN eer USING (fold)"""

GRID_BEST = """
span AS (SELECT {key} min(raw_score) AS lo, max(raw_score) AS hi FROM {source} {group}),
cand AS (SELECT {key} j, CASE WHEN j = {last} THEN hi ELSE j * ((hi - lo) / {last}) + lo END AS v
         FROM span CROSS JOIN range({last} + 1) t(j)),
acc AS (
  SELECT {ckey} j, v, sum(w * CASE WHEN (raw_score >= v) = (is_same = 1) THEN 1 ELSE 0 END)
         / CAST(sum(w) AS DOUBLE) AS a
  FROM cand c JOIN {source} s ON {on} GROUP BY {ckey} j, v),
top AS (SELECT *, max(a) OVER ({part}) AS best FROM acc),
lead_in AS (SELECT *, min(CASE WHEN a = best THEN j END) OVER ({part}) AS f FROM top),
chosen AS (SELECT {key} quantile_cont(v, 0.5) AS optimal_threshold FROM lead_in
           WHERE j >= f AND best - a <= 1e-7 + 1e-5 * best {group})"""

SQL["optimal_threshold"] = f"""
WITH {SCORED}, {WEIGHTS}, {GRID_BEST.format(key='', ckey='', source='weighted', group='', last=999, on='true', part='')}
SELECT round(optimal_threshold, 6) AS optimal_threshold FROM chosen"""

SQL["fold_metrics"] = f"""
WITH {SCORED},
fw AS (SELECT fold, raw_score, is_same, count(*) AS w FROM scored GROUP BY ALL),
train AS (SELECT k.fold AS tf, raw_score, is_same, sum(w) AS w
          FROM fw JOIN (SELECT DISTINCT fold FROM scored) k ON k.fold <> fw.fold GROUP BY ALL),
{GRID_BEST.format(key='tf,', ckey='c.tf,', source='train', group='GROUP BY tf', last=1999, on='c.tf = s.tf',
                  part='PARTITION BY tf')},
sc AS (SELECT fold, raw_score, CAST(sum(is_same) AS BIGINT) AS pos, CAST(sum(1 - is_same) AS BIGINT) AS neg
       FROM scored GROUP BY fold, raw_score),
{roc_ctes('sc', 'fold')},
t AS (
  SELECT s.fold, any_value(optimal_threshold) AS th,
         count(*) FILTER (WHERE raw_score >= optimal_threshold AND is_same = 1) AS tp,
         count(*) FILTER (WHERE raw_score < optimal_threshold AND is_same = 0) AS tn,
         count(*) FILTER (WHERE raw_score >= optimal_threshold AND is_same = 0) AS fp,
         count(*) FILTER (WHERE raw_score < optimal_threshold AND is_same = 1) AS fn, count(*) AS n
  FROM scored s JOIN chosen c ON c.tf = s.fold GROUP BY s.fold)
SELECT fold, n AS test_pairs, CAST((SELECT count(*) FROM scored) - n AS BIGINT) AS train_pairs,
       pyround(th, 4) AS calibrated_threshold,
       pyround(CAST(tp + tn AS DOUBLE) / n, 4) AS calibrated_accuracy,
       pyround(CAST(fp AS DOUBLE) / (fp + tn), 4) AS calibrated_far,
       pyround(CAST(fn AS DOUBLE) / (fn + tp), 4) AS calibrated_frr,
       pyround(roc_auc, 4) AS roc_auc, pyround(eer, 4) AS eer, pyround(eer_threshold, 4) AS eer_threshold
FROM t JOIN auc USING (fold) JOIN eer USING (fold)"""

SQL["fold_summary"] = f"""
WITH f AS ({SQL['fold_metrics']})
SELECT """ + ", ".join(
    f"pyround(avg({c}), 4) AS {c}_mean, pyround(stddev_pop({c}), 4) AS {c}_std"
    for c in ("calibrated_accuracy", "calibrated_far", "calibrated_frr", "calibrated_threshold", "roc_auc", "eer")
) + " FROM f"

SQL["fold_score_stats"] = f"""
WITH {SCORED} SELECT fold, is_same, count(*) AS n, pyround(avg(raw_score), 4) AS mean, pyround(median(raw_score), 4) AS median,
  pyround(stddev_pop(raw_score), 4) AS std, pyround(min(raw_score), 4) AS min, pyround(max(raw_score), 4) AS max FROM scored GROUP BY fold, is_same"""


def of_experiment(name: str) -> str:
    """The fold summary over the pairs of one experiment."""
    mine = SCORED.replace("FROM lineitem)", f"FROM lineitem WHERE 'E' || (l_suppkey % 2 + 1) = '{name}')")
    return SQL["fold_summary"].replace(SCORED, mine)


SQL["experiments_side_by_side"] = f"""
WITH one AS ({of_experiment('E1')}), two AS ({of_experiment('E2')}),
a AS (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE "E1"), b AS (UNPIVOT two ON COLUMNS(*) INTO NAME metric VALUE "E2")
SELECT metric, a."E1", b."E2" FROM a JOIN b USING (metric)"""

SQL["calibration_strategies"] = f"""
WITH {SCORED}, {WEIGHTS}, {SCORE_COUNTS}, {roc_ctes('sc')},
{sweep_ctes(-0.2, 0.95, 0.001, 'weighted').replace('rates AS', 'rt AS').replace('FROM rates', 'FROM rt')},
r AS (
  SELECT sweep.*, row_number() OVER (PARTITION BY accuracy ORDER BY threshold) AS ka,
         count(*) OVER (PARTITION BY accuracy) AS na, max(accuracy) OVER () AS ma,
         row_number() OVER (PARTITION BY f1 ORDER BY threshold) AS kf,
         count(*) OVER (PARTITION BY f1) AS nf, max(f1) OVER () AS mf,
         row_number() OVER (ORDER BY abs(threshold - (SELECT eer_threshold FROM eer)), threshold) AS ke,
         row_number() OVER (ORDER BY CASE WHEN far <= 0.001 THEN 0 ELSE 1 END, recall DESC, accuracy DESC,
                            threshold) AS kl,
         row_number() OVER (ORDER BY abs(far - frr), threshold) AS kb
  FROM sweep),
picked AS (
  SELECT 'eer_operating_point' AS strategy, r.* FROM r WHERE ke = 1
  UNION ALL SELECT 'maximum_accuracy', r.* FROM r WHERE accuracy = ma AND ka = na // 2 + 1
  UNION ALL SELECT 'security_oriented_low_far', r.* FROM r WHERE kl = 1
  UNION ALL SELECT 'f1_optimal', r.* FROM r WHERE f1 = mf AND kf = nf // 2 + 1
  UNION ALL SELECT 'far_frr_balanced', r.* FROM r WHERE kb = 1)
SELECT strategy, threshold, accuracy, far, frr, precision, recall, f1, acceptance_rate,
       (SELECT pyround(roc_auc, 4) FROM auc) AS roc_auc,
       CASE WHEN strategy = 'eer_operating_point' THEN (SELECT pyround(eer, 4) FROM eer) END AS eer_continuous,
       CASE WHEN strategy = 'security_oriented_low_far' THEN CAST(0.001 AS DOUBLE) END AS target_far,
       CASE WHEN strategy = 'security_oriented_low_far' THEN far <= 0.001 END AS supported,
       CASE WHEN strategy = 'far_frr_balanced' THEN pyround(abs(far - frr), 6) END AS far_frr_diff,
       strategy = 'security_oriented_low_far' AS recommended
FROM picked"""

FOLDS_OF_IDS = """
ids AS (SELECT identity1 AS identity FROM scored UNION SELECT identity2 FROM scored),
ranked AS (
  SELECT identity, row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || identity), 1, 15))::BIGINT, identity) - 1 AS z,
         count(*) OVER () AS n FROM ids),
folds AS (
  SELECT identity, CASE WHEN z < (n % 5) * (n // 5 + 1) THEN z // (n // 5 + 1)
         ELSE n % 5 + (z - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM ranked)"""

SQL["identity_folds"] = f"WITH {SCORED}, {FOLDS_OF_IDS} SELECT identity, CAST(fold AS BIGINT) AS fold FROM folds"

SQL["threshold_stability"] = f"""
WITH {SCORED}, {FOLDS_OF_IDS},
tr AS (
  SELECT k AS tf, raw_score, is_same, count(*) AS w
  FROM scored JOIN folds a ON a.identity = identity1 JOIN folds b ON b.identity = identity2
  CROSS JOIN range(5) t(k) WHERE k <> a.fold AND k <> b.fold GROUP BY ALL),
sc AS (SELECT tf, raw_score, CAST(sum(w * is_same) AS BIGINT) AS pos, CAST(sum(w * (1 - is_same)) AS BIGINT) AS neg
       FROM tr GROUP BY tf, raw_score),
{roc_ctes('sc', 'tf')},
{sweep_ctes(-0.2, 0.95, 0.005, 'tr', 'tf')},
per_fold AS (
  SELECT tf, (SELECT e.eer_threshold FROM eer e WHERE e.tf = s.tf) AS eer_threshold,
         arg_min(threshold, (-accuracy * 10000 * 100000 + threshold * 1000)) AS max_accuracy_threshold,
         min(threshold) FILTER (WHERE far <= 0.001) AS low_far_threshold
  FROM sweep s GROUP BY tf),
long AS (
  SELECT 'eer_threshold' AS kind, eer_threshold AS v FROM per_fold
  UNION ALL SELECT 'max_accuracy_threshold', max_accuracy_threshold FROM per_fold
  UNION ALL SELECT 'low_far_threshold', low_far_threshold FROM per_fold)
SELECT kind, pyround(avg(v), 4) AS mean, pyround(stddev_pop(v), 4) AS std, pyround(min(v), 4) AS min, pyround(max(v), 4) AS max
FROM long WHERE v IS NOT NULL GROUP BY kind"""

SQL["score_stats"] = f"""
WITH {SCORED} SELECT is_same, count(*) AS n, round(avg(raw_score), 6) AS mean, round(stddev_pop(raw_score), 6) AS std,
  round(min(raw_score), 6) AS min, round(max(raw_score), 6) AS max, round(quantile_cont(raw_score, 0.5), 6) AS median
FROM scored GROUP BY is_same"""

SUMMARY_COLS = """count(*) AS n, pyround(avg({v}), 4) AS mean, pyround(quantile_cont({v}, 0.5), 4) AS median,
  pyround(stddev_pop({v}), 4) AS std, pyround(min({v}), 4) AS min, pyround(max({v}), 4) AS max,
  pyround(quantile_cont({v}, 0.01), 4) AS p1, pyround(quantile_cont({v}, 0.05), 4) AS p5,
  pyround(quantile_cont({v}, 0.25), 4) AS p25, pyround(quantile_cont({v}, 0.5), 4) AS p50,
  pyround(quantile_cont({v}, 0.75), 4) AS p75, pyround(quantile_cont({v}, 0.95), 4) AS p95,
  pyround(quantile_cont({v}, 0.99), 4) AS p99"""

SQL["score_percentiles"] = f"WITH {SCORED} SELECT is_same, {SUMMARY_COLS.format(v='raw_score')} FROM scored GROUP BY is_same"

CONTINUOUS = """
cont AS (SELECT CASE WHEN (l_linenumber + l_partkey) % 3 = 0 THEN 1 ELSE 0 END AS is_same,
           CASE WHEN l_orderkey = 7 THEN CAST(1e6 AS DOUBLE)
                ELSE floor((CAST(l_extendedprice AS DOUBLE) / CAST(7919.0 AS DOUBLE) + l_orderkey % 9973 / CAST(10007.0 AS DOUBLE)) * CAST(1e9 AS DOUBLE)) / CAST(1e9 AS DOUBLE) END AS raw_score
         FROM lineitem)"""

SQL["roc_curve_continuous"] = f"""
WITH {CONTINUOUS}, n AS (SELECT raw_score, sum(is_same) AS p, sum(1 - is_same) AS q FROM cont GROUP BY raw_score),
c AS (SELECT raw_score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp FROM n
      WINDOW w AS (ORDER BY raw_score DESC)),
t AS (SELECT max(tp) AS tt, max(fp) AS ff FROM c)
SELECT threshold, tp, fp, round(CAST(tp AS DOUBLE) / tt, 6) AS tpr, round(CAST(fp AS DOUBLE) / ff, 6) AS fpr
FROM (SELECT * FROM c UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0) CROSS JOIN t"""

SQL["score_percentiles_continuous"] = f"WITH {CONTINUOUS} SELECT is_same, {SUMMARY_COLS.format(v='raw_score')} FROM cont GROUP BY is_same"

SQL["score_histogram"] = f"""
WITH {SCORED}, s AS (SELECT is_same, min(raw_score) AS lo, max(raw_score) AS hi, count(*) AS total
                     FROM scored GROUP BY is_same),
b AS (SELECT is_same, least(floor((raw_score - lo) / ((hi - lo) / 50.0)), 49) AS bin, count(*) AS n
      FROM scored JOIN s USING (is_same) GROUP BY ALL)
SELECT s.is_same, CAST(t.i AS BIGINT) AS bin, round(lo + t.i * ((hi - lo) / 50.0), 6) AS bin_start,
       round(lo + (t.i + 1) * ((hi - lo) / 50.0), 6) AS bin_end, coalesce(b.n, 0) AS n,
       round(coalesce(b.n, 0) / (total * ((hi - lo) / 50.0)), 6) AS density
FROM s CROSS JOIN range(50) t(i) LEFT JOIN b ON b.is_same = s.is_same AND b.bin = t.i"""

SQL["verification_summary"] = f"""
WITH {SCORED}, sc AS (SELECT experiment_id, raw_score, CAST(sum(is_same) AS BIGINT) AS pos,
       CAST(sum(1 - is_same) AS BIGINT) AS neg FROM scored GROUP BY experiment_id, raw_score),
{roc_ctes('sc', 'experiment_id')},
c AS (
  SELECT experiment_id, count(*) AS n, count(*) FILTER (WHERE (raw_score >= 0.24) = (is_same = 1)) AS ok,
         count(*) FILTER (WHERE raw_score >= 0.24 AND is_same = 0) AS fp, count(*) FILTER (WHERE is_same = 0) AS nn,
         count(*) FILTER (WHERE raw_score < 0.24 AND is_same = 1) AS fn, count(*) FILTER (WHERE is_same = 1) AS np
  FROM scored GROUP BY experiment_id)
SELECT experiment_id, n AS total_pairs, n AS successful_pairs, CAST(0 AS BIGINT) AS failed_pairs,
       pyround(roc_auc, 4) AS global_roc_auc, pyround(eer, 4) AS global_eer, pyround(eer_threshold, 4) AS global_eer_threshold,
       CAST(0.24 AS DOUBLE) AS reference_threshold, pyround(CAST(ok AS DOUBLE) / n, 4) AS accuracy,
       pyround(CAST(fp AS DOUBLE) / nn, 4) AS far, pyround(CAST(fn AS DOUBLE) / np, 4) AS frr
FROM c JOIN auc USING (experiment_id) JOIN eer USING (experiment_id)"""

SCORE_FIELDS = {"mean": "avg", "median": "median", "std": "stddev_pop", "min": "min", "max": "max"}


def class_stats(name: str, label: int) -> str:
    """Count and rounded statistics of the scores of a class."""
    of = f"FILTER (WHERE is_same = {label})"
    parts = [f"count(*) {of} AS {name}_n"] + [f"pyround({f}(raw_score) {of}, 4) AS {name}_{c}" for c, f in SCORE_FIELDS.items()]
    return ", ".join(parts)


SQL["verification_report"] = f"""
WITH vs AS ({SQL['verification_summary']}),
fs AS (SELECT 'E1' AS experiment_id, * FROM ({of_experiment('E1')}) UNION ALL SELECT 'E2', * FROM ({of_experiment('E2')})),
cs AS (WITH {SCORED} SELECT experiment_id, {class_stats('genuine', 1)}, {class_stats('impostor', 0)} FROM scored GROUP BY experiment_id)
SELECT *, 'similarity' AS score_direction FROM vs JOIN fs USING (experiment_id) JOIN cs USING (experiment_id)"""

SQL["report_json"] = f"""
WITH f AS ({SQL['fold_metrics']}), s AS ({SQL['calibration_strategies']}),
c AS (WITH {SCORED} SELECT {class_stats('genuine', 1)}, {class_stats('impostor', 0)} FROM scored)
SELECT c.*, part, name, threshold, accuracy FROM c,
  (SELECT 'fold' AS part, CAST(fold AS VARCHAR) AS name, calibrated_threshold AS threshold, calibrated_accuracy AS accuracy FROM f
   UNION ALL SELECT 'strategy', strategy, threshold, accuracy FROM s)"""


SQL["experiment_comparison"] = f"""
WITH {SCORED}, c AS (
  SELECT experiment_id, fold, count(*) FILTER (WHERE raw_score >= 0.24 AND is_same = 1) AS tp,
         count(*) FILTER (WHERE raw_score < 0.24 AND is_same = 0) AS tn,
         count(*) FILTER (WHERE raw_score >= 0.24 AND is_same = 0) AS fp,
         count(*) FILTER (WHERE raw_score < 0.24 AND is_same = 1) AS fn
  FROM scored GROUP BY GROUPING SETS ((experiment_id, fold), (experiment_id)))
SELECT experiment_id, fold, tp, tn, fp, fn, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
       round(CAST(fp AS DOUBLE) / (fp + tn), 6) AS far, round(CAST(fn AS DOUBLE) / (fn + tp), 6) AS frr FROM c"""


# Identity search

ROLES = """
members AS (SELECT vec_id, 'id_' || label AS identity, embedding::DOUBLE[] AS e,
                   row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
tpl AS (SELECT vec_id AS template_id, identity, e FROM members WHERE rn % 2 = 1),
qry AS (SELECT vec_id AS query_id, identity AS true_identity,
               list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e, e AS raw FROM members WHERE rn % 2 = 0)"""

BEST = """
byid AS (SELECT query_id, true_identity, t.identity, max(list_dot_product(q.e, t.e)) AS s,
                min(template_id) AS first_t
         FROM qry q CROSS JOIN {templates} t GROUP BY query_id, true_identity, t.identity),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first_t) AS k FROM byid),
res AS (SELECT query_id, true_identity, CASE WHEN s >= 0.24 THEN identity END AS identity,
               identity AS best_candidate, s AS score, s >= 0.24 AS recognized FROM best WHERE k = 1)"""

OPEN_SET = """SELECT query_id, true_identity, identity, best_candidate, round(score, 6) AS score, recognized FROM res"""

SQL["gallery_search_cosine"] = f"WITH {ROLES}, {BEST.format(templates='tpl')} {OPEN_SET}"

SQL["gallery_search_blocks"] = SQL["gallery_search_cosine"]

SQL["gallery_quarantine"] = """
SELECT vec_id AS template_id, 'id_' || label AS identity,
       CASE WHEN vec_id % 7 = 3 THEN 'non-finite values' WHEN vec_id % 11 = 4 THEN 'unexpected dimension'
            ELSE 'missing embedding' END AS reason
FROM embeddings WHERE vec_id % 7 = 3 OR vec_id % 11 = 4 OR vec_id % 13 = 5"""

SQL["match_euclidean"] = f"""
WITH {ROLES}, d AS (SELECT query_id, true_identity, t.identity, list_distance(q.raw, t.e) AS s,
       row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q.raw, t.e), template_id) AS k
       FROM qry q CROSS JOIN tpl t)
SELECT query_id, true_identity, CASE WHEN s <= 1.2 THEN identity ELSE 'Unknown' END AS identity,
       round(s, 6) AS score, s <= 1.2 AS recognized FROM d WHERE k = 1"""

SQL["match_cosine_template"] = f"""
WITH {ROLES}, d AS (SELECT query_id, true_identity, t.identity, list_cosine_similarity(q.raw, t.e) AS s,
       row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.raw, t.e) DESC, template_id) AS k
       FROM qry q CROSS JOIN tpl t)
SELECT query_id, true_identity, CASE WHEN s >= 0.24 THEN identity ELSE 'Unknown' END AS identity,
       round(s, 6) AS score, s >= 0.24 AS recognized FROM d WHERE k = 1"""


def centre_ctes(source: str) -> str:
    return f"""
el AS (SELECT identity, i, avg(e[i]) AS x FROM {source}, range(1, 65) t(i) GROUP BY identity, i),
raw_c AS (SELECT identity, list(x ORDER BY i) AS c FROM el GROUP BY identity),
ctr AS (SELECT identity, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS e,
               row_number() OVER (ORDER BY identity) AS template_id FROM raw_c)"""


SQL["nearest_centroid"] = f"WITH {ROLES}, {centre_ctes('tpl')}, {BEST.format(templates='ctr')} {OPEN_SET}"

SQL["identity_centroids"] = f"""
WITH {ROLES}, {centre_ctes('members')}
SELECT identity, CAST(i - 1 AS BIGINT) AS pos, round(e[i], 6) AS value FROM ctr, range(1, 65) t(i)"""

SQL["gallery_validation"] = f"""
WITH {ROLES}, n AS (SELECT identity, e, sqrt(list_dot_product(e, e)) AS s FROM members)
SELECT max(abs(s - 1)) <= 0.00101 AND min(len(e)) = 64 AND max(len(e)) = 64 AS valid, count(*) AS total_templates,
       count(DISTINCT identity) AS unique_identities, round(min(s), 4) AS min_norm, round(max(s), 4) AS max_norm,
       concat_ws('; ', CASE WHEN max(abs(s - 1)) > 0.00101 THEN 'not unit normalised' END,
                 CASE WHEN min(len(e)) <> 64 OR max(len(e)) <> 64 THEN 'unexpected dimension' END) AS errors FROM n"""

SQL["vector_report"] = f"""
WITH {ROLES}, n AS (SELECT e, sqrt(list_dot_product(e, e)) AS s FROM members)
SELECT count(*) AS vectors, count(*) FILTER (WHERE len(e) <> 64) AS wrong_dimension,
       count(*) FILTER (WHERE NOT isfinite(list_sum(e))) AS non_finite, bool_and(abs(s - 1) <= 1e-4) AS unit_norm,
       round(min(s), 4) AS min_norm, round(max(s), 4) AS max_norm, count(DISTINCT e) > 1 AS distinct_vectors FROM n"""

SQL["template_counts"] = f"WITH {ROLES} SELECT identity, count(*) AS template_count FROM tpl GROUP BY identity"

SQL["gallery_summary"] = f"""
WITH {ROLES} SELECT count(*) AS total_templates, count(DISTINCT identity) AS unique_identities FROM members"""

SQL["gallery_build_report"] = f"""
WITH {ROLES} SELECT identity, count(*) FILTER (WHERE vec_id % 11 <> 0) AS templates_added,
       count(*) FILTER (WHERE vec_id % 11 = 0) AS skipped FROM members GROUP BY identity"""

SQL["gallery_add_remove"] = f"""
WITH {ROLES} SELECT identity, count(*) AS template_count FROM members WHERE identity <> 'id_3' GROUP BY identity"""

SQL["identification_report"] = expand(f"""
WITH {ROLES}, enr AS (SELECT * FROM tpl WHERE identity < 'id_7'), {BEST.format(templates='enr')},
m AS (SELECT *, true_identity < 'id_7' AS known FROM res),
f AS (SELECT count(*) FILTER (WHERE known) AS k, count(*) FILTER (WHERE known AND best_candidate = true_identity) AS h,
             count(*) FILTER (WHERE known AND recognized) AS a, avg(score) FILTER (WHERE known) AS km,
             count(*) FILTER (WHERE NOT known) AS u, count(*) FILTER (WHERE NOT known AND NOT recognized) AS r,
             avg(score) FILTER (WHERE NOT known) AS um FROM m)
SELECT k AS known_queries_evaluated, pyround(CAST(h AS DOUBLE) / k * 100, 2) AS known_correct_candidate_pct,
       pyround(CAST(a AS DOUBLE) / k * 100, 2) AS known_accepted_pct, pyround(km, 4) AS known_avg_similarity,
       u AS unknown_queries_evaluated, pyround(CAST(r AS DOUBLE) / u * 100, 2) AS unknown_rejected_pct,
       pyround(um, 4) AS unknown_avg_similarity, pyround(km - um, 4) AS score_margin FROM f""")

# Pairs and splits

CLAIMS = """
claims AS (SELECT l_orderkey * 8 + l_linenumber AS claim, l_orderkey % (SELECT count(*) + count(*) // 25 + 1 FROM embeddings) AS key1, l_partkey % (SELECT count(*) FROM embeddings) AS key2
           FROM lineitem),
mem AS (SELECT 'id_' || label AS identity, vec_id AS key, embedding::DOUBLE[] AS e FROM embeddings)"""


def h60(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


SQL["pair_scores"] = f"""
WITH {CLAIMS}
SELECT claim, key1, key2, round(list_dot_product(a.e, b.e), 6) AS raw_score, 'similarity' AS score_direction,
       CASE WHEN a.key IS NULL OR b.key IS NULL THEN 'failed_embedding' ELSE 'success' END AS status
FROM claims LEFT JOIN mem a ON a.key = key1 LEFT JOIN mem b ON b.key = key2"""

PLACED = f"""
placed AS (SELECT identity, key, row_number() OVER (PARTITION BY identity
                  ORDER BY {h60("'42'", "identity", "key")}, key) - 1 AS z,
                  count(*) OVER (PARTITION BY identity) AS n FROM mem)"""

GENUINE = f"""
gsz AS (SELECT identity, n * (n - 1) // 2 AS total, least(n * (n - 1) // 2, 150) AS drawn
        FROM placed WHERE n >= 2 GROUP BY identity, n),
gst AS (SELECT identity, k, k * (total // drawn) + least(k, total % drawn) AS start,
               total // drawn + CASE WHEN k < total % drawn THEN 1 ELSE 0 END AS width
        FROM gsz, range(150) t(k) WHERE k < drawn),
gt AS (SELECT identity, start + {h60("'42'", "'g'", "identity", "k")} % width AS t FROM gst),
gij AS (SELECT identity, CAST(floor((1 + sqrt(1 + 8.0 * t)) / 2) AS BIGINT) AS j, t FROM gt),
gen AS (SELECT g.identity AS identity1, g.identity AS identity2, least(a.key, b.key) AS key1,
               greatest(a.key, b.key) AS key2, 1 AS is_same
        FROM gij g JOIN placed a ON a.identity = g.identity AND a.z = g.t - g.j * (g.j - 1) // 2
        JOIN placed b ON b.identity = g.identity AND b.z = g.j)"""

IMPOSTOR = f"""
named AS (SELECT identity, n, row_number() OVER (ORDER BY {h60("'42'", "identity")}, identity) - 1 AS idx,
                 count(*) OVER () AS g FROM (SELECT DISTINCT identity, n FROM placed)),
dr AS (SELECT p AS pair_id, {h60("'42'", "'a'", "p")} % g AS i1,
              ({h60("'42'", "'a'", "p")} % g + 1 + {h60("'42'", "'b'", "p")} % (g - 1)) % g AS i2
       FROM range(1, 50001) t(p), (SELECT any_value(g) AS g FROM named)),
imp AS (SELECT pair_id, a.identity AS identity1, b.identity AS identity2, x.key AS key1, y.key AS key2, 0 AS is_same
        FROM dr JOIN named a ON a.idx = i1 JOIN named b ON b.idx = i2
        JOIN placed x ON x.identity = a.identity AND x.z = {h60("'42'", "'m1'", "pair_id")} % a.n
        JOIN placed y ON y.identity = b.identity AND y.z = {h60("'42'", "'m2'", "pair_id")} % b.n)"""

SQL["genuine_pairs_capped"] = f"WITH {CLAIMS}, {PLACED}, {GENUINE} SELECT * FROM gen"
SQL["impostor_pairs"] = f"WITH {CLAIMS}, {PLACED}, {IMPOSTOR} SELECT * FROM imp"

SQL["validation_pair_scores"] = f"""
WITH {CLAIMS}, {PLACED}, {GENUINE}, {IMPOSTOR},
s AS (SELECT is_same, list_dot_product(a.e, b.e) AS v
      FROM (SELECT key1, key2, is_same FROM gen UNION ALL SELECT key1, key2, is_same FROM imp)
      JOIN mem a ON a.key = key1 JOIN mem b ON b.key = key2)
SELECT is_same, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS min,
       round(max(v), 5) AS max, round(quantile_cont(v, 0.5), 5) AS median FROM s GROUP BY is_same"""

SQL["banded_pairs"] = f"""
WITH {CLAIMS}, o AS (SELECT identity, key, row_number() OVER (PARTITION BY identity ORDER BY key) AS p FROM mem)
SELECT a.identity, a.key AS key1, b.key AS key2 FROM o a JOIN o b
  ON a.identity = b.identity AND b.p BETWEEN a.p + 1 AND a.p + 9"""

SPLITS = f"""
split AS (SELECT identity, key, CASE WHEN z < 2 THEN 'enrollment'
                 WHEN z < 2 + greatest(1, floor(greatest(n - 2, 0) * 0.5)) THEN 'validation' ELSE 'test' END AS split
          FROM placed WHERE n >= 20)"""

SQL["split_assignment"] = f"WITH {CLAIMS}, {PLACED}, {SPLITS} SELECT identity, key, split FROM split"

SQL["missing_cache_keys"] = f"""
WITH {CLAIMS} SELECT DISTINCT key1 AS key FROM claims WHERE key1 NOT IN (SELECT key FROM mem)"""

SQL["distinct_pair_keys"] = f"""
WITH {CLAIMS} SELECT key1 AS key FROM claims UNION SELECT key2 FROM claims"""

SQL["seeded_sample"] = f"""
WITH {CLAIMS}, u AS (SELECT DISTINCT * FROM claims)
SELECT * FROM u ORDER BY {h60("'42'", "claim")}, claim LIMIT 300"""

SQL["capped_groups"] = f"""
WITH {CLAIMS}, u AS (SELECT DISTINCT claim, key2 FROM claims),
r AS (SELECT *, row_number() OVER (PARTITION BY key2 ORDER BY {h60("'42'", "claim")}, claim) AS k FROM u)
SELECT claim, key2 FROM r WHERE k <= 5"""

SQL["unknown_probes"] = f"""
WITH {CLAIMS}, f AS (SELECT identity, min(key) AS key FROM mem WHERE identity >= 'id_4' GROUP BY identity)
SELECT * FROM f ORDER BY {h60("'42'", "identity")}, identity LIMIT 5"""

# Quality

D = "CAST({} AS DOUBLE)".format

DETECTIONS = """
d0 AS (SELECT o_orderkey AS image_id, CAST(i - 1 AS BIGINT) AS det_idx, o_orderkey * 7 + (i - 1) * 13 AS k
       FROM orders, range(1, 4) t(i) WHERE i <= o_orderkey % 4),
d1 AS (SELECT *, (k * 37) % 90 + 20 AS w, (k * 53) % 90 + 20 AS h, (k * 11) % 120 AS lft, (k * 17) % 120 AS tp,
              CAST((k * 29) % 600 / 1000.0 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS confidence, (k * 19) % 17 <> 0 AS marks,
              CAST((k * 71) % 3000 / 10.0 AS DOUBLE) AS blur_score, CAST((k * 43) % 2560 / 10.0 AS DOUBLE) AS brightness_score,
              CAST((k * 61) % 700 / 10.0 AS DOUBLE) AS contrast_score,
              (k * 3) % 11 - 5 AS j1, (k * 5) % 11 - 5 AS j2, (k * 7) % 11 - 5 AS j3 FROM d0),
d2 AS (SELECT *, CAST(CAST(lft + w * CAST(0.3 AS DOUBLE) AS FLOAT) AS DOUBLE) AS lx,
              CAST(CAST(tp + (h * CAST(0.35 AS DOUBLE) + j1) AS FLOAT) AS DOUBLE) AS ly,
              CAST(CAST(lft + w * CAST(0.7 AS DOUBLE) AS FLOAT) AS DOUBLE) AS rx,
              CAST(CAST(tp + (h * CAST(0.35 AS DOUBLE) + j2) AS FLOAT) AS DOUBLE) AS ry,
              CAST(CAST(lft + (w * CAST(0.5 AS DOUBLE) + j3) AS FLOAT) AS DOUBLE) AS nx,
              CAST(CAST(tp + h * CAST(0.55 AS DOUBLE) AS FLOAT) AS DOUBLE) AS ny,
              CAST(CAST(lft + w * CAST(0.35 AS DOUBLE) AS FLOAT) AS DOUBLE) AS mlx,
              CAST(CAST(lft + w * CAST(0.65 AS DOUBLE) AS FLOAT) AS DOUBLE) AS mrx,
              CAST(CAST(tp + h * CAST(0.75 AS DOUBLE) AS FLOAT) AS DOUBLE) AS my FROM d1),
d3 AS (SELECT *, w AS face_width, h AS face_height, w * h AS face_area, w * h / CAST(62500 AS DOUBLE) AS face_area_ratio,
              degrees(atan2(abs(ry - ly), greatest(abs(rx - lx), 1e-5))) AS deg,
              sqrt((nx - lx) ** 2 + (ny - ly) ** 2) AS dl, sqrt((nx - rx) ** 2 + (ny - ry) ** 2) AS dr,
              lft - w * 0.25 AS x0, lft + w * 1.25 AS x1, tp - h * 0.25 AS y0, tp + h * 1.25 AS y1 FROM d2),
d4 AS (SELECT *, CASE WHEN NOT marks THEN 0.0 WHEN sqrt((rx - lx) ** 2 + (ry - ly) ** 2) < 2 THEN 0.1 ELSE
              least(1.0, greatest(0.0, 0.5 * greatest(0.0, 1 - deg / 45.0)
                + 0.3 * CASE WHEN (ly + ry) / 2 < ny AND ny < my THEN 1.0 ELSE 0.3 END
                + 0.2 * CASE WHEN least(lx, rx, nx, mlx, mrx) >= x0 AND greatest(lx, rx, nx, mlx, mrx) <= x1
                                  AND least(ly, ry, ny, my) >= y0 AND greatest(ly, ry, ny, my) <= y1
                             THEN 1.0 ELSE 0.4 END)) END AS alignment_quality,
              CASE WHEN NOT marks THEN 0.0 WHEN dl <= 1e-5 OR dr <= 1e-5 THEN 0.1
                   ELSE least(dl, dr) / greatest(dl, dr) END AS pose_quality FROM d3),
det AS (SELECT *, confidence AS detection_confidence,
               0.30 * least(1, greatest(0, (blur_score - 40) / 210.0)) + 0.20 * least(1, confidence)
               + 0.15 * alignment_quality + 0.15 * pose_quality
               + 0.10 * greatest(0, 1 - abs(brightness_score - 128) / 128.0)
               + 0.10 * least(1, contrast_score / 60.0) AS overall_quality FROM d4)"""

LIMITS = {
    "lenient": (25, 0.008, 20, 20, 240, 12, 0.45, 0.35, 0.25),
    "balanced": (40, 0.015, 40, 35, 225, 18, 0.60, 0.50, 0.40),
    "strict": (60, 0.03, 75, 50, 205, 25, 0.80, 0.65, 0.55),
}


def reasons(mode: str) -> str:
    size, area, blur, dark, bright, contrast, conf, align, pose = LIMITS[mode]
    return f"""concat_ws(',', CASE WHEN face_width < {size} OR face_height < {size} THEN 'low_resolution' END,
      CASE WHEN face_area_ratio < {D(area)} THEN 'face_too_small' END, CASE WHEN blur_score < {blur} THEN 'blurry' END,
      CASE WHEN brightness_score < {dark} THEN 'underexposed' WHEN brightness_score > {bright} THEN 'overexposed' END,
      CASE WHEN contrast_score < {contrast} THEN 'low_contrast' END,
      CASE WHEN detection_confidence < {D(conf)} THEN 'low_detection_confidence' END,
      CASE WHEN alignment_quality < {D(align)} THEN 'poor_alignment' END,
      CASE WHEN pose_quality < {D(pose)} THEN 'extreme_pose' END)"""


PRIMARY = """
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_idx) AS pk,
                               count(*) OVER (PARTITION BY image_id) AS n_detections FROM det) WHERE pk = 1)"""

SQL["quality_scores"] = f"""
WITH {DETECTIONS} SELECT image_id, det_idx, face_width, face_height, face_area, round(face_area_ratio, 5) AS face_area_ratio,
  round(alignment_quality, 5) AS alignment_quality, round(pose_quality, 5) AS pose_quality,
  round(overall_quality, 5) AS overall_quality FROM det"""

SQL["quality_gate"] = f"""
WITH {DETECTIONS}, g AS (SELECT image_id, det_idx, {reasons('strict')} AS reasons FROM det)
SELECT image_id, det_idx, CASE WHEN reasons = '' THEN 'good' ELSE 'poor' END AS quality_status, reasons FROM g"""

SQL["primary_by_confidence"] = f"WITH {DETECTIONS}, {PRIMARY} SELECT image_id, det_idx, n_detections FROM prim"

SQL["primary_by_area"] = f"""
WITH {DETECTIONS}, p AS (SELECT image_id, det_idx, count(*) OVER (PARTITION BY image_id) AS n_detections,
  row_number() OVER (PARTITION BY image_id ORDER BY face_area DESC, det_idx) AS k FROM det)
SELECT image_id, det_idx, n_detections FROM p WHERE k = 1"""

QUALITY_METRICS = """blur_score face_width face_height face_area_ratio brightness_score contrast_score
detection_confidence alignment_quality pose_quality overall_quality""".split()

SQL["quality_distributions"] = (
    f"WITH {DETECTIONS}, {PRIMARY}, "
    + "long AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM prim" for m in QUALITY_METRICS)
    + ") SELECT metric, "
    + SUMMARY_COLS.format(v="v")
    + " FROM long GROUP BY metric"
)

PAIR_MIN = f"""
qp AS (SELECT l_orderkey AS key1, l_partkey AS key2, CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS is_same,
              round(CAST(0.64 AS DOUBLE) * CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END
               + ((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 1000 - 500) / CAST(1000.0 AS DOUBLE), 4)
               AS raw_score FROM lineitem),
pm AS (SELECT is_same, raw_score, least(a.blur_score, b.blur_score) AS min_blur,
              least(a.brightness_score, b.brightness_score) AS min_brightness,
              least(a.contrast_score, b.contrast_score) AS min_contrast,
              least(a.confidence, b.confidence) AS min_confidence,
              least(a.alignment_quality, b.alignment_quality) AS min_alignment,
              least(a.pose_quality, b.pose_quality) AS min_pose,
              least(a.overall_quality, b.overall_quality) AS min_overall_quality
       FROM qp JOIN prim a ON a.image_id = key1 JOIN prim b ON b.image_id = key2)"""

MINIMA = "min_blur min_brightness min_contrast min_confidence min_alignment min_pose min_overall_quality".split()

SQL["quality_pair_minima"] = (
    f"WITH {DETECTIONS}, {PRIMARY}, {PAIR_MIN} SELECT is_same, count(*) AS n, "
    + ", ".join(f"round(avg({m}), 4) AS {m}" for m in MINIMA)
    + " FROM pm GROUP BY is_same"
)

SQL["quality_correlation"] = f"WITH {DETECTIONS}, {PRIMARY}, {PAIR_MIN} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, pyround(corr({m}, raw_score), 4) AS correlation FROM pm WHERE is_same = 1"
    for m in MINIMA
    if m != "min_pose"
)

SQL["quality_trend"] = f"""
WITH {DETECTIONS}, {PRIMARY}, {PAIR_MIN}
SELECT count(*) AS n, round(regr_slope(raw_score, min_overall_quality), 5) AS slope,
       round(regr_intercept(raw_score, min_overall_quality), 5) AS intercept FROM pm WHERE is_same = 1"""

SQL["quality_mode_comparison"] = f"""
WITH {DETECTIONS}, {PRIMARY}, {PAIR_MIN},
f AS (SELECT image_id, 'baseline' AS mode, true AS good FROM prim """ + " ".join(
    f"UNION ALL SELECT image_id, '{m}', {reasons(m)} = '' FROM prim" for m in LIMITS
) + """),
c AS (SELECT a.mode, count(*) AS total, count(*) FILTER (WHERE a.good AND b.good) AS n,
        count(*) FILTER (WHERE a.good AND b.good AND raw_score >= 0.24 AND is_same = 1) AS tp,
        count(*) FILTER (WHERE a.good AND b.good AND raw_score >= 0.24 AND is_same = 0) AS fp,
        count(*) FILTER (WHERE a.good AND b.good AND raw_score < 0.24 AND is_same = 0) AS tn,
        count(*) FILTER (WHERE a.good AND b.good AND raw_score < 0.24 AND is_same = 1) AS fn
      FROM qp JOIN f a ON a.image_id = key1 JOIN f b ON b.image_id = key2 AND b.mode = a.mode GROUP BY a.mode)
SELECT mode, n AS total_pairs_evaluated, total - n AS rejected_pairs,
       pyround(CAST(total - n AS DOUBLE) / total, 4) AS rejection_rate,
       pyround(coalesce(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 0.0), 4) AS accuracy,
       pyround(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0.0), 6) AS far,
       pyround(coalesce(CAST(fn AS DOUBLE) / nullif(fn + tp, 0), 0.0), 6) AS frr,
       pyround(coalesce(CAST(tp AS DOUBLE) / nullif(fn + tp, 0), 0.0), 4) AS genuine_acceptance_rate,
       pyround(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0.0), 6) AS impostor_acceptance_rate FROM c"""

SQL["detection_audit"] = f"""
WITH {DETECTIONS}, n AS (SELECT image_id, count(*) AS n, bool_or(marks) AS al FROM det GROUP BY image_id),
i AS (SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(al, false) AS al FROM orders LEFT JOIN n ON image_id = o_orderkey)
SELECT count(*) AS images_checked, count(*) FILTER (WHERE n = 0) AS zero_detected, count(*) FILTER (WHERE n = 1) AS single_detected,
       count(*) FILTER (WHERE n > 1) AS multiple_detected,
       pyround(CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE) / count(*), 4) AS detection_rate,
       pyround(CAST(count(*) FILTER (WHERE al) AS DOUBLE) / count(*), 4) AS alignment_rate FROM i"""

# The lenient gate scores sharpness from 20, so its overall quality differs from ``det``.
LENIENT_OVERALL = """(overall_quality - 0.30 * least(1, greatest(0, (blur_score - 40) / 210.0))
   + 0.30 * least(1, greatest(0, (blur_score - 20) / 230.0)))"""

RECOGNISED = f"""
{DETECTIONS}, {PRIMARY},
st AS (SELECT o_orderkey AS image_id, o_custkey % 37 <> 0 AS valid, n_detections, marks, {LENIENT_OVERALL} AS oq,
              replace({reasons('lenient')}, ',', ', ') AS why, pk
       FROM orders LEFT JOIN prim ON image_id = o_orderkey),
blk AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_image' WHEN pk IS NULL THEN 'no_face_detected'
               WHEN n_detections > 1 THEN 'multiple_faces_rejected' WHEN why <> '' THEN 'quality_rejected: ' || why
               WHEN NOT marks THEN 'missing_landmarks' END AS reason FROM st),
{ROLES.replace('qry AS', 'qry_unused AS')},
qry AS (SELECT image_id AS query_id, '' AS true_identity,
               list_transform(e.embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS e
        FROM blk JOIN embeddings e ON e.vec_id = image_id % (SELECT count(*) + count(*) // 25 + 1 FROM embeddings) WHERE reason IS NULL),
{BEST.format(templates='tpl')},
outcome AS (
  SELECT image_id, res.identity, coalesce(best_candidate, 'Unknown') AS best_candidate, coalesce(score, -1.0) AS similarity,
         CAST(0.24 AS DOUBLE) AS threshold, coalesce(recognized, false) AS recognized,
         CASE WHEN reason IS NULL OR reason LIKE 'quality%' OR reason = 'missing_landmarks' THEN oq END AS overall_quality,
         coalesce(reason, CASE WHEN recognized THEN 'accepted' ELSE 'below_threshold' END) AS reason
  FROM blk LEFT JOIN res ON query_id = image_id)"""

SQL["recognition_outcomes"] = f"""
WITH {RECOGNISED} SELECT * REPLACE (round(similarity, 5) AS similarity, round(overall_quality, 5) AS overall_quality) FROM outcome"""

SQL["recognition_tally"] = f"""
WITH {RECOGNISED} SELECT split_part(reason, ':', 1) AS outcome, count(*) AS images FROM outcome GROUP BY 1"""

ENROLLED = f"""
{DETECTIONS},
fst AS (SELECT * FROM det WHERE det_idx = 0),
req AS (SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 29 <> 0 THEN 'C' || (o_custkey % 50) END AS identity,
               o_orderkey AS image_id, o_custkey % 37 <> 0 AS valid FROM orders),
en0 AS (SELECT req.*, {LENIENT_OVERALL} AS oq, {reasons('lenient')} AS why, det_idx, marks,
               req.image_id % 23 <> 0 AS aligned, e.vec_id IS NOT NULL AS vec
        FROM req LEFT JOIN fst ON fst.image_id = req.image_id LEFT JOIN embeddings e ON e.vec_id = req.image_id % (SELECT count(*) + count(*) // 25 + 1 FROM embeddings)),
en1 AS (SELECT *, CASE WHEN identity IS NULL THEN 'invalid_identity' WHEN NOT valid THEN 'invalid_image'
               WHEN det_idx IS NULL THEN 'no_face_detected' WHEN why <> '' THEN 'quality_rejected'
               WHEN NOT marks THEN 'missing_landmarks' WHEN NOT aligned THEN 'alignment_failed'
               WHEN NOT vec THEN 'embedding_failed' END AS error_code FROM en0)"""

SQL["enrollment_outcomes"] = f"""
WITH {ENROLLED} SELECT request_id, identity, image_id, error_code IS NULL AS success, error_code,
  CASE WHEN error_code IS NULL OR error_code = 'quality_rejected' THEN round(oq, 5) END AS quality_score,
  CASE WHEN error_code IS NULL THEN 'accepted' WHEN error_code = 'quality_rejected' THEN 'rejected' END AS quality_status,
  CASE WHEN error_code = 'quality_rejected' THEN 'Enrollment image rejected by Face Quality Assessment: '
       || replace(why, ',', ', ') || '.' END AS message FROM en1"""

SQL["enrollment_tally"] = f"""
WITH {ENROLLED} SELECT coalesce(error_code, 'enrolled') AS outcome, count(*) AS requests FROM en1 GROUP BY 1"""

SQL["enrolled_gallery"] = f"""
WITH {ENROLLED}, a AS (SELECT identity, count(*) AS n FROM en1 WHERE error_code IS NULL GROUP BY identity),
k AS (SELECT 'id_' || label AS identity, (count(*) + 1) // 2 AS n FROM embeddings GROUP BY label)
SELECT coalesce(a.identity, k.identity) AS identity, CAST(coalesce(a.n, 0) + coalesce(k.n, 0) AS BIGINT) AS template_count,
       CASE WHEN k.identity IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
       CASE WHEN a.identity IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS updated_at,
       CASE WHEN a.identity IS NULL THEN 'seed' END AS notes
FROM a FULL JOIN k ON a.identity = k.identity"""

SQL["extraction_tally"] = f"""
WITH {DETECTIONS}, p AS (SELECT image_id, count(*) AS n FROM det GROUP BY image_id),
i AS (SELECT o_custkey % 37 <> 0 AS valid, coalesce(n, 0) AS n, vec_id IS NOT NULL AND n IS NOT NULL AS vec
      FROM orders LEFT JOIN p ON image_id = o_orderkey LEFT JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) + count(*) // 25 + 1 FROM embeddings))
SELECT count(*) AS scanned, count(*) FILTER (WHERE valid AND vec) AS extracted, count(*) FILTER (WHERE valid AND n = 0) AS no_face,
       count(*) FILTER (WHERE valid AND n > 1) AS multiple_faces, count(*) FILTER (WHERE NOT valid) AS invalid FROM i"""

# Temporal smoothing and presence: the state machines step through the frames recursively

OBS = """
scale AS (SELECT CAST(1800 AS BIGINT) AS s),
ob0 AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS frame_index,
               epoch_us(ts) AS us, user_id % 10 AS u, user_id // 10 % 3 AS alt, epoch_us(ts) // 43200000000 % 3 AS base FROM events),
ob AS (SELECT stream_id, frame_index, us, 'P' || CASE WHEN u = 0 THEN alt ELSE base END AS cand, u <> 1 AS rec, u = 2 AS poor,
              'P' || base AS truth, CASE WHEN u <> 1 THEN 'P' || CASE WHEN u = 0 THEN alt ELSE base END END AS seen FROM ob0),
gp AS (SELECT *, coalesce(us - lag(us) OVER w > 2000000 * (SELECT s FROM scale), false) AS gap
       FROM ob WINDOW w AS (PARTITION BY stream_id ORDER BY frame_index)),
sg AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_index) AS seg FROM gp)"""

EVIDENCE = """
win AS (SELECT a.stream_id, a.frame_index, b.seen AS bs, b.poor AS bp, b.frame_index AS bf
        FROM sg a JOIN sg b ON a.stream_id = b.stream_id AND a.seg = b.seg
         AND b.frame_index BETWEEN a.frame_index - 6 AND a.frame_index),
wt AS (SELECT stream_id, frame_index, bs, count(*) AS n, min(bf) AS ff FROM win WHERE NOT bp AND bs IS NOT NULL GROUP BY ALL),
ld AS (SELECT stream_id, frame_index, arg_min(bs, -n * 1000000 + ff) AS leader, max(n) AS lw FROM wt GROUP BY ALL),
tot AS (SELECT stream_id, frame_index, count(*) AS wc, count(*) FILTER (WHERE NOT bp) AS tw,
               count(*) FILTER (WHERE NOT bp AND bs IS NULL) AS uw FROM win GROUP BY ALL),
ev AS (SELECT sg.stream_id, sg.frame_index, sg.us, gap, seg, seen, rec, cand, truth, coalesce(leader, cand) AS leader,
              coalesce(lw, 0) AS lw, tw, uw, wc, CASE WHEN tw > 0 THEN coalesce(lw, 0) / CAST(tw AS DOUBLE) ELSE 0.0 END AS ratio
       FROM sg JOIN tot USING (stream_id, frame_index) LEFT JOIN ld USING (stream_id, frame_index))"""

HOLDER = """
nx AS (SELECT *, lw >= 4 AND ratio >= CAST(0.70 AS DOUBLE) AS firm FROM ev),
st(stream_id, frame_index, stable, state, cnt, unk, chal, chn) AS (
  SELECT stream_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 'unstable', CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM (SELECT DISTINCT stream_id FROM ev)
  UNION ALL
  SELECT stream_id, frame_index,
    CASE WHEN p IS NULL THEN CASE WHEN firm THEN leader END
         WHEN seen IS NULL THEN CASE WHEN unk + 1 <= 3 THEN p END
         WHEN seen = p THEN p WHEN nch >= 3 THEN seen ELSE p END,
    CASE WHEN p IS NULL THEN CASE WHEN firm THEN 'stable' WHEN uw >= 4 THEN 'unknown' ELSE 'unstable' END
         WHEN seen IS NULL THEN CASE WHEN unk + 1 <= 3 THEN 'stable' ELSE 'unknown' END
         WHEN seen = p OR nch >= 3 THEN 'stable' ELSE 'switching' END,
    CASE WHEN p IS NULL THEN CASE WHEN firm THEN lw ELSE cnt END
         WHEN seen IS NULL THEN CASE WHEN unk + 1 <= 3 THEN cnt ELSE 0 END
         WHEN seen = p THEN cnt + 1 WHEN nch >= 3 THEN nch ELSE cnt END,
    CASE WHEN p IS NULL THEN CASE WHEN firm THEN 0 ELSE unk END WHEN seen IS NULL THEN unk + 1 ELSE 0 END,
    CASE WHEN p IS NULL THEN CASE WHEN NOT firm THEN chal END WHEN seen IS NULL THEN chal
         WHEN seen = p OR nch >= 3 THEN NULL ELSE seen END,
    CASE WHEN p IS NULL THEN CASE WHEN firm THEN 0 ELSE chn END WHEN seen IS NULL THEN chn
         WHEN seen = p OR nch >= 3 THEN 0 ELSE nch END
  FROM (SELECT n.*, CASE WHEN gap THEN NULL ELSE s.stable END AS p, CASE WHEN gap THEN 0 ELSE s.cnt END AS cnt,
               CASE WHEN gap THEN 0 ELSE s.unk END AS unk, CASE WHEN gap THEN NULL ELSE s.chal END AS chal,
               CASE WHEN gap THEN 0 ELSE s.chn END AS chn,
               CASE WHEN NOT gap AND s.chal = n.seen THEN s.chn + 1 ELSE 1 END AS nch
        FROM st s JOIN nx n ON n.stream_id = s.stream_id AND n.frame_index = s.frame_index + 1)),
res_t AS (SELECT ev.*, stable, state, cnt, unk, chal, chn FROM st JOIN ev USING (stream_id, frame_index))"""

SQL["gap_segments"] = f"WITH {OBS} SELECT stream_id, frame_index, CAST(seg AS BIGINT) AS gap_segment FROM sg"

SQL["window_consensus"] = f"""
WITH {OBS}, {EVIDENCE} SELECT stream_id, frame_index, leader, lw AS leader_weight, tw AS total_weight, uw AS unknown_weight,
  wc AS window_count, round(ratio, 6) AS consensus_ratio FROM ev"""

SMOOTH = f"WITH RECURSIVE {OBS}, {EVIDENCE}, {HOLDER}"

SQL["stable_identity"] = f"""
{SMOOTH} SELECT stream_id, frame_index, stable AS stable_identity, state,
  round(CASE WHEN stable IS NOT NULL THEN ratio ELSE 0.0 END, 6) AS confidence_score, wc AS observations_count,
  cnt AS consecutive_stable_count, leader AS active_candidate, chal AS challenger_identity, chn AS challenger_evidence,
  state = 'stable' AS is_stable FROM res_t"""

SQL["stabiliser_pass_through"] = f"""
WITH {OBS} SELECT stream_id, frame_index, seen AS stable_identity, CASE WHEN seen IS NOT NULL THEN 'stable' ELSE 'unknown' END AS state,
  CASE WHEN rec THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS confidence_score, 1 AS observations_count,
  CAST(seen IS NOT NULL AS BIGINT) AS consecutive_stable_count, cand AS active_candidate,
  CAST(NULL AS VARCHAR) AS challenger_identity, 0 AS challenger_evidence, seen IS NOT NULL AS is_stable FROM ob"""

SQL["stabiliser_state"] = f"""
{SMOOTH}, l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_index DESC) AS k FROM res_t)
SELECT stream_id, stable AS current_stable_identity, cnt AS consecutive_stable_count, unk AS consecutive_unknown_count,
       chal AS challenger_identity, chn AS challenger_count, wc AS window_size FROM l WHERE k = 1"""

SQL["first_stable_frames"] = f"""
{SMOOTH} SELECT stream_id, min(frame_index) FILTER (WHERE state = 'stable') AS first_stable_frame FROM res_t GROUP BY stream_id"""

SQL["entry_counts"] = f"""
{SMOOTH}, s AS (SELECT stream_id, frame_index, stable AS identity, us FROM res_t WHERE state = 'stable')
SELECT stream_id, frame_index, identity, count(*) OVER (PARTITION BY stream_id, identity ORDER BY us
  RANGE BETWEEN 18000000000 PRECEDING AND CURRENT ROW) AS entries_in_window FROM s""".replace(
    "18000000000", "5000000 * (SELECT CAST(s AS BIGINT) FROM scale)"
)

SQL["latest_events"] = f"""
WITH {OBS}, l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_index DESC) AS k FROM ob)
SELECT stream_id, frame_index, cand AS best_candidate FROM l WHERE k <= 100"""


def smoothing(mode: str) -> str:
    """The smoothing CTEs of a mode, with names ending in the mode (``res_t_fast``)."""
    window, enough, share, unknowns, challenges, gap = {
        "fast": (4, 3, 0.65, 2, 2, 2000000),
        "balanced": (7, 4, 0.70, 3, 3, 2000000),
        "stable": (10, 6, 0.80, 4, 5, 2500000),
    }[mode]
    text = OBS[OBS.index("gp AS") :] + ", " + EVIDENCE + ", " + HOLDER
    for old, new in (
        ("2000000 *", f"{gap} *"),
        ("frame_index - 6", f"frame_index - {window - 1}"),
        ("lw >= 4", f"lw >= {enough}"),
        ("uw >= 4", f"uw >= {enough}"),
        ("0.70 AS", f"{share} AS"),
        ("unk + 1 <= 3", f"unk + 1 <= {unknowns}"),
        ("nch >= 3", f"nch >= {challenges}"),
    ):
        text = text.replace(old, new)
    return re.sub(r"\b(gp|sg|win|wt|ld|tot|ev|nx|st|res_t)\b(?= AS|\(|\.|,? USING| JOIN| n\b| s\b| a\b| b\b|\)| WHERE| WINDOW| GROUP|$|\n)", rf"\1_{mode}", text)


def presence_ctes(entries: int, window: float, grace: float, frames: str = "res_t", suffix: str = "") -> str:
    """CTE ``pe`` with presence events from smoothed frames, one recursion per (stream, identity)."""
    return f"""
lim{suffix} AS (SELECT CAST({window} * 1000000 * s AS BIGINT) AS win, CAST({grace} * 1000000 * s AS BIGINT) AS grace,
                CAST(60000000000 AS BIGINT) AS longest FROM scale),
fs{suffix} AS (SELECT stream_id, stable AS x, min(frame_index) AS f0 FROM {frames} WHERE state = 'stable' GROUP BY ALL),
pf{suffix} AS (SELECT r.stream_id, x, f0, frame_index, us, coalesce(state = 'stable' AND stable = x, false) AS here
               FROM {frames} r JOIN fs{suffix} f ON f.stream_id = r.stream_id AND frame_index >= f0),
pt{suffix}(stream_id, x, frame_index, ps, entries, lost, started, seen, intr, ev, prev, us) AS (
  SELECT stream_id, x, f0 - 1, 'NOT_PRESENT', CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM fs{suffix}
  UNION ALL
  SELECT stream_id, x, frame_index,
    CASE WHEN over THEN 'ABSENT' WHEN idle THEN CASE WHEN here THEN 'CANDIDATE' ELSE ps END
         WHEN ps = 'CANDIDATE' THEN CASE WHEN conf THEN 'PRESENT' WHEN expired THEN 'NOT_PRESENT' ELSE ps END
         WHEN here THEN 'PRESENT' WHEN ps = 'PRESENT' THEN 'GRACE' WHEN gone THEN 'ABSENT' ELSE ps END,
    CASE WHEN idle AND here THEN [us] WHEN conf OR expired THEN CAST([] AS BIGINT[])
         WHEN ps = 'CANDIDATE' AND here THEN ne ELSE entries END,
    CASE WHEN ps = 'PRESENT' AND NOT here THEN us ELSE lost END,
    CASE WHEN conf THEN us ELSE started END,
    CASE WHEN conf THEN len(ne) WHEN ps IN ('PRESENT', 'GRACE') AND here AND NOT over THEN seen + 1 ELSE seen END,
    CASE WHEN conf THEN 0 WHEN ps = 'GRACE' AND here AND NOT over THEN intr + 1 ELSE intr END,
    CASE WHEN over OR gone THEN 'SESSION_ENDED' WHEN (idle AND here) OR expired THEN 'STATE_CHANGED'
         WHEN conf THEN 'ENTRY_CONFIRMED' WHEN ps = 'PRESENT' THEN CASE WHEN here THEN 'PRESENCE_UPDATED' ELSE 'GRACE_STARTED' END
         WHEN ps = 'GRACE' AND here THEN 'PRESENCE_RESUMED' END,
    ps, us
  FROM (SELECT *, ps = 'CANDIDATE' AND here AND len(ne) >= {entries} AS conf,
               ps = 'CANDIDATE' AND NOT here AND us - entries[1] > win AS expired,
               ps = 'GRACE' AND NOT here AND NOT over AND us - lost >= grace AS gone
        FROM (SELECT p.stream_id, p.x, n.frame_index, p.ps, p.entries, p.lost, p.started, p.seen, p.intr, n.us, n.here, win, grace,
                     p.ps IN ('NOT_PRESENT', 'ABSENT') AS idle,
                     p.ps IN ('PRESENT', 'GRACE') AND n.us - p.started >= longest AS over,
                     list_append(list_filter(p.entries, lambda t: t >= n.us - win), n.us) AS ne
              FROM pt{suffix} p JOIN pf{suffix} n ON n.stream_id = p.stream_id AND n.x = p.x AND n.frame_index = p.frame_index + 1,
                   lim{suffix}))),
pe{suffix} AS (SELECT *, CASE WHEN ev <> 'STATE_CHANGED'
                 THEN sha256(stream_id || '#' || x || '#' || started) END AS session_id,
               row_number() OVER (PARTITION BY stream_id, x ORDER BY frame_index DESC) AS back
               FROM pt{suffix} WHERE ev IS NOT NULL)"""


PRESENCE = f"{SMOOTH}, {presence_ctes(3, 5, 10)}"

SQL["presence_events"] = f"""
{PRESENCE} SELECT stream_id, frame_index, x AS identity, ev AS event_type, prev AS previous_state, ps AS new_state, session_id,
  CASE WHEN ev <> 'STATE_CHANGED' THEN seen END AS observation_count,
  CASE WHEN ev <> 'STATE_CHANGED' THEN intr END AS interruption_count FROM pe"""

SQL["presence_sessions"] = f"""
{PRESENCE} SELECT session_id, stream_id, x AS identity, started AS started_at, us AS ended_at, 'ABSENT' AS state,
  round((us - started) / CAST(1000000 AS DOUBLE), 3) AS duration_seconds, seen AS observation_count, intr AS interruption_count
  FROM pe WHERE ev = 'SESSION_ENDED'"""

OPEN = """
op AS (SELECT session_id, stream_id, x AS identity, started AS started_at, ps AS state,
  round((us - started) / CAST(1000000 AS DOUBLE), 3) AS duration_seconds, seen AS observation_count, intr AS interruption_count,
  us AS state_since FROM pe WHERE back = 1 AND ps IN ('PRESENT', 'GRACE'))"""

SQL["active_sessions"] = f"{PRESENCE}, {OPEN} SELECT * FROM op"

SQL["stopped_sessions"] = f"""
{PRESENCE}, {OPEN} SELECT session_id, identity, 'ABSENT' AS state, 'session closed due to runtime_shutdown' AS reason FROM op"""

SQL["grace_sweep"] = f"""
{PRESENCE}, {OPEN} SELECT session_id, identity, 'ABSENT' AS state FROM op, lim
WHERE state = 'GRACE' AND (SELECT max(us) FROM pe) + 172800000000 - state_since >= lim.grace"""

SQL["session_counts"] = f"""
{PRESENCE}, {OPEN} SELECT (SELECT count(*) FROM op) AS active_sessions,
  (SELECT count(*) FROM pe WHERE ev = 'SESSION_ENDED') AS archived_sessions"""

SQL["identity_states"] = f"""
{PRESENCE}, l AS (SELECT stream_id, x, ps, session_id, row_number() OVER (PARTITION BY stream_id, x ORDER BY us DESC, frame_index DESC) AS k FROM pe)
SELECT stream_id, 'P' || n_nationkey AS identity, coalesce(ps, 'NOT_PRESENT') AS state,
       CASE WHEN ps IN ('PRESENT', 'GRACE') THEN session_id END AS active_session_id
FROM nation LEFT JOIN l ON l.x = 'P' || n_nationkey AND k = 1"""

MODES = ("fast", "balanced", "stable")

SQL["policy_temporal_eval"] = (
    f"WITH RECURSIVE {OBS[: OBS.index('gp AS')].rstrip().rstrip(',')}, "
    + ", ".join(smoothing(m) for m in MODES)
    + ", runs AS (SELECT 'none' AS mode, stream_id, frame_index, seen, truth, rec, seen AS stable, seen IS NOT NULL AS firm FROM ob "
    + " ".join(
        f"UNION ALL SELECT '{m}', stream_id, frame_index, seen, truth, rec, stable, state = 'stable' FROM res_t_{m}" for m in MODES
    )
    + """),
pers AS (SELECT mode, stream_id, count(*) AS n, count(*) FILTER (WHERE stable IS NOT DISTINCT FROM truth) AS ok,
           min(frame_index) FILTER (WHERE firm) AS first, count(*) FILTER (WHERE NOT rec) AS dr,
           count(*) FILTER (WHERE NOT rec AND stable IS NOT DISTINCT FROM truth) AS rc,
           count(*) FILTER (WHERE rec AND seen <> truth) AS bl,
           count(*) FILTER (WHERE rec AND seen <> truth AND stable <> truth) AS sw FROM runs GROUP BY ALL)
SELECT mode, pyround(CAST(sum(ok) AS DOUBLE) / sum(n), 4) AS accuracy,
       pyround(coalesce(avg(first), 0.0), 2) AS mean_stabilization_latency,
       pyround(CAST(sum(rc) AS DOUBLE) / sum(dr), 4) AS transient_recovery_rate,
       pyround(CAST(sum(sw) AS DOUBLE) / sum(bl), 4) AS false_switch_rate, CAST(sum(n) AS BIGINT) AS total_frames_evaluated
FROM pers GROUP BY mode"""
)

PRESENCE_MODES = {"fast": (2, 3, 5), "balanced": (3, 5, 10), "strict": (5, 8, 20)}

SQL["policy_presence_eval"] = (
    f"{SMOOTH}, "
    + ", ".join(presence_ctes(*v, suffix=f"_{m}") for m, v in PRESENCE_MODES.items())
    + ", pa AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS mode, stream_id, x, ev, pe_{m}.us, truth <> x AS wrong FROM pe_{m} JOIN ob USING (stream_id, frame_index)" for m in PRESENCE_MODES
    )
    + """),
seen0 AS (SELECT stream_id, stable AS x, min(us) AS us0 FROM res_t WHERE state = 'stable' GROUP BY ALL),
pers AS (SELECT m.mode, s.stream_id, s.x, min(pa.us - us0) FILTER (WHERE ev = 'ENTRY_CONFIRMED') / CAST(1000000 AS DOUBLE) AS delay,
           count(*) FILTER (WHERE ev = 'ENTRY_CONFIRMED') AS en, count(*) FILTER (WHERE ev = 'GRACE_STARTED') AS gr,
           count(*) FILTER (WHERE ev = 'PRESENCE_RESUMED') AS re, count(*) FILTER (WHERE ev = 'SESSION_ENDED') AS ed,
           count(*) FILTER (WHERE ev = 'ENTRY_CONFIRMED' AND wrong) AS fe
         FROM seen0 s CROSS JOIN (VALUES ('fast'), ('balanced'), ('strict')) m(mode)
         LEFT JOIN pa ON pa.mode = m.mode AND pa.stream_id = s.stream_id AND pa.x = s.x GROUP BY ALL)
SELECT mode, pyround(coalesce(avg(delay), 0.0), 2) AS mean_entry_delay_seconds,
       pyround(CASE WHEN sum(gr) > 0 THEN CAST(sum(re) AS DOUBLE) / sum(gr) ELSE 0.0 END, 4) AS interruption_recovery_rate,
       pyround(1.0 - CAST(count(*) FILTER (WHERE en > 1) AS DOUBLE) / count(*), 4) AS session_continuity_rate,
       pyround(CAST(count(*) FILTER (WHERE en > 1) AS DOUBLE) / count(*), 4) AS duplicate_session_rate,
       pyround(CAST(count(*) FILTER (WHERE fe > 0) AS DOUBLE) / count(*), 4) AS false_entry_rate,
       CAST(sum(en) AS BIGINT) AS sessions, CAST(sum(ed) AS BIGINT) AS ended_sessions, count(*) AS identities_evaluated
FROM pers GROUP BY mode"""
)

# Attendance

LOG = """
pl AS (SELECT event_id AS f, epoch_us(ts) AS us, CASE WHEN user_id % 40 = 0 THEN 'Unknown' ELSE 'U' || (user_id % 40) END AS identity,
              CASE event_type WHEN 'view' THEN 'ENTRY_CONFIRMED' WHEN 'click' THEN 'SESSION_ENDED'
                WHEN 'signup' THEN 'PRESENCE_RESUMED' WHEN 'purchase' THEN 'PRESENCE_UPDATED' ELSE 'GRACE_STARTED' END AS kind,
              CASE WHEN event_id % 13 <> 0 THEN 'S' || (user_id % 40) || '-' || (epoch_us(ts) // 21600000000) END AS session_id,
              'because ' || event_type AS reason, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events)"""


def span_ctes(source: str, present: int) -> str:
    """CTE ``rec`` with event-based attendance from ``source`` (f, us, identity, kind, session_id, reason, date)."""
    open_status = "'IN_PROGRESS'" if present else "'PRESENT'"
    return f"""
rl AS (SELECT * FROM {source} WHERE identity <> 'Unknown' AND kind IN ('ENTRY_CONFIRMED', 'SESSION_ENDED', 'PRESENCE_RESUMED')
       QUALIFY kind <> 'SESSION_ENDED' OR session_id IS NULL
         OR row_number() OVER (PARTITION BY session_id, kind ORDER BY us, f) = 1),
mn AS (SELECT *, row_number() OVER (PARTITION BY identity, date ORDER BY us, f) AS a,
              row_number() OVER (PARTITION BY identity, date ORDER BY us DESC, f DESC) AS z FROM rl WHERE kind <> 'PRESENCE_RESUMED'),
dy AS (SELECT identity, date, min(us) AS first_us, max(us) FILTER (WHERE kind = 'SESSION_ENDED') AS out_us,
              count(DISTINCT session_id) FILTER (WHERE kind = 'ENTRY_CONFIRMED') AS en,
              max(CASE WHEN a = 1 AND (kind <> 'ENTRY_CONFIRMED' OR session_id IS NULL) THEN 1 ELSE 0 END) AS extra,
              max(CASE WHEN z = 1 THEN kind END) AS last_kind, max(us) AS last_us, max(CASE WHEN z = 1 THEN f END) AS last_f
       FROM mn GROUP BY ALL),
rs AS (SELECT r.identity, r.date, max(r.us) AS re_us FROM rl r JOIN dy USING (identity, date)
       WHERE r.kind = 'PRESENCE_RESUMED' AND (r.us, r.f) > (last_us, last_f) GROUP BY ALL),
b AS (SELECT dy.*, re_us, coalesce((out_us - first_us) / CAST(1000000 AS DOUBLE), 0.0) AS dwell,
             CASE WHEN last_kind = 'ENTRY_CONFIRMED' THEN {open_status}
                  WHEN coalesce((out_us - first_us) / CAST(1000000 AS DOUBLE), 0.0) >= {present} THEN 'PRESENT' ELSE 'PARTIAL' END AS base
      FROM dy LEFT JOIN rs USING (identity, date)),
rec AS (SELECT sha256(identity || '#' || date) AS record_id, identity, date, first_us AS first_check_in, out_us AS last_check_out,
               round(dwell, 3) AS total_dwell_seconds, en + extra AS session_count,
               CASE WHEN re_us IS NOT NULL AND base <> 'PRESENT' THEN 'IN_PROGRESS' ELSE base END AS status,
               CAST(1.0 AS DOUBLE) AS last_confidence_score, first_us AS created_at,
               CASE WHEN re_us IS NOT NULL AND base <> 'PRESENT' THEN re_us ELSE last_us END AS updated_at FROM b)"""


SQL["attendance_span"] = f"WITH {LOG}, {span_ctes('pl', 1800)} SELECT * FROM rec"

SQL["attendance_from_presence"] = f"""
{PRESENCE}, pl AS (SELECT frame_index AS f, us, x AS identity, ev AS kind, session_id, '' AS reason,
                          CAST(CAST(make_timestamp(us) AS DATE) AS VARCHAR) AS date FROM pe), {span_ctes('pl', 1800)} SELECT * FROM rec"""

SQL["attendance_daily_summary"] = f"""
WITH {LOG}, {span_ctes('pl', 1800)} SELECT date, count(*) AS total_records, count(*) FILTER (WHERE status = 'PRESENT') AS total_present,
  count(*) FILTER (WHERE status = 'IN_PROGRESS') AS total_in_progress, count(*) FILTER (WHERE status = 'PARTIAL') AS total_partial,
  round(sum(dwell), 3) AS total_dwell_seconds, round(avg(dwell), 3) AS average_dwell_seconds
FROM rec JOIN (SELECT identity, date, dwell FROM b) USING (identity, date) GROUP BY date"""

SESSIONS = """
se AS (SELECT 'S' || event_id AS session_id, event_id, 'U' || (user_id % 40) AS identity, epoch_us(ts) AS st,
              epoch_us(ts) + CAST(trunc(value * 60) AS BIGINT) * 1000000 AS en, trunc(value * 60) AS dur,
              CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events)"""


def sum_ctes(present: int) -> str:
    return f"""
rec AS (SELECT sha256(identity || '#' || date) AS record_id, identity, date, min(st) AS first_check_in, max(en) AS last_check_out,
               round(sum(dur), 3) AS total_dwell_seconds, count(*) AS session_count,
               CASE WHEN sum(dur) >= {present} THEN 'PRESENT' ELSE 'PARTIAL' END AS status,
               CAST(1.0 AS DOUBLE) AS last_confidence_score, min(st) AS created_at, max(en) AS updated_at FROM se GROUP BY identity, date)"""


SQL["attendance_sum"] = f"WITH {SESSIONS}, {sum_ctes(6000)} SELECT * FROM rec"
SQL["attendance_filter"] = f"WITH {SESSIONS}, {sum_ctes(0)} SELECT * FROM rec WHERE date = '2024-01-05'"


def later(text: str) -> str:
    """The event-attendance CTEs once more under other names, for a second version of the table."""
    return re.sub(r"\b(rl|mn|dy|rs|b|rec)\b(?= AS \(| USING| GROUP| LEFT| JOIN|\.\*| WHERE|\)|$)", r"\1_h", text).replace(
        "FROM rl r", "FROM rl_h r"
    )


SQL["attendance_upsert"] = f"""
WITH {LOG}, lo AS (SELECT * FROM pl WHERE us < 1704844800000000), hi AS (SELECT * FROM pl WHERE us >= 1704758400000000),
{span_ctes('lo', 0)}, {later(span_ctes('hi', 0))}
SELECT coalesce(n.identity, o.identity) AS identity, coalesce(n.date, o.date) AS date,
       coalesce(n.first_check_in, o.first_check_in) AS first_check_in, coalesce(n.session_count, o.session_count) AS session_count,
       coalesce(o.created_at, n.created_at) AS created_at, o.identity IS NULL AS is_new
FROM rec o FULL JOIN rec_h n ON o.identity = n.identity AND o.date = n.date"""

SQL["session_audit"] = f"""
WITH {SESSIONS} SELECT session_id, identity, date, st AS started_at, en AS ended_at, round(dur, 3) AS duration_seconds,
  event_id % 9 + 1 AS observation_count, event_id % 3 AS interruption_count, 'normal_exit' AS closure_reason FROM se"""

SQL["session_audit_span"] = f"""
WITH {LOG}, {span_ctes('pl', 0)}
SELECT coalesce(session_id, 'session_' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z') AS session_id,
  identity, date, first_us AS started_at, us AS ended_at,
  round((us - first_us) / CAST(1000000 AS DOUBLE), 3) AS duration_seconds, 1 AS observation_count, 0 AS interruption_count,
  reason AS closure_reason FROM mn JOIN dy USING (identity, date) WHERE kind = 'SESSION_ENDED'"""

SQL["session_audit_replace"] = """
SELECT CASE WHEN event_id % 9 + 1 > 5 THEN 'corrected' ELSE 'normal_exit' END AS closure_reason, count(*) AS n FROM events GROUP BY 1"""

SQL["first_session_events"] = f"""
WITH {LOG} SELECT session_id, kind AS event_type, identity, f AS frame_index FROM pl
QUALIFY session_id IS NULL OR row_number() OVER (PARTITION BY session_id, kind ORDER BY us, f) = 1"""

SQL["attendance_csv"] = f"""
WITH {SESSIONS}, {sum_ctes(0)} SELECT record_id, identity, date, printf('%.2f', total_dwell_seconds) AS total_dwell_seconds,
  CAST(session_count AS VARCHAR) AS session_count, status FROM rec"""

SQL["attendance_journal"] = f"""
WITH {LOG}, {span_ctes('pl', 1800)} SELECT identity, date, strftime(make_timestamp(first_check_in), '%Y-%m-%dT%H:%M:%S') AS check_in,
  coalesce(strftime(make_timestamp(last_check_out), '%Y-%m-%dT%H:%M:%S'), 'In Progress') AS check_out,
  printf('%.1f', (SELECT b.dwell FROM b WHERE b.identity = rec.identity AND b.date = rec.date) / 60.0) AS minutes, session_count, status FROM rec"""

SQL["identity_history"] = f"""
WITH {LOG}, {span_ctes('pl', 0)}, ppl AS (SELECT DISTINCT 'U' || (user_id % 40) AS identity FROM events)
SELECT ppl.identity, 'seed' AS notes, date, session_count FROM ppl LEFT JOIN rec ON rec.identity = ppl.identity"""

SQL["identity_reconcile"] = """
SELECT 'id_' || label AS identity, count(*) AS template_count,
       CASE WHEN label < 8 THEN 1704067200000000 ELSE 1706745600000000 END AS created_at,
       CASE WHEN label BETWEEN 5 AND 7 THEN 1704067200000000 ELSE 1706745600000000 END AS updated_at,
       CASE WHEN label < 8 THEN 'seed' ELSE 'Imported from initial gallery' END AS notes FROM embeddings GROUP BY label"""

# Dataset checks and configuration

DOCS = """
ds AS (SELECT doc_id, source || '_' || lang AS identity, CASE WHEN doc_id % 10 < 2 THEN 'enrollment' WHEN doc_id % 10 < 6 THEN 'validation'
              ELSE 'test' END AS split, sha256(text) AS file_hash, n_chars % 3 * 50 + 150 AS width FROM documents),
fl AS (SELECT file_hash, bool_or(split = 'enrollment') AS enrollment, bool_or(split = 'validation') AS validation,
              bool_or(split = 'test') AS test FROM ds GROUP BY file_hash),
ct AS (SELECT identity, count(*) AS total_images, count(*) FILTER (WHERE split = 'enrollment') AS enrollment_count,
              count(*) FILTER (WHERE split = 'validation') AS validation_count, count(*) FILTER (WHERE split = 'test') AS test_count
       FROM ds GROUP BY identity)"""

SQL["leakage_audit"] = f"""
WITH {DOCS}, n AS (SELECT count(*) FILTER (WHERE enrollment AND validation) AS a, count(*) FILTER (WHERE enrollment AND test) AS b,
  count(*) FILTER (WHERE validation AND test) AS c FROM fl)
SELECT a AS enrollment_validation, b AS enrollment_test, c AS validation_test, a + b + c AS cross_split_leakage_count FROM n"""

SQL["leaked_hashes"] = f"""
WITH {DOCS} SELECT * FROM fl WHERE enrollment::INT + validation::INT + test::INT > 1"""

SQL["split_counts"] = f"WITH {DOCS} SELECT * FROM ct"

SQL["sample_errors"] = f"""
WITH {DOCS} SELECT identity, 'fewer than 20 images' AS error FROM ct WHERE total_images < 20
UNION ALL SELECT identity, 'no enrollment images' FROM ct WHERE enrollment_count < 1
UNION ALL SELECT identity, 'no validation images' FROM ct WHERE validation_count < 1
UNION ALL SELECT identity, 'no test images' FROM ct WHERE test_count < 1"""

SQL["dataset_summary"] = f"""
WITH {DOCS} SELECT count(*) AS total_identities, CAST(sum(total_images) AS BIGINT) AS total_images,
  CAST(sum(enrollment_count) AS BIGINT) AS enrollment, CAST(sum(validation_count) AS BIGINT) AS validation,
  CAST(sum(test_count) AS BIGINT) AS test, min(total_images) AS images_per_identity_min, max(total_images) AS images_per_identity_max,
  pyround(avg(total_images), 2) AS images_per_identity_mean FROM ct"""

SQL["resolutions"] = f"WITH {DOCS} SELECT width || 'x250' AS resolution, count(*) AS images FROM ds GROUP BY 1"

SQL["policy_resolution"] = """
WITH m AS (SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'stable' ELSE 'balanced' END AS mode,
                  CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 7 END AS w FROM supplier),
p(mode, window_size, min_observations, min_stable_ratio, max_unknown_observations, challenger_switch_threshold, max_gap_seconds) AS (
  VALUES ('fast', 4, 3, CAST(0.65 AS DOUBLE), 2, 2, CAST(2.0 AS DOUBLE)), ('balanced', 7, 4, 0.70, 3, 3, 2.0), ('stable', 10, 6, 0.80, 4, 5, 2.5))
SELECT s_suppkey, mode, coalesce(w, window_size) AS window_size, min_observations, min_stable_ratio, max_unknown_observations,
       challenger_switch_threshold, max_gap_seconds FROM m JOIN p USING (mode)"""

SQL["latency_profile"] = """
WITH l AS (SELECT 'recognition_ms' AS stage, l_quantity AS ms FROM lineitem UNION ALL SELECT 'temporal_ms', l_discount * 10 FROM lineitem
           UNION ALL SELECT 'total_ms', l_quantity + l_discount * 10 FROM lineitem)
SELECT stage, round(avg(ms), 5) AS mean_ms, round(min(ms), 5) AS min_ms, round(max(ms), 5) AS max_ms,
       CASE WHEN stage = 'total_ms' THEN round(1000.0 / avg(ms), 5) END AS fps FROM l GROUP BY stage"""

SQL["timestamp_cleanup"] = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 1 THEN epoch_us(o_orderdate) - 7200000000 ELSE epoch_us(o_orderdate) END AS ts_us,
       CASE WHEN o_orderkey % 5 = 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
       'C' || o_custkey || '/C' || o_custkey || '_' || lpad(CAST(o_orderkey % 9999 AS VARCHAR), 4, '0') || '.jpg' AS path FROM orders"""

# Public projections

SQL["public_observations"] = f"""
WITH {OBS} SELECT stream_id, round(us / CAST(1000000 AS DOUBLE), 3) AS timestamp, frame_index, seen AS identity, cand AS best_candidate,
  CASE WHEN rec THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS similarity, CAST(0.24 AS DOUBLE) AS threshold, rec AS recognized,
  CASE WHEN poor THEN 'poor' ELSE 'good' END AS quality_status FROM ob"""

SQL["public_sessions"] = f"""
{PRESENCE} SELECT session_id, x AS identity, ps AS state, ps <> 'ABSENT' AS is_active,
  pyround((us - started) / CAST(1000000 AS DOUBLE), 2) AS duration_seconds, seen AS observation_count, intr AS interruption_count
FROM pe WHERE ev = 'SESSION_ENDED' OR (back = 1 AND ps IN ('PRESENT', 'GRACE'))"""

SQL["public_frames"] = f"""
{PRESENCE}, born AS (SELECT stream_id, x, min(frame_index) AS f0 FROM pt GROUP BY ALL),
l AS (SELECT pe.stream_id, frame_index, count(*) AS n,
             string_agg(ev, ',' ORDER BY CASE WHEN state = 'stable' AND stable = pe.x THEN 0 ELSE 1 END, f0) AS evs
      FROM pe JOIN born b ON b.stream_id = pe.stream_id AND b.x = pe.x
      JOIN (SELECT stream_id AS s, frame_index AS f, state, stable FROM res_t) r ON s = pe.stream_id AND f = frame_index
      GROUP BY pe.stream_id, frame_index)
SELECT r.stream_id, r.frame_index, r.cand AS best_candidate, r.state, coalesce(n, 0) AS n_events, coalesce(evs, '') AS event_types
FROM res_t r LEFT JOIN l ON l.stream_id = r.stream_id AND l.frame_index = r.frame_index"""

# The live job must give what the batch job gives.
SQL["live_presence_events"] = SQL["presence_events"]
SQL["live_attendance"] = SQL["attendance_from_presence"]

LIVE_SESSIONS = f"""
{OPEN}, cl AS (SELECT *, CASE WHEN us - started >= longest THEN 'maximum session duration safeguard reached (60000.0s)'
                             ELSE 'identity absent beyond configured grace period (18000.0s)' END AS why
               FROM pe, lim WHERE ev = 'SESSION_ENDED')"""

SQL["live_sessions"] = f"""
{PRESENCE}, {LIVE_SESSIONS}
SELECT session_id, stream_id, x AS identity, started AS started_at, us AS ended_at, 'ABSENT' AS state,
  round((us - started) / CAST(1000000 AS DOUBLE), 3) AS duration_seconds, seen AS observation_count, intr AS interruption_count,
  why AS reason, us AS as_of FROM cl
UNION ALL
SELECT session_id, stream_id, identity, started_at, NULL, state, duration_seconds, observation_count, interruption_count, NULL, state_since FROM op"""

SQL["live_audits"] = f"""
{PRESENCE}, {LIVE_SESSIONS}
SELECT session_id, x AS identity, CAST(CAST(make_timestamp(started) AS DATE) AS VARCHAR) AS date, started AS started_at, us AS ended_at,
  round((us - started) / CAST(1000000 AS DOUBLE), 3) AS duration_seconds, seen AS observation_count, intr AS interruption_count,
  why AS closure_reason FROM cl"""

SQL["live_stopped_sessions"] = f"""
{PRESENCE}, {OPEN} SELECT session_id, stream_id, identity, 'ABSENT' AS state, (SELECT max(us) FROM pe) AS ended_at,
  'session closed due to runtime_shutdown' AS reason FROM op"""


def timed_out(ctes: str) -> str:
    """The presence CTEs with graces that end on time: a frame behind that finds the identity absent."""
    state = "(CASE WHEN p.ps = 'GRACE' AND n.us - p.lost >= grace THEN 'ABSENT' ELSE p.ps END)"
    return ctes.replace("p.ps, p.entries", f"{state} AS ps, p.entries").replace("p.ps IN", f"{state} IN")


SQL["live_grace_timeout"] = f"""
{SMOOTH}, {timed_out(presence_ctes(3, 5, 10))},
ends AS (SELECT p.stream_id, p.x, p.started, p.lost + grace AS us, 'identity absent beyond configured grace period (18000.0s)' AS reason
         FROM lim, pt p LEFT JOIN pf n ON n.stream_id = p.stream_id AND n.x = p.x AND n.frame_index = p.frame_index + 1
         WHERE p.ps = 'GRACE' AND (n.us IS NULL OR n.us - p.lost >= grace)
         UNION ALL
         SELECT stream_id, x, started, us, 'maximum session duration safeguard reached (60000.0s)' FROM pe WHERE ev = 'SESSION_ENDED')
SELECT sha256(stream_id || '#' || x || '#' || started) AS session_id, stream_id, x AS identity, started AS started_at, us AS ended_at, reason FROM ends"""

# Single lookups and legacy matching

SQL["nearest_sweep_row"] = f"""
WITH {SCORED}, we AS (SELECT experiment_id, raw_score, is_same, count(*) AS w FROM scored GROUP BY ALL),
{sweep_ctes(-0.2, 0.95, 0.001, 'we', 'experiment_id')},
n AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY abs(threshold - 0.2405::DOUBLE), threshold) AS k FROM sweep)
SELECT * EXCLUDE (k) FROM n WHERE k = 1"""

SQL["legacy_detection_matches"] = f"""
WITH {DETECTIONS}, {ROLES},
q AS (SELECT image_id, det_idx, image_id % (SELECT count(*) + count(*) // 25 + 1 FROM embeddings) AS vk FROM det),
d AS (SELECT e.vec_id AS vk, t.identity, list_distance(e.embedding::DOUBLE[], t.e) AS s,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], t.e), template_id) AS k
      FROM embeddings e CROSS JOIN tpl t)
SELECT image_id, det_idx, CASE WHEN s <= 1.2 THEN identity ELSE 'Unknown' END AS identity,
       round(coalesce(s, CAST('inf' AS DOUBLE)), 5) AS score, coalesce(s <= 1.2, false) AS recognized
FROM q LEFT JOIN d ON d.vk = q.vk AND k = 1"""

SQL["file_flags"] = f"""
WITH {CLAIMS} SELECT claim, 'V/V_' || lpad(CAST(key1 AS VARCHAR), 4, '0') || '.jpg' AS image1_rel_path,
  'V/V_' || lpad(CAST(key2 AS VARCHAR), 4, '0') || '.jpg' AS image2_rel_path,
  a.key IS NOT NULL AS image1_exists, b.key IS NOT NULL AS image2_exists
FROM claims LEFT JOIN mem a ON a.key = key1 LEFT JOIN mem b ON b.key = key2"""
