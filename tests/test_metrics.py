import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmark.functions.scalars import round_half_even
from rollmark.operators import calibration as cal
from rollmark.operators import metrics as met
from rollmark.sources.writers import write_report

PAIRS = "is_same INT, raw_score DOUBLE"


def pairs(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, [float(s) for s in scores])), PAIRS)


def noisy(seed=7, n=900, places=2):
    rng = random.Random(seed)
    labels = [rng.randint(0, 1) for _ in range(n)]
    return labels, [round(0.4 * label + rng.random() * 0.8, places) for label in labels]


def roc_model(labels, scores):
    """Kept points (threshold, tp, fp), written out from the definition."""
    order = sorted(set(scores), reverse=True)
    points, tp, fp = [], 0, 0
    for s in order:
        tp += sum(1 for y, x in zip(labels, scores) if x == s and y == 1)
        fp += sum(1 for y, x in zip(labels, scores) if x == s and y == 0)
        points.append((s, tp, fp))
    kept = []
    for i, (s, tp, fp) in enumerate(points):
        if 0 < i < len(points) - 1:
            before, after = points[i - 1], points[i + 1]
            if after[1] - 2 * tp + before[1] == 0 and after[2] - 2 * fp + before[2] == 0:
                continue
        kept.append((s, tp, fp))
    return [(float("inf"), 0, 0)] + kept


@pytest.mark.parametrize("cell", [1_000_000, 7])
def test_roc_points(spark, cell):
    labels, scores = noisy()
    rows = met.roc_points(pairs(spark, labels, scores), rows_per_cell=cell).collect()
    assert sorted([(r.threshold, r.tp, r.fp) for r in rows], reverse=True) == roc_model(labels, scores)


@pytest.mark.parametrize("cell", [1_000_000, 7])
def test_auc_by_pair_counting(spark, cell):
    labels, scores = noisy()
    pos = np.array([s for y, s in zip(labels, scores) if y])
    neg = np.array([s for y, s in zip(labels, scores) if not y])
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert met.roc_auc(pairs(spark, labels, scores), rows_per_cell=cell).first().roc_auc == pytest.approx(wins)
    flipped = pairs(spark, labels, [-s for s in scores])
    assert met.roc_auc(flipped, direction=met.DISTANCE, rows_per_cell=cell).first().roc_auc == pytest.approx(wins)


def test_perfect_separation(spark):
    df = pairs(spark, [1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1, 0.05])
    assert met.roc_auc(df).first().roc_auc == 1.0
    row = met.equal_error_rate(met.roc_points(df)).first()
    assert row.eer == 0.0 and row.eer_threshold == 0.7


@pytest.mark.parametrize(
    "scores,direction", [([0.8, 0.4, 0.6, 0.2], met.SIMILARITY), ([0.2, 0.7, 0.4, 0.9], met.DISTANCE)]
)
def test_far_frr(spark, scores, direction):
    row = met.confusion_at(pairs(spark, [1, 1, 0, 0], scores), 0.5, direction).first()
    assert (row.accuracy, row.far, row.frr) == (0.5, 0.5, 0.5)


def test_unknown_direction(spark):
    with pytest.raises(ValueError):
        met.roc_points(pairs(spark, [1], [0.1]), "sideways")


def test_score_stats(spark):
    rows = {r.is_same: r for r in met.score_stats(pairs(spark, [1, 1, 0, 0], [0.8, 0.6, 0.1, 0.3])).collect()}
    assert rows[1]["mean"] == pytest.approx(0.7) and rows[0]["mean"] == pytest.approx(0.2)
    assert rows[1]["std"] == pytest.approx(0.1)


@pytest.mark.parametrize("cell", [1_000_000, 5])
def test_percentiles_match_numpy(spark, cell):
    _, scores = noisy(places=3)
    df = spark.createDataFrame([("a", s) for s in scores] + [("b", 1.0)], "g STRING, v DOUBLE")
    rows = {r.g: r for r in met.distribution_summary(df, "v", ["g"], rows_per_cell=cell).collect()}
    for name, p in met.SUMMARY_PERCENTILES.items():
        assert rows["a"][name] == pytest.approx(round(float(np.percentile(scores, p * 100)), 4), abs=1e-9)
        assert rows["b"][name] == 1.0
    assert rows["a"]["std"] == round(float(np.std(scores)), 4)


def optimal_model(labels, scores, direction, n):
    y, x = np.array(labels), np.array(scores)
    best, kept = -1.0, []
    for t in np.linspace(x.min(), x.max(), n):
        acc = float(np.mean(((x >= t) if direction == met.SIMILARITY else (x <= t)).astype(int) == y))
        if acc > best:
            best, kept = acc, [t]
        elif np.isclose(acc, best, atol=1e-7):
            kept.append(t)
    return float(np.median(kept))


@pytest.mark.parametrize("direction", [met.SIMILARITY, met.DISTANCE])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_optimal_threshold(spark, direction, seed):
    labels, scores = noisy(seed, 300)
    scores = scores if direction == met.SIMILARITY else [1.5 - s for s in scores]
    got = met.optimal_threshold(pairs(spark, labels, scores), direction, 400).first().optimal_threshold
    assert got == pytest.approx(optimal_model(labels, scores, direction, 400), abs=1e-12)


def test_optimal_threshold_of_nothing(spark):
    assert met.optimal_threshold(pairs(spark, [1], [0.1]).where("false")).first().optimal_threshold == 0.0


def test_fold_metrics_match_model_and_do_not_leak(spark):
    labels, scores = noisy(5, 600)
    folds = [i % 3 + 1 for i in range(600)]
    schema = "fold INT, is_same INT, raw_score DOUBLE"
    df = spark.createDataFrame(list(zip(folds, labels, scores)), schema)
    rows = {r.fold: r for r in met.fold_metrics(df, candidates=200).collect()}
    for k in (1, 2, 3):
        train = [(y, s) for f, y, s in zip(folds, labels, scores) if f != k]
        expected = optimal_model(*zip(*train), met.SIMILARITY, 200)
        assert rows[k].calibrated_threshold == round(expected, 4)
        assert (rows[k].test_pairs, rows[k].train_pairs) == (200, 400)
        test = [(y, s) for f, y, s in zip(folds, labels, scores) if f == k]
        hits = sum((s >= expected) == (y == 1) for y, s in test)
        assert rows[k].calibrated_accuracy == round(hits / 200, 4)
    spoiled = df.withColumn("raw_score", F.when(F.col("fold") == 1, 1.2 - F.col("raw_score")).otherwise(F.col("raw_score")))
    again = {r.fold: r for r in met.fold_metrics(spoiled, candidates=200).collect()}
    assert again[1].calibrated_threshold == rows[1].calibrated_threshold
    summary = met.fold_summary(met.fold_metrics(df, candidates=200)).first()
    assert summary.roc_auc_mean == pytest.approx(np.mean([rows[k].roc_auc for k in rows]), abs=1e-4)


def test_sweep_small(spark):
    rows = cal.threshold_sweep(pairs(spark, [1, 1, 0, 0], [0.8, 0.6, 0.4, 0.2]), 0.0, 1.0, 0.1).collect()
    assert len(rows) == 11
    at = {r.threshold: r for r in rows}[0.5]
    assert (at.tp, at.tn, at.fp, at.fn, at.f1) == (2, 2, 0, 0, 1.0)
    top = {r.threshold: r for r in rows}[1.0]
    assert (top.precision, top.recall, top.f1) == (1.0, 0.0, 0.0)


def sweep_model(labels, scores, low, high, step):
    y, x = np.array(labels), np.array(scores)
    rows = []
    for tau in np.arange(low, high + step / 2, step):
        tau = round(float(tau), 4)
        p = x >= tau
        tp, fp = int((p & (y == 1)).sum()), int((p & (y == 0)).sum())
        fn, tn = int((~p & (y == 1)).sum()), int((~p & (y == 0)).sum())
        precision = tp / (tp + fp) if tp + fp else 1.0
        recall = tp / (tp + fn)
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        rows.append(
            (tau, tp, tn, fp, fn, round((tp + tn) / len(y), 4), round(fp / (fp + tn), 6), round(fn / (tp + fn), 6))
            + (round(precision, 4), round(recall, 4), round(f1, 4), round((tp + fp) / len(y), 4))
        )
    return rows


@pytest.mark.parametrize("step,places", [(0.001, 3), (0.005, 3), (0.01, 2)])
def test_sweep_matches_model_on_grid_scores(spark, step, places):
    """Scores that sit exactly on thresholds: every bin edge must fall on the right side."""
    labels, scores = noisy(11, 500, places)
    rows = cal.threshold_sweep(pairs(spark, labels, scores), step=step).orderBy("threshold").collect()
    assert [tuple(r) for r in rows] == sweep_model(labels, scores, -0.2, 0.95, step)


def test_strategies_match_model(spark):
    labels, scores = noisy(3, 400, 3)
    rows = {r.strategy: r for r in cal.calibration_strategies(pairs(spark, labels, scores)).collect()}
    sweep = sweep_model(labels, scores, -0.2, 0.95, 0.001)
    best = [r for r in sweep if r[5] == max(s[5] for s in sweep)]
    assert rows["maximum_accuracy"].threshold == best[len(best) // 2][0]
    f1 = [r for r in sweep if r[10] == max(s[10] for s in sweep)]
    assert rows["f1_optimal"].threshold == f1[len(f1) // 2][0]
    low = sorted((r for r in sweep if r[6] <= 0.001), key=lambda r: (-r[9], -r[5], r[0]))[0]
    assert rows["security_oriented_low_far"].threshold == low[0] and rows["security_oriented_low_far"].supported
    assert rows["far_frr_balanced"].threshold == min(sweep, key=lambda r: (abs(r[6] - r[7]), r[0]))[0]
    assert rows["security_oriented_low_far"].recommended and not rows["f1_optimal"].recommended


def test_low_far_fallback(spark):
    df = pairs(spark, [1, 1, 0, 0], [0.3, 0.4, 2.0, 2.0])
    row = cal.calibration_strategies(df).where("strategy = 'security_oriented_low_far'").first()
    assert row.supported is False and row.recommended is False and row.threshold == -0.2


def test_identity_folds_are_even_and_stability_runs(spark):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(23)], "identity STRING")
    sizes = sorted(r["count"] for r in cal.identity_folds(ids, 5).groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]
    rng = random.Random(1)
    rows = []
    for _ in range(2000):
        a, b, same = rng.randrange(20), rng.randrange(20), rng.random() < 0.4
        b = a if same else (a + 1 + b % 19) % 20
        rows.append((f"p{a}", f"p{b}", int(same), round(rng.random() * 0.3 + 0.5 * same, 3)))
    df = spark.createDataFrame(rows, "identity1 STRING, identity2 STRING, is_same INT, raw_score DOUBLE")
    kinds = {r.kind: r for r in cal.threshold_stability(df).collect()}
    assert set(kinds) == {"eer_threshold", "max_accuracy_threshold", "low_far_threshold"}
    assert 0.29 <= kinds["max_accuracy_threshold"]["mean"] <= 0.5


def test_rounding_is_pythons(spark):
    rng = random.Random(5)
    values = [k / n for n in (60000, 2000, 800, 7) for k in range(0, n, max(1, n // 400))]
    values += [rng.random() for _ in range(500)] + [0.5, 1.5, 2.5, 0.03405, 0.00015, -0.00025, 1e-9, 0.0]
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    for places in (2, 4, 6):
        for r in df.select("v", round_half_even("v", places).alias("r")).collect():
            assert r.r == round(r.v, places), (r.v, places)


def test_density_histogram(spark):
    _, scores = noisy()
    df = spark.createDataFrame([(s,) for s in scores], "v DOUBLE")
    rows = met.density_histogram(df, "v", 30).orderBy("bin").collect()
    counts, edges = np.histogram(scores, bins=30)
    assert sum(r.n for r in rows) == len(scores) and len(rows) == 30
    assert sum(r.density * (r.bin_end - r.bin_start) for r in rows) == pytest.approx(1.0)
    assert sum(abs(r.n - c) for r, c in zip(rows, counts)) <= 6  # scores on an edge
    assert rows[0].bin_start == pytest.approx(edges[0])


def test_failed_pairs_are_counted_not_scored(spark):
    schema = "experiment_id STRING, fold INT, is_same INT, raw_score DOUBLE"
    df = spark.createDataFrame([("E", 1, 1, 0.9), ("E", 1, 0, 0.1), ("E", 1, 0, None)], schema)
    row = met.verification_summary(df, 0.5).first()
    assert (row.total_pairs, row.successful_pairs, row.failed_pairs, row.accuracy) == (3, 2, 1, 1.0)


def test_folds_of_many_experiments_train_apart(spark):
    """Experiments, folds and histogram groups without a name are groups like any other."""
    rows = []
    for k, name in enumerate(["a", "b", None]):
        labels, scores = noisy(k, 400)
        rows += [(name, None if i % 4 == 3 else i % 4, y, s) for i, (y, s) in enumerate(zip(labels, scores))]
    scored = spark.createDataFrame(rows, "experiment_id STRING, fold INT, is_same INT, raw_score DOUBLE")
    together = {(r.experiment_id, r.fold): r for r in met.fold_metrics(scored, group_cols=["experiment_id"]).drop("train_pairs").collect()}
    assert len(together) == 12
    for name in ("a", None):
        alone = met.fold_metrics(scored.where(F.col("experiment_id").eqNullSafe(F.lit(name)))).drop("train_pairs").collect()
        assert {tuple(r) for r in alone} == {tuple(r)[1:] for (who, _), r in together.items() if who == name}
    summary = {r.experiment_id: r for r in met.experiment_summary(scored).collect()}
    assert set(summary) == {"a", "b", None} and all(r.roc_auc_mean > 0.5 for r in summary.values())
    report = {r.experiment_id: r for r in met.verification_report(scored, 0.5).collect()}
    assert report[None].accuracy is not None and report[None].genuine_n + report[None].impostor_n == 400
    bins = met.density_histogram(scored, "raw_score", 5, ["experiment_id"]).where("experiment_id IS NULL").collect()
    assert sum(r.n for r in bins) == 400


def test_nested_report_holds_everything(spark, tmp_path):
    labels, scores = noisy(2, 400)
    rows = [(i % 3, y, s) for i, (y, s) in enumerate(zip(labels, scores))]
    scored = spark.createDataFrame(rows, "fold INT, is_same INT, raw_score DOUBLE")
    report = met.nested_report(met.class_spread(scored), met.fold_metrics(scored), cal.calibration_strategies(scored))
    write_report(report, str(tmp_path / "report"))
    (row,) = spark.read.schema(report.schema).json(str(tmp_path / "report")).collect()
    assert row.summary.genuine_n == sum(labels) and [f.fold for f in row.folds] == [0, 1, 2]
    assert {s.strategy for s in row.strategies} >= {"f1_optimal", "maximum_accuracy"}
