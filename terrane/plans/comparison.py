"""Model comparison: merged predictions, panels and thresholds by split, pairwise AUC tests."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def training_split(names: Sequence[str]) -> str | None:
    """The split that holds the training rows, by name: ``train`` first, then names that begin with or hold it."""
    plain = {n: re.sub(r"[^a-z]", "", n.lower()) for n in names}
    ranked = [(0 if p in ("train", "training") else 1 if p.startswith("train") else 2 if "train" in p else 3, n) for n, p in plain.items()]
    best = min(ranked, default=(3, ""))
    return best[1] if best[0] < 3 else None


def _long(df: DataFrame, models: Sequence[str], y: str, split: str) -> DataFrame:
    return df.select(split, y, *(F.col(m).cast("double").alias(m) for m in models)).unpivot([split, y], list(models), "model", "p")


def panels(df: DataFrame, models: Sequence[str], y: str, split: str, threshold: float = 0.5) -> DataFrame:
    """(split, model, panel, auc) of every model column at one cut; rows without a score of a model don't count for it."""
    rows = metrics.clean(_long(df, models, y, split), y, "p")
    by = (split, "model")
    return metrics.at_threshold(rows, y, "p", threshold, by).join(metrics.auc(rows, y, "p", by), list(by))


def transferred(df: DataFrame, models: Sequence[str], y: str, split: str) -> DataFrame:
    """(split, model, threshold, panel) with every model's best cut of the training split (of all rows where there is none)."""
    rows = metrics.clean(_long(df, models, y, split), y, "p")
    train = training_split([r[0] for r in rows.select(split).distinct().collect()])
    cut = metrics.youden(rows.where(F.col(split) == train) if train else rows, y, "p", ("model",)).select("model", "threshold")
    joined = rows.join(cut, "model")
    at = metrics.panel(joined, y, F.col("p") >= F.col("threshold"), (split, "model", "threshold"))
    return at


def closest_to_targets(df: DataFrame, y: str, p: str, targets: Mapping[str, float], distance: str = "euclidean") -> DataFrame:
    """(threshold, distance): the cut that misses the targets least, only shortfalls counting; ties to the higher cut."""
    curve = metrics._curve_panel(df, y, p, ())
    short = [F.greatest(F.lit(float(v)) - F.col(k), F.lit(0.0)) for k, v in targets.items()]
    total = {"euclidean": F.sqrt(sum((s * s for s in short), F.lit(0.0))), "manhattan": sum(short, F.lit(0.0)), "max": F.greatest(F.lit(0.0), *short)}[distance]
    best = F.min_by(F.struct("threshold", "d"), F.struct("d", -F.col("threshold")))
    return curve.withColumn("d", total).agg(best.alias("b")).select("b.threshold", F.col("b.d").alias("distance"))


def pairwise(df: DataFrame, models: Sequence[str], y: str, row: str) -> list[dict]:
    """Every pair of models with their AUCs, z and two-sided p, over rows that all models score."""
    out = []
    for r in metrics.delong(df.dropna(subset=list(models)), y, models, row).collect():
        if r["score_a"] != r["score_b"]:
            z, p = metrics.delong_test(r.asDict())
            out.append({"a": r["score_a"], "b": r["score_b"], "auc_a": r["auc_a"], "auc_b": r["auc_b"], "z": z, "p": p})
    return out
