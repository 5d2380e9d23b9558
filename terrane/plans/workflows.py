"""Workflows over unit tables: features, preprocessing, pooling, clustering, assignment, summaries; and a command line."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dist import knee
from ..functions.expr import compile_expression
from ..operators import cluster, prep, units
from .spec import Registry, Spec, parse_features

FEATURES = Registry("feature")


@FEATURES.add("raw")
def _raw(columns: Sequence[str], modality: str | None = None, modalities: Sequence[str] = (), as_: str | None = None) -> dict[str, Column]:
    names = [modality] if modality else list(modalities) or list(columns)
    return {as_ if as_ and len(names) == 1 else n: F.col(f"`{n}`").cast("double") for n in names}


@FEATURES.add("expression")
def _expression(columns: Sequence[str], expressions: dict[str, str] | None = None) -> dict[str, Column]:
    return {name: compile_expression(text, columns) for name, text in (expressions or {}).items()}


def _children(columns: Sequence[str], children: Sequence[dict]) -> list[dict[str, Column]]:
    return [FEATURES.build(Spec.from_dict(c), columns=columns) for c in children]


@FEATURES.add("concat")
def _concat(columns: Sequence[str], children: Sequence[dict]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for block in _children(columns, children):
        if clash := sorted(set(out) & set(block)):
            raise ValueError(f"features come twice: {clash}")
        out |= block
    return out


def _pairs(columns: Sequence[str], children: Sequence[dict], as_: str | None, sign: str) -> list[tuple[str, Column, Column]]:
    first, second = _children(columns, children)
    if len(first) != len(second):
        raise ValueError("both sides need as many features")
    named = [(as_ if as_ and len(first) == 1 else f"{a}{sign}{b}", first[a], second[b]) for a, b in zip(first, second, strict=True)]
    return named


@FEATURES.add("ratio")
def _ratio(columns: Sequence[str], children: Sequence[dict], as_: str | None = None, eps: float = units.EPS_RATIO) -> dict[str, Column]:
    return {n: F.try_divide(a, b + eps) for n, a, b in _pairs(columns, children, as_, "_over_")}


@FEATURES.add("difference")
def _difference(columns: Sequence[str], children: Sequence[dict], as_: str | None = None) -> dict[str, Column]:
    return {n: a - b for n, a, b in _pairs(columns, children, as_, "_minus_")}


def _weights(blocks: list[dict], weights: dict | None) -> list[float]:
    given = weights or {}
    return [float(next((given[k] for k in block if k in given), 1.0)) for block in blocks]


@FEATURES.add("weighted_concat")
def _weighted(columns: Sequence[str], children: Sequence[dict], weights: dict | None = None) -> dict[str, Column]:
    blocks = _children(columns, children)
    return {n: c * w for block, w in zip(blocks, _weights(blocks, weights), strict=True) for n, c in block.items()}


@FEATURES.add("average")
def _average(columns: Sequence[str], children: Sequence[dict], weights: dict | None = None, as_: str = "average") -> dict[str, Column]:
    blocks = _children(columns, children)
    w = _weights(blocks, weights)
    if sum(w) == 0:
        raise ValueError("weights add up to zero")
    parts = [next(iter(block.values())) * (x / sum(w)) for block, x in zip(blocks, w, strict=True)]
    return {as_: sum(parts[1:], parts[0])}


@dataclass
class Study:
    """A fitted description of regions: feature expression, subject and cohort preprocessing, optional units, centroids.

    ``unit`` columns pool rows into units before clustering (two steps); without them
    every row is a unit (one step, or direct pooling).
    """

    features: str
    subject: str
    unit: Sequence[str] = ()
    subject_steps: Sequence[tuple[str, dict]] = ()
    cohort_steps: Sequence[tuple[str, dict]] = ()
    n_habitats: int | str = "auto"
    most_habitats: int = 6
    seed: int = 0
    chain: prep.Chain | None = field(default=None, repr=False)
    centroids: np.ndarray | None = None
    names: list[str] = field(default_factory=list)

    def _units(self, df: DataFrame) -> DataFrame:
        built = FEATURES.build(parse_features(self.features), columns=df.columns)
        self.names = list(built)
        keys = [self.subject, *self.unit]
        rows = df.select(*(keys if self.unit else df.columns), *(c.alias(f"f_{n}") for n, c in built.items()))
        names = [f"f_{n}" for n in self.names]
        for name, options in self.subject_steps:
            method = prep.METHODS[name](**options)
            rows = prep.apply(rows, prep.fit(rows, names, method, [self.subject]), names, method, [self.subject])
        return units.units_frame(rows, keys, names) if self.unit else rows

    def fit(self, df: DataFrame) -> Study:
        rows = self._units(df)
        names = [f"f_{n}" for n in self.names]
        self.chain = prep.Chain(list(self.cohort_steps), names).fit(rows)
        scaled = self.chain.transform(rows)
        if self.n_habitats == "auto":
            fits = {k: cluster.fit_kmeans(scaled, names, k, self.seed, 1) for k in range(2, self.most_habitats + 1)}
            scores = [float(cluster.inertia(cluster.nearest(scaled, names, c), names, "habitat").first()[0]) for c in fits.values()]
            self.centroids = list(fits.values())[knee(scores)]
        else:
            self.centroids = cluster.fit_kmeans(scaled, names, int(self.n_habitats), self.seed)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """The units with their ``habitat``."""
        if self.chain is None or self.centroids is None:
            raise ValueError("the study has not been fitted")
        rows = self._units(df)
        return cluster.nearest(self.chain.transform(rows), [f"f_{n}" for n in self.names], self.centroids)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Centroids, preprocessing states and the description, as tables and one line of JSON."""
        assert self.chain is not None and self.centroids is not None
        spark.createDataFrame([(k + 1, [float(v) for v in c]) for k, c in enumerate(self.centroids)], "habitat int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")
        for k, state in enumerate(self.chain.states):
            state.write.mode("overwrite").parquet(f"{folder}/state-{k}")
        card = {k: getattr(self, k) for k in ("features", "subject", "unit", "subject_steps", "cohort_steps", "n_habitats", "most_habitats", "seed", "names")}
        spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/card")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Study:
        card = json.loads(spark.read.text(f"{folder}/card").first()[0])
        names = card.pop("names")
        card["subject_steps"], card["cohort_steps"] = ([tuple(s) for s in card[k]] for k in ("subject_steps", "cohort_steps"))
        out = cls(**card)
        out.names = names
        out.centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{folder}/centroids").orderBy("habitat").collect()])
        out.chain = prep.Chain(list(out.cohort_steps), [f"f_{n}" for n in names])
        out.chain.states = [spark.read.parquet(f"{folder}/state-{k}") for k in range(len(out.chain._methods()))]
        return out


def two_step(features: str, subject: str, unit: Sequence[str], **options) -> Study:
    return Study(features, subject, unit, **options)


def one_step(features: str, subject: str, **options) -> Study:
    return Study(features, subject, **options)


def direct_pooling(features: str, subject: str, **options) -> Study:
    """Like one step, with no preprocessing within subjects."""
    return Study(features, subject, subject_steps=(), **options)


def run_config(spark: SparkSession, path: str) -> DataFrame:
    """Run a JSON or YAML description {input, output?, study: {...}}: fit, predict, and write the units if an output is named."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    if unknown := set(config) - {"input", "output", "study"}:
        raise ValueError(f"unknown keys in {path}: {sorted(unknown)}")
    df = spark.read.parquet(config["input"])
    study = Study(**config["study"]).fit(df)
    out = study.predict(df)
    if folder := config.get("output"):
        study.save(spark, f"{folder}/model")
        out.write.mode("overwrite").parquet(f"{folder}/habitats.parquet")
    return out
