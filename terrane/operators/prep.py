"""Feature preprocessing: learn a state, apply it as column expressions.

``fit`` returns one struct of parameters per feature for each group (a subject, or
the whole cohort when no group is named); ``apply`` joins the state to the rows and
rewrites the features.  Missing and non-finite values never enter a state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .running import running



def finite(value: Column) -> Column:
    """The value as a double, null where it is missing, NaN or infinite."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def span(width: Column) -> Column:
    """A divisor that is 1 where the width is zero or unknown."""
    return F.when(width.isNull() | (width == 0), F.lit(1.0)).otherwise(width)


@dataclass(frozen=True)
class Method:
    """How a preprocessing method learns from a column and rewrites a value."""

    learn: Callable[[Column], dict[str, Column]]
    rewrite: Callable[[Column, Callable[[str], Column]], Column]
    #: For a whole cohort: shares whose exact quantiles are found by ranges, and the edges made of them.
    quantiles: tuple[Sequence[float], Callable[[list[float] | None], list[float]]] | None = None


def impute(strategy: str = "mean") -> Method:
    fill = {"mean": F.avg, "median": F.median, "zero": lambda x: F.max(F.lit(0.0))}[strategy]
    return Method(lambda x: {"fill": F.coalesce(fill(x), F.lit(0.0))}, lambda x, s: F.coalesce(x, s("fill")))


def minmax() -> Method:
    return Method(lambda x: {"low": F.min(x), "high": F.max(x)}, lambda x, s: (x - s("low")) / span(s("high") - s("low")))


def zscore() -> Method:
    return Method(lambda x: {"mean": F.avg(x), "std": F.stddev_samp(x)}, lambda x, s: (x - s("mean")) / span(s("std")))


def robust() -> Method:
    return Method(lambda x: {"q": F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))}, lambda x, s: (x - s("q")[1]) / span(s("q")[2] - s("q")[0]))


def winsorize(lower: float = 0.05, upper: float = 0.05) -> Method:
    edges = lambda x: F.percentile(x, F.array(F.lit(lower), F.lit(1 - upper)))
    return Method(lambda x: {"q": edges(x)}, lambda x, s: F.when(x.isNotNull(), F.least(F.greatest(x, s("q")[0]), s("q")[1])))


def log_shift() -> Method:
    """ln(x - smallest + 1); null below the smallest less one."""
    return Method(lambda x: {"low": F.min(x)}, lambda x, s: F.when(x - s("low") + 1 > 0, F.ln(x - s("low") + 1)))


#: Exact quantiles that one-dimensional centres are fitted on.
KMEANS_POINTS = 512


def _centre_edges(points: list[float] | None, k: int, rounds: int = 300) -> list[float]:
    """The inner edges between the centres that Lloyd's steps reach from even starts; an empty centre moves to the point farthest from its own, one without such a point vanishes."""
    import numpy as np

    if not points or points[0] is None:
        return []
    x = np.sort(np.array(points, float))
    starts = np.linspace(x[0], x[-1], k + 1)
    centres = (starts[:-1] + starts[1:]) / 2
    for _ in range(rounds):
        owner = np.searchsorted((centres[:-1] + centres[1:]) / 2, x, side="right")
        away = np.abs(x - centres[owner])
        found = []
        for c in range(len(centres)):
            if (owner == c).any():
                found.append(x[owner == c].mean())
            elif away.max() > 0:
                far = int(away.argmax())
                found.append(x[far])
                away[far] = 0
        found = np.unique(found)
        if len(found) == len(centres) and np.allclose(found, centres, rtol=0, atol=1e-12):
            break
        centres = found
    return ((centres[:-1] + centres[1:]) / 2).tolist()


def binning(n_bins: int = 10, strategy: str = "uniform") -> Method:
    """Ordinal bins from 0: the number of inner edges at or below the value.

    ``kmeans`` places the edges halfway between one-dimensional centres that start
    evenly over the range; they settle on KMEANS_POINTS exact quantiles of the column.
    """
    if strategy == "uniform":
        inside = lambda x, s: F.when(s("high") > s("low"), F.floor((x - s("low")) / (s("high") - s("low")) * n_bins)).otherwise(F.lit(0))
        return Method(lambda x: {"low": F.min(x), "high": F.max(x)}, lambda x, s: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(inside(x, s).cast("double"), F.lit(n_bins - 1.0)))))
    if strategy == "kmeans":
        grid = F.array(*(F.lit((k + 0.5) / KMEANS_POINTS) for k in range(KMEANS_POINTS)))
        edges = F.udf(lambda points: _centre_edges(points, n_bins), "array<double>")
        return Method(lambda x: {"edges": edges(F.percentile(x, grid))}, lambda x, s: F.when(x.isNotNull(), F.size(F.filter(s("edges"), lambda e: e <= x)).cast("double")), ([(k + 0.5) / KMEANS_POINTS for k in range(KMEANS_POINTS)], lambda points: _centre_edges(points, n_bins)))
    if strategy != "quantile":
        raise ValueError(f"unknown binning strategy {strategy}")
    return Method(lambda x: {"edges": F.percentile(x, F.array(*(F.lit(k / n_bins) for k in range(1, n_bins))))}, lambda x, s: F.when(x.isNotNull(), F.size(F.filter(s("edges"), lambda e: e <= x)).cast("double")))


#: Methods by the name used in specifications.
METHODS: dict[str, Callable[..., Method]] = {"impute": impute, "minmax": minmax, "zscore": zscore, "robust": robust, "winsorize": winsorize, "log": log_shift, "binning": binning}


def quantiles(df: DataFrame, feature: str, shares: Sequence[float]) -> list[float] | None:
    """Exact quantiles of the finite values with linear weights between neighbours, None without a value.

    Values are counted and their ranks summed by ranges (see :mod:`.running`), so no task
    holds all distinct values.
    """
    import numpy as np

    counts = running(df.groupBy(finite(F.col(feature)).alias("v")).agg(F.count("*").alias("n")).where("v is not null"), (), "v", {"upto": "n"})
    total = counts.agg(F.max("upto")).first()[0]
    if not total:
        return None
    at = np.array([(total - 1) * s for s in shares])
    low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    places = np.unique(np.concatenate([low, high]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v, n, upto = (batch.column(c).to_numpy() for c in ("v", "n", "upto"))
            first, end = np.searchsorted(places, upto - n), np.searchsorted(places, upto)
            own = end - first
            place = np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())
            yield pa.RecordBatch.from_arrays([pa.array(places[place]), pa.array(np.repeat(v, own))], names=["place", "v"])

    value = {r["place"]: r["v"] for r in counts.select("v", "n", "upto").mapInArrow(run, "place long, v double").collect()}
    a, b = (np.array([value[p] for p in q.tolist()]) for q in (low, high))
    return np.where(a == b, a, (high - at) * a + (at - low) * b).tolist()


def fit(df: DataFrame, features: Sequence[str], method: Method, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: the group columns and a struct ``state_<feature>`` for every feature."""
    if method.quantiles and not by:
        shares, made = method.quantiles
        row = tuple((made(quantiles(df, f, shares)),) for f in features)
        return df.sparkSession.createDataFrame([row], ", ".join(f"state_{f} struct<edges: array<double>>" for f in features))
    learned = [F.struct(*(agg.alias(name) for name, agg in method.learn(finite(F.col(f))).items())).alias(f"state_{f}") for f in features]
    return df.groupBy(*by).agg(*learned)


def literal(value: object) -> Column:
    """A learned parameter (a number, a list of numbers or nothing) as a constant."""
    if isinstance(value, list | tuple):
        return F.array(*(F.lit(float(v)) for v in value))
    return F.lit(None if value is None else float(value)).cast("double")


def apply(df: DataFrame, state: DataFrame, features: Sequence[str], method: Method, by: Sequence[str] = ()) -> DataFrame:
    """The rows with their features rewritten; groups that the state doesn't know get nulls.

    A cohort state is one row and becomes constants of the plan; a state by group is
    joined on the group, which shuffles only if it is too large to send.
    """
    if by:
        joined = df.join(state, list(by), "left")
        rewritten = {f: method.rewrite(finite(F.col(f)), lambda name, f=f: F.col(f"state_{f}.{name}")) for f in features}
        return joined.withColumns(rewritten).drop(*(f"state_{f}" for f in features))
    learned = state.first()
    return df.withColumns({f: method.rewrite(finite(F.col(f)), lambda name, f=f: literal(learned[f"state_{f}"][name])) for f in features})


@dataclass
class Chain:
    """Methods in order, with an imputation first unless one is named; learned once, replayed on any rows with these columns."""

    steps: Sequence[tuple[str, dict]]
    features: Sequence[str]
    by: Sequence[str] = ()
    states: list[DataFrame] = field(default_factory=list)

    def _methods(self) -> list[Method]:
        steps = list(self.steps)
        if all(name != "impute" for name, _ in steps):
            steps.insert(0, ("impute", {}))
        return [METHODS[name](**options) for name, options in steps]

    def _checked(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in (*self.by, *self.features) if c not in df.columns]:
            raise ValueError(f"columns are missing: {missing}")
        return df

    def fit(self, df: DataFrame) -> Chain:
        df, self.states = self._checked(df), []
        for method in self._methods():
            state = fit(df, self.features, method, self.by)
            # a state by group is written out: else every step would learn all steps before it again
            self.states.append(cut(state) if self.by else state)
            df = apply(df, self.states[-1], self.features, method, self.by)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = self._checked(df)
        if len(self.states) != len(self._methods()):
            raise ValueError("the chain has not been fitted")
        for method, state in zip(self._methods(), self.states, strict=True):
            df = apply(df, state, self.features, method, self.by)
        return df


def zscore_pooled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All features scaled by one mean and one population deviation."""
    x = F.array(*(finite(F.col(f)) for f in features))
    mean, std = df.select(F.explode(x).alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    return df.withColumns({f: (finite(F.col(f)) - literal(mean)) / span(literal(std)) for f in features})


def variances(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    return df.agg(*(F.var_samp(finite(F.col(f))).alias(f) for f in features)).first().asDict()


def keep_by_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.0, top_k: int | None = None, top_share: float | None = None, keep_one: bool = True) -> list[str]:
    """Features whose variance is strictly above the threshold, or the first by variance, in their given order."""
    var = {f: v if v is not None else 0.0 for f, v in variances(df, features).items()}
    ranked = sorted(features, key=lambda f: -var[f])
    if top_share is not None:
        top_k = -int(-top_share * len(features) // 100)
    kept = set(ranked[:top_k]) if top_k is not None else {f for f in features if var[f] > threshold}
    if not kept and keep_one and ranked:
        kept = {ranked[0]}
    return [f for f in features if f in kept]


def midranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with ``rank_<column>``: average ranks, equal values sharing theirs.

    Ranks are running sums over counted values (see :mod:`.running`).
    """
    for c in columns:
        counts = running(df.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n")), (), "__v", {"__upto": "__n"})
        ranks = counts.select("__v", (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(f"rank_{c}"))
        df = df.join(ranks, F.col(c).eqNullSafe(F.col("__v")), "left").drop("__v")
    return df


def correlations(df: DataFrame, features: Sequence[str], method: str = "spearman") -> dict[tuple[str, str], float]:
    """Correlation of each pair of features; 0 where it is undefined.  ``kendall`` is tau-b over rows where both are known."""
    if method == "kendall":
        return {(features[j], features[i]): kendall(df, features[j], features[i]) for i in range(len(features)) for j in range(i)}
    if method == "spearman":
        df, names = midranks(df, features), [f"rank_{f}" for f in features]
    elif method == "pearson":
        names = list(features)
    else:
        raise ValueError(f"unknown correlation {method}")
    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    if not pairs:
        return {}
    row = df.agg(*(F.corr(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"{i}_{j}") for i, j in pairs)).first()
    return {(features[j], features[i]): row[f"{i}_{j}"] or 0.0 if row[f"{i}_{j}"] == row[f"{i}_{j}"] else 0.0 for i, j in pairs}


def kendall(df: DataFrame, a: str, b: str) -> float:
    """Tau-b from counts: pairs in opposite order are the concordant pairs of a descending outcome, found by rank bits; 0 where it is undefined."""
    from .survival import c_index

    rows = df.select(finite(F.col(a)).alias("time"), F.lit(1).alias("event"), finite(F.col(b)).alias("risk")).dropna()
    counted = rows.groupBy("time", "risk").agg(F.count("*").alias("n"))
    pairs = F.sum((F.col("n") * (F.col("n") - 1)).cast("double")) / 2
    both = counted.agg(pairs).first()[0] or 0.0
    tied = [counted.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs).first()[0] or 0.0 for c in ("time", "risk")]
    n = counted.agg(F.sum("n")).first()[0] or 0
    every = n * (n - 1) / 2
    opposite = c_index(rows).first()["concordant"]
    spread = ((every - tied[0]) * (every - tied[1])) ** 0.5
    return (every - tied[0] - tied[1] + both - 2 * opposite) / spread if spread else 0.0


def keep_by_correlation(df: DataFrame, features: Sequence[str], threshold: float = 0.95, method: str = "spearman") -> list[str]:
    """Left to right, each feature that correlates with no kept one beyond the threshold (strictly)."""
    r = correlations(df, features, method)
    kept: list[str] = []
    for f in features:
        if all(abs(r[k, f]) <= threshold for k in kept):
            kept.append(f)
    return kept
