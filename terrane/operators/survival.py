"""Right-censored outcomes: (time, event 0 or 1, risk)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .running import running


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = ()) -> DataFrame:
    """(group, time, at_risk, events, survival) at every distinct event time.

    Rows are counted by time first and summed over the ordered times (see :mod:`.running`).
    """
    return _product(df, time, event, by).where("events > 0").select(*by, "time", "at_risk", "events", "survival")


def _product(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, time, at_risk, events, survival, before) at every distinct time: the product-limit estimate at it and just before it."""
    n = df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(event).alias("events"), F.count("*").alias("n"))
    s = running(n, by, "time", {"at_risk": "n"}, descending=True)
    share = 1 - F.col("events") / F.col("at_risk")
    s = s.withColumns({"__ln": F.when(share > 0, F.ln(share)).otherwise(0.0), "__end": (F.col("events") >= F.col("at_risk")).cast("int")})
    s = running(s, by, "time", {"__upto": "__ln", "__ended": "__end"})
    alive = lambda ended, total: F.when(ended > 0, 0.0).otherwise(F.exp(total))
    return s.withColumns({"survival": alive(F.col("__ended"), F.col("__upto")), "before": alive(F.col("__ended") - F.col("__end"), F.col("__upto") - F.col("__ln"))}).drop("__ln", "__end", "__upto", "__ended")


def c_index(df: DataFrame, time: str = "time", event: str = "event", risk: str = "risk") -> DataFrame:
    """(concordant, tied, comparable, c_index): of pairs where the earlier time is an event, those with the higher risk first.

    Risks are numbered by rank.  A pair of ranks parts at one bit: the higher has it, the
    lower has not, and the bits above are equal.  So every row is counted once a bit, and
    within the rows that share the bits above a running sum over later times gives the
    concordant pairs: a row costs its bits, and no two rows ever meet.
    """
    cell = df.groupBy(F.col(time).alias("t"), F.col(event).alias("e"), F.col(risk).alias("r")).agg(F.count("*").alias("n"))
    ranks = running(cell.select("r").distinct().withColumn("__one", F.lit(1)), (), "r", {"rank": "__one"}).select("r", "rank")
    cell = cut(cell.join(ranks, "r"))
    top = (cell.agg(F.max("rank")).first()[0] or 0).bit_length()
    bits = cell.select("t", "e", "n", "rank", F.explode(F.sequence(F.lit(0), F.lit(max(top - 1, 0)))).alias("bit"))
    has = F.expr("shiftright(rank, bit)").bitwiseAND(F.lit(1)) == 1
    node = bits.select("t", "e", "n", "bit", F.expr("shiftright(rank, bit + 1)").alias("node"), has.alias("has"))
    concordant = _later(node, ("bit", "node"), F.col("has"), ~F.col("has"))
    tied, comparable = _later(cell, ("rank",), F.lit(True), F.lit(True)), _later(cell, (), F.lit(True), F.lit(True))
    counts = [x.agg(F.sum("pairs")).first()[0] or 0 for x in (concordant, tied, comparable)]
    out = df.sparkSession.createDataFrame([tuple(counts)], "concordant long, tied long, comparable long")
    return out.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("comparable")))


def _later(cells: DataFrame, by: Sequence[str], asks: Column, answers: Column) -> DataFrame:
    """(group, t, pairs): rows (t, e, n) that ask with an event, times the answering rows of later times or censored at the same one."""
    n = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    at = cells.groupBy(*by, "t").agg(n(asks & (F.col("e") == 1)).alias("ask"), n(answers).alias("have"), n(answers & (F.col("e") == 0)).alias("kept"))
    at = running(at, by, "t", {"upto": "have"}, descending=True)
    return at.select(*by, "t", (F.col("ask") * (F.col("upto") - F.col("have") + F.col("kept"))).alias("pairs"))


def log_rank(df: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """(observed, expected, variance, chi2) of two groups, the first by name."""
    n = df.groupBy(F.col(time).alias("time")).agg(F.sum(event).alias("d"), F.count("*").alias("n"), F.sum(F.when(F.col(group) == 0, F.col(event)).otherwise(0)).alias("d0"), F.count_if(F.col(group) == 0).alias("n0"))
    r = running(n, (), "time", {"r": "n", "r0": "n0"}, descending=True).where("d > 0")
    d, k, k0 = F.col("d"), F.col("r"), F.col("r0")
    var = F.when(k > 1, d * (k0 / k) * (1 - k0 / k) * (k - d) / (k - 1)).otherwise(0.0)
    out = r.agg(F.sum("d0").alias("observed"), F.sum(d * k0 / k).alias("expected"), F.sum(var).alias("variance"))
    return out.withColumn("chi2", F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("variance"))


def cox(df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event", rounds: int = 30, tol: float = 1e-9) -> dict[str, np.ndarray]:
    """Proportional-hazards coefficients and standard errors (Breslow ties) by Newton steps.

    Each step is one aggregation by distinct time and one ordered sum over times; only
    the gradient and the information matrix reach the driver.
    """
    rows = df.select(F.col(time).alias("t"), F.col(event).alias("e"), *(F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)))
    p = len(features)
    center = rows.agg(*(F.avg(f"x{k}") for k in range(p))).first()
    rows = rows.select("t", "e", *((F.col(f"x{k}") - center[k]).alias(f"x{k}") for k in range(p)))
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    beta = np.zeros(p)
    info = np.eye(p)
    for _ in range(rounds):
        w = F.exp(sum((F.col(f"x{k}") * float(b) for k, b in enumerate(beta)), F.lit(0.0)))
        sums = [F.sum("w").alias("s0"), F.sum("e").alias("d")] + [F.sum(F.col("w") * F.col(f"x{k}")).alias(f"s1_{k}") for k in range(p)]
        sums += [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s2_{i}_{j}") for i, j in pairs] + [F.sum(F.col("e") * F.col(f"x{k}")).alias(f"d_{k}") for k in range(p)]
        by = rows.withColumn("w", w).groupBy("t").agg(*sums)
        names = ["s0", *(f"s1_{k}" for k in range(p)), *(f"s2_{i}_{j}" for i, j in pairs)]
        risk = running(by, (), "t", {f"r{c}": c for c in names}, descending=True).where("d > 0").select("d", *(f"d_{k}" for k in range(p)), *(F.col(f"r{c}").alias(c) for c in names))
        mean = lambda k: F.col(f"s1_{k}") / F.col("s0")
        grad = [F.sum(F.col(f"d_{k}") - F.col("d") * mean(k)) for k in range(p)]
        hess = [F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean(i) * mean(j))) for i, j in pairs]
        row = risk.agg(*grad, *hess).first()
        g = np.array(row[:p], float)
        for (i, j), v in zip(pairs, row[p:], strict=True):
            info[i, j] = info[j, i] = v
        step = np.linalg.solve(info, g)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return {"coef": beta, "se": np.sqrt(np.diag(np.linalg.inv(info)))}


def censoring(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """(time, g): the censoring distribution, by the product of those left uncensored at each censoring time."""
    flipped = df.select(F.col(time).alias("time"), (1 - F.col(event)).alias("event"))
    return kaplan_meier(flipped).select("time", F.col("survival").alias("g"))


def _weighed(df: DataFrame, time: str, event: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``__g``, the censoring distribution just before their time, and its steps (time, survival)."""
    steps = _product(df.select(F.col(time).alias("time"), (1 - F.col(event)).alias("event")), "time", "event")
    rows = df.join(steps.select(F.col("time").alias("__at"), F.col("before").alias("__g")), F.col(time) == F.col("__at")).drop("__at")
    return rows, steps


def _at(steps: DataFrame, times: Sequence[float]) -> list[float]:
    """The censoring distribution at each of some times."""
    row = steps.agg(*(F.max_by(F.when(F.col("time") <= t, F.col("survival")), F.when(F.col("time") <= t, F.col("time"))) for t in map(float, times))).first()
    return [1.0 if v is None else v for v in row]


def brier_curve(df: DataFrame, probability: str, times: Sequence[float], time: str = "time", event: str = "event") -> DataFrame:
    """(t, brier) of predicted survival at ``times``, weighted for censoring.

    ``probability`` is an array with one entry a time.  Rows meet the censoring
    distribution by their time; only its values at ``times`` reach the driver.
    """
    rows, steps = _weighed(df, time, event)
    cells = []
    for k, (t, g) in enumerate(zip(times, _at(steps, times), strict=True)):
        p = F.col(probability)[k]
        gone = (F.col(time) <= t) & (F.col(event) == 1)
        part = F.when(gone, F.try_divide(p * p, F.col("__g"))).when(F.col(time) > t, F.try_divide((1 - p) * (1 - p), F.lit(g))).otherwise(0.0)
        cells.append(F.struct(F.lit(float(t)).alias("t"), F.avg(part).alias("brier")))
    return rows.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def integrated_brier(curve: DataFrame) -> float:
    """Area under the curve over its span of times, by trapezoids."""
    rows = sorted((r["t"], r["brier"]) for r in curve.collect())
    t, b = (np.array(v) for v in zip(*rows, strict=True))
    return float(np.trapezoid(b, t) / (t[-1] - t[0])) if len(t) > 1 else float(b[0])


def time_grid(df: DataFrame, n_times: int = 100, time: str = "time", event: str = "event") -> list[float]:
    """Evenly placed times from the first event to half a step before the last time."""
    first, last = df.agg(F.min(F.when(F.col(event) == 1, F.col(time))), F.max(time)).first()
    if first is None:
        return []
    step = (last - first) / n_times
    return np.linspace(first, last - step / 2, n_times).tolist()


def dynamic_auc(df: DataFrame, times: Sequence[float], time: str = "time", event: str = "event", risk: str = "risk") -> DataFrame:
    """(t, auc): for each time, how well the risk ranks rows with an event by then, weighted for censoring, above rows still at risk."""
    rows, _ = _weighed(df, time, event)
    weight = F.when(F.col(event) == 1, F.try_divide(F.lit(1.0), F.col("__g")))
    at = rows.select(F.col(time).alias("time"), F.col(event).alias("event"), F.col(risk).alias("r"), weight.alias("w"), F.explode(F.array(*(F.lit(float(t)) for t in times))).alias("t"))
    n = at.groupBy("t", "r").agg(F.sum(F.when((F.col("time") <= F.col("t")) & (F.col("event") == 1), F.col("w")).otherwise(0.0)).alias("case"), F.count_if(F.col("time") > F.col("t")).alias("control"))
    won = running(n, ("t",), "r", {"upto": "control"}).withColumn("won", F.col("case") * (F.col("upto") - F.col("control") / 2))
    return won.groupBy("t").agg(F.try_divide(F.sum("won"), F.sum("case") * F.sum("control")).alias("auc"))
