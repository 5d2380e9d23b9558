"""Feature tables: joins with checks, merges, panels, sets and splits."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running


def assert_unique(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    if not df.groupBy(*ids).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(ids)} are not unique")
    return df


def join_one_to_one(a: DataFrame, b: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Inner join of feature tables that have one row per id and no feature in common."""
    if clash := sorted((set(a.columns) & set(b.columns)) - set(ids)):
        raise ValueError(f"features are in both tables: {clash}")
    return assert_unique(a, ids).join(assert_unique(b, ids), list(ids), "inner")


def merge(frames: Mapping[str, DataFrame], ids: Sequence[str], how: str = "inner") -> DataFrame:
    """Join tables by id; a name that an earlier table has gets the table's tag behind it."""
    out: DataFrame | None = None
    for tag, df in frames.items():
        if out is None:
            out = df
            continue
        taken = set(out.columns) - set(ids)
        out = out.join(df.withColumnsRenamed({c: f"{c}__{tag}" for c in df.columns if c in taken}), list(ids), {"inner": "inner", "outer": "full_outer"}[how])
    if out is None:
        raise ValueError("nothing to merge")
    return out


def load_feature_table(frames: Mapping[str, DataFrame], id_column: str, label: str | None = None) -> DataFrame:
    """Full outer join of named tables, features prefixed with the table's name, the label taken from the first that has it."""
    parts, labels = [], []
    for name, df in frames.items():
        cols = [F.col(id_column)]
        for c in df.columns:
            if c == label:
                labels.append(f"__{name}_{c}")
                cols.append(F.col(c).alias(labels[-1]))
            elif c != id_column:
                cols.append(F.col(c).alias(f"{name}_{c}"))
        parts.append(df.select(*cols))
    out = functools.reduce(lambda a, b: a.join(b, id_column, "full_outer"), parts)
    return out.withColumn(label, F.coalesce(*labels)).drop(*labels) if labels else out


def merge_predictions(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("subject_id", "label")) -> DataFrame:
    """Full outer join of model predictions on subject and label; scores are named ``<model>_prob``."""
    parts = [df.select(*keys, F.col("prob").alias(f"{model}_prob")) for model, df in sources.items()]
    return functools.reduce(lambda a, b: a.join(b, list(keys), "full_outer"), parts)


def select_ids(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows with one of the ids; an id that no row has raises."""
    if not ids.join(df, id_column, "left_anti").isEmpty():
        raise ValueError("unknown ids")
    return df.join(ids, id_column, "left_semi")


def holdout(df: DataFrame, train: DataFrame, test: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    if not train.join(test, id_column, "left_semi").isEmpty():
        raise ValueError("an id is in both parts")
    return select_ids(df, train, id_column), select_ids(df, test, id_column)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_ids(frames: Sequence[DataFrame], id_column: str) -> DataFrame:
    return functools.reduce(lambda a, b: a.intersect(b), [f.select(id_column) for f in frames])


def common_columns(frames: Sequence[DataFrame]) -> list[str]:
    return [c for c in frames[0].columns if all(c in f.columns for f in frames)]


def melt(df: DataFrame, ids: Sequence[str], pattern: str = r"^habitat_(\d+)_(.+)$") -> DataFrame:
    """Wide ``habitat_<k>_<feature>`` columns as rows (ids, habitat, feature, value); unknown values go."""
    import re

    wide = [c for c in df.columns if re.match(pattern, c)]
    long = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in wide)).unpivot(list(ids), wide, "name", "value")
    value = F.col("value")
    return long.where(value.isNotNull() & ~F.isnan("value")).select(*ids, F.regexp_extract("name", pattern, 1).cast("int").alias("habitat"), F.regexp_extract("name", pattern, 2).alias("feature"), "value")


def contrasts(panel: DataFrame, subject: str) -> DataFrame:
    """(feature, habitat_a, habitat_b, n, mean_diff, cliffs_delta, cohens_d) over subjects that have both habitats."""
    a = panel.select(subject, "feature", F.col("habitat").alias("habitat_a"), F.col("value").alias("a"))
    b = panel.select(subject, "feature", F.col("habitat").alias("habitat_b"), F.col("value").alias("b"))
    d = F.col("a") - F.col("b")
    met = a.join(b, [subject, "feature"]).where("habitat_a < habitat_b").groupBy("feature", "habitat_a", "habitat_b")
    return met.agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.avg(F.signum(d)).alias("cliffs_delta"), F.try_divide(F.avg(d), F.stddev_samp(d)).alias("cohens_d"))


def summary(panel: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return panel.groupBy("habitat", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), q[1].alias("median"), q[0].alias("q25"), q[2].alias("q75"))


def _draw(seed: int, *ids: str) -> Column:
    """A pseudo-random order that depends on the row's id alone, so that retries agree."""
    return F.xxhash64(*ids, F.lit(seed))


def split(df: DataFrame, id_column: str, share: float = 0.3, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """The rows with ``split``: the given share of each stratum (rounded up) is ``test``."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy(_draw(seed, id_column), id_column))
    return df.withColumn("split", F.when(rank <= F.ceil(F.count("*").over(whole) * share), "test").otherwise("train"))


def folds(df: DataFrame, id_column: str, k: int = 5, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """The rows with ``fold`` 0 to k - 1, equally filled in each stratum."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("fold", (F.row_number().over(whole.orderBy(_draw(seed, id_column), id_column)) - 1) % k)


def resample(df: DataFrame, y: str, id_column: str, method: str = "random_over", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Two-class training rows with the smaller class drawn again, or the larger one thinned, to the ratio."""
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}
    if len(sizes) != 2:
        raise ValueError("resampling is for two classes")
    small, large = sorted(sizes, key=lambda c: (sizes[c], str(c)))
    if method == "random_under":
        keep = int(sizes[small] / min(ratio, 1.0))
        rank = F.row_number().over(Window.partitionBy(y).orderBy(_draw(seed, id_column), id_column))
        return df.withColumn("__r", rank).where((F.col(y) != large) | (F.col("__r") <= keep)).drop("__r")
    if method != "random_over":
        raise ValueError(f"unknown method {method}")
    wanted = -int(-sizes[large] * ratio // 1)
    whole, extra = divmod(max(wanted, sizes[small]), sizes[small])
    rank = F.row_number().over(Window.partitionBy(y).orderBy(_draw(seed, id_column), id_column))
    times = F.when(F.col(y) == small, F.lit(whole) + (F.col("__r") <= extra).cast("int")).otherwise(1)
    return df.withColumn("__r", rank).withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__r", "__copy")


def ensemble(df: DataFrame, id_column: str, prob: str, voting: str = "soft") -> DataFrame:
    """(id, prob) over fold models: the mean probability, or the share of votes at one half."""
    value = F.col(prob) if voting == "soft" else (F.col(prob) >= 0.5).cast("double")
    return df.groupBy(id_column).agg(F.avg(value).alias("prob"))


def cohort_summary(df: DataFrame, subject: str, modality: str, salt: str = "") -> DataFrame:
    """(n_subjects, modalities, digest): the number of subjects, the sorted modality names, and a salted digest of the set of subjects that names none.

    Subjects are hashed one by one; the digest is of the sums of the hashes' quarters, so
    it depends on the set alone and nothing is gathered.  Null subjects don't count.
    """
    ids = df.where(F.col(subject).isNotNull()).select(F.sha2(F.concat(F.lit(salt), F.col(subject).cast("string")), 256).alias("h")).distinct()
    quarters = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 14 * k, 14), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    one = ids.agg(F.count("*").alias("n_subjects"), F.sha2(F.concat_ws(":", *quarters), 256).alias("digest"))
    names = df.agg(F.array_sort(F.collect_set(modality)).alias("modalities"))
    return one.withColumn("__one", F.lit(1)).join(names.withColumn("__one", F.lit(1)), "__one").select("n_subjects", "modalities", "digest")


def whitelist(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns and the listed features in the list's order; a feature that the table lacks raises."""
    if missing := [f for f in features if f not in df.columns]:
        raise ValueError(f"features absent from the table: {missing}")
    return df.select(*keep, *features)


def representatives(df: DataFrame, score: str, row: str, n: int = 3) -> DataFrame:
    """The rows at evenly spaced places of the order by score (the middle one if n is 1), with ``rank`` from 0; null scores are left out, ties go by row."""
    placed = df.where(F.col(score).isNotNull())
    total = placed.count()
    n = min(n, total)
    places = [total // 2] if n == 1 else [round(k * (total - 1) / (n - 1)) for k in range(n)] if n else []
    ordered = placed.groupBy(score).agg(F.count("*").alias("__n"))
    upto = running(ordered, (), score, {"__upto": "__n"}).select(F.col(score).alias("__s"), (F.col("__upto") - F.col("__n")).alias("__before"))
    # only rows whose score's places are asked for are put in order
    hit = [(F.col("__before") <= p) & (F.lit(p) < F.col("__before") + F.col("__n")) for p in places]
    wanted = upto.join(ordered.select(F.col(score).alias("__t"), "__n"), F.col("__s") == F.col("__t")).where(F.exists(F.array(*hit), lambda x: x) if hit else F.lit(False)).select("__s", "__before")
    near = placed.join(F.broadcast(wanted), F.col(score) == F.col("__s"))
    ranked = near.withColumn("rank", F.col("__before") + F.row_number().over(Window.partitionBy(score).orderBy(row)) - 1)
    return ranked.where(F.col("rank").isin(places)).drop("__s", "__before")


def synthetic_features(spark, rows: int = 60, features: int = 12, task: str = "binary", seed: int = 0) -> DataFrame:
    """A seeded table (subject_id, feature_000 ..., label; or time and event): the first two features drive the outcome.

    Every value is a hash of its row and column, the same on any cluster.
    """
    if task not in ("binary", "survival"):
        raise ValueError(f"unknown task {task}")
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(u(2 * k))) * F.cos(2 * 3.141592653589793 * u(2 * k + 1))
    df = spark.range(rows).select("id", F.format_string("S%05d", "id").alias("subject_id"), *(normal(k).alias(f"feature_{k:03d}") for k in range(features)))
    risk = F.col("feature_000") + (0.5 * F.col("feature_001") if features > 1 else 0)
    if task == "binary":
        return df.withColumn("label", (u(10_001) < 1 / (1 + F.exp(-1.5 * risk))).cast("int")).drop("id")
    time, censor = -F.ln(u(10_001)) * 24 / F.exp(risk), -F.ln(u(10_002)) * 48
    return df.withColumn("time", F.least(time, censor)).withColumn("event", (time <= censor).cast("int")).drop("id")


def synthetic_cohort(spark, subjects: int = 4, modalities: Sequence[str] = ("T1", "T2"), shape: Sequence[int] = (32, 32, 32), regions: int = 3, seed: int = 0) -> DataFrame:
    """A seeded phantom cohort as cells (subject, z, y, x, region, a column a modality): a ball of nested shells, each with its own mean intensity, and noise."""
    u = lambda k: (F.pmod(F.xxhash64("subject", "z", "y", "x", F.lit(seed), F.lit(k)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    cells = spark.range(subjects * shape[0]).select((F.col("id") / shape[0]).cast("int").alias("subject"), (F.col("id") % shape[0]).cast("int").alias("z"))
    cells = cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(shape[2] - 1))))
    d = F.sqrt(sum((F.pow((F.col(a) - (n - 1) / 2) / (n / 2), F.lit(2.0)) for a, n in zip(("z", "y", "x"), shape, strict=True)), F.lit(0.0)))
    inside = cells.withColumn("region", F.when(d < 0.9, 1 + F.floor(d / 0.9 * regions)).otherwise(0).cast("int")).where("region > 0")
    noise = lambda k: F.sqrt(-2 * F.ln(u(2 * k))) * F.cos(2 * 3.141592653589793 * u(2 * k + 1))
    return inside.select(F.format_string("S%03d", "subject").alias("subject"), "z", "y", "x", "region", *((100.0 * F.col("region") * (k + 1) / len(modalities) + 10 * noise(k)).alias(m) for k, m in enumerate(modalities)))


def voxel_frame(maps: Mapping[str, DataFrame], mask: DataFrame, keys: Sequence[str], label: int | None = 1, suffix: str = "") -> DataFrame:
    """The mask's cells of a label (None: any but 0) with a column for each map (keys, value), ``name-suffix`` if there is a suffix; cells that a map lacks are null."""
    out = mask.where(F.col("label") == label if label is not None else F.col("label") != 0).select(*keys)
    for name, df in maps.items():
        out = out.join(df.select(*keys, F.col("value").alias(f"{name}-{suffix}" if suffix else name)), list(keys), "left")
    return out
