"""Whole tasks over files: extraction, radiomics, reliability, retest, Dice, comparison, cross-validation, merging, DICOM tables, images.

Each recipe is a thin plan over the library's operators: it reads what its description
names, returns a DataFrame and writes it where an ``output`` is named.  A description is
a mapping, or a JSON or YAML file of one; unknown and missing keys raise.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images, models, prep, radiomics, reliability, spatial, tables
from ..sources import tables as files
from ..sources import volumes
from . import comparison, workflows


@dataclass(frozen=True)
class Recipe:
    """A task by name: the keys that its description must and may have."""

    run: Callable[[SparkSession, dict], DataFrame]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()

    def check(self, config: Mapping, where: str = "description") -> dict:
        """The description, if its keys are those of the recipe."""
        if unknown := set(config) - {*self.needs, *self.may, "output"}:
            raise ValueError(f"unknown keys in {where}: {sorted(unknown)}")
        if missing := set(self.needs) - set(config):
            raise ValueError(f"keys missing in {where}: {sorted(missing)}")
        return dict(config)


RECIPES: dict[str, Recipe] = {}


def recipe(name: str, needs: tuple[str, ...], may: tuple[str, ...] = ()) -> Callable:
    def add(run: Callable[[SparkSession, dict], DataFrame]) -> Callable[[SparkSession, dict], DataFrame]:
        RECIPES[name] = Recipe(run, needs, may)
        return run

    return add


def read_config(path: str) -> dict:
    """A mapping from a JSON or YAML file."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def check_config(name: str, config: Mapping | str) -> dict:
    """The description of a recipe, checked; nothing is read or run."""
    if name not in RECIPES:
        raise ValueError(f"no recipe {name}; there are {', '.join(sorted(RECIPES))}")
    return RECIPES[name].check(read_config(config) if isinstance(config, str) else config, config if isinstance(config, str) else "description")


def example(name: str) -> dict:
    """A description of a recipe to start from: every key it knows, those that it needs named so."""
    known = RECIPES[name]
    return {k: "needed" for k in known.needs} | dict.fromkeys((*known.may, "output"))


#: Earlier names of keys, and what they are called now.
RENAMED = {"out_dir": "output", "data_path": "input", "features_expr": "features", "id_col": "id", "label_col": "y"}


def migrate(config: Mapping) -> dict:
    """A description with earlier names of keys replaced; two names of one key raise."""
    out: dict = {}
    for k, v in config.items():
        new = RENAMED.get(k, k)
        if new in out:
            raise ValueError(f"{new} is given twice")
        out[new] = v
    return out


def run(spark: SparkSession, name: str, config: Mapping | str) -> DataFrame:
    """Run a recipe and write its rows where ``output`` names a folder."""
    given = check_config(name, config)
    out = RECIPES[name].run(spark, given)
    if folder := given.get("output"):
        out.write.mode("overwrite").parquet(folder)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return files.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def _name(column: str = "path") -> Column:
    return F.regexp_extract(column, r"([^/]+?)(?:_habitats)?\.[^/]*$", 1)


def _labels(spark: SparkSession, root: str, pattern: str = "*.nrrd") -> DataFrame:
    """Label maps as cells (subject, z, y, x, label), the subject being the file's name."""
    return volumes.cells(spark, root, pattern, _name()).select("subject", "z", "y", "x", F.col("value").cast("int").alias("label"))


#: Feature families of label maps by name.
FAMILIES: dict[str, Callable[[DataFrame, list[int]], DataFrame]] = {
    "volume": lambda c, labels: spatial.volumes(c, "subject", labels),
    "msi": lambda c, labels: spatial.interaction_features(spatial.interaction(c, "subject"), "subject", max(labels) + 1),
    "non_radiomics": lambda c, labels: spatial.zone_regions(c, "subject"),
    "ith_score": lambda c, labels: spatial.fragmentation(spatial.zone_regions(c, "subject"), "subject"),
}


@recipe("extract", ("maps", "features"), ("labels", "pattern"))
def extract_habitat_features(spark: SparkSession, config: dict) -> DataFrame:
    """Features of label maps below a folder, one row a subject and family: (subject, family, feature, value)."""
    cells = _labels(spark, config["maps"], config.get("pattern") or "*.nrrd")
    labels = config.get("labels") or [r[0] for r in cells.where("label <> 0").select("label").distinct().orderBy("label").collect()]
    out = None
    for family in config["features"]:
        if family not in FAMILIES:
            raise ValueError(f"no family {family}; there are {', '.join(FAMILIES)}")
        found = FAMILIES[family](cells, labels)
        key = F.concat(F.lit("habitat_"), F.col("label"), F.lit("_")) if "label" in found.columns else F.lit("")
        names = [c for c in found.columns if c not in ("subject", "label")]
        long = found.select("subject", F.lit(family).alias("family"), F.inline(F.array(*(F.struct(F.concat(key, F.lit(c)).alias("feature"), F.col(c).cast("double").alias("value")) for c in names))))
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("no features are named")
    return out


@recipe("radiomics", ("images", "masks"), ("bin_width", "families", "pattern", "each_label"))
def traditional_radiomics(spark: SparkSession, config: dict) -> DataFrame:
    """Radiomics of images within masks of the same file name, of the whole mask or of each of its labels."""
    pattern = config.get("pattern") or "*.nrrd"
    image = volumes.cells(spark, config["images"], pattern, _name())
    mask = _labels(spark, config["masks"], pattern).where("label <> 0")
    # a cell of the mask without an image value has the value 0
    rows = mask.join(image, ["subject", "z", "y", "x"], "left").na.fill({"value": 0.0})
    by = ["subject", "label"] if config.get("each_label") else ["subject"]
    return radiomics.features(rows, by, "value", float(config.get("bin_width") or 25.0), ["subject"], tuple(config.get("families") or radiomics.FAMILIES))


@recipe("icc", ("files", "id"), ("features",))
def icc_analysis(spark: SparkSession, config: dict) -> DataFrame:
    """Reliability of every feature that all files share, over the ids that all share: (feature, n, k, coefficients)."""
    frames = {p: read_table(spark, p) for p in config["files"]}
    key = config["id"]
    common = tables.common_ids(list(frames.values()), key)
    names = [c for c in tables.common_columns(list(frames.values())) if c != key and (not config.get("features") or c in config["features"])]
    if not names:
        raise ValueError("the files share no features")
    long = None
    for path, df in frames.items():
        part = df.join(common, key, "left_semi").select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot([key], names, "feature", "value").withColumn("rater", F.lit(path))
        long = part if long is None else long.unionByName(part)
    # a target without a value from every file is left out of its feature
    whole = long.where("value is not null").groupBy("feature", key).agg(F.count("*").alias("n")).where(F.col("n") == len(frames)).select("feature", key)
    return reliability.icc(long.join(whole, ["feature", key], "left_semi"), key, "rater", "value", ["feature"])


@recipe("retest", ("test", "retest", "habitat", "features"))
def test_retest_analysis(spark: SparkSession, config: dict) -> DataFrame:
    """For each region of the first table the most similar one of the second."""
    return reliability.retest_mapping(read_table(spark, config["test"]), read_table(spark, config["retest"]), config["habitat"], config["features"])


@recipe("dice", ("a", "b"), ("pattern",))
def dice(spark: SparkSession, config: dict) -> DataFrame:
    """(subject, label, dice) of label maps with equal file names below two folders."""
    pattern = config.get("pattern") or "*.nrrd"
    return spatial.dice(_labels(spark, config["a"], pattern), _labels(spark, config["b"], pattern), "subject")


@recipe("compare", ("predictions", "id", "y", "models"), ("split",))
def compare_models(spark: SparkSession, config: dict) -> DataFrame:
    """(split, model, panel, auc) of every model's column of a table of predictions."""
    rows = read_table(spark, config["predictions"])
    split = config.get("split") or "split"
    if split not in rows.columns:
        rows = rows.withColumn(split, F.lit("all"))
    return comparison.panels(rows, config["models"], config["y"], split)


@recipe("delong", ("predictions", "id", "y", "models"))
def compare_pairs(spark: SparkSession, config: dict) -> DataFrame:
    """Every pair of models with AUCs, z and p."""
    rows = comparison.pairwise(read_table(spark, config["predictions"]), config["models"], config["y"], config["id"])
    return spark.createDataFrame([tuple(r[k] for k in ("a", "b", "auc_a", "auc_b", "z", "p")) for r in rows], "a string, b string, auc_a double, auc_b double, z double, p double")


@recipe("cv", ("input", "id", "y", "features", "model"), ("folds", "seed"))
def cross_validation(spark: SparkSession, config: dict) -> DataFrame:
    """(fold, id, y, prob) of every row from the model that was trained without its fold."""
    rows = tables.folds(read_table(spark, config["input"]), config["id"], int(config.get("folds") or 5), [config["y"]], int(config.get("seed") or 0))
    return models.cross_validate(rows, "fold", config["model"], config["features"], config["y"], [config["id"], config["y"]])


@recipe("model", ("input", "id", "y", "features", "model"), ("mode", "path"))
def train_or_predict(spark: SparkSession, config: dict) -> DataFrame:
    """Train a model (saved to ``path`` where one is named) and predict its rows, or predict with the saved one."""
    from pyspark.ml import PipelineModel

    rows = read_table(spark, config["input"])
    if config.get("mode") == "predict":
        fitted = PipelineModel.load(config["path"])
    else:
        fitted = models.train(rows, config["model"], config["features"], config["y"])
        if config.get("path"):
            fitted.write().overwrite().save(config["path"])
    return models.predict(fitted, rows, [config["id"], *([config["y"]] if config["y"] in rows.columns else [])])


@recipe("merge", ("files",), ("ids", "how", "separator"))
def merge_tables(spark: SparkSession, config: dict) -> DataFrame:
    """CSV files side by side."""
    return files.merge_files(spark, config["files"], config.get("ids"), config.get("how") or "inner", config.get("separator") or ",")


@recipe("dicom_info", ("input",), ("tags", "pattern", "one_per_folder"))
def dicom_info(spark: SparkSession, config: dict) -> DataFrame:
    """(path, a column for each tag, error) of DICOM files, or of the first one of each folder."""
    pattern = config.get("pattern") or "*.dcm"
    found = volumes.tags(spark, config["input"], pattern)
    if config.get("one_per_folder"):
        found = found.join(volumes.first_in_folder(spark, config["input"], pattern).select(F.url_encode("path").alias("__first")), F.url_encode(F.url_decode(F.regexp_replace("path", r"\+", "%2B"))) == F.col("__first"), "left_semi")
    return found.select("path", *(F.col("tags")[t.lower()].alias(t) for t in config.get("tags") or ("00100020", "00080060", "0020000e")), "error")


@recipe("sort_dicom", ("input",), ("pattern",))
def sort_dicom(spark: SparkSession, config: dict) -> DataFrame:
    """(path, target): where each DICOM file belongs, by patient, study date and series; unreadable ones under ``unreadable``."""
    tag = lambda t: F.coalesce(F.nullif(F.regexp_replace(F.col("tags")[t], r"[^\w.-]+", "_"), F.lit("")), F.lit("unknown"))
    target = F.when(F.col("error").isNotNull(), F.lit("unreadable")).otherwise(F.concat_ws("/", tag("00100020"), tag("00080020"), tag("0020000e")))
    return volumes.tags(spark, config["input"], config.get("pattern") or "*.dcm").select("path", F.concat_ws("/", target, F.element_at(F.split("path", "/"), -1)).alias("target"))


#: Steps of image preprocessing by name; each maps cells (subject, z, y, x, value) to cells.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "zscore": lambda c: images.zscore(c, ["subject"], "value"),
    "standardise": lambda c: images.standardise(c, ["subject"], "value"),
    "resample": lambda c, spacing, target: images.resample_linear(c, ["subject"], "value", spacing, target),
    "resample_nearest": lambda c, spacing, target: images.resample_nearest(c, ["subject"], spacing, target),
    "reorient": lambda c, source, target: images.reorient(c, ["subject"], source, target),
    "equalise": lambda c, **o: images.equalise(c, ["subject"], "value", **o),
}


def preprocess_image(cells: DataFrame, steps: list) -> DataFrame:
    """Cells after a chain of steps, each a name or {name: options}."""
    for step in steps:
        name, options = next(iter(step.items())) if isinstance(step, Mapping) else (step, {})
        if name not in STEPS:
            raise ValueError(f"no step {name}; there are {', '.join(STEPS)}")
        cells = STEPS[name](cells, **(options or {}))
    return cells


@recipe("preprocess", ("images", "steps"), ("pattern", "subject"))
def preprocess_images(spark: SparkSession, config: dict) -> DataFrame:
    """Images below a folder, of all subjects or one, after a chain of steps, as cells (subject, z, y, x, value)."""
    cells = volumes.cells(spark, config["images"], config.get("pattern") or "*.nrrd", _name())
    return preprocess_image(cells.where(F.col("subject") == config["subject"]) if config.get("subject") else cells, config["steps"])


@recipe("view", ("map",), ("pattern",))
def view(spark: SparkSession, config: dict) -> DataFrame:
    """(subject, label, voxels, extent) of label maps: what a viewer would show in numbers."""
    cells = _labels(spark, config["map"], config.get("pattern") or "*.nrrd")
    return cells.groupBy("subject", "label").agg(F.count("*").alias("voxels"), *(F.struct(F.min(a).alias("low"), F.max(a).alias("high")).alias(f"extent_{a}") for a in ("z", "y", "x")))


@recipe("habitat", ("input", "study"), ("predict",))
def get_habitat(spark: SparkSession, config: dict) -> DataFrame:
    """Fit a study and label its units, or label them with the one saved in the folder ``predict``."""
    df = read_table(spark, config["input"])
    study = workflows.Study.load(spark, config["predict"]) if config.get("predict") else workflows.Study(**config["study"]).fit(df)
    return study.predict(df)


def precise_voxel_features(cells: DataFrame, subject: str, value: str, radii: tuple[int, ...] = (1, 3), widths: tuple[float, ...] = (12.0, 25.0), base: tuple[int, float] = (3, 12.0), families: tuple[str, ...] = ("firstorder",), sigma: float = 1.0, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """(feature) of voxels that stay precise when the image is perturbed and when kernel radius or bin width change.

    The experiments are: the perturbed image against the image, every other radius and
    every other width against the base; a feature's lower limit is that of ICC(3,1) over
    all voxels, and it must reach the threshold in each.
    """
    def voxels(df: DataFrame, radius: int, width: float) -> DataFrame:
        found = radiomics.voxel_features(df, subject, value, width, radius, families)
        names = [c for c in found.columns if c not in (subject, "z", "y", "x")]
        return found.select(F.concat_ws("|", subject, "z", "y", "x").alias("voxel"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["voxel"], names, "feature", "value")

    radius, width = base
    plain = voxels(cells, radius, width)
    others = {"perturbed": voxels(perturb(cells, [subject], value, sigma, seed), radius, width)}
    others |= {f"radius {r}": voxels(cells, r, width) for r in radii if r != radius} | {f"width {w}": voxels(cells, radius, w) for w in widths if w != width}
    panels = None
    for name, other in others.items():
        both = plain.withColumn("rater", F.lit(0)).unionByName(other.withColumn("rater", F.lit(1))).where("value is not null")
        ms = reliability.mean_squares(both, "voxel", "rater", "value", ["feature"]).collect()
        rows = [(name, r["feature"], reliability.icc3_limits(r.asDict())[0]) for r in ms]
        part = cells.sparkSession.createDataFrame(rows, "experiment string, feature string, lcl double")
        panels = part if panels is None else panels.union(part)
    return reliability.precise_features(panels, threshold)


#: One perturbation by name, of cells (keys, z, y, x, value).
PERTURBATIONS: dict[str, Callable[..., DataFrame]] = {
    "noise": lambda c, by, value, seed, sigma=None: images.gaussian_noise(c, by, value, images.noise_sigma(c, by, value) if sigma is None else sigma, seed),
    "translate": lambda c, by, value, seed, shift=(0.0, 0.5, 0.5): images.translate(c, by, value, shift),
    "rotate": lambda c, by, value, seed, degrees=0.5: images.rigid(c, by, value, degrees),
    "rigid": lambda c, by, value, seed, degrees=0.5, shift=(0.0, 0.5, 0.5): images.rigid(c, by, value, degrees, shift),
}


def perturb_image(cells: DataFrame, by: list[str], value: str, method: str, seed: int = 0, **options) -> DataFrame:
    """One perturbation of an image by name."""
    if method not in PERTURBATIONS:
        raise ValueError(f"no perturbation {method}; there are {', '.join(PERTURBATIONS)}")
    return PERTURBATIONS[method](cells, by, value, seed, **options)


def perturb_chain(cells: DataFrame, by: list[str], value: str, steps: list[tuple[str, dict]], seed: int = 0) -> DataFrame:
    """Perturbations one after the other, each with a seed of its own."""
    for k, (method, options) in enumerate(steps):
        cells = perturb_image(cells, by, value, method, seed + k, **options)
    return cells


def perturb(cells: DataFrame, by: list[str], value: str, sigma: float | None = None, seed: int = 0, fraction: float = 0.5, degrees: float = 0.5) -> DataFrame:
    """A simulated second session: noise, a shift by a part of a voxel, a small turn in the plane."""
    shift = (fraction, fraction if seed % 2 else -fraction, fraction)
    return perturb_chain(cells, by, value, [("noise", {} if sigma is None else {"sigma": sigma}), ("translate", {"shift": shift}), ("rotate", {"degrees": degrees})], seed)


def map_cohort(df: DataFrame, subject: str, function: Callable, schema: str) -> DataFrame:
    """A pandas function for every subject; a subject that fails has one row with ``error`` and nulls, the others go on."""
    import pandas as pd

    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[subject].iloc[0]
        try:
            out = function(pdf)
            return out[[c for c in names if c != subject]].assign(**{subject: key}, error=None)[[subject, *(c for c in names if c != subject), "error"]]
        except Exception as error:
            return pd.DataFrame([{subject: key, **{c: None for c in names if c != subject}, "error": f"{type(error).__name__}: {error}"}])

    kind = dict(df.dtypes)[subject]
    rest = [x.strip() for x in schema.split(",") if x.strip().split()[0] != subject]
    return df.groupBy(subject).applyInPandas(run, ", ".join([f"{subject} {kind}", *rest, "error string"]))


def subject_prefix(study: workflows.Study, df: DataFrame) -> DataFrame:
    """The units of a study after the stages within subjects only: features, subject preprocessing, pooling."""
    return study._units(df)


def prep_steps() -> list[str]:
    """Names of the preprocessing methods that descriptions may use."""
    return sorted(prep.METHODS)
