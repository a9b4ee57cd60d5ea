"""Classifiers over feature columns with MLlib, their probabilities by class, stacking and cascades.

Training and scoring are distributed by MLlib. Probabilities come out as ``{name}_prob_{class}`` columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import votes as V
from lineweave.operators.ranks import unit_hash


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def label_index(df: DataFrame, classes: Sequence[str], label: str = "label", out: str = "label_idx") -> DataFrame:
    """Index of the label in the sorted class list; an unknown label is an error."""
    return StringIndexerModel.from_labels(sorted(classes), inputCol=label, outputCol=out, handleInvalid="error").transform(df)


@dataclass
class Scored:
    """A trained classifier: ``transform`` adds ``{name}_prob_{class}`` and ``{name}_pred``."""

    name: str
    classes: list[str]
    models: list[Model]
    scaler: Model | None = None
    calibrators: list[Model] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        rest = df.columns
        x = self.scaler.transform(df) if self.scaler else df
        if len(self.models) == 1:
            x = self.models[0].setPredictionCol("_prediction").transform(x)
            probs = vector_to_array(F.col("probability"))
        else:
            for i, model in enumerate(self.models):
                x = model.setPredictionCol(f"_p{i}").transform(x).withColumnRenamed("rawPrediction", f"_raw{i}").drop("probability")
            margins = [vector_to_array(F.col(f"_raw{i}"))[1] for i in range(len(self.models))]
            ones = [_platt(m, self.calibrators[i]) if self.calibrators else 1.0 / (1.0 + F.exp(-2.0 * m)) for i, m in enumerate(margins)]
            total = sum(ones[1:], start=ones[0])
            probs = F.array(*[F.try_divide(o, total) for o in ones])
        x = x.withColumn("_probs", probs)
        cols = {f"{self.name}_prob_{c}": F.coalesce(F.get("_probs", F.lit(i)), F.lit(0.0)) for i, c in enumerate(self.classes)}
        x = x.withColumns(cols)
        best = V.choose_label({c: F.col(f"{self.name}_prob_{c}") for c in self.classes}, "enabled", self.classes)["label"]
        return x.withColumn(f"{self.name}_pred", best).select(*rest, *cols, f"{self.name}_pred")


def _platt(margin: Column, model) -> Column:
    return 1.0 / (1.0 + F.exp(-(float(model.coefficients[0]) * margin + float(model.intercept))))


def train_rf(df: DataFrame, classes: Sequence[str], weight: str = "weight", trees: int = 100, depth: int = 10, seed: int = 42) -> Scored:
    rf = RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol=weight, numTrees=trees, maxDepth=depth, seed=seed)
    return Scored("rf", sorted(classes), [rf.fit(df)])


def train_boosted(df: DataFrame, classes: Sequence[str], is_val: str, weight: str = "weight", rounds: int = 50, depth: int = 4, seed: int = 42,
                  name: str = "xgb") -> Scored:
    """One boosted model for each class against the rest, each stopped early on the rows where ``is_val`` is true."""
    models = []
    for i, _ in enumerate(sorted(classes)):
        one = df.withColumn("_y", (F.col("label_idx") == float(i)).cast("double"))
        gbt = GBTClassifier(featuresCol="features", labelCol="_y", weightCol=weight, validationIndicatorCol=is_val, maxIter=rounds, maxDepth=depth, seed=seed)
        models.append(gbt.fit(one))
    return Scored(name, sorted(classes), models)


def train_svm(df: DataFrame, classes: Sequence[str], key: str, weight: str = "weight", folds: int = 5, iters: int = 50) -> Scored:
    """Scaled linear margin for each class, with a sigmoid fitted on margins of rows the margin model has not seen."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True).fit(df)
    scaled = scaler.transform(df).withColumn("_fold", F.floor(unit_hash(F.col(key), seed=11) * folds))
    models, sigmoids = [], []
    for i, _ in enumerate(sorted(classes)):
        one = scaled.withColumn("_y", (F.col("label_idx") == float(i)).cast("double"))
        svc = LinearSVC(featuresCol="scaled", labelCol="_y", weightCol=weight, maxIter=iters, standardization=False)
        held = None
        for fold in range(folds):
            scored = svc.fit(one.where(F.col("_fold") != fold)).transform(one.where(F.col("_fold") == fold)).select(
                "_y", vector_to_array(F.col("rawPrediction"))[1].alias("margin"))
            held = scored if held is None else held.unionByName(scored)
        sigmoids.append(LogisticRegression(featuresCol="m", labelCol="_y", maxIter=20).fit(assemble(held, ["margin"], "m")))
        models.append(svc.fit(one))
    return Scored("svm", sorted(classes), models, scaler, sigmoids)


def train_mlp(df: DataFrame, classes: Sequence[str], n_features: int, hidden: Sequence[int] = (512, 256), iters: int = 100, seed: int = 42) -> Scored:
    """Multilayer perceptron on scaled features. It takes no weights: resample the rows first (``weighted_resample``)."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True).fit(df)
    mlp = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label_idx", layers=[n_features, *hidden, len(classes)], maxIter=iters, seed=seed)
    return Scored("mlp", sorted(classes), [mlp.fit(scaler.transform(df))], scaler)


def stack_columns(names: Sequence[str], classes: Sequence[str], features: Sequence[str]) -> list[str]:
    return [f"{n}_prob_{c}" for n in names for c in sorted(classes)] + list(features)


def stack_train(df: DataFrame, base: Sequence[Scored], classes: Sequence[str], features: Sequence[str], is_val: str, rounds: int = 30) -> Scored:
    """Boosted meta model over base probabilities and features. ``df`` must not hold rows the base models were trained on."""
    x = df
    for model in base:
        x = model.transform(x)
    x = assemble(x.drop("features"), stack_columns([m.name for m in base], classes, features))
    return train_boosted(x, classes, is_val, rounds=rounds, depth=3, name="meta")


def stack_score(df: DataFrame, base: Sequence[Scored], meta: Scored, features: Sequence[str]) -> DataFrame:
    """Adds ``label``, ``confidence`` and the meta probabilities; a row that cannot be scored gets the label ERROR."""
    x = df
    for model in base:
        x = model.transform(x)
    x = meta.transform(assemble(x.drop("features"), stack_columns([m.name for m in base], meta.classes, features)))
    best = V.choose_label({c: F.col(f"meta_prob_{c}") for c in meta.classes}, "enabled", meta.classes)
    return x.withColumn("_b", best).withColumns({
        "confidence": F.col("_b.p"), "label": F.when(F.coalesce(F.col("_b.p"), F.lit(0.0)) > 0, F.col("_b.label")).otherwise("ERROR")}).drop("_b", "features")


def cascade_score(df: DataFrame, gate: Scored, kind: Scored, positive: str = "P") -> DataFrame:
    """Gate probability times type probability for each type, and N from the gate."""
    x = kind.transform(gate.transform(df))
    p = F.col(f"{gate.name}_prob_{positive}")
    return x.withColumns({"cascade_prob_N": 1.0 - p, **{f"cascade_prob_{c}": p * F.col(f"{kind.name}_prob_{c}") for c in kind.classes}})


def score_with(df: DataFrame, fn, schema: str) -> DataFrame:
    """Hand Arrow batches to an outside scorer; ``fn`` maps an iterator of pandas frames to one."""
    return df.mapInPandas(fn, schema)
