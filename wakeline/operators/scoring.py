"""Model-bearing steps: batch scoring with any model, and Spark ML classifiers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.scalars import argmax
from wakeline.operators.metrics import class_weights, evaluate_predictions, frame_accuracy
from wakeline.operators.segments import SEG, SEGMENT_ROWS, cut, halo, stage_folder
from wakeline.operators.splits import held_out_rows, subject_folds, train_rows

#: Windows handed to a model at once.
_VIEWS = 4096

# --- Scoring with a model that is loaded once per task ------------------------------------


def batch_scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]], returns: str):
    """Column function over an array column; ``load`` builds the model once per task.

    The model maps a (rows, …) float32 array to one result per row. Null inputs are not
    scored and give null.
    """

    @F.pandas_udf(returns)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            given = batch.notna().to_numpy()
            if given.any():
                stacked = np.stack([np.array(list(v), dtype=np.float32) for v in batch[given]])
                out[given] = list(np.asarray(model(stacked)))
            yield out

    return score


def onnx_loader(path: str, output: int = 0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Loader of an ONNX file that every executor can read."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: np.asarray(session.run(None, {name: batch})[output])

    return load


def window_levels(
    frames: DataFrame,
    keys: Sequence[str],
    frame: str,
    columns: Sequence[str],
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    window: int,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """(keys, frame, level): class of every frame's last ``window`` frames, 0 until there are so many.

    ``load`` builds a model from (windows, window, columns) float32 arrays to one level per
    window, once per task. A frame goes to Python once, and the ``window - 1`` frames before a
    segment once more; windows are views of the segment's array, never copies of the rows.
    """
    wide = halo(frames.select(*keys, frame, *columns), frame, before=window - 1, rows=rows)
    models: list = []

    def score(part: pd.DataFrame) -> pd.DataFrame:
        if not models:
            models.append(load())
        part = part.sort_values(frame, ignore_index=True)
        values = part[list(columns)].to_numpy(dtype=np.float32)
        levels = np.zeros(len(part), dtype=np.int32)
        if len(part) >= window:
            views = np.lib.stride_tricks.sliding_window_view(values, window, axis=0).transpose(0, 2, 1)
            for lo in range(0, len(views), _VIEWS):
                batch = views[lo : lo + _VIEWS]
                levels[window - 1 + lo : window - 1 + lo + len(batch)] = np.asarray(models[0](batch))
        out = part[[*keys, frame]].copy()
        out["level"] = levels
        return out[(part[frame] // rows == part[SEG]).to_numpy()]

    plain = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys, frame).schema]
    return wide.groupBy(*keys, SEG).applyInPandas(score, ", ".join([*plain, "level int"]))


# --- Spark ML ------------------------------------------------------------------------------


def assemble(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")


def as_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


class BoostedClasses:
    """Boosted trees for several classes: one binary model a class, scores normalised."""

    def __init__(self, models: Sequence) -> None:
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, model in enumerate(self.models):
            scored = model.transform(out)
            out = scored.withColumn(f"_p{i}", vector_to_array("probability")[1]).drop(
                "rawPrediction", "probability", "prediction"
            )
        raw = [F.col(f"_p{i}") for i in range(len(self.models))]
        total = sum(raw[1:], raw[0])
        scores = F.array(*[r / total for r in raw])
        named = out.withColumn("scores", scores).withColumn("prediction", argmax(F.col("scores")))
        return named.drop(*[f"_p{i}" for i in range(len(self.models))])


def fit_boosted(
    train: DataFrame,
    label: str,
    n_classes: int,
    features: str = "features",
    seed: int = 0,
    max_iter: int = 20,
    max_depth: int = 3,
    step: float = 0.1,
) -> BoostedClasses:
    """The models know nothing of each other, so their many short jobs run side by side."""

    def fit(c: int):
        one = train.withColumn("_is", (F.col(label) == c).cast("double"))
        trees = GBTClassifier(
            labelCol="_is",
            featuresCol=features,
            maxIter=max_iter,
            maxDepth=max_depth,
            stepSize=step,
            seed=seed,
        )
        return trees.fit(one)

    with ThreadPoolExecutor(n_classes) as pool:
        return BoostedClasses(pool.map(inheritable_thread_target(train.sparkSession)(fit), range(n_classes)))


def evaluate_boosted_windows(
    train: DataFrame,
    validate: DataFrame,
    columns: Sequence[str],
    label: str,
    n_classes: int,
    alarm_class: int | None = None,
    **params: object,
) -> DataFrame:
    """Boosted baseline on window features: fit on train, metrics bundle on validation.

    Trees split on order alone, so standardising the features would not change them. Windows and
    scores are written once: every model reads the windows several times, every metric the scores.
    """
    vectors = assemble(columns)
    fitted = fit_boosted(cut(vectors.transform(train).select("features", label)), label, n_classes, **params)
    scored = fitted.transform(vectors.transform(validate).select("features", label))
    scored = cut(scored.select(label, "prediction", "scores"))
    alarm = n_classes - 1 if alarm_class is None else alarm_class
    return evaluate_predictions(scored, label, "prediction", "scores", n_classes, alarm)


def leave_one_subject_out(
    corpus: DataFrame,
    subject: str,
    fit: Callable[[DataFrame], object],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Pooled predictions, every subject predicted by a model that never saw them.

    ``fit`` takes training rows and returns a model with ``transform``. Each subject costs
    one fit, by the definition of the method. Folds are read one at a time and the
    predictions of each are written, so neither the list of subjects nor a plan that grows
    with it is held. ``columns`` of the predictions are kept (all plain ones by default).
    """
    spark = corpus.sparkSession
    path = f"{stage_folder(spark)}/folds-{uuid.uuid4().hex}"
    for fold in subject_folds(corpus, subject).select("held_out").toLocalIterator():
        model = fit(train_rows(corpus, fold["held_out"], subject))
        scored = model.transform(held_out_rows(corpus, fold["held_out"], subject))
        kept = columns or [f.name for f in scored.schema if not isinstance(f.dataType, VectorUDT)]
        scored.select(*kept).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def leave_one_subject_out_discriminant(
    corpus: DataFrame,
    subject: str,
    label: str,
    features: str,
    out: str = "prediction",
    least_variance: float = 1e-12,
) -> DataFrame:
    """Adds the class that a linear discriminant fitted on all other subjects predicts.

    Classes are normal with one variance per dimension. All a fold needs are counts, sums and
    sums of squares per class and dimension, which are those of the corpus less those of the
    subject: every fold is fitted by one aggregation, whatever the number of subjects, and a
    subject's model (classes x dimensions numbers) is a row that joins its vectors. Classes
    that no other subject has are never predicted. ``label`` numbers classes; rows without a
    subject are one subject, rows without label or vector are predicted null.
    """
    named = corpus.withColumns({"_s": F.col(subject).cast("string"), "_c": F.col(label).cast("int"), "_x": F.col(features).cast("array<double>")})
    entries = named.where(F.col("_c").isNotNull()).select("_s", "_c", F.posexplode("_x").alias("_d", "_v"))
    own = entries.groupBy("_s", "_c", "_d").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_v").alias("_m"), F.sum(F.col("_v") * F.col("_v")).alias("_q")
    )
    whole = own.groupBy("_c", "_d").agg(*[F.sum(c).alias(f"{c}t") for c in ("_n", "_m", "_q")])
    subjects = own.select("_s").distinct().withColumnRenamed("_s", "_f")
    # A row for each fold, class and dimension: the size of the models, not of the rows.
    folds = subjects.join(F.broadcast(whole)).join(
        own.withColumnsRenamed({"_c": "_co", "_d": "_do"}),
        F.col("_f").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_co")) & (F.col("_d") == F.col("_do")),
        "left",
    )
    rest = {c: F.col(f"{c}t") - F.coalesce(c, F.lit(0.0)) for c in ("_n", "_m", "_q")}
    folds = folds.select("_f", "_c", "_d", *[v.alias(c) for c, v in rest.items()]).where("_n > 0")
    fold = W.partitionBy("_f", "_d")
    spread = (F.sum("_q").over(fold) - F.sum(F.col("_m") * F.col("_m") / F.col("_n")).over(fold)) / F.sum("_n").over(fold)
    folds = folds.withColumns({"_var": F.greatest(spread, F.lit(least_variance)), "_all": F.sum("_n").over(fold)})
    mean = F.col("_m") / F.col("_n")
    classes = folds.groupBy("_f", "_c").agg(
        (F.max(F.ln(F.col("_n") / F.col("_all"))) - F.sum(mean * mean / F.col("_var")) / 2).alias("_bias"),
        F.array_sort(F.collect_list(F.struct("_d", (mean / F.col("_var")).alias("_w")))).alias("_w"),
    )
    models = classes.groupBy("_f").agg(F.collect_list(F.struct("_c", "_bias", "_w")).alias("_models"))

    def score(m: Column) -> Column:
        parts = F.zip_with(m["_w"], F.col("_x"), lambda w, x: w["_w"] * x)
        return F.struct((m["_bias"] + F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)).alias("score"), m["_c"].alias("of"))

    known = named.join(models, F.col("_s").eqNullSafe(F.col("_f")), "left")
    best = F.array_max(F.transform("_models", score))["of"]
    return known.select(*corpus.columns, F.when(F.col("_c").isNotNull() & F.col("_x").isNotNull(), best).alias(out))


def run_sweep(
    spark,
    train: DataFrame,
    validate: DataFrame,
    grid: Sequence[Mapping[str, object]],
    evaluate: Callable[..., DataFrame],
) -> DataFrame:
    """One metrics row per configuration: (grid_pos, config, metrics…)."""
    out: DataFrame | None = None
    for position, config in enumerate(grid):
        entries = [F.lit(str(x)) for pair in config.items() for x in pair]
        row = evaluate(train, validate, **config).select(
            F.lit(position).alias("grid_pos"), F.create_map(*entries).alias("config"), "*"
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("the sweep grid is empty")
    return out


def fit_linear_head(
    train: DataFrame,
    validate: DataFrame,
    label: str = "label_index",
    features: str = "features",
    penalties: Sequence[float] = (0.0, 0.01, 0.1),
    max_iter: int = 50,
):
    """Multinomial linear classifier on cached vectors; the best on validation is kept."""
    best, tried = linear_head_sweep(train, validate, label, features, penalties, max_iter)
    return best, max(tried.values())


def linear_head_sweep(
    train: DataFrame,
    validate: DataFrame,
    label: str = "label_index",
    features: str = "features",
    penalties: Sequence[float] = (0.0, 0.01, 0.1),
    max_iter: int = 50,
) -> tuple[object, dict[float, float]]:
    """The best linear classifier (the first on a tie), and the accuracy of every penalty."""
    tried: dict[float, float] = {}
    vectors = as_vector(train, features, "_v").select("_v", label)
    held = as_vector(validate, features, "_v").select("_v", label)
    best, best_accuracy = None, -1.0
    for penalty in penalties:
        head = LogisticRegression(
            featuresCol="_v", labelCol=label, family="multinomial", regParam=penalty, maxIter=max_iter
        ).fit(vectors)
        accuracy = frame_accuracy(head.transform(held), label, "prediction").first()["accuracy"]
        tried[penalty] = accuracy
        if accuracy > best_accuracy:
            best, best_accuracy = head, accuracy
    return best, tried


def fit_zone_model(train: DataFrame, label: str = "label", features: str = "features"):
    """Gaze-zone classifier with fixed parameters: multinomial linear, lightly penalised."""
    model = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=0.01, maxIter=50)
    return model.fit(train.select(label, features))


def fit_event_classifier(
    events: DataFrame,
    label: str = "label",
    features: str = "features",
    class_weighted: bool = True,
    max_iter: int = 50,
):
    """Two-class event classifier, rare events weighted up; see `score_events`."""
    vectors = as_vector(events, features, "_v").select("_v", label)
    head = LogisticRegression(featuresCol="_v", labelCol=label, maxIter=max_iter)
    if class_weighted:
        weights = class_weights(vectors, label, 2).select(F.col("class").alias(label), "weight")
        vectors = vectors.join(F.broadcast(weights), [label])  # two rows
        head = head.setWeightCol("weight")
    return head.fit(vectors)


def score_events(model, events: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``score``, the probability of the positive class."""
    scored = model.transform(as_vector(events, features, "_v"))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "_v", "rawPrediction", "probability", "prediction"
    )
