"""Feature archives in MATLAB files: two feature matrices, labels and a training flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Positions of the features in the archive's cell X.
FEATURES = {"MVCNN": 0, "GVCNN": 1}


def archive(content, feature: str):
    """(matrix, labels from 0, training flags) of a loaded archive with X, Y and indices; labels from 1 are moved to 0."""
    import numpy as np

    if feature not in FEATURES:
        raise ValueError(f"no feature {feature}: {', '.join(FEATURES)}")
    labels = np.asarray(content["Y"]).ravel().astype("i8")
    if len(labels) and labels.min() == 1:
        labels = labels - 1
    return np.asarray(content["X"][0][FEATURES[feature]], "f8"), labels, np.asarray(content["indices"]).ravel() == 1


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training rows and the others, by is_train."""
    return rows.where("is_train"), rows.where("NOT is_train")


def load(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """row, vec, label, is_train. The archive is one file of one machine's memory and is read on the driver; SciPy does so."""
    from scipy.io import loadmat

    x, y, train = archive(loadmat(path), feature)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), bool(train[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "row long, vec array<double>, label int, is_train boolean")
