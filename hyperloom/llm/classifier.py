"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .shared import lean, stored

#: Random features, the kernel's width in standard deviations, the ridge, and the generator's seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1.0, 11
#: Most labelled rows that are fitted on; beyond, rows are chosen by a hash of doc_id.
MOST_FIT = 200_000
#: Most rows that calibrate, chosen alike, and tasks that sum the normal equations.
MOST_CALIBRATE, FIT_TASKS = 50_000, 16
#: What the uncalibrated score adds, so that rows of one calibrated level keep their order.
BLEND = 0.02
THRESHOLD = 0.7


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 4; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def statistics() -> list[Column]:
    """The document statistics: shares, means and logarithms of the measurements; 0 where there are no words."""
    share = lambda a, b: F.least(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), F.lit(20.0))
    log = lambda a: F.log1p(F.col(a).cast("double"))
    return [
        log("n_words"), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
        share("n_upper", "n_letters"), share("n_marks", "n_words"), share("n_letters", "word_chars"), log("n_lines"), F.log1p(F.coalesce(F.try_divide(F.col("n_words").cast("double"), F.col("n_lines")), F.lit(0.0))),
    ]


@dataclass
class Model:
    mean: object
    scale: object
    weights: object
    levels: tuple

    def features(self, x):
        """Cosines whose inner products approximate the Gaussian kernel of the standardised statistics, and a constant."""
        import numpy as np

        rng = np.random.default_rng(SEED)
        w, b = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ w + b)
        return np.hstack((z, np.ones((len(x), 1))))

    def raw(self, x):
        import numpy as np

        return np.clip(self.features(x) @ self.weights, 0, 1)

    def score(self, x):
        import numpy as np

        raw = self.raw(x)
        return np.clip((1 - BLEND) * np.interp(raw, *self.levels) + BLEND * raw, 0, 1)


def isotonic(score, label) -> tuple:
    """The increasing step function of score closest to label, by pooling adjacent violators: (places, values)."""
    import numpy as np

    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order]):
        blocks.append([s, float(y), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s, y, n = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[2] + s * n) / (last[2] + n)
            last[1] += y
            last[2] += n
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


def _arrays(batch: pa.RecordBatch):
    import numpy as np

    x = batch.column("x")
    return np.asarray(x.flatten(), "f8").reshape(len(x), -1)


def fit(labelled: DataFrame, calibrate: int = MOST_CALIBRATE) -> Model:
    """The model of rows (x, y, part), where part 1 calibrates and part 0 is fitted; stored. Without rows of a part the
    other's serve; without any, every score is 0.5. About ``calibrate`` rows at most calibrate."""
    import numpy as np

    n, moments = labelled.count(), None
    d = len(statistics())
    if n:
        both = [f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(d)]
        moments = np.array(labelled.agg(*both).first(), "f8").reshape(2, d)
    mean, scale = (moments[0], np.where(moments[1] > 1e-9, moments[1], 1)) if n else (np.zeros(d), np.ones(d))
    model = Model(mean, scale, np.zeros(FEATURES + 1), ([0.0], [0.5]))
    if not n:
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = model.features(_arrays(batch)), batch.column("y").to_numpy(zero_copy_only=False)
            gram += z.T @ z
            moment += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel()]), pa.array([moment])], ["gram", "moment"])

    fitted = labelled.where("part = 0")
    fitted = fitted if fitted.take(1) else labelled
    parts = fitted.select("x", "y").repartition(FIT_TASKS).mapInArrow(lean(sums), "gram array<double>, moment array<double>").collect()
    gram, moment = (np.sum([np.array(p[i]) for p in parts], axis=0) for i in (0, 1))
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram.reshape(FEATURES + 1, -1) + penalty, moment)
    held = labelled.where("part = 1")
    held = held if held.take(1) else labelled
    share = int((1 << 30) * min(1.0, calibrate / held.count()))
    some = held.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < share).select("x", "y").collect()
    held = some or held.select("x", "y").take(calibrate)
    x, y = np.array([r[0] for r in held], "f8"), np.array([r[1] for r in held], "f8")
    model.levels = isotonic(model.raw(x), y)
    return model


def scores(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, calibrate: int = MOST_CALIBRATE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Statistics are of the whole text; neither labels, lang, source nor doc_id is one. Labels (doc_id, quality) count if
    their doc_id's fold isn't 2; fold 3 calibrates. Of more than about ``most``, rows are chosen by a hash of doc_id; of
    fold 3, about ``calibrate`` of them at most calibrate, chosen by a hash of their statistics. A score is the calibrated
    one, with BLEND of the uncalibrated so that rows of one calibrated level keep their order.
    Null quality and unknown doc_ids are left out; of a doc_id's several labels all count. Null and empty texts have
    the statistics 0 and a score like others; repeated rows get the same score; an empty table gives no rows.
    """
    stats = rules.measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    stats = stored(stats.select("doc_id", fold().alias("fold"), F.array(*statistics()).alias("x")), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & (fold() != 2))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    labelled = stored(stats.where("fold <> 2").join(known, "doc_id").select("x", "y", (F.col("fold") == 3).cast("int").alias("part")), "labelled")
    model = fit(labelled, calibrate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                score = pa.array(model.score(_arrays(batch)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), score], ["doc_id", "held_out", "score"])

    found = stats.select("doc_id", (F.col("fold") == 2).alias("held_out"), "x").mapInArrow(lean(run), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
