"""Runs a configuration: reads its matrices, trains, and logs each reported epoch."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import config as C
from ..sources.csv import append_log, hardware
from ..sources.storage import stored
from ..types import Coo, Dense
from . import model, optim
from .preprocess import read_features, read_labels, read_sparse


def run(spark: SparkSession, cfg: C.Config, log: str | None = None, run_id: str | None = None, seed: int = 0) -> tuple[dict, list[model.Epoch]]:
    """Rows before ``test_idx`` are the training rows. Distributed runs use SGD with the early decay and start weights by
    input width; others Adam and start weights by output width, with dropout. Learnable hyperedge weights start at 1."""
    import numpy as np

    data, m, t, run_id = cfg.data, cfg.model, cfg.trainer, run_id or uuid.uuid4().hex
    x = read_features(spark, data.features_path)
    n, d = x.shape()
    x = Dense(stored(x.df), n, d)
    labels = read_labels(spark, data.labels_path)
    dims = [d, *m.hidden_dims, m.classes]
    params = model.init(dims, m.with_bias, "in" if m.distributed else "out", seed, 1.0 if m.distributed and m.learnable_w else None)
    if m.learnable_w:
        left, right = read_sparse(spark, data.dvh_path), read_sparse(spark, data.invde_ht_dvh_path)
        params["w"] = np.ones(max(left.shape()[1], right.shape()[0]))
        how = model.Factored(Coo(stored(left.df)), Coo(stored(right.df)))
    elif data.g_path:
        how = model.Fixed(Coo(stored(read_sparse(spark, data.g_path).df)))
    else:
        from ..operators.sparse import spgemm

        how = model.Fixed(Coo(stored(spgemm(read_sparse(spark, data.dvh_path), read_sparse(spark, data.invde_ht_dvh_path)).df)))
    net = model.Network(how, dims, m.with_bias, dropout=0.0 if m.distributed else m.dropout_rate, seed=seed)
    s = cfg.lr_scheduler
    decay = optim.early_step_lr if m.distributed else optim.step_lr
    optimiser = optim.Sgd(t.learning_rate) if m.distributed else optim.Adam(t.learning_rate)
    params, epochs = model.train(net, x, labels, F.col("row") < data.test_idx, params, optimiser, t.epochs, lambda e: decay(t.learning_rate, e, s.step_size, s.gamma), t.output_stepsize)
    if log:
        append_log(spark, f"{log}/main_training_hw", run_id=run_id, **hardware(spark, m.distributed))
        append_log(spark, f"{log}/main_training_info", run_id=run_id, learnable_w=m.learnable_w, hidden_dims=str(m.hidden_dims), with_bias=m.with_bias, dropout_rate=float(m.dropout_rate), epochs=t.epochs, dataset=data.dataset)
        for e in epochs:
            append_log(spark, f"{log}/main_training", run_id=run_id, epoch=e.epoch, ms=int(e.ms), train_loss=e.train_loss, test_loss=e.test_loss, test_acc=e.test_acc, test_f1=e.test_f1)
    return params, epochs


def example(spark: SparkSession, x: Dense, labels: DataFrame, how: model.Fixed | model.Factored, hidden: list[int], classes: int, test_idx: int, epochs: int = 1000, log: str | None = None, run_id: str = "example") -> tuple[dict, list[model.Epoch]]:
    """The example preset: SGD at 0.1, constant for a hundred epochs and then times 0.8 every fifth; rows before ``test_idx``
    train. With ``log``, run_id, cpus, epoch, ms and loss of each epoch are added to it."""
    import numpy as np

    n, d = x.shape()
    net = model.Network(how, [d, *hidden, classes])
    params = model.init(net.dims)
    if isinstance(how, model.Factored):
        params["w"] = np.ones(max(how.left.shape()[1], how.right.shape()[0]))
    params, found = model.train(net, x, labels, F.col("row") < test_idx, params, optim.Sgd(0.1), epochs, lambda e: optim.warm_lr(0.1, e))
    if log:
        cpus = spark.sparkContext.defaultParallelism
        rows = [(run_id, cpus, e.epoch, int(e.ms), e.train_loss) for e in found]
        spark.createDataFrame(rows, "run_id string, cpus int, epoch int, ms long, loss double").coalesce(1).write.mode("append").parquet(log)
    return params, found


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    with open(sys.argv[1], encoding="utf-8") as f:
        for epoch in run(session, C.parse(f.read(), sys.argv[2] if len(sys.argv) > 2 else None), sys.argv[3] if len(sys.argv) > 3 else None)[1]:
            print(epoch)
