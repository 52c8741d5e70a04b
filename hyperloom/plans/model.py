"""Hypergraph convolution networks with explicit gradients.

Vertices' features, activations and gradients are relations (row, vec); weights are small arrays that the driver keeps and
sends out each epoch. Both propagation forms stay n by d: the product S (X W) with S given, or L (w (R (X W))) with S's
factors and learnable hyperedge weights w.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import dense as D
from ..operators import loss as L
from ..operators import sparse as S
from ..sources.storage import released, stored
from ..types import Coo, Dense


def init(dims: list[int], bias: bool = True, by: str = "in", seed: int = 0, constant_bias: float | None = None) -> dict:
    """Weights W0.. and biases b0.., uniform within 1 / sqrt(fan), by input or output width; biases are ``constant_bias`` if given."""
    import numpy as np

    params = {}
    for i, (n, m) in enumerate(zip(dims, dims[1:])):
        rng, limit = np.random.default_rng([seed, i]), 1 / (n if by == "in" else m) ** 0.5
        params[f"W{i}"] = rng.uniform(-limit, limit, (n, m))
        if bias:
            params[f"b{i}"] = rng.uniform(-limit, limit, m) if constant_bias is None else np.full(m, float(constant_bias))
    return params


@dataclass
class Fixed:
    """Propagation by a given S."""

    s: Coo

    def forward(self, x: Dense, params: dict) -> Dense:
        return _kept(S.spmm(self.s, x))

    def backward(self, g: Dense, x: Dense, params: dict) -> tuple[Dense, object]:
        return _kept(S.spmm(S.transpose(self.s), g)), None


@dataclass
class Factored:
    """Propagation by L diag(w) R with w = params["w"]; the gradient of w needs no square matrix."""

    left: Coo
    right: Coo

    def _weighted(self, x: Dense, w) -> Dense:
        told = x.df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "row long, w double")
        df = x.df.join(F.broadcast(told) if len(w) <= D.MOST_CELLS else told, "row")
        return Dense(df.select("row", V.scale("vec", F.col("w")).alias("vec")), x.n_rows, x.n_cols)

    def forward(self, x: Dense, params: dict) -> Dense:
        return _kept(S.spmm(self.left, self._weighted(S.spmm(self.right, x), params["w"])))

    def backward(self, g: Dense, x: Dense, params: dict) -> tuple[Dense, object]:
        import numpy as np

        up, across = _kept(S.spmm(S.transpose(self.left), g)), S.spmm(self.right, x)
        dw = np.zeros(len(params["w"]))
        met = up.df.join(across.df.select("row", F.col("vec").alias("v")), "row").select("row", V.dot("vec", "v").alias("d"))
        for row, d in met.toLocalIterator():
            dw[row] = d
        return _kept(S.spmm(S.transpose(self.right), self._weighted(up, params["w"]))), dw


def _kept(x: Dense) -> Dense:
    """Written to the shared folder, so that plans don't grow with layers and epochs."""
    return Dense(stored(x.df), x.n_rows, x.n_cols)


@dataclass
class Network:
    """Layers relu(P(X W + b)), the last without relu; ``propagate_last`` False leaves its propagation out too."""

    propagation: Fixed | Factored
    dims: list[int]
    bias: bool = True
    propagate_last: bool = True
    dropout: float = 0.0
    seed: int = 0
    cache: list = field(default_factory=list, repr=False)

    @property
    def depth(self) -> int:
        return len(self.dims) - 1

    def forward(self, x: Dense, params: dict, epoch: int | None = None) -> Dense:
        """The logits; with ``epoch``, in training mode: dropout applies after hidden layers. Vertices that no hyperedge
        holds have no row after a propagation."""
        self.cache = []
        for i in range(self.depth):
            last = i == self.depth - 1
            z = D.times_local(x, params[f"W{i}"])
            z = D.add_bias(z, params[f"b{i}"]) if self.bias else z
            out = self.propagation.forward(z, params) if not last or self.propagate_last else _kept(z)
            self.cache.append((x, z, out))
            if not last:
                x = D.map_rows(out, V.relu)
                if epoch is not None and self.dropout:
                    x = Dense(x.df.select("row", V.dropout("vec", "row", self.dropout, self.seed + i, epoch).alias("vec")), x.n_rows, x.n_cols)
        return out

    def backward(self, grad: Dense, params: dict, epoch: int | None = None) -> dict:
        """Gradients of all parameters from that of the logits; a layer's input gradient uses its weights before any update."""
        import numpy as np

        grads: dict = {}
        for i in reversed(range(self.depth)):
            x, z, out = self.cache[i]
            if i < self.depth - 1:
                met = grad.df.join(out.df.select("row", F.col("vec").alias("o")), "row")
                vec = V.hadamard("vec", V.relu_grad("o"))
                if epoch is not None and self.dropout:
                    vec = V.dropout(vec, "row", self.dropout, self.seed + i, epoch)
                grad = Dense(met.select("row", vec.alias("vec")), grad.n_rows, grad.n_cols)
            if i < self.depth - 1 or self.propagate_last:
                grad, dw = self.propagation.backward(grad, z, params)
                if dw is not None:
                    grads["w"] = grads.get("w", 0.0) + dw
            else:
                grad = _kept(grad)
            known = Dense(x.df, x.n_rows, self.dims[i])
            grads[f"W{i}"] = D.at_matmul_local(known, Dense(grad.df, grad.n_rows, self.dims[i + 1]))
            if self.bias:
                db = np.zeros(self.dims[i + 1])
                for k, v in D.col_sum(grad).collect():
                    db[k] = v
                grads[f"b{i}"] = db
            if i:
                grad = D.times_local(grad, params[f"W{i}"].T.copy())
        return grads


@dataclass
class Epoch:
    epoch: int
    ms: float
    train_loss: float
    test_loss: float
    test_acc: float
    test_f1: float


def train(net: Network, x: Dense, labels: DataFrame, is_train: Column, params: dict, optimiser, epochs: int, schedule=None, report: int = 1) -> tuple[dict, list[Epoch]]:
    """Full-batch training: in each epoch forward, loss over the training rows, backward, a step of all parameters. The
    metrics of every ``report``-th epoch are of its logits before the step; those of the test rows without dropout. What an
    epoch stores is deleted when its step is done."""
    import time

    log, labels = [], stored(labels.select("row", "label"))
    n_train = labels.where(is_train).count()
    for epoch in range(epochs):
        with released(x.df.sparkSession):
            began = time.perf_counter()
            logits = net.forward(x, params, epoch)
            grads = net.backward(L.ce_gradient(logits, labels, is_train, n_train), params, epoch)
            if epoch % report == 0:
                shown = logits if not net.dropout else Network(net.propagation, net.dims, net.bias, net.propagate_last).forward(x, params)
                losses = L.row_losses(shown, labels).withColumn("t", is_train)
                train_loss, test_loss = losses.agg(F.avg(F.when(F.col("t"), F.col("loss"))), F.avg(F.when(~F.col("t"), F.col("loss")))).first()
                test = stored(L.predictions(shown, labels).where(~is_train))
                acc, f1 = test.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0], L.macro(test).first()["f1"]
                log.append(Epoch(epoch, 1000 * (time.perf_counter() - began), train_loss, test_loss, acc, f1))
            params = optimiser.step(params, grads, schedule(epoch) if schedule else None)
    return params, log
