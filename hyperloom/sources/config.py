"""Run configurations in YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ModelConfig:
    classes: int
    distributed: bool
    learnable_w: bool
    hidden_dims: list
    dropout_rate: float
    with_bias: bool
    activation: str


@dataclass(frozen=True)
class TrainerConfig:
    learning_rate: float
    epochs: int
    output_stepsize: int
    loss_fn: str


@dataclass(frozen=True)
class LrScheduler:
    step_size: int
    gamma: float


@dataclass(frozen=True)
class DataConfig:
    dataset: str
    g_path: str
    dvh_path: str
    invde_ht_dvh_path: str
    labels_path: str
    features_path: str
    test_idx: int


@dataclass(frozen=True)
class Config:
    model: ModelConfig
    trainer: TrainerConfig
    lr_scheduler: LrScheduler
    task_type: str
    data: DataConfig


def _yaml():
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!join", lambda l, n: os.path.join(*map(str, l.construct_sequence(n))))
    Loader.add_constructor("!concat", lambda l, n: "".join(map(str, l.construct_sequence(n))))
    return lambda text: yaml.load(text, Loader)  # noqa: S506 - a safe loader with two path constructors


def _section(kind: type, values: dict, name: str):
    missing = [f.name for f in fields(kind) if f.name not in values]
    if missing:
        raise ValueError(f"{name}: {', '.join(missing)} missing")
    return kind(**{f.name: values[f.name] for f in fields(kind)})


def parse(text: str, root: str | None = None) -> Config:
    """A run's configuration; every key must be there. With ``root``, paths that begin with .. begin there instead."""
    raw = _yaml()(text)
    data = dict(raw["data"])
    if root is not None:
        data |= {k: root + v[2:] for k, v in data.items() if isinstance(v, str) and k.endswith("_path") and v.startswith("..")}
    model = _section(ModelConfig, raw["model"], "model")
    trainer = _section(TrainerConfig, raw["trainer"], "trainer")
    for name, value, known in (("activation", model.activation, "relu"), ("loss_fn", trainer.loss_fn, "cross_entropy"), ("task_type", raw["task_type"], "classification")):
        if value != known:
            raise ValueError(f"{name} must be {known}")
    return Config(model, trainer, _section(LrScheduler, raw["lr_scheduler"], "lr_scheduler"), raw["task_type"], _section(DataConfig, data, "data"))


def preprocessing(text: str) -> dict:
    """A preprocessing configuration, with !join for paths and !concat for names."""
    return _yaml()(text)


#: The folders of a preprocessing configuration: the first must be there, the others are made.
DATA_FOLDER, RESULT_FOLDERS = "data_root", ("result_root", "ckpt_folder", "result_sub_folder")


def check_folders(spark, cfg: dict) -> None:
    """Raises ValueError if the data folder of a preprocessing configuration isn't there, and makes those of its results."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda k: jvm.org.apache.hadoop.fs.Path(cfg[k])
    if not path(DATA_FOLDER).getFileSystem(conf).exists(path(DATA_FOLDER)):
        raise ValueError(f"no folder {cfg[DATA_FOLDER]}")
    for k in RESULT_FOLDERS:
        if cfg.get(k):
            path(k).getFileSystem(conf).mkdirs(path(k))


def dataset_name(mvcnn: bool, gvcnn: bool, mvcnn_structure: bool, gvcnn_structure: bool) -> str:
    """The name of a choice of features and structures, such as m_g_ms_gs."""
    flags = (("m", mvcnn), ("g", gvcnn), ("ms", mvcnn_structure), ("gs", gvcnn_structure))
    return "_".join(n for n, on in flags if on)
