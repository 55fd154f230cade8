"""Train pipeline (C4, M1-M9): align, split, fit, evaluate per epoch, keep the best, test, log."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import MAX_CLASSES
from ..operators.evaluate import evaluate_adapter, measure_projection, quality_gap_value, teacher_v_measure
from ..operators.fit import gd_epochs, gram_stats, solve_normal, theta_to_model
from ..operators.labels import load_labels
from ..operators.metrics import best_epoch
from ..operators.project import AdapterModel
from ..operators.split import assign_split, split_rows
from ..operators.vectors import pair_embeddings, validate_alignment
from ..session import materialize, path_exists
from ..sources.metadata import PREPROCESS_SCHEMA, MetricLog, read_metadata
from ..sources.vectors import load_vector_folder


# fixed values: metric names are those of the logged keys below ({split}_loss, {split}_v_measure_pred, ...)
@dataclass
class TrainConfig:
    solver: str = "normal"            # "normal" (exact optimum) or "gd" (optimizer steps)
    epochs: int = 10
    batch_size: int = 64
    optimizer: dict = field(default_factory=lambda: {"name": "adam", "lr": 1e-3})
    scheduler: dict | None = None
    bias: bool = True
    l2: float = 0.0
    dropout: float = 0.0
    train_ratio: float = 0.7
    val_ratio: float = 0.2
    test_ratio: float = 0.1
    shuffle: bool = True
    seed: int = 42
    n_init: int = 10
    eval_every: int = 1
    monitor: str = "val_v_measure_pred"
    mode: str = "max"


@dataclass
class TrainResult:
    model: AdapterModel
    metrics: DataFrame
    best_epoch: int
    summary: dict


def train_pipeline(spark: SparkSession, base: DataFrame, teacher: DataFrame, labels: DataFrame | None = None,
                   config: TrainConfig | None = None, out_dir: str | None = None,
                   teacher_latency_sec: float | None = None, validate: bool = True) -> TrainResult:
    """Fit the adapter on ``(row_id, embedding)`` base/teacher tables (+ ``(row_id, label)``)."""
    cfg = config or TrainConfig()
    if cfg.solver not in ("normal", "gd"):
        raise ValueError(f"solver must be normal or gd, not {cfg.solver}")
    n = base.count()
    if labels is None:
        if n > MAX_CLASSES:
            raise ValueError(f"no labels: each of the {n} rows would be its own class, and scores take at most {MAX_CLASSES}")
        labels = load_labels(spark, None, base)
    if validate:
        validate_alignment(base, teacher, labels)
    # the split comes from the ids alone; the paired rows with it are written once and read by every later job
    ratios = cfg.train_ratio, cfg.val_ratio, cfg.test_ratio
    data = pair_embeddings(base, teacher, labels)
    if cfg.shuffle:
        data = split_rows(data, "row_id", *ratios, cfg.seed, n, base)
    else:
        splits = assign_split(base.select("row_id"), "row_id", *ratios, cfg.seed, False, n)
        data = data.join(splits.select("row_id", "split"), "row_id")
    data = materialize(data, "train-pairs")
    train = data.where(F.col("split") == "train")
    val = data.where(F.col("split") == "val")
    test = data.where(F.col("split") == "test")

    log = MetricLog(spark, out_dir)
    log.log_params(**{k: v for k, v in cfg.__dict__.items()})
    # The k-means fits are independent jobs over small model-sized state: the
    # teacher scores depend only on the data, so they run while the adapter is
    # fitted, and (with one candidate model) val and test are scored together.
    pool = ThreadPoolExecutor(max_workers=4)
    try:
        teacher_v = {st: pool.submit(teacher_v_measure, part, cfg.seed, cfg.n_init)
                     for st, part in (("val", val), ("test", test))}
        stats = gram_stats(train, "base", "teacher", cfg.bias)

        def score(part: DataFrame, model: AdapterModel, stage: str) -> dict:
            # the teacher's future is resolved after the adapter's fit: the two run side by side
            return evaluate_adapter(part, model, stage, cfg.seed, cfg.n_init, teacher_v[stage])

        models: dict[int, AdapterModel] = {}
        test_future = None
        if cfg.solver == "normal":
            theta = solve_normal(stats, cfg.l2, cfg.dropout)
            log.log("train_loss", stats.loss(theta), "train", 0)
            models[0] = theta_to_model(theta, cfg.bias, {"solver": cfg.solver, "epoch": 0})
            test_future = pool.submit(score, test, models[0], "test")
            for name, value in score(val, models[0], "val").items():
                log.log(name, value, "val", 0)
            last = 0
        else:
            last = cfg.epochs - 1
            for epoch, theta, loss, lr in gd_epochs(stats, cfg.epochs, cfg.batch_size, cfg.optimizer,
                                                    cfg.scheduler, cfg.seed, cfg.l2, cfg.dropout):
                log.log("train_loss", loss, "train", epoch)
                log.log("lr", lr, "train", epoch)
                if epoch % max(1, cfg.eval_every) == 0 or epoch == last:
                    models[epoch] = theta_to_model(theta, cfg.bias, {"solver": cfg.solver, "epoch": epoch})
                    for name, value in score(val, models[epoch], "val").items():
                        log.log(name, value, "val", epoch)

        best_rows = best_epoch(log.frame(), cfg.monitor, cfg.mode).collect()
        chosen = int(best_rows[0]["epoch"]) if best_rows else last
        model = models.get(chosen, models[max(models)])
        if test_future is None:
            test_future = pool.submit(score, test, model, "test")
        test_metrics = test_future.result()
    finally:
        pool.shutdown(wait=True)
    for name, value in test_metrics.items():
        log.log(name, value, "test", chosen)

    # timed alone, after the concurrent scoring jobs are done
    total, per_row, n_val = measure_projection(val, model)
    log.log("adapter_latency_sec", total, "latency")
    log.log("adapter_latency_ms_per_sample", None if per_row is None else per_row * 1e3, "latency")
    if teacher_latency_sec:
        log.log("teacher_instruct_latency_sec", teacher_latency_sec, "latency")
        log.log("latency_speedup", teacher_latency_sec / total if total else None, "latency")
    gap = quality_gap_value(test_metrics.get("test_v_measure_teacher"), test_metrics.get("test_v_measure_pred"))
    log.log("test_quality_gap", gap, "test", chosen)

    if out_dir:
        model.save(spark, f"{out_dir}/checkpoints/adapter")
    metrics = log.flush()
    summary = {"best_epoch": chosen, "rows": stats.n, **test_metrics, "test_quality_gap": gap}
    return TrainResult(model, metrics, chosen, summary)


def train_from_folder(spark: SparkSession, folder: str, config: TrainConfig | None = None, out_dir: str | None = None) -> TrainResult:
    """Train from stored vectors (C4): ``base`` and ``instruct`` folders, ``labels`` if there are any, and the record
    beside them, whose encoding time of the instructed vectors is the teacher's latency."""
    base, teacher = (load_vector_folder(spark, f"{folder}/{kind}") for kind in ("base", "instruct"))
    stored = next((p for p in (f"{folder}/labels", f"{folder}/labels.npy") if path_exists(spark, p)), None)
    labels = load_labels(spark, stored, base) if stored else None
    meta = read_metadata(spark, f"{folder}/metadata", PREPROCESS_SCHEMA) or {}
    return train_pipeline(spark, base, teacher, labels, config, out_dir, meta.get("instruct_encode_seconds"))
