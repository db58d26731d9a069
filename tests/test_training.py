"""Training against a plain numpy run, from the command line to the scored corpus; event files; stored members."""

import json
import math
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import yaml
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_library import jpeg

from corvane import cli, events, fitting, jobs, models
from corvane.config import DatasetConfig
from corvane.operators import scoring, training
from corvane.sources import files

REPO = Path(__file__).parents[1]


def blobs(n=400, k=3, width=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, width)) * 2
    y = rng.integers(0, k, n) % rng.integers(1, k + 1, n)
    return centres[y] + rng.normal(size=(n, width)), y


def table(spark, x, y, first=0):
    return spark.createDataFrame([(i + first, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "key long, features array<double>, label int").repartition(5)


def plainly(x, y, vx, vy, s: fitting.Settings):
    """One step an epoch over all rows, written out once more: losses by element, the optimizers by their papers."""
    one = lambda a: np.c_[a, np.ones(len(a))]
    k = s.classes
    w = np.zeros((k, s.width + 1))
    weights = np.array([len(y) / (k * max(1, (y == c).sum())) for c in range(k)]) if s.weighted else np.ones(k)
    first, second, history = np.zeros_like(w), np.zeros_like(w), []

    def loss(a, b):
        total = norm = 0.0
        for row, label in zip(one(a), b):
            z = w @ row
            lp = z - math.log(sum(math.exp(v) for v in z))
            total -= (1 - s.smoothing) * weights[label] * lp[label] + s.smoothing / k * sum(weights[c] * lp[c] for c in range(k))
            norm += weights[label]
        return total / norm

    def slope(a, b):
        g, eps = np.zeros_like(w), 1e-6
        nonlocal_w = w.copy()
        for i in range(k):
            for j in range(s.width + 1):
                for sign in (1, -1):
                    w[i, j] = nonlocal_w[i, j] + sign * eps
                    g[i, j] += sign * loss(a, b) / (2 * eps)
                w[i, j] = nonlocal_w[i, j]
        return g

    for epoch in range(1, s.epochs + 1):
        lr = 0.5 * s.lr * (1 + math.cos(math.pi * (epoch - 1) / s.epochs))
        before, g = loss(x, y), slope(x, y)
        if s.optimizer == "sgd":
            first = 0.9 * first + g + s.weight_decay * w
            w -= lr * first
        else:
            w *= 1 - lr * s.weight_decay
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= lr * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        hit = (one(vx) @ w.T).argmax(axis=1) == vy
        history.append((before, loss(vx, vy), 0.5 * s.lr * (1 + math.cos(math.pi * epoch / s.epochs)), hit.mean()))
    return history


@pytest.mark.parametrize("optimizer, weighted", [("sgd", True), ("adamw", False)])
def test_losses_equal_a_plain_run(spark, optimizer, weighted):
    x, y = blobs(120)
    vx, vy = blobs(60, seed=1)
    s = fitting.Settings(3, 0.2, 3, 4, optimizer, 0.01, smoothing=0.1, weighted=weighted)
    got = fitting.fit(table(spark, x, y), table(spark, vx, vy), s).history
    want = plainly(x, y, vx, vy, s)
    assert [r["epoch"] for r in got] == [1, 2, 3]
    for r, (train, val, lr, accuracy) in zip(got, want):
        assert (r["train_loss"], r["val_loss"], r["lr"], r["accuracy"]) == pytest.approx((train, val, lr, accuracy), rel=1e-6)


def test_steps_visit_each_row_once_an_epoch_and_the_model_generalises(spark, tmp_path):
    x, y = blobs(900)
    s = fitting.Settings(6, 0.1, 3, 4, steps=4, patience=3, best_metric="accuracy", seed=7)
    seen = []
    real = fitting.sums

    def watched(rows, settings, w, class_weights, learn):
        out = real(rows, settings, w, class_weights, learn)
        seen.append((learn, out[2]))
        return out

    fitting.sums = watched
    try:
        fitted = fitting.fit(table(spark, x[:600], y[:600]), table(spark, x[600:], y[600:]), s, f"{tmp_path}/b")
    finally:
        fitting.sums = real
    epochs = len(fitted.history)
    assert sum(n for learn, n in seen if learn) == 600 * epochs and len([1 for learn, _ in seen if learn]) == 4 * epochs
    assert sum(n for learn, n in seen if not learn) == 300 * epochs
    assert fitted.best_metric > 0.8 == (max(r["accuracy"] for r in fitted.history) > 0) * 0.8


def test_rows_without_label_or_features_and_bad_settings(spark):
    x, y = blobs(50)
    rows = table(spark, x, y)
    more = rows.union(rows.limit(3).withColumn("label", F.lit(None).cast("int"))).union(rows.limit(2).withColumn("features", F.lit(None).cast("array<double>"))).withColumn("weight", F.lit("clash"))
    s = fitting.Settings(1, 0.1, 3, 4)
    assert fitting.fit(more, more, s).history[0] == pytest.approx(fitting.fit(rows, rows, s).history[0])
    with pytest.raises(ValueError, match="no training row"):
        fitting.fit(rows.limit(0), rows, s)
    assert math.isnan(fitting.fit(rows, rows.limit(0), s).history[0]["val_loss"])
    for bad in ({"optimizer": "adam"}, {"scheduler": "step"}, {"best_metric": "loss"}):
        with pytest.raises(ValueError):
            fitting.Settings(1, 0.1, 3, 4, **bad)


def test_training_ends_early_as_the_window_query_says(spark):
    x, y = blobs(60)
    s = fitting.Settings(12, 5.0, 3, 4, "sgd", patience=2, best_metric="macro_f1")
    history = fitting.fit(table(spark, x, y), table(spark, *blobs(40, seed=1)), s).history
    df = spark.createDataFrame([(r["epoch"], r["macro_f1"]) for r in history], "epoch long, macro_f1 double")
    ran = training.checkpoints(df, "macro_f1", 2).orderBy("epoch").collect()
    assert len(ran) == len(history) and (len(history) == 12 or ran[-1].bad_epochs == 2)


def run_cli(*args, fails=False):
    done = subprocess.run([sys.executable, "-m", "corvane.cli", *map(str, args)], cwd=REPO, capture_output=True, text=True, timeout=600)
    assert (done.returncode != 0) == fails, done.stderr[-3000:]
    return done.stdout


SCORER = """
import json

def load(table, high=3.0):
    known = json.load(open(table))
    open(known["log"], "a").write("loaded\\n")
    return lambda frame: [[high, 0.0] if c.count(b"A"[0]) > c.count(b"B"[0]) else [0.0, known["other"]] for c in map(bytes, frame["content"])]
"""


def corpus(tmp_path) -> dict:
    """Files of class a hold many As, those of class b many Bs; all are whole by their structure."""
    rng = np.random.default_rng(5)
    for code, name, byte in (("a", "壁", b"A"), ("b", "柱", b"B")):
        for i in range(30):
            path = tmp_path / "raw" / f"{code}.{name}" / f"{i:02}.jpg"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(jpeg(byte * int(rng.integers(50, 90)) + bytes(rng.integers(0, 60, 40, dtype=np.uint8))))
    cfg = {
        "dataset_name": "corpus", "raw_root": f"{tmp_path}/raw", "processed_root": f"{tmp_path}/processed/corpus", "manifest_dir": f"{tmp_path}/manifests",
        "audit_dir": f"{tmp_path}/audit", "seed": 1, "split": {"train": 0.6, "val": 0.2, "test": 0.2}, "image_extensions": [".jpg"], "class_map": {"a": "壁", "b": "柱"},
    }
    (tmp_path / "dataset.yaml").write_text(yaml.safe_dump(cfg, allow_unicode=True), encoding="utf-8")
    return cfg


def own_run(tmp_path, name: str, other: float, cfg: dict) -> Path:
    run = tmp_path / "runs" / name
    (run / "checkpoints").mkdir(parents=True)
    (run / "model.py").write_text(SCORER)
    (run / "checkpoints/best.json").write_text(json.dumps({"other": other, "log": f"{tmp_path}/{name}.log"}))
    settings = {
        "scorer": {"factory": "model.py:load", "artifacts": {"table": "checkpoints/best.json"}, "args": {"high": 2.0}},
        "dataset": {"processed_root": cfg["processed_root"], "manifest_dir": cfg["manifest_dir"]},
    }
    (run / "config.yaml").write_text(yaml.safe_dump(settings))
    (run / "class_mapping.json").write_text(json.dumps({"class_to_idx": {"壁": 0, "柱": 1}}))
    return run


def predictions(path: Path) -> list[list[str]]:
    data = path.read_bytes()
    assert data.startswith(b"\xef\xbb\xbfpath,true_idx,true_class,pred_idx,pred_class,confidence,prob_")
    return [line.split(",") for line in data.decode("utf-8-sig").splitlines()[1:]]


def test_commands_with_scorers_of_their_own(spark, tmp_path):
    """evaluate, ensemble, infer: each in a process that knows no scorer but what the run says."""
    cfg = corpus(tmp_path)
    assert cli.run_audit(spark, DatasetConfig.from_dict(cfg))["valid"] == 60
    cli.run_prepare(spark, DatasetConfig.from_dict(cfg))
    a, b = own_run(tmp_path, "one", 2.0, cfg), own_run(tmp_path, "two", 5.0, cfg)
    assert "'accuracy': 1.0" in run_cli("evaluate", "--run-dir", a, "--split", "test", "--batch-size", 4)
    rows = predictions(a / "predictions/test_predictions.csv")
    assert len(rows) == 12 and [r[0] for r in rows] == sorted(r[0] for r in rows) and all(r[0].startswith("test/") for r in rows)
    own = 1 / (1 + math.exp(-2.0))
    assert all(float(r[5]) == pytest.approx(own) for r in rows)
    assert len((tmp_path / "one.log").read_text().split()) <= 8  # once a worker, not once a batch

    ensemble = {
        "ensemble_name": "both", "output_root": f"{tmp_path}/runs", "class_to_idx": f"{cfg['manifest_dir']}/class_to_idx.json", "manifest_dir": cfg["manifest_dir"],
        "members": [{"run_dir": str(a), "weight": 0.5}, {"run_dir": str(b), "weight": 1.5}],
    }
    (tmp_path / "ensemble.yaml").write_text(yaml.safe_dump(ensemble))
    run_cli("ensemble", "--config", tmp_path / "ensemble.yaml", "--split", "val", "test")
    out = next((tmp_path / "runs").glob("*_both"))
    rows = predictions(out / "predictions/val_predictions.csv")
    far = 1 / (1 + math.exp(-5.0))
    assert {r[4]: float(r[5]) for r in rows} == pytest.approx({"壁": 2.0 * own, "柱": 0.5 * own + 1.5 * far})  # weights as given
    assert (out / "config.yaml").exists() and json.loads((out / "class_mapping.json").read_text())["class_names"] == ["壁", "柱"]

    image = next((tmp_path / "raw").rglob("07.jpg"))
    run_cli("infer", "--image", image, "--image-dir", tmp_path / "raw", "--ensemble-config", tmp_path / "ensemble.yaml", "--output", tmp_path / "inferred.csv", "--top-k", 9)
    lines = (tmp_path / "inferred.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0] == "image,pred_class,confidence,top1_class,top1_prob,top2_class,top2_prob" and len(lines) == 62
    assert jobs.infer(spark, [jobs.load_member(spark, str(a))], [str(image)], None, 1, f"{tmp_path}/single.csv").count() == 1
    assert jobs.chart_tables(spark, str(a)) == ["test"]


def test_a_trained_run_is_evaluated(spark, tmp_path):
    cfg = corpus(tmp_path)
    cli.run_prepare(spark, DatasetConfig.from_dict(cfg))
    raw = {
        "run_name": "linear", "output_root": f"{tmp_path}/runs", "seed": 3, "model": {"features": "bytes"},
        "dataset": {"processed_root": cfg["processed_root"], "manifest_dir": cfg["manifest_dir"], "class_to_idx": f"{cfg['manifest_dir']}/class_to_idx.json"},
        "train": {"epochs": 4, "optimizer": "adamw", "lr": "0.05", "weight_decay": 0.0001, "scheduler": "cosine", "label_smoothing": 0.05, "class_weighted_loss": True,
                  "early_stopping_patience": 2, "best_metric": "macro_f1", "steps": 2},
    }
    (tmp_path / "train.yaml").write_text(yaml.safe_dump(raw))
    said = run_cli("train", "--config", tmp_path / "train.yaml")
    run = next((tmp_path / "runs").glob("*_linear"))
    assert f"Saved to {run}" in said and "epoch=1 train_loss=0.69" in said
    text = (run / "metrics/history.csv").read_text()
    assert text.splitlines()[0] == "epoch,train_loss,val_loss,lr,accuracy,macro_precision,macro_recall_r1,macro_f1,weighted_precision,weighted_recall_r1,weighted_f1"
    best = json.loads((run / "metrics/best_summary.json").read_text())
    history = files.read_history(spark, f"{run}/metrics/history.csv")
    assert best["best_metric_name"] == "macro_f1" and best["best_metric"] == training.best_checkpoint(history, "macro_f1", 2).head().best_metric > 0.9
    assert "'accuracy': 1.0" in run_cli("evaluate", "--run-dir", run) and len(predictions(run / "predictions/test_predictions.csv")) == 12
    logged = {(r.epoch, r.tag): r.value for r in events.read_events(spark, f"{run}/logs").collect()}
    assert logged == {(r.epoch, r.tag): pytest.approx(r.value, rel=1e-6) for r in training.scalar_log(history).collect()}
    assert not (run / "work").exists() and sorted(p.name for p in (run / "checkpoints").glob("[!.]*")) == ["best.npz", "last.npz"]


def test_scorers_are_named_or_refused(spark, tmp_path):
    (tmp_path / "m.py").write_text("def make(): return lambda frame: [[1.0]] * len(frame)")
    one = models.scorer(spark, "m.py:make", str(tmp_path))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/m.py").write_text("def make(): return lambda frame: [[2.0]] * len(frame)")
    two = models.scorer(spark, {"factory": "m.py:make"}, str(tmp_path / "other"))
    rows = models.score_all(spark.range(5), [one, two, models.scorer(spark, {"factory": "m.py:make"}, str(tmp_path))], batch_size=2).collect()
    assert [r.logits for r in rows] == [[[1.0], [2.0], [1.0]]] * 5  # equal names, unequal code
    (tmp_path / "lists.py").write_text("def make(logits): return lambda frame: [logits] * len(frame)")
    listed = models.scorer(spark, {"factory": "lists.py:make", "args": {"logits": [3.0, 4.0]}}, str(tmp_path))
    assert [r.logits for r in models.score_all(spark.range(2), [listed]).collect()] == [[[3.0, 4.0]]] * 2
    with pytest.raises(ValueError, match="neither"):
        models.scorer(spark, "nobody", str(tmp_path))
    with pytest.raises(PySparkException, match="absent"):
        models.score_all(spark.range(1), [models.scorer(spark, "corvane.fitting:absent")]).collect()


def test_checksums_and_numbers():
    assert events.crc32c(b"123456789") == 0xE3069283  # the check value of CRC-32C
    assert events.varint(300) == b"\xac\x02" and events.varint(0) == b"\0"
    assert zlib.crc32(b"123456789") != events.crc32c(b"123456789")
    record = events.framed(events.event(1.0, 7, "loss", 0.5))
    assert record[:8] == struct.pack("<Q", len(record) - 16) and list(events.scalars(record)) == [(7, "loss", 0.5)]


def test_event_files_read_back_and_show_damage(spark, tmp_path):
    rows = [(run, e, t, v) for run in ("a", "b c/d") for e in (1, 2, 300) for t, v in (("loss", 0.1 * e), ("äcc", -1.5), ("none", None))]
    log = spark.createDataFrame(rows, "run string, epoch long, tag string, value double")
    made = events.write_events(log, str(tmp_path), wall=12.5).collect()
    assert sorted((r.run, r.rows) for r in made) == [("a", 9), ("b c/d", 9)]
    got = {(r.run, r.epoch, r.tag): r.value for r in events.read_events(spark, str(tmp_path)).collect()}
    assert got == {(r, e, t): pytest.approx(v, rel=1e-6) for r, e, t, v in rows if v is not None}
    path = Path(made[0].path)
    data = bytearray(path.read_bytes())
    first = 16 + struct.unpack_from("<Q", data)[0]
    for at in range(first, len(data)):
        changed = bytearray(data)
        changed[at] ^= 0x40
        with pytest.raises(ValueError, match="record at byte"):
            list(events.scalars(bytes(changed)))
    with pytest.raises(ValueError, match=f"record at byte {first}: its data are damaged"):
        list(events.scalars(bytes(data[: first + 13])))
    path.write_bytes(data[:-3])
    broken = [r for r in events.read_events(spark, str(tmp_path)).collect() if r.error]
    assert len(broken) == 1 and broken[0].run == made[0].run and "damaged" in broken[0].error


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_stored_members_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = [spark.range(500).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.array(F.rand(s), F.rand(s + 9)).alias("probs")) for s in range(4)]
        stored = [scoring.store_member(m, f"{tmp_path}/{i}", 6) for i, m in enumerate(plain)]
        weights = [0.1, 0.2, 0.3, 0.4]
        joined = scoring.ensemble_members(stored, weights, False)
        assert exchanges(joined) == 0 < exchanges(scoring.ensemble_members(plain, weights, False))
        again = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(4)]
        want = {r.path: r.probs for r in scoring.ensemble_members(again, weights, False).collect()}
        assert {r.path: r.probs for r in joined.collect()} == want and len(want) == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
