"""Hand vectors, file trees and properties of the library."""

import csv
import hashlib
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane import cli, jobs, sinks
from corvane.config import DatasetConfig, EnsembleConfig, SplitRatios, check_inference_arguments
from corvane.functions import paths, vectors
from corvane.operators import audit, curate, report, scoring, training
from corvane.sources import files


def test_report_of_three_classes(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "true_idx long, pred_idx long")
    classes = report.per_class(report.confusion(pairs, 3))
    rows = {r.idx: r for r in classes.collect()}
    assert [rows[i].precision for i in range(3)] == [0.5, 2 / 3, 0.0]
    assert [rows[i].recall_r1 for i in range(3)] == [0.5, 1.0, 0.0]
    assert [rows[i].f1 for i in range(3)] == [0.5, 0.8, 0.0]
    assert [rows[i].support for i in range(3)] == [2, 2, 1]
    s = report.summary(classes).head()
    assert s.accuracy == pytest.approx(0.6) and s.weighted_recall_r1 == pytest.approx(s.accuracy)
    assert s.macro_f1 == pytest.approx(13 / 30) and s.weighted_f1 == pytest.approx(13 / 25)
    assert s.macro_precision == pytest.approx(7 / 18) and s.weighted_precision == pytest.approx(7 / 15)


def test_report_without_rows(spark):
    classes = report.per_class(report.confusion(spark.createDataFrame([], "true_idx long, pred_idx long"), 2))
    assert [tuple(r)[1:] for r in classes.collect()] == [(0, 0, 0, 0.0, 0.0, 0.0)] * 2
    assert report.summary(classes).head().accuracy == 0.0


def history(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "epoch long, m double")


def test_early_stopping(spark):
    best = training.best_checkpoint(history(spark, [0.1, 0.3, 0.2, 0.3, 0.5]), "m", 2).head()
    assert (best.best_epoch, best.last_epoch) == (2, 4)
    best = training.best_checkpoint(history(spark, [0.1, 0.3, 0.2, 0.3, 0.5]), "m", 0).head()
    assert (best.best_epoch, best.last_epoch) == (5, 5)
    ran = training.checkpoints(history(spark, [float("nan"), 0.2, float("nan"), 0.2]), "m", 3).orderBy("epoch").collect()
    assert [r.improved for r in ran] == [False, True, False, False] and [r.bad_epochs for r in ran] == [1, 0, 1, 2]


def test_quotas(spark):
    rows = [(f"{c}{i}", c) for c, n in (("A", 5), ("B", 3), ("C", 2)) for i in range(n)]
    got = {r.class_name: r for r in curate.quotas(spark.createDataFrame(rows, "sha256 string, class_name string"), SplitRatios(0.7, 0.15, 0.15)).collect()}
    assert [got[c].train for c in "ABC"] == [4, 2, 1]
    assert all(r.train + r.val + r.test == r.n for r in got.values())
    many = spark.range(90).select(F.col("id").cast("string").alias("sha256"), F.lit("x").alias("class_name"))
    assert curate.quotas(many, SplitRatios(0.7, 0.15, 0.15)).head().train == 63  # a decimal ratio: no float floor
    with pytest.raises(ValueError):
        curate.check_classes(curate.quotas(spark.createDataFrame([("a", "x")], "sha256 string, class_name string"), SplitRatios(0.7, 0.15, 0.15)))


def test_paths(spark):
    cases = ["a.x/b.y/f.jpg", "x/a.jpg", "A.x/f.jpg", "ab.x/f.jpg", "a/f.jpg", "d/.jpg", "d/x.", "d/a.b.JPG"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = df.select("p", paths.class_code(F.col("p"), {"a": 1, "b": 2}).alias("c"), paths.suffix(F.col("p")).alias("s")).collect()
    assert [r.c for r in got[:5]] == ["a", "a", None, None, None]
    assert [r.s for r in got[5:]] == ["", "", ".jpg"]
    numbers = spark.createDataFrame([(7,), (123456,)], "n int").select(paths.numbered_path(F.lit("t"), F.lit("c"), F.col("n"), F.lit(".x")).alias("p"))
    assert [r.p for r in numbers.collect()] == ["t/c/c_00007.x", "t/c/c_123456.x"]


def test_vectors(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3, 0.5],)], "v array<double>")
    r = df.select(vectors.top_k(F.col("v"), 3).alias("t"), vectors.argmax(F.col("v")).alias("a"), vectors.softmax(F.col("v")).alias("s"), vectors.log_softmax(F.col("v")).alias("l")).head()
    assert [x.idx for x in r.t] == [1, 3, 2] and r.a == 1
    assert sum(r.s) == pytest.approx(1) and [math.log(x) for x in r.s] == pytest.approx(r.l)
    with pytest.raises(ValueError):
        vectors.top_k(F.col("v"), 0)


def test_class_weights_and_loss(spark):
    rows = spark.createDataFrame([(0, [2.0, 0.0, 1.0]), (0, [0.0, 1.0, 0.0]), (0, [1.0, 1.0, 1.0]), (1, [0.0, 3.0, 1.0])], "true_idx long, logits array<double>")
    weights = [r.weight for r in training.class_weights(rows, 3).orderBy("class_idx").collect()]
    assert weights == pytest.approx([4 / 9, 4 / 3, 4 / 3])
    nll = smooth = norm = 0.0
    for y, z in [tuple(r) for r in rows.collect()]:
        lp = [v - math.log(sum(map(math.exp, z))) for v in z]
        nll, smooth, norm = nll - weights[y] * lp[y], smooth - sum(w * x for w, x in zip(weights, lp)), norm + weights[y]
    want = 0.9 * nll / norm + 0.1 / 3 * smooth / norm
    assert training.losses(rows, 3, 0.1, []).head().loss == pytest.approx(want)


def test_ensembles_agree_where_weights_sum_to_one(spark):
    df = spark.createDataFrame([([0.1, 0.9], [0.8, 0.2])], "a array<double>, b array<double>")
    raw, norm = (scoring.ensemble([F.col("a"), F.col("b")], [0.25, 0.75], n) for n in (False, True))
    r = df.select(raw.alias("r"), norm.alias("n")).head()
    assert r.r == pytest.approx([0.625, 0.375]) and r.n == pytest.approx([0.625, 0.375])
    with pytest.raises(ValueError):
        scoring.check_class_orders([["a", "b"], ["b", "a"]])


def test_settings():
    with pytest.raises(ValueError):
        SplitRatios(0.7, 0.2, 0.2)
    with pytest.raises(ValueError):
        EnsembleConfig.from_dict({"ensemble_name": "e", "output_root": "o", "class_to_idx": "c", "manifest_dir": "m", "members": [{"run_dir": "REPLACE_WITH_x"}]})
    for bad in ([[], "r", None, 1], [["i"], None, None, 1], [["i"], "r", None, 0]):
        with pytest.raises(ValueError):
            check_inference_arguments(*bad)
    with pytest.raises(ValueError):
        training.schedule(None, 0.1, 3, "step")


def jpeg(body: bytes) -> bytes:
    """The least whole file of its structure, with a comment."""
    comment = b"\xff\xfe" + (len(body) + 2).to_bytes(2) + body
    frame = bytes.fromhex("FFC0000B080001000101011100")
    return b"\xff\xd8" + comment + frame + bytes.fromhex("FFDA0008010100003F00") + b"\x12\xff\x00\x34" + b"\xff\xd9"


def tree(root):
    names = {"a.壁/1 x.JPG": b"1", "a.壁/2%20.jpg": b"2", "b.柱/3.jpg": b"3", "b.柱/4.jpg": b"3", "a.壁/5.jpg": b"shared", "b.柱/6.jpg": b"shared", "other/7.jpg": b"7", "a.壁/.hidden.jpg": b"h", "a.壁/note.txt": b"n"}
    names |= {f"{c}/n{i}.jpg": f"{c}{i}".encode() for c in ("a.壁", "b.柱") for i in range(10)}
    for name, body in names.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(jpeg(body))
    (root / "b.柱" / "bad.jpg").write_bytes(b"not an image")
    return names


def config(tmp_path, **more):
    return DatasetConfig.from_dict(
        {"dataset_name": "d", "raw_root": str(tmp_path / "raw"), "processed_root": str(tmp_path / "out"), "manifest_dir": str(tmp_path / "m"), "audit_dir": str(tmp_path / "audit"),
         "seed": 5, "split": {"train": 0.7, "val": 0.15, "test": 0.15}, "image_extensions": [".JPG"], "class_map": {"a": "壁", "b": "柱"}} | more
    )


def test_audit_of_a_tree(spark, tmp_path):
    tree(tmp_path / "raw")
    assert cli.run_audit(spark, config(tmp_path)) == {"valid": 26, "invalid": 1, "errors": 1, "duplicates": 4}
    assert cli.run_audit(spark, config(tmp_path), strict=True)["valid"] == 27


def test_prepare_of_a_tree(spark, tmp_path):
    names = tree(tmp_path / "raw")
    cfg = config(tmp_path)
    counts = cli.run_prepare(spark, cfg)
    assert sum(counts.values()) == 25  # with bad.jpg, without the two that contradict each other
    manifest = spark.read.parquet(f"{cfg.manifest_dir}/d").collect()
    assert len({r.processed_rel_path for r in manifest}) == 25
    rows = list(csv.DictReader(Path(cfg.audit_dir, "cross_class_duplicates.csv").open(encoding="utf-8-sig")))
    keys = [(r["sha256"], r["class_name"], r["src_path"]) for r in rows]
    assert len(keys) == 2 and keys == sorted(keys)
    splits = {}
    for r in manifest:
        data = (tmp_path / "out" / r.processed_rel_path).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and r.class_idx == ["壁", "柱"].index(r.class_name)
        splits.setdefault(r.sha256, set()).add(r.split)
    assert all(len(s) == 1 for s in splits.values()) and "a.壁/1 x.JPG" in {r.raw_rel_path for r in manifest} and names
    train = files.read_split(spark, f"{cfg.manifest_dir}/d", "train")
    assert train.count() == sum(n for (s, _), n in counts.items() if s == "train")
    with pytest.raises(FileExistsError):
        cli.run_prepare(spark, cfg)
    assert cli.run_prepare(spark, cfg, force=True) == counts
    with pytest.raises(ValueError):
        cli.run_prepare(spark, config(tmp_path, exclude_cross_class_duplicates=False), force=True)


def test_prepare_of_nothing(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.jpg").write_bytes(jpeg(b""))
    with pytest.raises(ValueError, match="no file of a known class"):
        cli.run_prepare(spark, config(tmp_path))


def test_reports_as_files(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "true_idx long, pred_idx long")
    pairs.write.parquet(str(tmp_path / "p"))
    for split in ("val", "te st"):
        cli.run_report(spark, str(tmp_path / "p"), ["x", "y"], str(tmp_path / "metrics" / split))
    assert (tmp_path / "metrics/val/per_class_metrics.csv").read_bytes().startswith(b"\xef\xbb\xbfclass,")
    got = files.read_reports(spark, str(tmp_path / "metrics/*/per_class_metrics.csv")).collect()
    assert {(r.split, r["class"], r.support) for r in got} == {(s, c, n) for s in ("val", "te st") for c, n in (("x", 2), ("y", 1))}


def test_confusion_file_names_its_classes(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "true_idx long, pred_idx long")
    pairs.write.parquet(str(tmp_path / "p"))
    cli.run_report(spark, str(tmp_path / "p"), ["x", "y"], str(tmp_path / "m"))
    assert (tmp_path / "m/confusion_matrix.csv").read_text(encoding="utf-8-sig").split() == ["class,x,y", "x,1,1", "y,0,1"]
    got = {tuple(r) for r in files.read_confusion(spark, str(tmp_path / "m/confusion_matrix.csv")).collect()}
    assert got == {("x", "x", 1), ("x", "y", 1), ("y", "x", 0), ("y", "y", 1)}
    report = files.load_json(tmp_path / "m/classification_report.json")
    assert list(report) == ["x", "y", "accuracy", "macro avg", "weighted avg"] and report["x"]["support"] == 2


def register():
    """A scorer that goes by the length of a file; local, so that tasks need not find this module."""

    @scoring.scorer("odd length")
    def factory(high: float = 3.0):
        return lambda frame: [[high, 0.0] if len(c) % 2 else [0.0, 1.0] for c in frame["content"]]


def run_folder(path, *args):
    register()
    sinks.save_json({"scorer": "odd length", "args": list(args), "class_to_idx": {"壁": 0, "柱": 1}}, path / "run.json")
    return str(path)


def test_evaluate_ensemble_and_charts(spark, tmp_path):
    tree(tmp_path / "raw")
    cfg = config(tmp_path)
    counts = cli.run_prepare(spark, cfg)
    run = run_folder(tmp_path / "run")
    members = [jobs.load_member(spark, run), jobs.load_member(spark, run_folder(tmp_path / "other", 9.0), 2.0)]
    got = jobs.evaluate(spark, members, f"{cfg.manifest_dir}/d", cfg.processed_root, ["train", "test"], run)
    predicted = spark.read.parquet(f"{run}/predictions/train").collect()
    assert len(predicted) == sum(n for (s, _), n in counts.items() if s == "train")
    assert all(abs(sum(r.probs) - 3.0) < 1e-9 for r in predicted)  # weights count as given
    right = sum(r.true_idx == r.pred_idx for r in predicted)
    assert got["train"]["accuracy"] == pytest.approx(right / len(predicted))
    assert jobs.chart_tables(spark, run) == ["test", "train"]
    lines = (tmp_path / "run/metrics/per_class_metrics_all_splits.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0] == "split,class,precision,recall_r1,f1,support" and [x.split(",")[0] for x in lines[1:]] == ["test", "test", "train", "train"]
    assert (tmp_path / "run/figures/train/confusion_matrix.csv").exists()
    manifest = files.read_manifest(spark, f"{cfg.manifest_dir}/d_all.csv").collect()
    assert [(r.split, r.class_name, r.src_path) for r in manifest] == sorted((r.split, r.class_name, r.src_path) for r in manifest) and len(manifest) == 25
    assert files.read_manifest(spark, f"{cfg.manifest_dir}/d_train.csv").count() == len(predicted)


def test_inference_of_a_bag(spark, tmp_path):
    tree(tmp_path / "raw")
    members = [jobs.load_member(spark, run_folder(tmp_path / "a")), jobs.load_member(spark, run_folder(tmp_path / "b", 9.0), 3.0)]
    one = str(next((tmp_path / "raw").rglob("bad.jpg")))
    rows = jobs.infer(spark, members, [one, one], str(tmp_path / "raw"), 5, str(tmp_path / "out.csv")).collect()
    assert sum(r.image == one for r in rows) == 3
    assert all(float(r.top1_prob) + float(r.top2_prob) == pytest.approx(1) and r.pred_class == r.top1_class and r.confidence == r.top1_prob for r in rows)


def test_best_epoch_and_curves_of_a_run(spark, tmp_path):
    (tmp_path / "history.csv").write_text("epoch,train_loss,val_loss,lr,accuracy\n1,3,3,.1,.1\n2,2,2,.1,.3\n3,1,2,.1,.2\n4,1,2,.1,.3\n5,1,2,.1,.5\n")
    best = jobs.best_summary(spark, str(tmp_path), "accuracy", 2)
    assert best | {"best_metric_name": "accuracy"} == files.load_json(tmp_path / "best_summary.json") == {"best_epoch": 2, "best_metric": 0.3, "last_epoch": 4, "best_metric_name": "accuracy"}
    assert jobs.chart_tables(spark, str(tmp_path)) == [] and (tmp_path / "figures/loss_curve.csv").exists()


def test_a_torn_copy_is_never_taken_for_a_file(spark, tmp_path, monkeypatch):
    (tmp_path / "src").write_bytes(b"x" * 100)

    def torn(src, dst):
        dst.write_bytes(b"x" * 10)
        raise OSError("died")

    monkeypatch.setattr(sinks.shutil, "copy2", torn)
    with pytest.raises(OSError, match="died"):
        sinks._bring(str(tmp_path / "src"), tmp_path / "out/dst", link=False)
    assert not (tmp_path / "out/dst").exists() and not list((tmp_path / "out").iterdir())
    monkeypatch.undo()
    assert sinks._bring(str(tmp_path / "src"), tmp_path / "out/dst", link=False) and (tmp_path / "out/dst").read_bytes() == b"x" * 100


def test_numbers_in_order_whatever_the_paths_begin_with(spark):
    rows = spark.createDataFrame([(f"/one/long/common/folder/{i:05d}.jpg", "train", "x", f"{i}.jpg") for i in range(3000)], "src_path string, split string, class_name string, raw_rel_path string")
    got = curate.with_processed_path(rows.repartition(7)).collect()
    assert all(r.processed_rel_path == f"train/x/x_{int(r.src_path[-9:-4]) + 1:05d}.jpg" for r in got)


def test_stream_keeps_first_of_content(spark, tmp_path):
    from corvane.streaming import audit_stream

    tree(tmp_path / "raw")
    out = audit_stream.first_of_content(audit_stream.arriving(spark, str(tmp_path / "raw")), {"a": "壁", "b": "柱"})
    query = out.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from firsts").collect()
    assert len(rows) == len({r.sha256 for r in rows}) == 27


def test_routing_order(spark):
    rows = spark.createDataFrame([("a.x/1", False), ("q/2", False), ("a.x/3", True)], "raw_rel_path string, ok boolean").withColumn("src_path", F.col("raw_rel_path"))
    got = {r.raw_rel_path: r.status for r in audit.routed(rows, {"a": "A"}, readable=F.col("ok")).collect()}
    assert got == {"a.x/1": "error", "q/2": "invalid", "a.x/3": "valid"}
