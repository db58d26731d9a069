"""The file tree source, the single-file sink and what is published whole."""

import csv
import hashlib
import multiprocessing
import os
import time
import tracemalloc
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_library import config, jpeg, tree

from corvane import cli, jobs, sinks
from corvane.config import DatasetConfig
from corvane.single_csv import write_single_csv
from corvane.sources import files
from corvane.sources import tree as source
from corvane.sources.store import Store


def some_files(root: Path) -> dict[str, bytes]:
    names = {f"{split}/{c}/{i}.jpg": f"{split}{c}{i}".encode() for split in ("train", "val", "test") for c in ("a", "b c", "100%25") for i in range(5)}
    names |= {"top.txt": b"t", ".hidden/x.JPG": b"h", "val/.y.jpg": b"y", "train/deep/er/z.png": b"z", "train/a/.jpg": b"", "val/a/q.": b"q"}
    for name, data in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return names


def contents(df) -> dict[str, bytes]:
    return {r.raw_rel_path: bytes(r.content) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_tree_has_every_file_once(spark, tmp_path, parts, monkeypatch):
    names = some_files(tmp_path)
    rows = source.scan(spark, str(tmp_path), parts=parts).collect()
    assert {r.raw_rel_path: bytes(r.content) for r in rows} == names and len(rows) == len(names)
    assert all(r.src_path == f"{tmp_path}/{r.raw_rel_path}" and r.length == len(r.content) for r in rows)
    assert contents(source.scan(spark, f"file://{tmp_path}", parts=parts)) == names
    wanted = {n for n in names if n.lower().endswith((".jpg", ".png")) and not n.endswith("/.jpg")}
    assert set(contents(source.scan(spark, str(tmp_path), (".jpg", ".png"), parts=parts))) == wanted
    one = source.scan(spark, f"{tmp_path}/top.txt", parts=parts).collect()
    assert [(r.raw_rel_path, bytes(r.content)) for r in one] == [("top.txt", b"t")]


def reader(root, *filters, **options):
    found = source.TreeReader({"root": str(root)} | options)
    return found, list(found.pushFilters(list(filters)))


def test_filters_prune_folders_before_anything_is_opened(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

    names = some_files(tmp_path)
    listed = []
    one = source.TreeReader._list
    monkeypatch.setattr(source.TreeReader, "_list", lambda self, fs, base, rel: listed.append(rel) or one(self, fs, base, rel))
    at = ("raw_rel_path",)
    for tests, keep in (
        ([StringStartsWith(at, "val/b")], lambda n: n.startswith("val/b")),
        ([EqualTo(at, "train/deep/er/z.png")], lambda n: n == "train/deep/er/z.png"),
        ([In(at, ("val/a/1.jpg", "test/a/2.jpg"))], lambda n: n in ("val/a/1.jpg", "test/a/2.jpg")),
        ([StringStartsWith(at, "t"), StringEndsWith(at, "g")], lambda n: n[0] == "t" and n[-1] == "g"),
    ):
        listed.clear()
        found, left = reader(tmp_path, *tests, GreaterThan(("length",), 0), content="true", parts="2")
        assert [type(f) for f in left] == [GreaterThan]
        got = [r for p in found.partitions() for b in found.read(p) for r in b.to_pylist()]
        assert {r["raw_rel_path"]: r["content"] for r in got} == {n: d for n, d in names.items() if keep(n)}
        below = {str(Path(n).parent) for n in names if keep(n)}
        assert all(f == "" or any(b == f or b.startswith(f + "/") for b in below) for f in listed), listed


def test_filters_reach_the_source_from_queries(spark, tmp_path):
    names = some_files(tmp_path)
    (tmp_path / "train/a/3.jpg").chmod(0)
    rows = source.scan(spark, str(tmp_path)).where(F.col("raw_rel_path").startswith("val/") & (F.length("content") > 1))
    assert contents(rows) == {n: d for n, d in names.items() if n.startswith("val/") and len(d) > 1}
    assert source.scan(spark, str(tmp_path), content=False).count() == len(names)


def test_a_folder_of_many_files_is_shared_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "SHARE", 4)
    names = some_files(tmp_path)
    found, _ = reader(tmp_path)
    parts = found.partitions()
    assert max(len(list(found._files(p, *source.located(str(tmp_path))))) for p in parts) <= 4
    assert sorted(n for p in parts for n, _ in found._files(p, *source.located(str(tmp_path)))) == sorted(names)


def test_large_files_are_hashed_in_pieces(tmp_path):
    names = {"a/large": 96 << 20, "b": source.PIECE, "c": source.PIECE + 1, "empty": 0}
    for n, size in names.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        with (tmp_path / n).open("wb") as f:
            f.write(n.encode()[:size])
            f.truncate(size)
    found, _ = reader(tmp_path, content="false", sha256="true")
    tracemalloc.start()
    got = [r for p in found.partitions() for b in found.read(p) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in names}
    assert {r["raw_rel_path"]: r["sha256"] for r in got} == want and all(set(r) == {"src_path", "raw_rel_path", "length", "sha256"} for r in got)
    assert peak < 4 * source.PIECE, peak
    small, _ = reader(tmp_path, sha256="true", max_bytes=str(source.PIECE))
    got = {r["raw_rel_path"]: r for p in small.partitions() for b in small.read(p) for r in b.to_pylist()}
    assert {n: r["sha256"] for n, r in got.items()} == want
    assert {n for n, r in got.items() if r["content"] is None} == {"a/large", "c"}


def test_a_folder_of_large_files_is_shared_out(tmp_path):
    for i in range(6):
        with (tmp_path / f"{i}").open("wb") as f:
            f.truncate((300 if i == 4 else 50) << 20)
    shared = lambda **o: [[n for n, _ in found._files(p, *source.located(str(tmp_path)))] for found, _ in [reader(tmp_path, **o)] for p in found.partitions()]
    parts = shared(content="false", sha256="true")
    assert len(parts) == 5 and sorted(n for p in parts for n in p) == [str(i) for i in range(6)]
    assert shared(content="false") == [["4", "0", "1", "2", "3", "5"]]


def test_a_file_above_two_gigabytes_is_hashed(spark, tmp_path):
    import __spark_entry__ as entry

    size, said = (1 << 31) + 5, hashlib.sha256()
    with (tmp_path / "t.parquet").open("wb") as f:  # sparse
        f.truncate(size)
    for _ in range(32):
        said.update(bytes(1 << 26))
    said.update(bytes(5))
    (row,) = entry.queries()["binary_file_hash"](spark, str(tmp_path)).collect()
    assert tuple(row) == ("t.parquet", size, said.hexdigest())


def test_evaluation_opens_only_the_files_of_its_split(spark, tmp_path):
    """Files of the other splits are gone: nothing asks for them."""
    tree(tmp_path / "raw")
    cfg = config(tmp_path)
    counts = cli.run_prepare(spark, cfg)
    for p in (tmp_path / "out/train").rglob("*.jpg"):
        p.unlink()
    rows = jobs.labelled(spark, f"{cfg.manifest_dir}/d", "test", cfg.processed_root).collect()
    assert len(rows) == sum(n for (s, _), n in counts.items() if s == "test")
    assert all(bytes(r.content) == (tmp_path / "out" / r.path).read_bytes() for r in rows)
    with pytest.raises(PySparkException, match="train"):
        jobs.labelled(spark, f"{cfg.manifest_dir}/d", "train", cfg.processed_root).collect()


ODD = [("a,b", 1.5, None), ('say "x"', 0.1, 2), ("line\nbreak", float("inf"), 3), ("", 1e-9, -4), (None, None, 5), ("壁", 2.0, 6)]


def test_one_csv_file_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(1000)], "n int, s string").repartition(7)
    write_single_csv(df, f"{tmp_path}/x/a b%.csv", ["n"])
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["a b%.csv"]
    data = (tmp_path / "x/a b%.csv").read_bytes()
    assert data == b"\xef\xbb\xbfn,s\n" + b"".join(b"%d,r%d\n" % (i, i) for i in range(1000))
    write_single_csv(df.limit(0), f"{tmp_path}/x/a b%.csv", bom=False)
    assert (tmp_path / "x/a b%.csv").read_text() == "n,s\n"


def test_csv_values_read_back(spark, tmp_path):
    write_single_csv(spark.createDataFrame(ODD, "s string, x double, n long").coalesce(1), f"{tmp_path}/o.csv")
    rows = list(csv.reader((tmp_path / "o.csv").open(encoding="utf-8-sig", newline="")))
    assert rows == [["s", "x", "n"], *[["" if v is None else str(v) for v in r] for r in ODD]]
    got = spark.read.options(**files.CSV).schema("s string, x double, n long").csv(f"{tmp_path}/o.csv").collect()
    assert [(r.s or "", r.n) for r in got] == [(s or "", n) for s, _, n in ODD]


def test_a_failed_task_leaves_the_former_csv(spark, tmp_path):
    target = f"{tmp_path}/k.csv"
    write_single_csv(spark.range(3), target, ["id"])
    before = Path(target).read_bytes()
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("torn"))).alias("id"))
    with pytest.raises(PySparkException):
        write_single_csv(broken, target)
    assert Path(target).read_bytes() == before and os.listdir(tmp_path) == ["k.csv"]
    with pytest.raises(PySparkException):
        write_single_csv(broken, f"{tmp_path}/new.csv")
    assert os.listdir(tmp_path) == ["k.csv"]


def test_published_folders_change_together_or_not_at_all(spark, tmp_path):
    store = Store(spark)
    a, b = f"{tmp_path}/a", f"{tmp_path}/b%20 c"
    with store.published(a, b) as (x, y):
        store.write_text("1", f"{x}/f")
        store.write_text("1", f"{y}/f")
    assert store.read_text(f"{a}/f") == store.read_text(f"{b}/f") == "1"
    with pytest.raises(RuntimeError), store.published(a, b) as (x, y):
        store.write_text("2", f"{x}/f")
        raise RuntimeError
    with pytest.raises(FileExistsError), store.published(a, overwrite=False):
        pass
    real, store_rename = Store.rename, []

    def rename(self, source, target):
        if target == b and source.startswith(f"{b}.staged"):
            raise OSError("no")
        real(self, source, target)

    Store.rename = rename
    try:
        with pytest.raises(OSError, match="no"), store.published(a, b) as (x, y):
            store.write_text("3", f"{x}/f")
            store.write_text("3", f"{y}/f")
    finally:
        Store.rename = real
    assert store.read_text(f"{a}/f") == store.read_text(f"{b}/f") == "1" and not store_rename
    assert sorted(e.name for e in store.entries(str(tmp_path))) == ["a", "b%20 c"]


def test_a_job_that_dies_leaves_the_former_corpus(spark, tmp_path, monkeypatch):
    tree(tmp_path / "raw")
    cfg = config(tmp_path)
    counts = cli.run_prepare(spark, cfg)
    held = lambda: {str(p.relative_to(tmp_path)): p.read_bytes() for d in ("out", "m/d") for p in (tmp_path / d).rglob("*") if p.is_file()}
    before, lists = held(), {p.name: p.read_bytes() for p in (tmp_path / "m").glob("*.csv")}
    assert sorted(lists) == ["d_all.csv", "d_test.csv", "d_train.csv", "d_val.csv"] and all(x.startswith(b"\xef\xbb\xbfsrc_path,") for x in lists.values())
    (tmp_path / "raw/a.壁/new.jpg").write_bytes(jpeg(b"new"))
    monkeypatch.setattr(sinks, "materialise", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        cli.run_prepare(spark, cfg, force=True)
    assert held() == before and {p.name: p.read_bytes() for p in (tmp_path / "m").glob("*.csv")} == lists
    monkeypatch.undo()
    assert sum(cli.run_prepare(spark, cfg, force=True).values()) == sum(counts.values()) + 1


def _prepare_and_hang(root: str) -> None:
    """In a process of its own: stands still when the corpus is half laid out."""
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    bring = sinks.materialise

    def half(manifest, target, mode):
        bring(manifest.limit(5), target, mode)
        Path(root, "half").touch()
        time.sleep(600)

    sinks.materialise = half
    cli.run_prepare(spark, config(Path(root)), force=True)


def test_a_killed_job_leaves_the_former_corpus(spark, tmp_path):
    tree(tmp_path / "raw")
    cli.run_prepare(spark, config(tmp_path))
    before = {p: p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")}
    other = multiprocessing.get_context("spawn").Process(target=_prepare_and_hang, args=(str(tmp_path),))
    other.start()
    for _ in range(600):
        if (tmp_path / "half").exists():
            break
        time.sleep(0.2)
    other.kill()
    other.join()
    assert (tmp_path / "half").exists() and {p: p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")} == before
    cli.run_prepare(spark, config(tmp_path), force=True)
    assert {p: p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")} == before


def test_prepare_may_validate(spark, tmp_path):
    tree(tmp_path / "raw")
    assert sum(cli.run_prepare(spark, config(tmp_path), validate=True).values()) == 24  # bad.jpg stays out


def test_charts_of_a_run_anywhere(spark, tmp_path):
    run = tmp_path / "run 100%25 [x]"
    spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "true_idx long, pred_idx long").write.parquet(f"{tmp_path}/p")
    for split in ("val", "te st%"):
        cli.run_report(spark, f"{tmp_path}/p", ["x", "y"], f"{run}/metrics/{split}")
    (run / "metrics/history.csv").write_text("epoch,train_loss,val_loss\n1,2,3\n")
    for where in (str(run), f"file://{run}"):
        assert jobs.chart_tables(spark, where) == ["te st%", "val"]
        lines = (run / "metrics/per_class_metrics_all_splits.csv").read_text(encoding="utf-8-sig").splitlines()
        assert [x.split(",")[:2] for x in lines] == [["split", "class"], ["te st%", "x"], ["te st%", "y"], ["val", "x"], ["val", "y"]]
        assert (run / "figures/te st%/confusion_matrix.csv").exists() and (run / "figures/loss_curve.csv").exists()


def test_confusion_of_many_classes_is_written_whole(spark, tmp_path):
    k = 350  # 122,500 cells
    spark.range(k).selectExpr("id as true_idx", "(id + 1) % 350 as pred_idx").write.parquet(f"{tmp_path}/p")
    cli.run_report(spark, f"{tmp_path}/p", [f"c{i}" for i in range(k)], f"{tmp_path}/metrics/test")
    assert jobs.chart_tables(spark, str(tmp_path)) == ["test"]
    with (tmp_path / "figures/test/confusion_matrix.csv").open(encoding="utf-8-sig") as f:
        assert sum(1 for _ in f) == k * k + 1


def test_audit_counts_equal_a_count(spark, tmp_path):
    from corvane.operators import audit

    tree(tmp_path / "raw")
    cfg: DatasetConfig = config(tmp_path)
    got = cli.run_audit(spark, cfg)
    assert got == audit.summary(spark.read.parquet(f"{cfg.audit_dir}/routed")).head().asDict()
    errors = list(csv.DictReader(Path(cfg.audit_dir, "image_errors.csv").open(encoding="utf-8-sig")))
    assert [e["error"] for e in errors] == ["byte 0: no image begins with 6E6F7420"]
    assert (Path(cfg.audit_dir) / "class_counts.csv").read_text(encoding="utf-8-sig").splitlines()[0] == "class_code,class_name,count"
