"""The registered queries over the synthetic tables, each beside the SQL that an independent engine runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import class_code, has_suffix, suffix
from corvane.functions.vectors import micro
from corvane.operators import audit, curate, report, scoring, training
from corvane.plans.fixtures import (
    CLASS_MAP, EXTENSIONS, FILES_SQL, HISTORY_SQL, HOST_MAP, K, NAMES, PAGES_SQL, RATIOS, SEED,
    documents_as_files, history, member, member_sql, pages_as_files, read,
)

_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _shared(spark, name: str) -> str:
    """A new path in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _micro_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5) AS BIGINT)"


# ---- audit ---------------------------------------------------------------------------------------------------------

@query(f'WITH {FILES_SQL} SELECT sha256, src_path AS path, "count" FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS "count" FROM files) WHERE "count" > 1')
def audit_duplicate_files(spark, d) -> DataFrame:
    return audit.duplicate_files(documents_as_files(spark, d))


@query(f'WITH {FILES_SQL} SELECT class_code, class_name, count(*) AS "count" FROM files GROUP BY ALL')
def audit_class_counts(spark, d) -> DataFrame:
    return audit.class_counts(documents_as_files(spark, d))


def _routed_pages(spark, d) -> DataFrame:
    return audit.routed(pages_as_files(spark, d), HOST_MAP, readable=~F.col("raw_rel_path").contains("?"))


@query(f"""WITH {PAGES_SQL} SELECT src_path, class_code, CASE class_code WHEN 'b' THEN 'blog' WHEN 'm' THEN 'mobile' ELSE 'web' END AS class_name, sha256
  FROM routed WHERE class_code IS NOT NULL AND NOT contains(raw_rel_path, '?')""")
def audit_valid_files(spark, d) -> DataFrame:
    return audit.valid_files(_routed_pages(spark, d))


@query(f"WITH {PAGES_SQL} SELECT src_path AS path, 'missing_class_directory' AS reason FROM routed WHERE class_code IS NULL")
def audit_invalid_files(spark, d) -> DataFrame:
    return audit.invalid_files(_routed_pages(spark, d))


@query(f"WITH {PAGES_SQL} SELECT src_path AS path, 'unreadable image' AS error FROM routed WHERE class_code IS NOT NULL AND contains(raw_rel_path, '?')")
def audit_file_errors(spark, d) -> DataFrame:
    return audit.file_errors(_routed_pages(spark, d))


@query(f"""WITH {PAGES_SQL},
s AS (SELECT *, CASE WHEN class_code IS NULL THEN 'invalid' WHEN contains(raw_rel_path, '?') THEN 'error' ELSE 'valid' END AS status FROM routed),
g AS (SELECT *, count(*) OVER (PARTITION BY status, sha256) AS n FROM s)
SELECT count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'error') AS errors,
       count(*) FILTER (status = 'valid' AND n > 1) AS duplicates FROM g""")
def audit_summary(spark, d) -> DataFrame:
    return audit.summary(_routed_pages(spark, d))


@query(f"WITH {PAGES_SQL} SELECT page_id, class_code FROM routed")
def path_class_code(spark, d) -> DataFrame:
    return pages_as_files(spark, d).select("page_id", class_code(F.col("raw_rel_path"), HOST_MAP).alias("class_code"))


@query("""SELECT page_id, lower(regexp_extract(url, '([^/])(\\.[^./]+)$', 2)) AS suffix,
       lower(regexp_extract(url, '([^/])(\\.[^./]+)$', 2)) IN ('.html', '.jpg', '.png') AS known FROM pages""")
def path_extension_filter(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", suffix(F.col("url")).alias("suffix"), has_suffix(F.col("url"), EXTENSIONS).alias("known"))


# ---- curation ------------------------------------------------------------------------------------------------------

_BAD = f"WITH {FILES_SQL}, bad AS (SELECT sha256 FROM files GROUP BY sha256 HAVING count(DISTINCT class_name) > 1)"
_KEPT = f"{_BAD}, kept AS (SELECT f.* FROM files f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.sha256 = f.sha256))"
_GROUPS = f"""{_KEPT}, groups AS (SELECT sha256, class_name FROM
  (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY class_code, src_path) AS r FROM kept) WHERE r = 1)"""
_QUOTA = f"""{_GROUPS},
c AS (SELECT class_name, count(*) AS n FROM groups GROUP BY 1),
c1 AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS g, CAST(floor(CAST(0.70 AS DECIMAL(9, 6)) * CAST(sum(n) OVER () AS BIGINT)) AS BIGINT) AS t FROM c),
c2 AS (SELECT *, t * n // g AS base, t * n % g AS rem FROM c1),
c3 AS (SELECT class_name, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, class_name) <= t - CAST(sum(base) OVER () AS BIGINT) THEN 1 ELSE 0 END AS train FROM c2),
c4 AS (SELECT *, n - train AS rest, CAST(sum(n - train) OVER () AS BIGINT) AS g FROM c3),
c5 AS (SELECT *, CAST(floor(CAST(0.5 AS DECIMAL(9, 6)) * g) AS BIGINT) AS t FROM c4),
c6 AS (SELECT *, t * rest // g AS base, t * rest % g AS rem FROM c5),
c7 AS (SELECT class_name, n, train, rest, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, class_name) <= t - CAST(sum(base) OVER () AS BIGINT) THEN 1 ELSE 0 END AS val FROM c6),
quota AS (SELECT class_name, n, train, val, rest - val AS test FROM c7)"""
_SPLIT = f"""{_QUOTA},
drawn AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('{SEED}:' || sha256), sha256) AS r FROM groups),
split AS (SELECT sha256, class_name, CASE WHEN r <= train THEN 'train' WHEN r <= train + val THEN 'val' ELSE 'test' END AS split FROM drawn JOIN quota USING (class_name)),
manifest AS (SELECT k.*, s.split FROM kept k LEFT JOIN split s ON s.sha256 = k.sha256)"""


@query(f"{_BAD} SELECT src_path, raw_rel_path, class_code, class_name, sha256 FROM files WHERE sha256 IN (SELECT sha256 FROM bad)")
def cross_class_duplicates(spark, d) -> DataFrame:
    return curate.conflicts(documents_as_files(spark, d))


@query(f"{_KEPT} SELECT src_path, class_code, class_name, sha256 FROM kept")
def curated_manifest(spark, d) -> DataFrame:
    return curate.curated(documents_as_files(spark, d)).select("src_path", "class_code", "class_name", "sha256")


@query(f"{_GROUPS} SELECT * FROM groups")
def unique_content_groups(spark, d) -> DataFrame:
    return curate.clean_groups(documents_as_files(spark, d))


@query(f"{_QUOTA} SELECT * FROM quota")
def stratified_quota(spark, d) -> DataFrame:
    return curate.quotas(unique_content_groups(spark, d), RATIOS)


@query(f"{_SPLIT} SELECT * FROM split")
def stratified_split(spark, d) -> DataFrame:
    return curate.split_groups(unique_content_groups(spark, d), RATIOS, SEED)


def _manifest(spark, d) -> DataFrame:
    return curate.split_manifest(documents_as_files(spark, d), RATIOS, SEED)


@query(f"{_SPLIT} SELECT src_path, class_code, class_name, sha256, split FROM manifest")
def split_manifest(spark, d) -> DataFrame:
    return _manifest(spark, d).select("src_path", "class_code", "class_name", "sha256", "split")


@query(f'{_SPLIT} SELECT split, class_name, count(*) AS "count" FROM manifest GROUP BY ALL')
def split_class_counts(spark, d) -> DataFrame:
    return curate.split_class_counts(_manifest(spark, d))


@query(f"{_SPLIT} SELECT count(*) AS groups, count(*) FILTER (n > 1) AS leaks FROM (SELECT sha256, count(DISTINCT split) AS n FROM manifest GROUP BY 1)")
def split_leakage_check(spark, d) -> DataFrame:
    return curate.leakage(_manifest(spark, d))


_INDEX = "CASE class_name WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 WHEN 'gamma' THEN 2 ELSE 3 END"


@query(f"WITH {FILES_SQL} SELECT src_path, class_name, CAST({_INDEX} AS BIGINT) AS class_idx FROM files")
def class_index_map(spark, d) -> DataFrame:
    return curate.with_class_index(documents_as_files(spark, d), curate.class_index(spark, CLASS_MAP)).select("src_path", "class_name", "class_idx")


@query(f"""{_SPLIT} SELECT src_path, split || '/' || class_name || '/' || class_name || '_' ||
  format('{{:05d}}', row_number() OVER (PARTITION BY split, class_name ORDER BY src_path)) || '.txt' AS processed_rel_path FROM manifest""")
def processed_rel_path(spark, d) -> DataFrame:
    return curate.with_processed_path(_manifest(spark, d), paths=documents_as_files(spark, d)).select("src_path", "processed_rel_path")


@query(f'{_SPLIT} SELECT src_path, text, split FROM manifest JOIN documents ON CAST(doc_id AS VARCHAR) = src_path')
def manifest_csv_roundtrip(spark, d) -> DataFrame:
    from corvane import sinks
    from corvane.sources.files import CSV

    texts = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("src_path"), "text")
    df = _manifest(spark, d).select("src_path", "split").join(texts, "src_path").select("src_path", "text", "split")
    path = _shared(spark, "roundtrip")
    sinks.write_csv(df, path)
    return spark.read.options(**CSV).schema(df.schema).csv(path)


@query(f"""{_SPLIT} SELECT src_path, src_path || '.TXT' AS raw_rel_path, class_code, class_name, sha256, split, CAST({_INDEX} AS BIGINT) AS class_idx,
  split || '/' || class_name || '/' || class_name || '_' || format('{{:05d}}', row_number() OVER (PARTITION BY split, class_name ORDER BY src_path)) || '.txt' AS processed_rel_path
  FROM manifest""")
def manifest_read_back(spark, d) -> DataFrame:
    """The whole manifest, written in order as CSV and read by its schema."""
    from corvane import schemas, sinks
    from corvane.sources.files import read_manifest

    indexed = curate.with_class_index(_manifest(spark, d), curate.class_index(spark, CLASS_MAP))
    path = _shared(spark, "manifest")
    named = curate.with_processed_path(indexed, paths=documents_as_files(spark, d))
    sinks.write_sorted_csv(named.select(*schemas.MANIFEST.names), path, ["split", "class_name", "src_path"])
    return read_manifest(spark, path)


@query()
def binary_file_hash(spark, d) -> DataFrame:
    from corvane.sources.files import scan_tree

    return scan_tree(spark, d, content=False, sha256=True).select("raw_rel_path", "length", "sha256")


# ---- scores --------------------------------------------------------------------------------------------------------

_A, _B = member_sql("a"), member_sql("b", 11)
_PRED_A = f"WITH {_A}, pred AS (SELECT path, true_idx, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS pred_idx, list_max(probs) AS confidence, probs FROM a)"


def _predicted(spark, d, start: int = 1) -> DataFrame:
    return scoring.predictions(member(spark, d, start), NAMES)


@query(f"{_PRED_A} SELECT path, {_micro_sql('confidence')} AS confidence_micro, {_micro_sql('list_sum(probs)')} AS total_micro FROM pred")
def softmax_confidence(spark, d) -> DataFrame:
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return _predicted(spark, d).select("path", micro(F.col("confidence")).alias("confidence_micro"), micro(total).alias("total_micro"))


_CLASSES = "true_idx, 'c' || true_idx AS true_class, pred_idx, 'c' || pred_idx AS pred_class"


@query(f"{_PRED_A} SELECT path, {_CLASSES} FROM pred")
def argmax_predictions(spark, d) -> DataFrame:
    return _predicted(spark, d).select("path", "true_idx", "true_class", "pred_idx", "pred_class")


@query(f"{_PRED_A} SELECT path, {_CLASSES} FROM pred")
def scorer_map_in_pandas(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings").where(f"label between 0 and {K - 1}")
    rows = e.select(F.col("vec_id").cast("string").alias("path"), F.col("label").cast("long").alias("true_idx"), "embedding")
    return scoring.predictions(scoring.with_probs(scoring.score(rows, "slice", 0, K)), NAMES).select("path", "true_idx", "true_class", "pred_idx", "pred_class")


@query(f"{_PRED_A} SELECT path, true_idx, pred_idx, {', '.join(_micro_sql(f'probs[{i + 1}]') + f' AS prob_c{i}' for i in range(K))} FROM pred")
def predictions_wide(spark, d) -> DataFrame:
    out = scoring.wide(_predicted(spark, d), NAMES)
    return out.select("path", "true_idx", "pred_idx", *(micro(F.col(f"prob_c{i}")).alias(f"prob_c{i}") for i in range(K)))


def _ensemble(spark, d, weights, normalize) -> DataFrame:
    a, b = member(spark, d), member(spark, d, 11)
    out = scoring.ensemble_members([a, b], weights, normalize).join(a.select("path", "true_idx"), "path")
    return scoring.predictions(out, NAMES)


def _ensemble_sql(wa: str, wb: str) -> str:
    return f"""WITH {_A}, {_B},
mix AS (SELECT a.path, a.true_idx, list_transform(generate_series(1, {K}), lambda i: {wa} * a.probs[i] + {wb} * b.probs[i]) AS probs FROM a JOIN b USING (path)),
pred AS (SELECT path, true_idx, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS pred_idx, list_max(probs) AS confidence FROM mix)"""


_ENSEMBLE = f"path, true_idx, pred_idx, {_micro_sql('confidence')} AS confidence_micro"


def _ensemble_rows(df: DataFrame) -> DataFrame:
    return df.select("path", "true_idx", "pred_idx", micro(F.col("confidence")).alias("confidence_micro"))


@query(f"{_ensemble_sql('0.5', '0.5')} SELECT {_ENSEMBLE} FROM pred")
def ensemble_predictions(spark, d) -> DataFrame:
    return _ensemble_rows(_ensemble(spark, d, [0.5, 0.5], False))


@query(f"{_ensemble_sql('0.75', '0.25')} SELECT {_ENSEMBLE} FROM pred")
def ensemble_normalized(spark, d) -> DataFrame:
    return _ensemble_rows(_ensemble(spark, d, [3.0, 1.0], True))


@query(f"""{_ensemble_sql('0.5', '0.5')},
hits AS (SELECT 'ensemble' AS model, true_idx = pred_idx AS hit FROM pred
  UNION ALL SELECT 'a', true_idx = list_position(probs, list_max(probs)) - 1 FROM a
  UNION ALL SELECT 'b', true_idx = list_position(probs, list_max(probs)) - 1 FROM b)
SELECT model, count(*) FILTER (hit) AS correct, count(*) AS n FROM hits GROUP BY 1""")
def ensemble_vs_members(spark, d) -> DataFrame:
    tables = {"a": _predicted(spark, d), "b": _predicted(spark, d, 11), "ensemble": _ensemble(spark, d, [0.5, 0.5], False)}
    rows = report.per_split({k: v.select("true_idx", "pred_idx") for k, v in tables.items()}).withColumnRenamed("split", "model")
    return rows.groupBy("model").agg(F.count_if(F.col("true_idx") == F.col("pred_idx")).alias("correct"), F.count("*").alias("n"))


@query(f"""{_PRED_A}, long AS (SELECT path, generate_subscripts(probs, 1) - 1 AS idx, unnest(probs) AS p FROM pred),
top AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p DESC, idx) AS r FROM long)
SELECT path, CAST(r AS INTEGER) AS rank, 'c' || idx AS class, {_micro_sql('p')} AS prob_micro FROM top WHERE r <= 4""")
def topk_predictions(spark, d) -> DataFrame:
    from corvane.functions.vectors import class_at, top_k

    rows = member(spark, d).select("path", F.posexplode(top_k(F.col("probs"), 4)).alias("r", "t"))
    return rows.select("path", (F.col("r") + 1).alias("rank"), class_at(NAMES, F.col("t.idx")).alias("class"), micro(F.col("t.prob")).alias("prob_micro"))


@query(f"""{_PRED_A}, long AS (SELECT path, generate_subscripts(probs, 1) - 1 AS idx, unnest(probs) AS p FROM pred),
top AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p DESC, idx) AS r FROM long)
SELECT path AS image, max('c' || idx) FILTER (r = 1) AS pred_class, {_micro_sql('max(p)')} AS confidence,
       {', '.join(f"max('c' || idx) FILTER (r = {r}) AS top{r}_class, " + _micro_sql(f'max(p) FILTER (r = {r})') + f' AS top{r}_prob' for r in (1, 2, 3))}
FROM top GROUP BY path""")
def inference_wide(spark, d) -> DataFrame:
    out = scoring.inference(member(spark, d).select(F.col("path").alias("image"), "probs"), NAMES, 3)
    return out.select(*(micro(F.col(c)).alias(c) if c.endswith("prob") or c == "confidence" else F.col(c) for c in out.columns))


# ---- reports -------------------------------------------------------------------------------------------------------

_CM = f"""{_PRED_A}, cm AS (SELECT t.i AS true_idx, p.i AS pred_idx, count(pred.path) AS n
  FROM generate_series(0, {K - 1}) t(i) CROSS JOIN generate_series(0, {K - 1}) p(i) LEFT JOIN pred ON pred.true_idx = t.i AND pred.pred_idx = p.i GROUP BY ALL)"""


def _classes_sql(source: str = "cm") -> str:
    return f"""per AS (SELECT idx, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(support) AS BIGINT) AS support FROM (
  SELECT true_idx AS idx, CASE WHEN true_idx = pred_idx THEN n ELSE 0 END AS tp, 0 AS predicted, n AS support FROM {source}
  UNION ALL SELECT pred_idx, 0, n, 0 FROM {source}) GROUP BY idx),
classes AS (SELECT idx, tp, predicted, support,
  CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / predicted END AS "precision",
  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / support END AS recall_r1,
  CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE ELSE CAST(2 * tp AS DOUBLE) / (predicted + support) END AS f1 FROM per)"""


_SUMMARY = ", ".join(
    [f"{_micro_sql('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS accuracy"]
    + [f'{_micro_sql(f"""avg("{m}")""")} AS macro_{m}, {_micro_sql(f"""sum(support * "{m}") / sum(support)""")} AS weighted_{m}' for m in report.MEASURES]
)


def _cells(spark, d) -> DataFrame:
    return report.confusion(_predicted(spark, d), K)


def _summary_micro(classes: DataFrame) -> DataFrame:
    out = report.summary(classes)
    return out.select(*(micro(F.col(c)).alias(c) for c in out.columns))


@query(f"{_CM} SELECT true_idx, pred_idx, n FROM cm")
def confusion_matrix_long(spark, d) -> DataFrame:
    return _cells(spark, d)


@query(f"{_CM} SELECT true_idx, {', '.join(f'CAST(sum(n) FILTER (pred_idx = {i}) AS BIGINT) AS c{i}' for i in range(K))} FROM cm GROUP BY 1")
def confusion_matrix_wide(spark, d) -> DataFrame:
    return report.confusion_wide(_cells(spark, d), NAMES)


@query(f'{_CM}, {_classes_sql()} SELECT \'c\' || idx AS class, "precision", recall_r1, f1, support FROM classes')
def per_class_metrics(spark, d) -> DataFrame:
    return report.per_class(_cells(spark, d)).select(F.concat(F.lit("c"), F.col("idx")).alias("class"), *report.MEASURES, "support")


@query(f"{_CM}, {_classes_sql()} SELECT {_SUMMARY} FROM classes")
def summary_metrics(spark, d) -> DataFrame:
    return _summary_micro(report.per_class(_cells(spark, d)))


@query(f"""{_CM}, {_classes_sql()}, s AS (SELECT {_SUMMARY}, CAST(sum(support) AS BIGINT) AS support FROM classes)
SELECT 'c' || idx AS label, {_micro_sql('"precision"')} AS "precision", {_micro_sql('recall_r1')} AS recall, {_micro_sql('f1')} AS f1, support FROM classes
UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM s
UNION ALL SELECT 'macro avg', macro_precision, macro_recall_r1, macro_f1, support FROM s
UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall_r1, weighted_f1, support FROM s""")
def classification_report(spark, d) -> DataFrame:
    out = report.classification_report(report.per_class(_cells(spark, d)), NAMES)
    return out.select("label", *(micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), "support")


_LINES = """li AS (SELECT CAST(l_linenumber % 4 AS BIGINT) AS true_idx, CAST(CAST(floor(l_quantity) AS BIGINT) % 4 AS BIGINT) AS pred_idx FROM lineitem),
cm AS (SELECT true_idx, pred_idx, count(*) AS n FROM li GROUP BY ALL)"""


@query(f"WITH {_LINES}, {_classes_sql()} SELECT idx, tp, predicted, support, \"precision\", recall_r1, f1 FROM classes")
def lineitem_report(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("true_idx"), (F.floor("l_quantity") % 4).alias("pred_idx"))
    return report.per_class(report.confusion(li, 4))


@query(f"""{_PRED_A}, parts AS (SELECT *, CASE CAST(path AS BIGINT) % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split FROM pred),
cm AS (SELECT s.split, t.i AS true_idx, p.i AS pred_idx, count(parts.path) AS n FROM (VALUES ('test'), ('train'), ('val')) s(split)
  CROSS JOIN generate_series(0, {K - 1}) t(i) CROSS JOIN generate_series(0, {K - 1}) p(i)
  LEFT JOIN parts ON parts.split = s.split AND parts.true_idx = t.i AND parts.pred_idx = p.i GROUP BY ALL),
per AS (SELECT split, idx, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(support) AS BIGINT) AS support FROM (
  SELECT split, true_idx AS idx, CASE WHEN true_idx = pred_idx THEN n ELSE 0 END AS tp, 0 AS predicted, n AS support FROM cm
  UNION ALL SELECT split, pred_idx, 0, n, 0 FROM cm) GROUP BY ALL)
SELECT split, 'c' || idx AS class, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / predicted END AS "precision",
       CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / support END AS recall_r1, support FROM per""")
def per_split_report_union(spark, d) -> DataFrame:
    rows = _predicted(spark, d).withColumn("part", F.col("path").cast("long") % 3)
    reports = {s: report.per_class(report.confusion(rows.where(F.col("part") == i), K)) for i, s in enumerate(("test", "train", "val"))}
    return report.per_split(reports).select("split", F.concat(F.lit("c"), F.col("idx")).alias("class"), "precision", "recall_r1", "support")


@query(f"""{_CM}, {_classes_sql()} SELECT 'c' || idx AS class, m.measure,
  {_micro_sql('CASE m.measure WHEN \'precision\' THEN "precision" WHEN \'recall_r1\' THEN recall_r1 ELSE f1 END')} AS value_micro
FROM classes CROSS JOIN (VALUES ('precision'), ('recall_r1'), ('f1')) m(measure)""")
def chart_prf_long(spark, d) -> DataFrame:
    return report.chart_rows(report.per_class(_cells(spark, d)), NAMES).select("class", "measure", micro(F.col("value")).alias("value_micro"))


@query(f"{_CM} SELECT 'c' || true_idx AS \"true\", 'c' || pred_idx AS predicted, n FROM cm")
def chart_confusion(spark, d) -> DataFrame:
    return _cells(spark, d).select(F.concat(F.lit("c"), F.col("true_idx")).alias("true"), F.concat(F.lit("c"), F.col("pred_idx")).alias("predicted"), "n")


# ---- training telemetry --------------------------------------------------------------------------------------------

_WEIGHTS = """w AS (SELECT CAST(i AS BIGINT) AS class_idx, count(label) AS n, CAST((SELECT count(*) FROM embeddings) AS DOUBLE) / ({k} * CASE WHEN count(label) = 0 THEN 1 ELSE count(label) END) AS weight
  FROM generate_series(0, {k} - 1) t(i) LEFT JOIN embeddings ON label = i GROUP BY 1)"""


@query(f"WITH {_WEIGHTS.format(k=12)} SELECT class_idx, n, weight FROM w")
def class_weights(spark, d) -> DataFrame:
    return training.class_weights(read(spark, d, "embeddings").select(F.col("label").alias("true_idx")), 12)


_TERMS = f"""WITH {_A}, {_WEIGHTS.format(k=K)}, ws AS (SELECT list(weight ORDER BY class_idx) AS w FROM w),
lp AS (SELECT path, true_idx, list_transform(z, lambda v: v - list_max(z) - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))) AS lp FROM a),
terms AS (SELECT path, w[true_idx + 1] AS own, -w[true_idx + 1] * lp[true_idx + 1] AS nll, -list_sum(list_transform(generate_series(1, {K}), lambda i: lp[i] * w[i])) AS smooth FROM lp CROSS JOIN ws)"""
_LOSS = f"0.9 * sum(nll) / sum(own) + {0.1 / K} * sum(smooth) / sum(own)"


@query(f"{_TERMS} SELECT count(*) AS \"rows\", {_micro_sql(_LOSS)} AS loss_micro FROM terms")
def cross_entropy_weighted_smoothed(spark, d) -> DataFrame:
    return training.losses(member(spark, d), K, 0.1, []).select("rows", micro(F.col("loss")).alias("loss_micro"))


@query(f"{_TERMS} SELECT CAST(path AS BIGINT) // 64 AS batch, count(*) AS \"rows\", {_micro_sql(_LOSS)} AS loss_micro FROM terms GROUP BY 1")
def batch_weighted_loss(spark, d) -> DataFrame:
    rows = member(spark, d).withColumn("batch", F.expr("cast(path as bigint) div 64"))
    return training.losses(rows, K, 0.1, ["batch"]).select("batch", "rows", micro(F.col("loss")).alias("loss_micro"))


@query(f"{_TERMS}, b AS (SELECT count(*) AS n, {_LOSS} AS loss FROM terms GROUP BY CAST(path AS BIGINT) // 64) SELECT {_micro_sql('sum(loss * n) / sum(n)')} AS loss_micro FROM b")
def epoch_loss(spark, d) -> DataFrame:
    rows = member(spark, d).withColumn("batch", F.expr("cast(path as bigint) div 64"))
    return training.epoch_loss(training.losses(rows, K, 0.1, ["batch"])).select(micro(F.col("loss")).alias("loss_micro"))


@query(f"""WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY md5('{SEED}:3:' || vec_id), vec_id) - 1 AS position FROM embeddings)
SELECT vec_id, position, position // 64 AS batch FROM s""")
def shuffled_batches(spark, d) -> DataFrame:
    return training.shuffled_batches(read(spark, d, "embeddings").select("vec_id"), "vec_id", SEED, 3, 64).select("vec_id", "position", "batch")


@query(f"WITH {HISTORY_SQL} SELECT epoch, {_micro_sql('accuracy')} AS accuracy, {_micro_sql('train_loss')} AS train_loss, {_micro_sql('val_loss')} AS val_loss FROM history")
def history_metrics(spark, d) -> DataFrame:
    return history(spark, d).select("epoch", *(micro(F.col(c)).alias(c) for c in ("accuracy", "train_loss", "val_loss")))


_STOP = f"""WITH {HISTORY_SQL},
b AS (SELECT *, greatest(-1.0, coalesce(max(accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0)) AS before FROM history),
i AS (SELECT *, accuracy > before AS improved, sum(CASE WHEN accuracy > before THEN 1 ELSE 0 END) OVER (ORDER BY epoch) AS run FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS bad_epochs FROM i),
ran AS (SELECT * FROM n WHERE epoch <= coalesce((SELECT min(epoch) FROM n WHERE bad_epochs >= 5), 1000000))"""


@query(f"{_STOP} SELECT epoch, improved, bad_epochs FROM ran")
def early_stopping(spark, d) -> DataFrame:
    return training.checkpoints(history(spark, d), "accuracy", 5).select("epoch", "improved", "bad_epochs")


@query(f"{_STOP} SELECT max(epoch) FILTER (improved) AS best_epoch, {_micro_sql('max(accuracy)')} AS best_micro, max(epoch) AS last_epoch FROM ran")
def best_checkpoint(spark, d) -> DataFrame:
    return training.best_checkpoint(history(spark, d), "accuracy", 5).select("best_epoch", micro(F.col("best_metric")).alias("best_micro"), "last_epoch")


@query(f"""WITH {HISTORY_SQL}, n AS (SELECT max(epoch) AS n FROM history)
SELECT epoch, CAST(floor(0.5 * 0.001 * (1 + cos(pi() * epoch / n)) * 1000000000 + 0.5) AS BIGINT) AS lr_nano FROM history, n""")
def cosine_lr_schedule(spark, d) -> DataFrame:
    """The rate recorded in each epoch of the history."""
    rows = history(spark, d).select("epoch").withColumn("n", F.max("epoch").over(Window.partitionBy()))  # a row an epoch
    return rows.select("epoch", F.floor(training.cosine_lr(F.col("epoch"), 0.001, F.col("n")) * 1e9 + 0.5).cast("long").alias("lr_nano"))


@query(f"""WITH {HISTORY_SQL} SELECT epoch, tag, {_micro_sql("CASE tag WHEN 'accuracy' THEN accuracy WHEN 'train_loss' THEN train_loss ELSE val_loss END")} AS value_micro
FROM history CROSS JOIN (VALUES ('accuracy'), ('train_loss'), ('val_loss')) t(tag)""")
def scalar_log_long(spark, d) -> DataFrame:
    return training.scalar_log(history(spark, d)).select("epoch", "tag", micro(F.col("value")).alias("value_micro"))


@query(f"""WITH {HISTORY_SQL} SELECT epoch, tag, {_micro_sql("CASE tag WHEN 'train_loss' THEN train_loss ELSE val_loss END")} AS value_micro
FROM history CROSS JOIN (VALUES ('train_loss'), ('val_loss')) t(tag)""")
def chart_loss_curve(spark, d) -> DataFrame:
    return training.curves(history(spark, d)).select("epoch", "tag", micro(F.col("value")).alias("value_micro"))




# ---- a trained classifier -------------------------------------------------------------------------------------------

WIDTH, EPOCHS, RATE, SMOOTHING, DECAY = 64, 4, 0.5, 0.1, 0.01


def _fit_sql() -> str:
    """Gradient descent with momentum 0.9, one step an epoch, unrolled: weights (k, j, w, v), features in long form."""
    parts = [
        f"""e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, vec_id % 5 = 0 AS held, CAST(embedding AS DOUBLE[]) || [1.0] AS x
  FROM embeddings WHERE label BETWEEN 0 AND {K - 1})""",
        f"x AS (SELECT vec_id, held, label, unnest(x) AS x, unnest(range(1, {WIDTH + 2})) AS j FROM e)",
        f"""cw AS (SELECT k, (SELECT count(*) FROM e WHERE NOT held) / CAST({K} * greatest(1, (SELECT count(*) FROM e WHERE NOT held AND label = k)) AS DOUBLE) AS c
  FROM range({K}) t(k))""",
        f"w0 AS (SELECT k, j, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS v FROM range({K}) t(k), range(1, {WIDTH + 2}) s(j))",
    ]
    for n in range(1, EPOCHS + 1):
        rate = f"(0.5 * {RATE} * (1 + cos(pi() * {n - 1} / {EPOCHS})))"
        for when, of, w in (("t", "NOT held", n - 1), ("h", "held", n)):
            parts += [
                f"z{when}{n} AS (SELECT vec_id, label, k, sum(x * w) AS z FROM x JOIN w{w} USING (j) WHERE {of} GROUP BY ALL)",
                f"m{when}{n} AS (SELECT vec_id, label, k, z, z - max(z) OVER r - ln(sum(exp(z - m)) OVER r) AS lp FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z{when}{n}) WINDOW r AS (PARTITION BY vec_id))",
                f"a{when}{n} AS (SELECT vec_id, label, k, z, lp, c * ({SMOOTHING} / {K} + CASE WHEN k = label THEN 1 - {SMOOTHING} ELSE 0 END) AS aim, CASE WHEN k = label THEN c ELSE 0 END AS own FROM m{when}{n} JOIN cw USING (k))",
                f"l{when}{n} AS (SELECT -sum(aim * lp) / sum(own) AS loss FROM a{when}{n})",
            ]
            if when == "t":
                parts += [
                    f"d{n} AS (SELECT vec_id, k, exp(lp) * sum(aim) OVER (PARTITION BY vec_id) - aim AS d FROM at{n})",
                    f"g{n} AS (SELECT k, j, sum(d * x) / (SELECT sum(own) FROM at{n}) AS g FROM d{n} JOIN x USING (vec_id) GROUP BY ALL)",
                    f"w{n} AS (SELECT k, j, w - {rate} * nv AS w, nv AS v FROM (SELECT k, j, w, 0.9 * v + g + {DECAY} * w AS nv FROM w{n - 1} JOIN g{n} USING (k, j)))",
                ]
        parts.append(f"r{n} AS (SELECT avg(CASE WHEN k = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS r FROM zh{n}) WHERE r = 1)")
    rows = [
        f"SELECT CAST({n} AS BIGINT) AS epoch, {_micro_sql(f'(SELECT loss FROM lt{n})')} AS train_loss, {_micro_sql(f'(SELECT loss FROM lh{n})')} AS val_loss, "
        f"{_micro_sql(f'(SELECT accuracy FROM r{n})')} AS accuracy, {_micro_sql(f'0.5 * {RATE} * (1 + cos(pi() * {n} / {EPOCHS}))')} AS lr"
        for n in range(1, EPOCHS + 1)
    ]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


def _fitted(spark, d):
    """All labelled embeddings: a fifth is held out to choose the best epoch."""
    from corvane import fitting

    rows = read(spark, d, "embeddings").where(f"label between 0 and {K - 1}").select("vec_id", F.col("embedding").alias("features"), "label")
    settings = fitting.Settings(EPOCHS, RATE, K, WIDTH, "sgd", DECAY, smoothing=SMOOTHING, weighted=True, best_metric="accuracy")
    return fitting.fit(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), settings)


@query(_fit_sql())
def training_history(spark, d) -> DataFrame:
    """Each epoch of a classifier trained on the embeddings."""
    rows = [tuple(r[c] for c in ("epoch", "train_loss", "val_loss", "accuracy", "lr")) for r in _fitted(spark, d).history]
    df = spark.createDataFrame(rows, "epoch bigint, train_loss double, val_loss double, accuracy double, lr double")
    return df.select("epoch", *(micro(F.col(c)).alias(c) for c in df.columns[1:]))



@query(f"""WITH {member_sql('m')}, s AS (SELECT path, list_transform(z, lambda v: 2 * v) AS z FROM m_z),
e AS (SELECT path, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM s),
p AS (SELECT path, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
SELECT path, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS pred_idx, {_micro_sql('list_max(p)')} AS confidence FROM p""")
def external_scorer(spark, d) -> DataFrame:
    """A scorer that a module outside the registry makes, with an artefact shipped to the workers."""
    from corvane import models
    from corvane.functions.vectors import argmax, softmax
    from corvane.sources.store import Store

    folder = _shared(spark, "run")
    Store(spark).save_json({"scale": 2.0}, f"{folder}/scale.json")
    one = models.scorer(spark, {"factory": "corvane.plans.fixtures:scaled_scorer", "artifacts": {"settings": "scale.json"}}, folder)
    rows = models.score_all(member(spark, d).select("path", F.col("logits").alias("z")), [one], drop=("z",))
    p = softmax(F.get("logits", F.lit(0)))
    return rows.select("path", argmax(p).cast("long").alias("pred_idx"), micro(F.array_max(p)).alias("confidence"))


@query(_ORACLE["ensemble_predictions"])
def ensemble_bucketed(spark, d) -> DataFrame:
    """The same ensemble from members stored by path: the join shuffles nothing."""
    stored = [scoring.store_member(member(spark, d, start).select("path", "true_idx", "probs"), _shared(spark, "member"), 8) for start in (1, 11)]
    out = scoring.ensemble_members(stored, [0.5, 0.5], False).join(stored[0].select("path", "true_idx"), "path")
    return _ensemble_rows(scoring.predictions(out, NAMES))


# ---- sinks and sources of their own ---------------------------------------------------------------------------------

@query(_ORACLE["manifest_read_back"])
def single_csv_read_back(spark, d) -> DataFrame:
    """The whole manifest as one named CSV file, joined from the tasks' parts in order, and read by its schema."""
    from corvane import schemas
    from corvane.single_csv import write_single_csv
    from corvane.sources.files import read_manifest

    indexed = curate.with_class_index(_manifest(spark, d), curate.class_index(spark, CLASS_MAP))
    path = f"{_shared(spark, 'single')}/all.csv"
    named = curate.with_processed_path(indexed, paths=documents_as_files(spark, d))
    write_single_csv(named.select(*schemas.MANIFEST.names), path, ["split", "class_name", "src_path"])
    return read_manifest(spark, path)


@query(f"""WITH {HISTORY_SQL} SELECT epoch, tag, {_micro_sql("CAST(CAST(CASE tag WHEN 'accuracy' THEN accuracy WHEN 'train_loss' THEN train_loss ELSE val_loss END AS FLOAT) AS DOUBLE)")} AS value_micro
FROM history CROSS JOIN (VALUES ('accuracy'), ('train_loss'), ('val_loss')) t(tag)""")
def event_files_read_back(spark, d) -> DataFrame:
    """The history as framed event files, read back with every checksum verified: numbers have 32 bits there."""
    from corvane import events

    folder = _shared(spark, "events")
    events.write_events(training.scalar_log(history(spark, d)), folder).write.format("noop").mode("overwrite").save()
    return events.read_events(spark, folder).select("epoch", "tag", micro(F.col("value")).alias("value_micro"))


@query(_ORACLE["audit_summary"])
def audit_observed(spark, d) -> DataFrame:
    """The audit's counters, observed while its tables are written: no job counts."""
    from pyspark.sql import Observation

    routed, repeated, path = Observation(), Observation(), _shared(spark, "routed")
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    _routed_pages(spark, d).observe(routed, of(audit.VALID), of(audit.INVALID), of(audit.ERROR)).write.parquet(path)
    audit.duplicate_files(audit.valid_files(spark.read.parquet(path))).observe(repeated, F.count("*").alias("n")).write.parquet(f"{path}-repeated")
    row = (routed.get[audit.VALID], routed.get[audit.INVALID], routed.get[audit.ERROR], repeated.get["n"])
    return spark.createDataFrame([row], "valid bigint, invalid bigint, errors bigint, duplicates bigint")


@query("""SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents WHERE lang = 'en'""")
def file_tree_read_back(spark, d) -> DataFrame:
    """Every document as a file below its language; the English ones are read by a filter that prunes the other folders."""
    from corvane.sources.tree import located, scan

    root = _shared(spark, "tree")

    def put(batches):
        fs, base = located(root)
        for batch in batches:
            for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                fs.create_dir(f"{base}/{lang}/{doc % 50}", recursive=True)
                with fs.open_output_stream(f"{base}/{lang}/{doc % 50}/{doc}.txt", compression=None) as out:
                    out.write(text.encode())
            yield batch.select(["doc_id"])

    read(spark, d, "documents").select("doc_id", "lang", "text").mapInArrow(put, "doc_id long").write.format("noop").mode("overwrite").save()
    rows = scan(spark, root, (".txt",)).where(F.col("raw_rel_path").startswith("en/"))
    return rows.select(F.regexp_extract("raw_rel_path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha256"), "length")


@query("""WITH n AS (SELECT doc_id, doc_id % 4 AS kind, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE kind WHEN 1 THEN 'byte 33: the checksum of chunk IDAT is wrong'
  WHEN 2 THEN CASE WHEN n < 8 THEN 'byte 33: the file ends within a chunk' ELSE 'byte 33: chunk IDAT goes beyond the end' END
  WHEN 3 THEN 'byte ' || (57 + n) || ': 2 bytes after the end' END AS fault FROM n""")
def image_integrity(spark, d) -> DataFrame:
    """Every document's text in a PNG's chunks: whole, with a wrong checksum, cut, and with bytes after the end."""
    from corvane.operators.integrity import image_faults

    four = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    raw, kind = F.col("text").cast("binary"), F.col("doc_id") % 4
    head = F.unhex(F.lit("89504E470D0A1A0A" "0000000D49484452" "0000000100000001" "0802000000" "907753DE"))
    body = F.concat(F.lit(b"IDAT"), raw)
    crc = F.crc32(body).bitwiseXOR((kind == 1).cast("long"))
    whole = F.concat(head, four(F.octet_length(raw)), body, four(crc), F.unhex(F.lit("0000000049454E44AE426082")))
    length = F.octet_length(whole)
    content = F.when(kind == 2, F.substr(whole, F.lit(1), length - 20)).when(kind == 3, F.concat(whole, F.lit(b"ab"))).otherwise(whole)
    return read(spark, d, "documents").select("doc_id", content.alias("content")).select("doc_id", image_faults(F.col("content")).alias("fault"))
