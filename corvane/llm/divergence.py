"""How far the sources of a language are from each other, and which terms set a source apart, by term frequencies.

A block of texts becomes partial runs (lang, term, source, documents, count). They are dealt by ranges of and sorted by
(lang, term, source), so that no term, however common, fills one task, and a run-length scan streams over each part. A
term that lies within a part is complete: its documents decide whether it is kept; kept ones leave a row a source. The
first and the last term of a part may go on in the next one; their runs are merged by Spark, at most two terms a part.

Shares need totals that only the whole scan knows. So the scan emits partial pairs by counts: in how many terms a source
has count c where another has count d. With the totals known, a pair's value is the sum over all kept terms of a
function of both counts, of which most are zero: all terms as if neither had any, corrected by the terms that one has
(as many rows as it has different counts) and by those that both have. No grid of terms and sources is made.

All numbers are integers of 64 bits; shares come by long division in thousands, exact up to 9 * 10**15 occurrences.

Cases: null texts, languages and sources are ''. A text without terms still makes its group. Rows are documents each,
repeated ones and those that share an id too; ids are not read. A language without kept terms has pairs of value 0 and no
terms. Ties go to the lesser item in UTF-8. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, give_back, read, slices

LEAST_DOCUMENTS, TOP, WHOLE = 3, 200, 10**9
BLOCK_BYTES = 16 << 20
CHUNK_ROWS = 100_000  # of the sorted runs, scanned at once
PAIRS = 2_000_000  # of counts, held at once

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of UTF-8 texts in lower case, and the number of the text of each."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]]))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return terms, np.searchsorted(text_ends, starts, "right")


def counted(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, source, docs, n) of every block: documents with the term, and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=block_bytes):
            terms, of = terms_of([t.encode() for t in batch.column("text").to_pylist()])
            coded = terms.dictionary_encode()
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            n_sources, n_terms, n_docs = len(source.dictionary), len(coded.dictionary), batch.num_rows
            group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
            key = np.sort((group[of] * n_terms + coded.indices.to_numpy()) * n_docs + of)
            run_of = key // max(1, n_docs)
            first = np.flatnonzero(np.diff(run_of, prepend=-1))
            new_doc = np.append(0, np.cumsum(np.diff(key, prepend=-1) != 0))
            ends = np.append(first[1:], len(key))
            group, term = np.divmod(run_of[first], max(1, n_terms))
            columns = [lang.dictionary.take(pa.array(group // n_sources)), coded.dictionary.take(pa.array(term)), source.dictionary.take(pa.array(group % n_sources))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new_doc[ends] - new_doc[first]), pa.array(ends - first)], ["lang", "term", "source", "docs", "n"])

    return docs.mapInArrow(run, "lang string, term string, source string, docs long, n long")


def changes(*columns: pa.Array) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
    return out


class PairCounts:
    """In how many terms the source s of a language has count c where its source t has count d: partial sums."""

    def __init__(self):
        self.ids: dict[tuple[str, str], int] = {}
        self.keys, self.times, self.more = [], [], []
        self.held = 0

    def numbers(self, lang: pa.Array, source: pa.Array) -> np.ndarray:
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        code, back = np.unique(lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(), return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        return np.array([self.ids.setdefault((langs[c // len(sources)], sources[c % len(sources)]), len(self.ids)) for c in code.tolist()], np.int64)[back]

    def add(self, group: np.ndarray, n: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs of runs start[i] to start[i] + size[i]; what no longer fits is given out."""
        for k in np.unique(size[size > 1]).tolist():
            begins, step = start[size == k], max(1, PAIRS // (k * (k - 1) // 2))
            wide = k * (k - 1) // 2 > PAIRS
            ways = [(np.full(k - 1 - i, i), np.arange(i + 1, k)) for i in range(k - 1)] if wide else [np.triu_indices(k, 1)]
            for at in range(0, len(begins), step):
                for i, j in ways:
                    a, b = ((begins[at : at + step, None] + x).ravel() for x in (i, j))
                    yield from self._take(group[a], group[b], n[a], n[b])

    def _take(self, s: np.ndarray, t: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        small = (np.maximum(s, t) < 1 << 16) & (np.maximum(c, d) < 1 << 16)
        if not small.all():
            yield self._rows(*(x[~small] for x in (s, t, c, d)), np.ones(int((~small).sum()), np.int64))
            s, t, c, d = (x[small] for x in (s, t, c, d))
        key = s.astype(np.uint64) << np.uint64(48) | t.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64) << np.uint64(16) | d.astype(np.uint64)
        self.keys.append(key), self.times.append(np.ones(len(key), np.int64))
        self.held += len(key)
        if self.held > 2 * PAIRS:
            self._merge()
            if self.held > PAIRS:
                yield from self.rest()

    def _merge(self) -> None:
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.keys, self.times, self.held = [key[first]], [np.add.reduceat(times[order], first)], len(first)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            key = self.keys[0]
            s, t, c, d = ((key >> np.uint64(x) & np.uint64(0xFFFF)).astype(np.int64) for x in (48, 32, 16, 0))
            yield self._rows(s, t, c, d, self.times[0])
        self.keys, self.times, self.held = [], [], 0

    def _rows(self, s, t, c, d, times) -> pa.RecordBatch:
        langs, sources = (pa.array(list(names), pa.string()) for names in zip(*self.ids))
        return emitted("pair", langs.take(pa.array(s)), None, sources.take(pa.array(s)), sources.take(pa.array(t)), c, times, d)


SCANNED = "kind string, lang string, term string, source string, other string, n long, m long, total long"


def emitted(kind: str, lang, term, source, other, n, m, total) -> pa.RecordBatch:
    """`term`: n of the source, total of the language, m one for the term's first row. `pair`: n of the source and total
    of the other in m terms. `open`: n and m, documents, of a term that may go on in another part."""
    size = len(lang)
    texts = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int8)), [kind]).dictionary_decode(), lang]
    texts += [pa.nulls(size, pa.string()) if c is None else c for c in (term, source, other)]
    return pa.RecordBatch.from_arrays(texts + [pa.array(x) for x in (n, m, total)], [c.split()[0] for c in SCANNED.split(", ")])


def scan(least: int, chunk_rows: int = CHUNK_ROWS):
    """The run-length scan over sorted (lang, term, source, docs, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, waiting, rows, first = PairCounts(), [], 0, True

        def terms(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, rows, first
            table = pa.Table.from_batches(waiting).combine_chunks()
            lang, term, source, docs, n = (c.chunk(0) for c in table.columns)
            runs = np.flatnonzero(changes(lang, term, source))
            lang, term, source = (c.take(pa.array(runs)) for c in (lang, term, source))
            docs, n = (np.add.reduceat(c.to_numpy(), runs) for c in (docs, n))
            starts = np.flatnonzero(changes(lang, term))
            if not final:  # the last term may go on
                cut = int(starts[-1])
                last = [c.slice(cut) for c in (lang, term, source)] + [pa.array(docs[cut:]), pa.array(n[cut:])]
                waiting, rows = [pa.RecordBatch.from_arrays(last, table.schema.names)], len(docs) - cut
                lang, term, source, docs, n = (c[:cut] for c in (lang, term, source, docs, n))
                starts = starts[:-1]
            if not len(starts):
                return
            size = np.diff(np.append(starts, len(docs)))
            of = np.repeat(np.arange(len(starts)), size)
            unsure = np.zeros(len(starts), bool)
            unsure[0], first = first, False
            unsure[-1] |= final
            df, total = np.add.reduceat(docs, starts), np.add.reduceat(n, starts)
            at = pa.array(np.flatnonzero(unsure[of]))
            if len(at):
                yield emitted("open", *(c.take(at) for c in (lang, term, source)), None, n[at], docs[at], n[at])
            kept = ~unsure & (df >= least)
            here = np.flatnonzero(kept[of])
            if len(here):
                at, opens = pa.array(here), np.zeros(len(docs), np.int64)
                opens[starts] = 1
                yield emitted("term", *(c.take(at) for c in (lang, term, source)), None, n[here], opens[here], total[of[here]])
                yield from pairs.add(pairs.numbers(lang, source), n, starts[kept], size[kept])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= chunk_rows and len(waiting) > 1:
                yield from terms(False)
        if waiting:
            yield from terms(True)
        yield from pairs.rest()
        give_back()

    return run


def share(n: Column, whole: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / whole), by long division, a thousand at a time."""
    out, rest = F.lit(0).cast("long"), n + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, whole), rest % whole
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block_bytes: int = BLOCK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(text, lang, source) to (lang, source, part, item, value, rank): `pair` rows to every other source of the language,
    and `term` rows of the terms whose share in the source exceeds that in the language, up to rank `top`."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    runs = scratch.table(counted(docs, block_bytes)).repartitionByRange("lang", "term", "source").sortWithinPartitions("lang", "term", "source")
    found = scratch.table(runs.mapInArrow(scan(least, chunk_rows), SCANNED))

    of_term = Window.partitionBy("lang", "term")
    merged = found.where("kind = 'open'").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("m").alias("docs"))
    merged = merged.withColumn("total", F.sum("n").over(of_term)).withColumn("m", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"))
    merged = merged.withColumn("docs", F.sum("docs").over(of_term)).where(F.col("docs") >= least)
    terms = found.where("kind = 'term'").select("lang", "term", "source", "n", "total", "m").union(merged.select("lang", "term", "source", "n", "total", "m"))
    a, b = merged.alias("a"), merged.alias("b")
    opened = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    both = found.where("kind = 'pair'").select("lang", "source", "other", "n", F.col("total").alias("d"), "m")
    both = both.union(opened.select("a.lang", "a.source", F.col("b.source").alias("other"), "a.n", F.col("b.n").alias("d"), F.lit(1).cast("long")))

    # Totals: n_all of a group, kept of a language.
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.sum("m").alias("m"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["n_all", "m"])
    langs = groups.groupBy("lang").agg(F.sum("m").alias("kept"), F.sum("n_all").alias("lang_all"))
    groups = scratch.table(groups.drop("m").join(langs, "lang").withColumn("whole", F.col("n_all") + F.col("kept")))
    without = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("whole"))).alias("p0")  # the share of a term that a source lacks
    groups = groups.select("*", without)

    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = share(F.col("n"), F.col("whole")), share(F.col("total"), F.col("lang_all") + F.col("kept"))
    apart = terms.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    apart = apart.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)

    mine = groups.select("lang", "source", F.col("whole").alias("whole_s"), F.col("p0").alias("s0"), "kept")
    others = groups.select("lang", F.col("source").alias("other"), F.col("whole").alias("whole_t"), F.col("p0").alias("t0"))
    p, q, s0, t0 = share(F.col("n"), F.col("whole_s")), share(F.col("d"), F.col("whole_t")), F.col("s0"), F.col("t0")

    def both_ways(rows: DataFrame, there: Column, back: Column) -> DataFrame:
        """(lang, source, item, value) for source and other, and for other and source."""
        ways = F.array(F.struct("source", F.col("other").alias("item"), there.alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), back.alias("value")))
        return rows.select("lang", F.inline(ways))

    neither = mine.join(others, "lang").where("source <> other")
    neither = neither.select("lang", "source", F.col("other").alias("item"), F.when(F.col("kept") > 0, F.col("kept") * gap(s0, t0)).otherwise(0).alias("value"))
    one = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(mine, ["lang", "source"]).withColumn("p", p)
    one = one.join(others, "lang").where("source <> other")
    p, m = F.col("p"), F.col("m")
    one = both_ways(one, m * (gap(p, t0) - gap(s0, t0)), m * (gap(t0, p) - gap(t0, s0)))
    both = both.groupBy("lang", "source", "other", "n", "d").agg(F.sum("m").alias("m")).join(mine, ["lang", "source"]).join(others, ["lang", "other"])
    both = both.withColumn("p", share(F.col("n"), F.col("whole_s"))).withColumn("q", q)
    q = F.col("q")
    both = both_ways(both, m * (gap(p, q) - gap(p, t0) - gap(s0, q) + gap(s0, t0)), m * (gap(q, p) - gap(t0, p) - gap(q, s0) + gap(t0, s0)))
    pairs = neither.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranks))
    return pairs.union(apart).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *,
    (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER of_group + count(*) OVER of_group))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER of_group + count(*) OVER of_group))::HUGEINT AS q
  FROM grid WINDOW of_group AS (PARTITION BY lang, source)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) v ON v.lang = a.lang AND v.source = a.source AND v.other = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
) WHERE part = 'pair' OR rank <= 200
"""
