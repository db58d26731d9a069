"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns POINTS points of a ring of 2**32 positions; a key belongs to the first point at or after its hash. No
shard takes more rows than its room: what a full shard cannot take goes on clockwise to the next point whose shard has
room. The rooms add up to the number of rows and differ by one at most, so the counts do too. (`slack` gives every shard
more room: less overflow and fewer moved rows against looser counts.)

Rows of one arc move alike, so the way of every row follows from how many rows each arc holds. `fill` finds it from
these counts alone: shards * POINTS numbers, whatever the number of rows. In a round all rows that wait go to their next
point with room, and each shard takes its rows by arc until it is full; those that belong there came first. So as few
rows overflow as can, and each round fills a shard or ends.

Rows are numbered within their arc by windows over parts of it, dealt by a hash of the row, so two runs place it alike;
only a part that many equal rows overfill, as of one id that holds a third of all rows, is dealt by numbers drawn and
stored. The text is read once, for its size and checksum; only ids and numbers are shuffled. All of it is DataFrame
functions.

Cases: a null text counts as empty: size 16, checksum 0. Null ids are one key; rows that share an id and repeated rows
are each dealt, and only overflow parts them. Equal texts under different ids are different keys. Fewer rows than shards
leave shards empty. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, numbered, read, small_table

POINTS = 256
CELLS = 1 << 12  # of the ring, by which a key finds its point without comparing it to all points
LAW = "rows"


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard), clockwise: the first 32 bits of the MD5 of 'shard:point'."""
    return sorted((int(hashlib.md5(f"{s}:{i}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for i in range(points))


def rooms(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may take: the mean rounded up for the first ones and down for the others, times 1 + slack."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) for s in range(shards)]


def fill(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first row, rows, shard, first slot): which rows of each arc go where."""
    room, taken = list(room), [0] * len(room)
    runs, waiting = [], [(arc, 0) for arc in sorted(counts) if counts[arc]]
    while waiting:
        following, last = [0] * len(owners), 0
        for point in [*range(len(owners) - 1, -1, -1)] * 2:
            last = point if room[owners[point]] else last
            following[point] = last
        still = []
        for arc, done in waiting:
            shard = owners[following[arc]]
            rows = min(room[shard], counts[arc] - done)
            if rows:
                runs.append((arc, done, rows, shard, taken[shard]))
                room[shard], taken[shard] = room[shard] - rows, taken[shard] + rows
            if done + rows < counts[arc]:
                still.append((arc, done + rows))
        waiting = still
    return runs


def on_ring(keys: DataFrame, spots: list[tuple[int, int]]) -> DataFrame:
    """Adds `arc`, the number of the first point at or after the position `at` (long, 0 to 2**32 - 1), or 0 beyond the last.

    A cell of the ring holds the points that lie in it and the first one after it; a key compares itself with those."""
    width, cells = (1 << 32) // CELLS, []
    first, inside = 0, [[] for _ in range(CELLS)]
    for p, _ in spots:
        inside[p // width].append(p)
    for c in range(CELLS):
        cells.append((c, first, inside[c]))
        first += len(inside[c])
    cells = small_table(keys.sparkSession, cells, "_cell int, _first int, _inside array<bigint>")
    passed = F.size(F.filter("_inside", lambda p: p < F.col("at")))
    found = keys.withColumn("_cell", F.floor(F.col("at") / F.lit(width)).cast("int")).join(F.broadcast(cells), "_cell")  # CELLS rows
    return found.withColumn("arc", F.pmod(F.col("_first") + passed, F.lit(len(spots))).cast("int")).drop("_cell", "_first", "_inside")


def shard_rows(docs: DataFrame, shards: int, points: int = POINTS, slack: float = 0.0, arc_rows: int | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, size, text_crc32, shard, slot, home_shard).

    home_shard: whose point the key belongs to; another shard holds the row if that one was full."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    at = F.conv(F.substring(F.md5(F.concat(F.lit("key:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    spots = ring(shards, points)
    owners = [s for _, s in spots]
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), at.alias("at"))
    # Drawn numbers part equal rows; written once, they never change.
    keys = Scratch(spark).table(on_ring(keys, spots).drop("at").withColumn("drawn", F.floor(F.rand() * (1 << 30)).cast("int")))
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # shards * points rows at most
    runs = fill(counts, owners, rooms(sum(counts.values()), shards, slack))
    ranked = numbered(keys, "arc", counts, ["doc_id", "size", "text_crc32", "drawn"], F.xxhash64("doc_id", "size", "text_crc32"), F.col("drawn"), arc_rows)
    # An arc is cut in as many runs as shards share it: each row finds its own among them.
    by_arc: dict[int, list] = {}
    for arc, first, rows, shard, slot in runs:
        by_arc.setdefault(arc, []).append({"first": first, "shard": shard, "slot": slot})
    ways = small_table(spark, [(arc, owners[arc], r) for arc, r in by_arc.items()], "arc int, home_shard int, _runs array<struct<first:bigint,shard:int,slot:bigint>>")
    mine = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_row")), -1)
    placed = ranked.join(F.broadcast(ways), "arc").withColumn("_run", mine)
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("_run.shard").alias("shard"), (F.col("_run.slot") + F.col("_row") - F.col("_run.first")).alias("slot"), "home_shard"
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


#: The same by a recursion over the rounds. The checksum is folded over the bytes, by a table made from its polynomial.
OP11_SQL = """WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents
), keyed AS (
  SELECT doc_id, CAST(len(b) + 16 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
    CAST('0x' || substr(md5('key:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS at FROM bytes, tab
), ring AS (
  SELECT row_number() OVER (ORDER BY p, s) - 1 AS arc, p, s FROM (
    SELECT s, CAST('0x' || substr(md5(s || ':' || i), 1, 8) AS BIGINT) AS p FROM range(40) a(s), range(256) b(i))
), spots AS (SELECT p, min(arc) AS arc FROM ring GROUP BY p
), dealt AS (
  SELECT doc_id, size, text_crc32, arc, row_number() OVER (PARTITION BY arc ORDER BY doc_id, size, text_crc32) - 1 AS place
  FROM (SELECT k.*, coalesce(s.arc, 0) AS arc FROM keyed k ASOF LEFT JOIN spots s ON k.at <= s.p)
), caps AS (
  SELECT s, docs // 40 + CASE WHEN s < docs % 40 THEN 1 ELSE 0 END AS cap FROM range(40) a(s), (SELECT count(*) AS docs FROM documents)
), rounds(round, arc, owner, n, done, room, first, shard, slot) AS (
  SELECT 0, r.arc, r.s, count(d.arc), 0::BIGINT, any_value(c.cap), 0::BIGINT, NULL::BIGINT, NULL::BIGINT
  FROM ring r LEFT JOIN dealt d USING (arc) JOIN caps c ON c.s = r.s GROUP BY r.arc, r.s
  UNION ALL
  SELECT round + 1, arc, owner, n, done + taken, CASE WHEN room > 0 THEN room - sum(taken) OVER (PARTITION BY target) ELSE 0 END::BIGINT, done,
    target, (sum(taken) OVER (PARTITION BY target ORDER BY arc) - taken - target_room)::BIGINT
  FROM (
    SELECT *, greatest(0, least(n - done, target_room - (sum(n - done) OVER (PARTITION BY target ORDER BY arc) - (n - done))))::BIGINT AS taken FROM (
      SELECT *, (there // 1099511627776 % 4096)::BIGINT AS target, (there % 1099511627776)::BIGINT AS target_room FROM (
        SELECT *, coalesce(min(open) OVER (ORDER BY arc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), min(open) OVER ()) AS there FROM (
          SELECT *, CASE WHEN room > 0 THEN (arc * 4096 + owner)::HUGEINT * 1099511627776 + room END AS open, sum(n - done) OVER () AS waiting FROM rounds)
        WHERE waiting > 0)))
)
SELECT d.doc_id, d.size, d.text_crc32, 'rows' AS law, r.shard::INTEGER AS shard, (c.cap + r.slot + d.place - r.first)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, r.owner::INTEGER AS home_shard
FROM dealt d JOIN rounds r ON r.arc = d.arc AND r.round > 0 AND d.place >= r.first AND d.place < r.done JOIN caps c ON c.s = r.shard
"""
