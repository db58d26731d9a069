"""Line deduplication within one edited word, by a join of deletion neighbourhoods; DataFrame functions only.

A line of MIN_WORDS words or more goes if an earlier line (smaller id, or same document and earlier place) is equal to
it, word by word, or differs by one inserted, deleted or replaced word; with five words or more that keeps a similarity
of 0.8. A shorter line goes if an earlier one is equal to it; lines without a word stay. Lines are judged on the input,
not on what is left.

Equal lines are one class from the first aggregate on; a class stands where its first line stands. Two lines within one
edit share their first or last half, so only classes that share a half emit their neighbourhood: themselves, and
themselves without each word of the other half, as 64-bit hashes with the place left out. Lines that agree in hash and
place differ by that one word; a line that equals another's variant lacks one word. Each finds the least of such lines
by windows, first within its bucket of lines, without a shuffle; only what is least there is dealt by its hash and
looks on. So of a hash that very many lines share one row a bucket travels, and those lines point to as many others as
there are buckets. What was found is verified on the words.

Cases: a null text is empty. A null id counts as one of the highest ids, LAST less a hash of the text, so rows without
an id are ordered by that and no task holds them all. Rows that share an id are one document as to order, so no line
takes its equal at the same place. An empty table gives an empty one; other columns are carried in `rest`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, id_text, read, total_bytes

MIN_WORDS = 5
PART_BYTES = 16 << 20
WHOLE, APART = -1, -2
LAST = (1 << 63) - 1
UNNAMED = (1 << 61) - 1
EARLIER = "({by}.did < of.did or ({by}.did = of.did and {by}.no < of.no))"


def plain(line: Column) -> Column:
    """The line's words, each parted from the next by one blank. The costly steps run only where they change a line."""
    blank = F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")), F.translate(line, "\t\r\x0b\x0c", "    ")).otherwise(line)
    return F.trim(F.when(F.contains(blank, F.lit("  ")), F.regexp_replace(blank, " +", " ")).otherwise(blank))


def word_count(plain_line: Column) -> Column:
    """1 for an empty line too, which is as short as one of a word."""
    return F.octet_length(plain_line) - F.octet_length(F.replace(plain_line, F.lit(" "), F.lit(""))) + 1


def variants(lines: DataFrame) -> DataFrame:
    """(bucket, of, sides, words) to (bucket, of, variant long, place int): the hash of the words without the one at each
    place, and at place WHOLE that of all words. Dealt by bucket, nothing is shuffled.

    sides: which halves are shared with another line, 0 the last and 1 the first; the edit lies in the other half, so
    only its places are left out. A hash is the xor of the words' hashes with their places; without a word, those before
    it keep their places and those after it move up by one."""
    word = lines.select("bucket", "of", "sides", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    least = F.floor((F.col("n") - 1) / 2)
    inside = (F.array_contains("sides", 0) | (F.col("place") >= least)) & (F.array_contains("sides", 1) | (F.col("place") < F.col("n") - least))
    word = word.select("bucket", "of", "place", inside.alias("inside"), F.xxhash64("word", "place").alias("own"), F.xxhash64("word", F.col("place") - 1).alias("moved"))
    line = Window.partitionBy("bucket", "of")
    before = line.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    up_to = line.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    word = word.select(
        "bucket", "of", "place", "inside", F.coalesce(F.bit_xor("own").over(before), none).alias("before"), F.bit_xor("moved").over(up_to).alias("up_to"),
        F.bit_xor("own").over(line).alias("whole"), F.bit_xor("moved").over(line).alias("moved"),
    )
    without = F.struct(F.col("before").bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("up_to")).alias("variant"), F.col("place"))
    whole = F.struct(F.col("whole").alias("variant"), F.lit(WHOLE).alias("place"))
    first = F.col("place") == 0
    found = F.when(first & F.col("inside"), F.array(without, whole)).when(first, F.array(whole)).when(F.col("inside"), F.array(without))
    return word.select("bucket", "of", F.explode(found).alias("v")).select("bucket", "of", "v.variant", "v.place")


def _met(near: DataFrame, *within: str) -> DataFrame:
    """Adds least, the least line of the same variant and place, and met, the least line one edit away, or this one."""
    same, variant = Window.partitionBy(*within, "variant", "place"), Window.partitionBy(*within, "variant")
    whole = F.col("place") == WHOLE
    df = near.withColumn("least", F.min("of").over(same))
    df = df.withColumns({"all_words": F.min(F.when(whole, F.col("of"))).over(variant), "lacking": F.min(F.when(~whole, F.col("of"))).over(variant)})
    return df.withColumn("met", F.when(whole, F.least("of", "lacking")).otherwise(F.least("least", "all_words"))).drop("all_words", "lacking")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two lists of words differ by at most one inserted, deleted or replaced word: what they share from the
    front and from the back leaves at most one word of the longer."""
    same = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False), F.lit(0)).cast("int")
    front, back = same(a, b), same(F.reverse(a), F.reverse(b))
    longest = F.greatest(F.size(a), F.size(b))
    return (front == 0) | ((front - 1) + (back - 1) >= longest - 1)


def _classes(docs: DataFrame) -> DataFrame:
    """Classes of equal lines: (h1, h2), where the first stands (did, no), and hashes of their halves."""
    line = docs.select("did", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    line = line.select("did", "no", plain(F.col("line")).alias("line")).withColumn("n", word_count(F.col("line")))
    place = F.col("did").cast("decimal(38,0)") * F.lit(1 << 32) + F.col("no")  # fits a hash aggregate's buffer
    big, small = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    # Lines too short to have variants have no halves; those of a line with an odd number of words are the same twice.
    half = lambda side, i, h: F.when((F.col("n") >= MIN_WORDS) & ((big != small) if i else F.lit(True)), F.xxhash64(F.lit(side), h, F.call_function("substring_index", F.col("line"), F.lit(" "), h if side else -h)))
    keys = {f"k{side}{i}": half(side, i, h) for side in (0, 1) for i, h in enumerate((big, small))}
    rows = line.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), place.cast("decimal(38,0)").alias("place"), *(k.alias(c) for c, k in keys.items()))
    found = rows.groupBy("h1", "h2").agg(F.min("place").alias("place"), *(F.min(c).alias(c) for c in keys))
    did = F.floor(F.col("place") / F.lit(1 << 32)).cast("long")
    return found.select("h1", "h2", did.alias("did"), F.pmod(F.col("place"), F.lit(1 << 32).cast("decimal(38,0)")).cast("int").alias("no"), *keys)


def deduplicate_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, text, n_lines long, n_removed long, rest struct)."""
    scratch = scratch or Scratch(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))).alias("rest")
    unnamed = F.lit(LAST) - F.xxhash64("text").bitwiseAND(F.lit(UNNAMED))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("did"), "doc_id", "text", packed)
    classes = scratch.table(_classes(docs))
    n = max(8, math.ceil(total_bytes(docs) / PART_BYTES))
    base = docs.repartition(n, "did")

    sided = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"k{side}{i}").alias("key")) for side in (0, 1) for i in (0, 1)))
    keyed = classes.where("k00 is not null").select("did", "no", F.explode(sided).alias("k")).select("did", "no", "k.side", "k.key").where("key is not null")
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    wanted = keyed.join(shared, "key", "left_semi").groupBy("did", "no").agg(F.collect_set("side").alias("sides"))
    wanted = wanted.groupBy("did").agg(F.collect_list(F.struct("no", "sides")).alias("wanted")).hint("shuffle_hash")
    # The condition names the other columns too (it always holds): so the texts have one and the same exchange here and
    # at the end, and Spark runs it once.
    held = F.hash(base["doc_id"], base["rest"], F.size(wanted["wanted"])).bitwiseOR(F.lit(1)) != 0
    texts = base.join(wanted, (base["did"] == wanted["did"]) & held).select(base["did"], "wanted", F.split("text", "\n").alias("lines"))
    # Two uses of lines, else the optimizer would split the text again for each line.
    at = lambda w: F.when(w["no"] < F.size("lines"), F.get("lines", w["no"]))
    found = texts.select("did", F.explode(F.transform("wanted", lambda w: F.struct(w["no"].alias("no"), w["sides"].alias("sides"), at(w).alias("line")))).alias("l"))
    line = found.select("did", "l.no", "l.sides", plain(F.col("l.line")).alias("line")).where(word_count(F.col("line")) >= MIN_WORDS)
    # Of rows that share an id, another may have a line there too: it is an earlier line for others all the same.
    of = F.struct("did", "no", F.xxhash64("line").alias("h1")).alias("of")
    line = line.select(of, "sides", F.split("line", " ").alias("words"))
    lines = line.withColumn("bucket", F.pmod(F.xxhash64("of"), F.lit(n)).cast("int")).repartition(n, "bucket")
    lines = lines.dropDuplicates(["bucket", "of"])  # of repeated rows

    near = _met(variants(lines), "bucket")
    # A line that has met an earlier one of its variant and place here needs look no further; it stands for none elsewhere.
    stands = ~F.expr(EARLIER.format(by="least"))
    near = near.select("of", F.when(stands, F.col("variant")).otherwise(F.xxhash64("of", "place")).alias("variant"), F.when(stands, F.col("place")).otherwise(APART).alias("place"), F.col("met").alias("by"))
    near = _met(near.repartition(n, "variant"))
    alone = F.col("place") == APART
    by = F.when(alone, F.col("by")).otherwise(F.least("by", "met")).alias("by")
    links = near.select("of", by).where(EARLIER.format(by="by")).groupBy("of").agg(F.min("by").alias("by"))

    words = lambda c: lines.select(F.col("of").alias(c), F.col("words").alias(f"{c}_words"))
    true = links.join(words("of"), "of").join(words("by"), "by").where(within_one_edit(F.col("of_words"), F.col("by_words")))
    places = lambda df, c: df.groupBy("did").agg(F.collect_set(F.struct("no", "h1")).alias(c)).hint("shuffle_hash")
    first, gone = places(classes.select("did", "no", "h1"), "first"), places(true.select("of.did", "of.no", "of.h1"), "gone")
    content = F.xxhash64("text")
    several = docs.groupBy("did").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").select("did", F.lit(True).alias("several"))
    out = base.join(first, "did", "left").join(gone, "did", "left").join(several, "did", "left")
    no_places = F.array().cast("array<struct<no: int, h1: bigint>>")
    out = out.select("doc_id", "rest", "several", F.coalesce("first", no_places).alias("first"), F.coalesce("gone", no_places).alias("gone"), F.split("text", "\n").alias("lines"))

    # Where rows share an id, places are told apart by the lines' hashes. Marks are compared as sets, so a document of
    # very many lines costs no square of them.
    mark = lambda no, h1: F.concat(F.lpad(F.hex(no), 8, "0"), F.lpad(F.hex(h1), 16, "0"))
    marks = lambda c: F.transform(c, lambda p: mark(p["no"], p["h1"]))
    own = F.array_intersect(F.transform("lines", lambda x, i: mark(i, F.xxhash64(plain(x)))), marks("first"))
    by_hash = F.transform(F.array_except(own, marks("gone")), lambda m: F.conv(F.substring(m, 1, 8), 16, 10).cast("int"))
    stay = F.when(F.col("several"), by_hash).otherwise(F.array_except(F.col("first.no"), F.col("gone.no")))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.ltrim(x, F.lit(" \t\r\x0b\x0c")) == "", i)), lambda i: i.isNotNull())
    out = out.select("doc_id", "rest", "lines", F.array_sort(F.array_union(blank, stay)).alias("stay"))
    kept = F.transform("stay", lambda i: F.get("lines", i))
    n_lines, n_left = F.size("lines").cast("long"), F.size("stay").cast("long")
    return out.select("doc_id", F.array_join(kept, "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_removed"), "rest")


def op7_lines(spark, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(id_text(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
