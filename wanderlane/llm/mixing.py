"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, in a pseudorandom document order, are packed into blocks of fixed length (the last one may be short).
Output shards of a fixed number of slots draw their source counts from a multinomial distribution over the targets (one
pseudorandom number per slot, looked up in a grid of the cumulative targets). The k-th slot that a source drew, over all
shards, is mapped through the source's pseudorandom index permutation of pass k / blocks to a block, and slots and blocks
are joined by index. A permutation is a swap-or-not shuffle: a bijection of any range, computed per row, without sorting.

The draws decide how many words each source gives, as long as that is within TOLERANCE of its target; beyond, and for
sources that are to be taken `cap` times whole, the source's last slots are cut, or slots follow that no shard drew (shard
null), to the word: a source then ends at the bound that it had passed. So every source is within TOLERANCE, at least to
half a word, and no block, hence no document, is used more than `cap` times.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; documents without words
are returned with taken 0; repeated rows are separate documents; documents are ordered by a hash of id and text, so ties
there are repeated rows, which are alike; one very long text is one row, cut into blocks like any other; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop, free_name, table, with_row_key

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, CAP = 150, 2
BLOCK, SHARD_SLOTS, TOLERANCE = 256, 1024, 0.001
ROUNDS = 24
BUCKET_DOCS = 1024
SLOTS_PER_TASK = 20_000  # a permutation takes some 20 microseconds
GROUP = 1 << 10  # shards whose counts are summed together
GRID = 1 << 10  # cells of the grid of cumulative targets, besides two for each source


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """src, source_size, target, from (src, source_size): water filling by weight under a cap. One row per source.

    A source is capped when the level reaches cap * size / weight; so with the sources in the order of size / weight, the
    capped ones are a prefix, and each row can tell from prefix sums whether the level reaches it.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("src").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * share_percent / 100.0)
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("mass_left", F.col("total") - F.coalesce(cap * F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", F.col("mass_left") / F.col("weight_left"))
        .withColumn("capped", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
        .withColumn("open_level", F.max(F.when(~F.col("capped"), F.struct(-F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    return filled.select("src", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """index's place under a pseudorandom permutation of 0..n-1 that key picks: a swap-or-not shuffle of ROUNDS rounds."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.shiftright(F.xxhash64(*key, r, F.greatest(at, partner), F.lit("swap")), 17).bitwiseAND(1) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, step)


def _running(df: DataFrame, value: str, out: str, bucket: str, order: list) -> DataFrame:
    """Exclusive running sum of value in each source s, in two levels: no task sorts a whole source."""
    before = Window.partitionBy("s").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("s", bucket).agg(F.sum(value).alias("sum_")).select("s", bucket, F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
    within = Window.partitionBy("s", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("in_", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(totals, ["s", bucket]).withColumn(out, F.col("base_") + F.col("in_")).drop("base_", "in_")


def plan(sizes: DataFrame, block: int, weights: tuple, share_percent: int, cap: int, tolerance: float) -> DataFrame:
    """A row for each source: s (its number), src, source_size, target, n_blocks, and the least and most words it may give."""
    goal = targets(sizes, weights, share_percent, cap).withColumn("s", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    full, wanted = cap * F.col("source_size"), F.least(F.round("target").cast("long"), cap * F.col("source_size"))
    slack = F.when(wanted == full, F.lit(0)).otherwise(F.floor(F.col("target") * tolerance))
    return goal.select("s", "src", "source_size", "target", F.ceil(F.col("source_size") / block).cast("long").alias("n_blocks"), wanted.alias("wanted"), (wanted - slack).alias("least"), F.least(wanted + slack, full).alias("most"))


def draw_counts(goal: DataFrame, n_slots: int, total: int, n_sources: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, s, n: the multinomial counts of every shard, each slot drawing source s with probability wanted / total."""
    width = max(1, -(-total // (GRID + 2 * n_sources)))
    cum = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ends = goal.filter("wanted > 0").select("s", F.sum("wanted").over(cum).alias("hi"), "wanted").select("s", (F.col("hi") - F.col("wanted")).alias("lo"), "hi")
    grid = cut(ends.select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell")), "mix-grid", most=GRID + 3 * n_sources)
    at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(total))
    slots = goal.sparkSession.range(n_slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), at.alias("at")).withColumn("cell", F.floor(F.col("at") / width))
    return slots.join(grid, "cell").filter("lo <= at and at < hi").groupBy("shard", "s").agg(F.count("*").alias("n"))


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP,
        tolerance: float = TOLERANCE, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", key_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per row: key, doc_id, source, size, source_size, target, taken; per piece: key, shard, k, use, from, to).

    A piece is a stretch of a row's words, from (included) to `to` (not), in the slot of a shard that is the k-th of its
    source; use counts how often the source was begun. key: key_col if given (it must tell all rows apart), else a number.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    rows = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text, F.lit(seed), F.col(id_col)).alias("mark"))
    rows = cut(rows, "mix-sizes")
    n_rows = rows.count()
    bits = max(1, (n_rows // BUCKET_DOCS).bit_length())
    goal = cut(plan(rows.groupBy("src").agg(F.sum("size").alias("source_size")), block, weights, share_percent, cap, tolerance), "mix-targets", most=n_rows)
    sums = goal.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    n_slots = -(-int(sums.total) // block)

    # What each shard draws, and the place of its slots among all slots of a source.
    counts = cut(draw_counts(goal, n_slots, max(1, int(sums.total)), sums.n, shard_slots, seed), "mix-counts", most=(n_slots // shard_slots + 1) * sums.n)
    info = goal.filter("n_blocks > 0").join(counts.groupBy("s").agg(F.sum("n").alias("drawn")), "s", "left")
    room = F.col("n_blocks") * cap
    info = info.withColumn("drawn", F.least(F.coalesce("drawn", F.lit(0)), room)).withColumn("reach", F.least(room, F.greatest("drawn", F.ceil(F.col("most") / block) + cap)))
    info = cut(info.select("s", "source_size", "n_blocks", "least", "most", "drawn", "reach"), "mix-info", most=n_rows)
    placed = _running(counts.withColumn("group", F.floor(F.col("shard") / GROUP)), "n", "base", "group", ["shard"])
    # Few rows become many slots: they are dealt out before.
    most_slots = int(info.agg(F.coalesce(F.sum("reach"), F.lit(0))).first()[0])
    drawn = placed.join(info, "s").filter("base < drawn").repartition(max(1, -(-most_slots // SLOTS_PER_TASK))).select("s", "n_blocks", "shard", F.explode(F.sequence(F.col("base"), F.least(F.col("base") + F.col("n"), F.col("drawn")) - 1)).alias("k"))
    # Slots that no shard drew, of which the correction takes as many as it needs; step by step, so that no array is long.
    step = 1 << 16
    spare = info.filter("drawn < reach").withColumn("at", F.explode(F.sequence(F.floor(F.col("drawn") / step), F.floor((F.col("reach") - 1) / step))))
    spare = spare.select("s", "n_blocks", F.lit(None).cast("long").alias("shard"), F.explode(F.sequence(F.greatest("drawn", F.col("at") * step), F.least("reach", (F.col("at") + 1) * step) - 1)).alias("k"))
    use = F.floor(F.col("k") / F.col("n_blocks"))
    slots = drawn.unionByName(spare).select("s", "shard", "k", use.alias("use"), permuted(F.pmod("k", F.col("n_blocks")), F.col("n_blocks"), F.lit(seed), F.col("s"), use).alias("block"))
    slots = cut(slots, "mix-slots", most=most_slots, per_file=SLOTS_PER_TASK)

    # Words before the k-th slot: whole blocks, but for the source's short last one, met once in each pass (cap numbers at most).
    short = slots.join(info.select("s", (F.col("n_blocks") - 1).alias("block")), ["s", "block"]).groupBy("s").agg(F.collect_list("k").alias("short_at"))
    info = info.join(short, "s", "left").withColumn("missing", F.col("n_blocks") * block - F.col("source_size"))
    words_before = lambda k: block * k - F.col("missing") * F.coalesce(F.size(F.filter("short_at", lambda x: x < k)), F.lit(0))
    ends = cut(info.withColumn("words", F.least(F.greatest(words_before(F.col("drawn")), "least"), "most")).select("s", "n_blocks", "missing", "short_at", "words"), "mix-ends", most=n_rows)
    held = block - F.when(F.col("block") == F.col("n_blocks") - 1, F.col("missing")).otherwise(0)
    uses = slots.join(ends, "s").withColumn("take", F.least(held, F.col("words") - words_before(F.col("k")))).filter("take > 0").select("s", "block", "shard", "k", "use", "take")

    # Blocks of words, as stretches of documents.
    known = rows.join(goal.select(F.col("src").alias("src_"), "s", "source_size", "target"), F.col("src").eqNullSafe(F.col("src_"))).drop("src_")
    known = known.withColumn("bucket", F.shiftrightunsigned("mark", 64 - bits))
    stream = _running(known.filter("size > 0").select("s", "bucket", "key", "doc_id", "mark", "size"), "size", "start", "bucket", [F.col("mark"), F.col("doc_id"), F.col("size"), F.col("key")])
    spans = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first = F.col("block") * block
    spans = spans.select("s", "block", "key", (first - F.col("start")).alias("shift"), F.greatest(F.col("start") - first, F.lit(0)).alias("lo"), F.least(F.col("start") + F.col("size") - first, F.lit(block)).alias("hi"))
    pieces = spans.join(uses.hint("shuffle_merge"), ["s", "block"]).filter("lo < least(hi, take)")
    pieces = cut(pieces.select("key", "shard", "k", "use", (F.col("shift") + F.col("lo")).alias("from"), (F.col("shift") + F.least("hi", "take")).alias("to")), "mix-pieces", most=cap * n_rows + most_slots)
    drop(counts, slots)
    taken = pieces.groupBy("key").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    by_row = known.join(taken.hint("shuffle_merge"), "key", "left")
    return by_row.select("key", "doc_id", F.col("src").alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), pieces


def apply_mix(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each use of a document, its text without the words not taken.

    White space stays as it is: a word goes with what stands before it, the last one also with what follows it; a document
    taken whole keeps its text. A document that was used twice is two rows.
    """
    key, taken = free_name(docs, "key"), free_name(docs, "taken")
    keyed = with_row_key(docs, key)
    by_row, pieces = mix(keyed, text_col=text_col, key_col=key, **options)
    stretches = pieces.groupBy("key", "use").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("parts"), F.sum(F.col("to") - F.col("from")).alias("n"))  # of one document
    found = stretches.join(by_row.select("key", "size").hint("shuffle_merge"), "key").select(F.col("key").alias(key), F.struct(F.when(F.col("n") < F.col("size"), F.col("parts")).alias("parts"), "size").alias(taken))
    words = F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}(?:[\x20\x09-\x0D]+$)?"), F.lit(0))
    # An array of one keeps the words bound once, whatever the number of parts.
    part = F.transform(F.array(words), lambda w: F.array_join(F.transform(F.col(taken)["parts"], lambda p: F.array_join(F.slice(w, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), "")), ""))
    text = F.when(F.col(taken)["parts"].isNull(), F.col(text_col)).otherwise(F.get(part, F.lit(0)))
    return keyed.join(found.hint("shuffle_merge"), key).withColumn(text_col, text).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_row, _ = mix(table(spark, sf_dir, "documents"))
    return by_row.select("doc_id", "size", "source_size", "target", "taken")
