"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, partitions, row_key, saved

#: Bytes of UTF-8 between words are space and tab to carriage return.
WORDS, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
GOLDEN = 0.6180339887498949


def mix_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Words to take of each source: ``share`` of all, dealt by weight, at most ``cap`` times the source.

    ``sizes`` has a row a source: source, source_size. Sources in code point
    order, null last, get ``weights`` in turn. What a full source cannot take
    goes to the others by weight, until none is above its cap: sources fill in
    the order of cap over weight, so one pass of running sums finds the level.
    Returns source, source_size, target. Null counts as a source of its own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    )
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.struct(-F.col("ratio"), "level"))).over(every)["level"]
    return ranked.withColumn("line", level).select("source", "source_size", F.when(F.col("line").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("line"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), block_words: int = 256, key_col: str | None = None) -> DataFrame:
    """How many words of each row a mix of the sources takes.

    Each source's rows, shuffled by a hash of the id, make a stream of words cut
    into blocks of ``block_words``. Slots of the mix are dealt by
    :func:`schedule`; a slot holds one block of its source. Streams and ranks
    come from two-level prefix sums over hash buckets, so that one source may
    hold most rows.

    Returns id_col, source, size, source_size, target, taken and slots: for each
    time that the mix comes to the row, the slot in which the row begins. Null
    text and text without words have size and taken 0. Null sources are one
    source. Rows that repeat are rows of their own. No rows give no rows.
    ``key_col`` of ``docs``, where given, comes along with each row.
    """
    spark = docs.sparkSession
    key = [key_col] * bool(key_col)
    n = 4 * partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), digest.alias("digest"), *key
    ).withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 6), 16, 10).cast("double") * n / float(1 << 24)).cast("int"))
    keyed = saved(keyed, "mix-sizes")

    per_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = saved(mix_targets(sizes, share, cap, weights), "mix-targets")
    ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_size").over(ordered), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "id", "size", *key)
    streams = (
        keyed.withColumn("nth", F.row_number().over(inside))
        .withColumn("prefix", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .select("id", "source", "size", "bucket", "nth", (F.col("base") + F.col("prefix")).alias("start"), *key)
    )

    slots = schedule(targets, block_words, n)
    taken = slots.groupBy(F.col("source").alias("t_source"), F.col("block").alias("t_block")).agg(F.sort_array(F.collect_list(F.struct("pass", "words", "slot"))).alias("ts"))  # as many as passes
    b = F.lit(block_words)
    first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
    pieces = (
        streams.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        .withColumn("begins", F.col("block") == first)
        .withColumn("lo", F.greatest(F.col("start") - F.col("block") * b, F.lit(0)))
        .withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * b, b))
    )
    overlap = lambda sum_, t: sum_ + F.greatest(F.least(F.col("hi"), t["words"]) - F.col("lo"), F.lit(0))
    got = F.aggregate("ts", F.lit(0).cast("long"), overlap)
    begun = F.transform(F.filter("ts", lambda t: t["words"] > F.col("lo")), lambda t: t["slot"])
    mixed = (
        pieces.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block")), "left")
        .groupBy("source", "bucket", "nth", "id", "size", *key)
        .agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"), F.coalesce(F.max(F.when(F.col("begins"), begun)), F.array().cast("array<long>")).alias("slots"))
    )
    about = targets.select(F.col("source").alias("s_source"), "source_size", "target")
    return mixed.join(about, F.col("source").eqNullSafe(F.col("s_source"))).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "slots", *key)


def schedule(targets: DataFrame, block_words: int = 256, n: int = 32) -> DataFrame:
    """The slots of a mix in their order: slot, source, pass, block, words.

    ``targets`` has source, source_size and target, a row a source. Point i of
    the golden-ratio sequence falls in the share of one source: slot i is that
    source's, and the n-th slot of a source takes its n-th block of
    ``block_words``, from the start again once all are taken. A source's last
    slot is cut so that it takes its target, to the word; points that fall to it
    later are no slots. So every stretch of the mix holds the sources as their
    targets ask. Points are made and ranked in ``n`` chunks.
    """
    spark = targets.sparkSession
    size, most = F.col("source_size"), F.floor("target")
    per_pass = F.ceil(size / block_words)
    passes = F.when(size > 0, F.floor(most / size)).otherwise(0)
    shares = (
        targets.withColumn("per_pass", per_pass)
        .withColumn("slots", passes * per_pass + F.ceil((most - passes * size) / block_words))
        .withColumn("top", F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_last())))  # a row a source
        .withColumn("low", F.col("top") - F.col("slots"))
        .where("slots > 0")
    )
    slots, least = shares.agg(F.max("top"), F.min("slots")).first()
    slots, least = int(slots or 0), int(least or 1)
    # Of L golden-ratio points, a share of k in M slots gets k L / M, give or take about 2 + log2(M); no gap between them exceeds 1.9 / L, so 2 M points reach every slot.
    length = min(slots + -(-slots * (2 + slots.bit_length()) // least), 2 * slots + 2)
    chunk = max(1024, -(-length // n))
    low, high = F.pmod(F.col("id"), F.lit(1 << 20)), F.floor(F.col("id") / (1 << 20))
    point = F.pmod(low * F.lit(GOLDEN) + F.pmod(high * F.lit((GOLDEN * (1 << 20)) % 1.0), F.lit(1.0)), F.lit(1.0))
    # A share is looked up by the cell of the point: some thousand cells, and a row for each that a share touches.
    wide = max(1, -(-slots // 4096))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("top") - 1) / wide))))
    points = spark.range(length).withColumn("point", point * F.lit(float(slots))).withColumn("cell", F.floor(F.col("point") / wide))
    dealt = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("top"))).withColumn("chunk", F.floor(F.col("id") / chunk))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("source", "chunk").agg(F.count("*").alias("k")).select(F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("id")
    return (
        dealt.withColumn("nth", F.row_number().over(inside) - 1)
        .join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("chunk") == F.col("b_chunk")))
        .withColumn("rank", F.col("base") + F.col("nth"))
        .where("rank < slots")
        .withColumn("pass", F.floor(F.col("rank") / F.col("per_pass")))
        .withColumn("block", F.col("rank") - F.col("pass") * F.col("per_pass"))
        .withColumn("before", F.col("pass") * size + F.col("block") * block_words)
        .withColumn("words", F.least(F.lit(block_words), size - F.col("block") * block_words, most - F.col("before")))
        .where("words > 0")
        .select(F.col("id").alias("slot"), "source", "pass", "block", "words")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, in the order of its slots, with all columns.

    A row comes once for each slot in which it begins; where the mix ends within
    a row, that last copy has only the words taken (other columns are as they
    were). Rows not taken, and rows without words, are not in it. Rows are told
    apart by id, source and text; those that repeat all three are numbered, and
    their copies dealt in that order.
    """
    text = options.get("text_col", "text")
    key_col, nth_col, plan_col, slot_col, k, r, n = (free_name(docs, f"_mix_{x}") for x in ("key", "nth", "plan", "slot", "k", "r", "n"))
    keyed = docs.withColumn(key_col, row_key(docs, options.get("id_col", "doc_id"), text, options.get("source_col", "source")))
    plan = saved(mix(keyed, key_col=key_col, **options).select(F.col(key_col).alias(k), F.struct("slots", "taken", "size").alias(plan_col)), "mix-plan")
    repeats = saved(plan.groupBy(F.col(k).alias(r)).count().where("count > 1").select(r), "mix-repeats")
    in_mix, same = plan.where(F.size(f"{plan_col}.slots") > 0), F.col(key_col).eqNullSafe(F.col(k))
    if repeats.isEmpty():
        found = keyed.join(in_mix, same).drop(k)
    else:
        found = keyed.join(in_mix.join(repeats, F.col(k).eqNullSafe(F.col(r)), "left_anti"), same).drop(k)
        hashed = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
        numbered = keyed.join(repeats, F.col(key_col).eqNullSafe(F.col(r)), "left_semi").withColumn(nth_col, F.row_number().over(Window.partitionBy(key_col).orderBy(hashed)))
        several = plan.join(repeats, F.col(k).eqNullSafe(F.col(r)), "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(plan_col)))
        found = found.unionByName(numbered.join(several, same & (F.col(nth_col) == F.col(n))).drop(k, n, nth_col))
    copies = found.select("*", F.posexplode(f"{plan_col}.slots").alias(nth_col, slot_col))
    left = F.col(f"{plan_col}.taken") - F.col(f"{plan_col}.size") * F.col(nth_col)
    words = F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORDS}"), F.lit(0))
    cut = F.when(left < F.col(f"{plan_col}.size"), F.array_join(F.slice(words, 1, left.cast("int")), "")).otherwise(F.col(text))
    ordered = copies.withColumn(text, cut).repartitionByRange(partitions(docs.sparkSession), slot_col, key_col).sortWithinPartitions(slot_col, key_col)
    return ordered.select(*docs.columns)
