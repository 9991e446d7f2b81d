"""Mixing sources to target weights, in DataFrame and SQL functions only.

1. Targets: sources share ``share`` times all words by weight; a target stops at ``most`` times its source's
   words and its excess is shared anew by weight until none is above (one pass over sources in the order of
   limit over weight gives the level at which sharing ends).
2. Blocks: a hash of the id puts the documents of a source in a fixed random order, cut into about
   sqrt(documents) blocks.  Whole passes take every block; a last pass takes blocks in order until the
   quota of words is met, so that only one block of each source has to be looked into row by row.
3. Shards: a splitting tree gives every output shard its exact number of blocks of each source.  At a node
   the left child gets half of the blocks, drawn without replacement: multivariate hypergeometric counts,
   by inversion of a hash.  Children own disjoint ranges of the blocks of each source.
4. Within a shard rows are ordered by a hash.

Only tables with a row a source, or a row a block, are joined to documents; they are broadcast while
counted small and shuffled otherwise.

What is taken of a document is what the shards hold of it: a block that no shard owns gives nothing.

Defined results: null texts have size 0 and nothing is taken of them; a null source is a source of its own,
the last; rows of one key, source and size are alike: where a quota ends among them each gives the same number of
words (``mixed_documents`` takes all of them or none), so no row exceeds its limit; an empty table gives an empty mix;
texts are counted whole, however long; other columns, whatever their names, are kept by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: Words of a shard, blocks of a shard at least, rows of a table that is broadcast at most.
SHARD_WORDS, LEAST_BLOCKS, BROADCAST_ROWS = 1_000_000, 8, 20_000
HASH_BITS = 60


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key, seed: int) -> F.Column:
    """60 bits of a hash, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(by_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Of rows (source, source_size, ...) one a source: adds weight and target."""
    names = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.array(*map(F.lit, weights))[(F.row_number().over(names) - 1) % len(weights)]
    limits = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0))) / F.sum("weight").over(above)
    levels = limits.withColumn("level", level).withColumn("open", F.col("level") <= F.col("limit") / F.col("weight"))
    # the level falls below the limits from one source on; the first of these is where sharing ends
    shared = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("limit") / F.col("weight"))).over(everything)
    target = F.least(F.col("limit").cast("double"), F.coalesce(shared * F.col("weight"), F.col("limit").cast("double")))
    return levels.withColumn("target", target).drop("limit", "level", "open")


def _draw(k: str, n: str, total: str, u: str) -> str:
    """SQL for a hypergeometric draw: of n drawn from total, how many are of k marked ones.

    Weights are summed over twelve deviations around the mode, from a start of 1, and u inverts their sum.
    """
    mode = f"CAST(floor(({n} + 1D) * ({k} + 1D) / ({total} + 2D)) AS BIGINT)"
    width = f"CAST(ceil(12 * sqrt({n} * (1D * {k} / greatest({total}, 1)) * (1 - 1D * {k} / greatest({total}, 1)) * (1D * ({total} - {n}) / greatest({total} - 1, 1)))) + 2 AS BIGINT)"
    low = f"greatest(0L, {n} - ({total} - {k}), {mode} - {width})"
    high = f"least({k}, {n}, {mode} + {width})"
    ratio = f"(1D * ({k} - x) * ({n} - x) / ((x + 1D) * greatest(1D, {total} - {k} - {n} + x + 1D)))"
    xs = f"sequence({low}, {high})"
    start = "named_struct('w', 1D, 't', 0D)"
    total_weight = f"aggregate({xs}, {start}, (a, x) -> named_struct('w', a.w * {ratio}, 't', a.t + a.w)).t"
    picked = f"aggregate({xs}, named_struct('w', 1D, 't', 0D, 'x', -1L), (a, x) -> named_struct('w', a.w * {ratio}, 't', a.t + a.w, 'x', CASE WHEN a.x < 0 AND a.t + a.w >= goal THEN x ELSE a.x END)).x"
    # rounding may leave the goal just above the sum; then the last value is meant
    return f"transform(array({u} * {total_weight}), goal -> transform(array({picked}), x -> CASE WHEN x < 0 THEN {high} ELSE x END)[0])[0]"


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """From one row (names array<string>, blocks array<long>) to rows source, shard, first, n.

    Every shard's blocks sum to a share of all that differs by one at most; each source's sum to its quota.
    """
    nodes = quotas.select("names", F.col("blocks"), F.transform("blocks", lambda b: F.lit(0).cast("long")).alias("first"), F.lit(0).cast("long").alias("shard"))
    for level in range(depth):
        u = f"(pmod(xxhash64({seed}, {level}, s0, i), 9007199254740992) + 0.5D) / 9007199254740992D"
        step = f"""aggregate(transform(blocks, (b, i) -> named_struct('b', b, 'i', i)),
            named_struct('left', aggregate(blocks, 0L, (a, b) -> a + b) div 2, 'rest', aggregate(blocks, 0L, (a, b) -> a + b), 'out', cast(array() AS array<bigint>)),
            (s, e) -> transform(array({_draw('e.b', 's.left', 's.rest', u.replace('s0', 'shard').replace('i)', 'e.i)'))}),
                d -> named_struct('left', s.left - d, 'rest', s.rest - e.b, 'out', concat(s.out, array(d))))[0]).out"""
        nodes = nodes.withColumn("l", F.expr(step))
        nodes = nodes.select("names", F.explode(F.expr("array(named_struct('blocks', l, 'first', first, 'shard', shard * 2), named_struct('blocks', zip_with(blocks, l, (b, d) -> b - d), 'first', zip_with(first, l, (f, d) -> f + d), 'shard', shard * 2 + 1))")).alias("node")).select("names", "node.*")
        if level and level % 6 == 0:
            nodes = nodes.repartition("shard")
    rows = nodes.select("shard", F.explode(F.arrays_zip("names", "first", "blocks")).alias("q"))
    return rows.select(F.col("q.names").alias("source"), "shard", F.col("q.first").alias("first"), F.col("q.blocks").alias("n")).filter("n > 0")


def _with(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


@dataclass
class Plan:
    """What has to be known of the sources to mix: see ``plan``."""

    bounds: DataFrame  # one row a source: target, whole passes, blocks, the block in which the last pass ends
    within: DataFrame  # the documents of those blocks, with the words of the block before each
    shards: DataFrame  # one row a block and pass: the shard that it goes to
    sources: int
    edge: int
    blocks: int


def plan(sized: DataFrame, seed: int = 0, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shard_words: int = SHARD_WORDS) -> Plan:
    """Of rows (key, source, size, place): quotas, the split blocks and the shards of all blocks."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    targets = source_targets(totals, weights, share, most)
    bits = F.ceil(F.log2(F.col("documents")) / 2).cast("int")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) div source_size")).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("bits", bits).withColumn("whole", F.least(whole, F.lit(most))).withColumn("rest", quota - F.col("whole") * F.col("source_size"))
    targets = checkpointed(targets)
    sources = targets.count()
    placed = sized.join(_with(targets.select("source", "bits", "rest"), sources).alias("t"), sized["source"].eqNullSafe(F.col("t.source"))).select(sized["*"], "t.bits", "t.rest").withColumn("block", F.expr(f"shiftright(place, {HASH_BITS} - bits)"))
    filled = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("block")
    ends = filled.withColumn("before", F.sum("words").over(order) - F.col("words"))
    edges = ends.join(targets.select("source", "rest").alias("t"), ends["source"].eqNullSafe(F.col("t.source"))).filter("before < t.rest AND t.rest <= before + words").select(ends["source"], "block", "before")
    bounds = targets.join(edges.alias("e"), targets["source"].eqNullSafe(F.col("e.source")), "left").select(targets["*"], F.coalesce("e.block", F.lit(-1).cast("long")).alias("edge"), F.coalesce("e.before", F.lit(0).cast("long")).alias("before"))
    bounds = checkpointed(bounds)
    edge = placed.join(_with(bounds, sources).alias("b"), placed["source"].eqNullSafe(F.col("b.source")) & (placed["block"] == F.col("b.edge"))).select(placed["source"], "key", "place", "size", F.col("b.before").alias("before"))
    # rows of one key and size are one entry
    entries = edge.groupBy("source", "key", "place", "size", "before").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("source").orderBy("place", "key", "size")
    words = F.col("size") * F.col("rows")
    within = checkpointed(entries.select("source", "key", "size", "rows", (F.col("before") + F.sum(words).over(order) - words).alias("start")))
    drawn = bounds.select("source", (F.col("whole") * F.expr("shiftleft(1L, bits)") + F.col("edge") + 1).cast("long").alias("blocks"), "target")
    sums = drawn.agg(F.sum("blocks"), F.sum("target")).first()  # one row
    blocks = int(sums[0] or 0)
    size = max(1.0, min((sums[1] or 0) / shard_words, blocks / LEAST_BLOCKS))
    depth = (int(size) - 1).bit_length()
    ordered = drawn.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks"))).alias("rows"))
    quotas = ordered.select(F.col("rows.source").alias("names"), F.col("rows.blocks").alias("blocks"))
    leaves = splitting_tree(quotas, depth, seed)
    shards = leaves.select("source", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("draw"))
    return Plan(bounds, within, checkpointed(shards), sources, within.count(), blocks)


def mixture(documents: DataFrame, made: Plan, whole_documents: bool = False) -> DataFrame:
    """Rows (key, source, size, place, ...) as the rows of the mix: a row each time a document is taken.

    Adds source_size, target, turn (which pass), taken (words), shard and order.  Documents that aren't taken
    have one row with taken 0 and no shard.  At a quota's end a document is cut by words, or, with
    ``whole_documents``, taken whole if at least half of it fits.
    """
    d = documents.join(_with(made.bounds, made.sources).alias("b"), documents["source"].eqNullSafe(F.col("b.source"))).select(documents["*"], *(F.col(f"b.{c}") for c in ("source_size", "target", "whole", "rest", "bits", "edge")))
    d = d.withColumn("block", F.expr(f"shiftright(place, {HASH_BITS} - bits)"))
    w = _with(made.within, made.edge).alias("w")
    same = d["source"].eqNullSafe(F.col("w.source")) & d["key"].eqNullSafe(F.col("w.key")) & (d["size"] == F.col("w.size"))
    d = d.join(w, same & (F.col("block") == F.col("edge")), "left").select(d["*"], F.col("w.start").alias("start"), F.col("w.rows").alias("rows"))
    words = F.col("size") * F.col("rows")
    part = F.greatest(F.lit(0), F.least(words, F.col("rest") - F.col("start")))
    part = F.when(part * 2 >= words, F.col("size")).otherwise(0) if whole_documents else F.call_function("div", part, F.col("rows"))
    last = F.when(F.col("block") < F.col("edge"), F.col("size")).when(F.col("block") == F.col("edge"), part).otherwise(0).cast("long")
    d = d.withColumn("last", last)
    turns = F.filter(F.transform(F.expr("sequence(0L, whole)"), lambda t: F.struct(t.alias("turn"), F.when(t < F.col("whole"), F.col("size")).otherwise(F.col("last")).alias("taken"), (F.expr("shiftleft(1L, bits)") * t + F.col("block")).alias("draw"))), lambda t: t["taken"] > 0)
    d = d.withColumn("t", F.explode_outer(turns))
    s = _with(made.shards, made.blocks).alias("s")
    d = d.join(s, d["source"].eqNullSafe(F.col("s.source")) & (F.col("t.draw") == F.col("s.draw")), "left")
    return d.select(*(documents[c] for c in documents.columns), "source_size", "target", F.col("t.turn").alias("turn"), F.coalesce("t.taken", F.lit(0).cast("long")).alias("taken"), F.col("s.shard").alias("shard"), F.xxhash64("place", "t.turn").alias("order"))


def sized_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    return documents.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), place(F.col(key), seed).alias("place"))


def mix_digests(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken words over all shards, and draws, in how many shards' blocks it is."""
    sized = checkpointed(sized_documents(documents).withColumn("row", F.monotonically_increasing_id()))
    mixed = mixture(sized, plan(sized))
    owned = F.col("shard").isNotNull()
    taken = F.sum(F.when(owned, F.col("taken")).otherwise(0)).alias("taken")
    return mixed.groupBy("row", F.col("key").cast("long").alias("doc_id"), "size", "source_size", "target").agg(taken, F.count_if(owned).alias("draws")).drop("row")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents of the mix, whole, in shards; the columns of ``documents``."""
    columns = documents.columns
    own = sized_documents(documents)
    made = plan(checkpointed(own))
    rows = documents.select(F.struct(*columns).alias("document"), F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), place(F.col("doc_id"), 0).alias("place"))
    mixed = mixture(rows, made, whole_documents=True).filter("taken > 0 AND shard IS NOT NULL")
    shards = mixed.repartition("shard").sortWithinPartitions("shard", "order")
    return shards.select("document.*")
