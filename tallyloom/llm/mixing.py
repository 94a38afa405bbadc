"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks.

A document's size is its number of words. Sources, by code point with null last, weigh 1, 2, 3 and so on in turn and
share the words of all; a target stops at CAP times its source's words, and the excess is shared again by weight. A
source's documents are dealt by a hash of doc_id and text to blocks of about BLOCK_WORDS words. Its target is met by whole
passes over its blocks and one partial pass, in a permuted order; in the block where the partial pass ends, documents
are taken in a permuted order for half of what is left, then the largest that fit, a few times, and at last one more if
that comes nearer. There is a shard for every SHARD_WORDS words of the mix.

The sources' exact block quotas then split among the output shards: a node's quotas split between its two children by a
multivariate-hypergeometric draw of as many blocks as the left child's shards hold, so every shard is like a random
draw without replacement from all blocks. Each shard takes its own range of each source's permuted blocks, and its
documents are ordered by hash. Everything is DataFrame functions; draws are hashes of the seed, so reruns agree.

Running sums over a source's blocks are taken in parts of about PART blocks, in the order of their hashes, and put
together from the parts' sums, so that no task holds all blocks of a large source.

Null texts have size 0; a source without words has target 0. Documents without a doc_id are dealt by their texts. Repeated
rows are rows of their own, in one block. A text that is longer than a block is a block's only one as a rule. At the
boundary, ties in the permuted order are broken by doc_id, size and text. Without documents the result is empty.
mixed() keeps all columns of the documents, also where they are named like its own; mixture() reads three of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

WEIGHTS, CAP, BLOCK_WORDS, SHARD_WORDS, PART, ROUNDS, SEED = (1, 2, 3), 3, 20_000, 2_000_000, 4096, 6, 17

#: ln x! by Stirling's series, shifted by 8.
_LN_FACT = "(({x} + 8.5) * ln({x} + 9D) - ({x} + 9D) + 0.9189385332046727D + 1 / (12 * ({x} + 9D)) - 1 / (360 * pow({x} + 9D, 3)) + 1 / (1260 * pow({x} + 9D, 5)) - ln(({x} + 1D) * ({x} + 2D) * ({x} + 3D) * ({x} + 4D)) - ln(({x} + 5D) * ({x} + 6D) * ({x} + 7D) * ({x} + 8D)))"


def ln_fact(x: str) -> str:
    return _LN_FACT.replace("{x}", f"cast({x} as double)")


def hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL for the number of good ones among draws from total, good of which are good, at uniform u.

    By inversion, over all values within 40 standard deviations of the mean; beyond, probabilities vanish in doubles.
    """
    mean = f"({draws} * cast({good} as double) / greatest({total}, 1))"
    sd = f"sqrt({mean} * (1 - {good} / cast(greatest({total}, 1) as double)) * ({total} - {draws}) / greatest({total} - 1, 1))"
    lo = f"greatest(0L, {draws} + {good} - {total}, cast(floor({mean} - 40 * {sd} - 40) as bigint))"
    hi = f"least({draws}, {good}, cast(ceil({mean} + 40 * {sd} + 40) as bigint))"
    choose = lambda n, k: f"({ln_fact(n)} - {ln_fact(k)} - {ln_fact(f'({n} - {k})')})"
    log_p = f"{choose(good, 'k')} + {choose(f'({total} - {good})', f'({draws} - k)')} - {choose(total, draws)}"
    p = f"transform(sequence({lo}, {hi}), k -> named_struct('k', k, 'p', exp({log_p})))"
    # One pass for the sum of all, kept with the array, and one to the value where the running sum passes u of it.
    return f"aggregate(array({p}), 0L, (none, q) -> aggregate(q, named_struct('c', 0D, 'k', element_at(q, 1).k, 't', {u} * aggregate(q, 0D, (s, x) -> s + x.p)), (a, x) -> named_struct('c', a.c + x.p, 'k', if(a.c < a.t, x.k, a.k), 't', a.t), a -> a.k))"


def words_of() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_key) of documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of().alias("size"), F.xxhash64(text_or_empty()).alias("text_key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target). The sources that stop at their cap are those of least cap for their weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("bound", F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("bound", cap * F.col("source_size") / F.col("weight"))
    whole = Window.partitionBy()
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(whole) - before) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("n", F.row_number().over(by_cap))
    at = F.min(F.when(F.col("bound") >= F.col("level"), F.struct("n", "level"))).over(whole)["level"]
    return filled.select("source", "source_size", "weight", F.least(cap * F.col("source_size").cast("double"), at * F.col("weight")).alias("target"))


def block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key")), F.col("blocks"))


def running(rows: DataFrame, salt: str, seed: int, value: str, *ties: str) -> DataFrame:
    """rows (place, blocks, ...) with before: the sum of value over the rows of the same place that come before in an order permuted by a hash of ties."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "place", *ties), 11)
    part = F.floor(u / 2.0**53 * F.ceil(F.col("blocks") / PART)).cast("long")
    cut = rows.withColumn("_u", u).withColumn("_part", part)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("place", "_part").agg(F.sum(value).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("place").orderBy("_part"))), F.lit(0))
    starts = sums.select("place", "_part", start.alias("_start"))
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("place", "_part").orderBy("_u", *ties))), F.lit(0))
    return cut.withColumn("_own", own).join(starts, ["place", "_part"]).withColumn("before", F.col("_start") + F.col("_own")).drop("_u", "_part", "_own", "_start")


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, place, blocks): the quota of each source, by its place, in each shard. quotas: (place, blocks)."""
    node = quotas.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "blocks"))), lambda x: x["blocks"]).alias("q"))  # a number for each source
    node = node.withColumns({"lo": F.lit(0), "n": F.lit(shards)})
    rest = 1
    while rest < shards:
        u = f"(shiftrightunsigned(xxhash64({seed}, lo, n, size(a.out)), 11) / 9007199254740992D)"
        total = "aggregate(q, 0L, (s, x) -> s + x)"
        drawn = hypergeometric("a.total", "x", "a.draws", u)
        left = f"aggregate(q, named_struct('total', {total}, 'draws', cast(floor({total} * (n div 2) / n) as bigint), 'out', cast(array() as array<bigint>)), (a, x) -> aggregate(array({drawn}), a, (b, d) -> named_struct('total', b.total - x, 'draws', b.draws - d, 'out', concat(b.out, array(d)))), a -> a.out)"
        split = node.withColumn("l", F.when(F.col("n") > 1, F.expr(left)))
        first = F.struct("lo", F.when(F.col("n") > 1, F.expr("n div 2")).otherwise(F.col("n")).cast("int").alias("n"), F.when(F.col("n") > 1, F.col("l")).otherwise(F.col("q")).alias("q"))
        second = F.struct(F.expr("cast(lo + n div 2 as int)").alias("lo"), F.expr("cast(n - n div 2 as int)").alias("n"), F.zip_with("q", "l", lambda x, y: x - y).alias("q"))
        both = F.when(F.col("n") > 1, F.array(first, second)).otherwise(F.array(first))
        node = split.select(F.explode(both).alias("x")).select("x.q", "x.lo", "x.n")
        rest *= 2
        if rest == 256:  # from here on there is work for many tasks
            node = node.repartition("lo")
    return node.select(F.col("lo").alias("shard"), F.posexplode("q").alias("place", "blocks"))


def planned(sized: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """Sources with targets and numbers of blocks, their blocks: (source, block, draws, residual), and the number of shards.

    draws: an array of (turn, shard, whole), one for each time that the block is drawn.
    """
    goal = targets(sized).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    goal = goal.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    goal = stored(goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")), "sources")
    if shards is None:
        shards = max(1, -(-int(goal.agg(F.sum("target")).first()[0] or 0) // SHARD_WORDS))
    named = sized.join(goal.select(F.col("source").alias("s"), "place", "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    words = named.groupBy("place", "blocks", block_of(seed).alias("block")).agg(F.sum("size").alias("words"))
    run = running(words, "partial", seed, "words", "block").join(goal.select("place", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest")), "place")
    in_part = (F.col("before") < F.col("rest")) & (F.col("words") > 0)
    edge = in_part & (F.col("before") + F.col("words") > F.col("rest"))
    drawn = F.sequence(F.lit(0), F.col("passes") - F.when(in_part, 0).otherwise(1))
    drawn = F.when((F.col("passes") > 0) | in_part, drawn).otherwise(F.array().cast("array<int>"))
    run = stored(run.select("place", "blocks", "block", edge.alias("boundary"), (F.col("rest") - F.col("before")).alias("residual"), "passes", drawn.alias("drawn")), "blocks")
    quotas = goal.select("place").join(run.groupBy("place").agg(F.sum(F.size("drawn")).alias("blocks")), "place", "left").select("place", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))
    leaves = splitting_tree(quotas, shards, seed).where("blocks > 0")
    # Each shard's range of a source's permuted draws, and the draws, meet in groups of PART ranks.
    by_shard = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = leaves.withColumn("end", F.sum("blocks").over(by_shard)).withColumn("start", F.col("end") - F.col("blocks"))
    ranges = ends.select("place", "shard", "start", F.explode(F.sequence(F.expr(f"start div {PART}"), F.expr(f"(end - 1) div {PART}"))).alias("g"))
    marks = ranges.select("place", "g", F.greatest("start", F.col("g") * PART).alias("rank"), F.lit(0).alias("kind"), "shard")
    one = running(run.select("place", "blocks", "block", "boundary", "residual", "passes", F.explode("drawn").alias("turn"), F.lit(1).cast("long").alias("one")), "draw", seed, "one", "block", "turn")
    draws = one.select("place", F.expr(f"before div {PART}").alias("g"), F.col("before").alias("rank"), F.lit(1).alias("kind"), "block", "turn", "residual", (~(F.col("boundary") & (F.col("turn") == F.col("passes")))).alias("whole"))
    latest = F.last("shard", ignorenulls=True).over(Window.partitionBy("place", "g").orderBy("rank", "kind").rowsBetween(Window.unboundedPreceding, 0))
    dealt = marks.unionByName(draws, allowMissingColumns=True).withColumn("shard", latest).where("kind = 1")
    by_block = dealt.groupBy("place", "block").agg(F.collect_list(F.struct("turn", "shard", "whole")).alias("draws"), F.max("residual").alias("residual"))
    return goal, by_block.join(goal.select("place", "source"), "place").select("source", "block", "draws", "residual"), shards


def with_draws(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """docs, which have doc_id, source, size and text_key, with the columns mix: (source_size, target), and draws: of the document. And the number of shards."""
    goal, blocks, shards = planned(docs.select("doc_id", "source", "size", "text_key"), shards, seed=seed)
    g = goal.select(F.col("source").alias("_s"), F.struct("source_size", "target").alias("mix"), F.col("blocks"))
    rows = docs.join(g, docs["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumn("_block", block_of(seed)).drop("blocks")
    b = stored(blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "draws", F.when(F.exists("draws", lambda d: ~d["whole"]), F.col("residual")).alias("_residual")), "draws")
    rows = rows.join(b, rows["source"].eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left").drop("_s", "_b")
    # In the block where a source's partial pass ends, one for each source: half of what is left in a permuted order, then the largest that fit.
    edge = rows.where("_residual IS NOT NULL").withColumns({"_took": F.lit(False), "_left": F.col("_residual").cast("double")})
    whole, permuted = Window.partitionBy("source", "_block"), (F.xxhash64(F.lit(seed), F.lit("document"), "doc_id", "text_key"), "doc_id", "size", "text_key")
    for k in range(ROUNDS):
        order = whole.orderBy(*([] if k == 0 else [F.desc("size")]), *permuted)
        free = F.col("_left") / (2 if k == 0 else 1)
        fits = ~F.col("_took") & (F.col("size") <= free)
        edge = edge.withColumn("_upto", F.when(fits, F.sum(F.when(fits, F.col("size"))).over(order.rowsBetween(Window.unboundedPreceding, 0))))
        new = F.coalesce(F.col("_upto") <= free, F.lit(False))
        edge = edge.withColumns({"_took": F.col("_took") | new, "_left": F.col("_left") - F.coalesce(F.sum(F.when(new, F.col("size"))).over(whole), F.lit(0))})
    # At last the smallest one, if it comes nearer with it.
    nearer = ~F.col("_took") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("_left"))
    edge = edge.withColumn("_nearer", nearer).withColumn("_place", F.row_number().over(whole.orderBy(F.desc("_nearer"), "size", *permuted)))
    edge = edge.withColumn("_took", F.col("_took") | (F.col("_nearer") & (F.col("_place") == 1))).drop("_nearer", "_place")
    edge = edge.withColumn("draws", F.when(F.col("_took"), F.col("draws")).otherwise(F.filter("draws", lambda d: d["whole"]))).drop("_took", "_left", "_upto")
    rest = rows.where("_residual IS NULL").withColumn("draws", F.coalesce("draws", F.array().cast(rows.schema["draws"].dataType)))
    return rest.unionByName(edge).drop("_block", "_residual"), shards


def mixture(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for each document; shards: one for each time it is taken."""
    out, _ = with_draws(stored(sizes(docs), "sizes"), shards)
    return out.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.array_sort(F.transform("draws", lambda d: d["shard"])).alias("shards"))


def mixed(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, a partition for each shard, in a shuffled order in each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of().alias("size"), F.xxhash64(text_or_empty()).alias("text_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    drawn, shards = with_draws(rows, shards, seed)
    dealt = drawn.select("doc_id", "text_key", "row", F.explode("draws").alias("d")).repartitionById(shards, F.col("d.shard").cast("int"))
    dealt = dealt.sortWithinPartitions("d.shard", F.xxhash64(F.lit(seed), F.lit("local"), "doc_id", "text_key", "d.turn"), "doc_id", "d.turn")
    return dealt.select("row.*")
