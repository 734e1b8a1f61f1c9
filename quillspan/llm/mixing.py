"""Operator 4, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Sources share the total by weight; no target exceeds `most` times its source
(the excess is shared again by weight). A source is drawn in whole passes and one partial pass. Each
pass is cut into blocks of documents by a keyed permutation. A binary tree over the output shards
splits the exact number of blocks of every source: a node with n blocks of which the left half of
its shards takes m draws the sources' parts from the multivariate hypergeometric law, one source after
the other, by inverting the univariate law at a keyed uniform number. Leaves hold the shards' quotas;
each takes a range of the source's permuted blocks, so that blocks are disjoint, and orders its
documents by a keyed hash. DataFrame and SQL functions only.

Defined results: a null text has size 0; null is a source of its own, the last; sources of size 0
have target 0; repeated rows are separate draws with equal keys told apart by their text; an empty
table gives an empty mix. Extra columns are ignored. Reruns agree: all randomness is keyed by
(seed, source, document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NOT_SPACE, Scratch, only

#: Blocks of a source: one for every so many documents, and at most so many.
BLOCK_DOCS, MOST_BLOCKS = 256, 65_536
#: Sources in a group; a node of the tree deals its half among groups, and a group its part among its sources.
GROUP = 256


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of docs; key tells repeated rows with different texts apart."""
    return only(docs, "doc_id", "source", "text").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("key"))


def running(df: DataFrame, order: list, sums: dict[str, F.Column], scratch: Scratch) -> DataFrame:
    """df with `rank` (from 0) and running sums, this row's included, in a total order over all rows.

    Rows are dealt out by ranges of the order; what a range adds is known from one row for each range, so no
    task and not the driver holds more than a range's rows or a row for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(F.count("*").alias("rank"), *[F.sum(c).alias(n) for n, c in sums.items()]).collect()  # a row for each range
    before, at = [], {n: 0 for n in ("rank", *sums)}
    for r in sorted(totals, key=lambda r: r["__part"]):
        before.append((r["__part"], *at.values()))
        at = {n: v + r[n] for n, v in at.items()}
    kinds = ", ".join(f"__{n} {'double' if any(isinstance(r[n], float) for r in totals) else 'long'}" for n in at)
    offsets = df.sparkSession.createDataFrame(before, f"__part int, {kinds}")
    w = Window.partitionBy("__part").orderBy(*order)
    here = {n: F.col(f"__{n}") + F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}
    return placed.join(offsets, "__part").select(*df.columns, (F.col("__rank") + F.row_number().over(w) - 1).alias("rank"), *[c.alias(n) for n, c in here.items()])


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, weight, target) of sizes(source, size).

    Water filling in closed form: sources are capped in order of most * size / weight, least first.
    With c sources capped, the others share what is left at one rate per weight; the right c is the
    first at which no other source exceeds its cap.
    """
    per = scratch.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    choices = F.array(*map(F.lit, weights))
    ordered = running(per, [F.col("source").asc_nulls_last()], {}, scratch)
    weighed = ordered.select("source", "source_size", "n_docs", F.get(choices, (F.col("rank") % len(weights)).cast("int")).cast("long").alias("weight"))
    cap = most * F.col("source_size")
    line = scratch.keep(running(weighed, [cap / F.col("weight"), F.col("source").asc_nulls_last()], {"caps": cap, "weights": F.col("weight")}, scratch))
    total = line.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # the rate if all sources before this one are capped; the first source whose cap is not reached sets the rate
    rate = (F.lit(total["size"]) - F.col("caps") + cap) / (F.lit(total["weight"]) - F.col("weights") + F.col("weight"))
    free = line.select("rank", rate.alias("rate")).where(rate * F.col("weight") < cap)
    level = free.agg(F.min_by("rate", "rank").alias("rate"), F.min("rank").alias("rank")).first()
    if level["rank"] is None:
        return line.select("source", "source_size", "n_docs", "weight", cap.cast("double").alias("target"))
    shared = F.least(cap.cast("double"), F.lit(level["rate"]) * F.col("weight"))
    return line.select("source", "source_size", "n_docs", "weight", F.when(F.col("rank") < level["rank"], cap.cast("double")).otherwise(shared).alias("target"))


def unit(*cols) -> F.Column:
    """A number in [0, 1) keyed by cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def ln_factorial(n) -> F.Column:
    """ln n! by Stirling's series, shifted so that it holds for small n as well."""
    x = n.cast("double") + 8.0
    series = x * F.ln(x) - x - 0.5 * F.ln(x) + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    down = n.cast("double")
    product = (down + 1) * (down + 2) * (down + 3) * (down + 4) * (down + 5) * (down + 6) * (down + 7)
    return series - F.ln(product)


def let(value, body) -> F.Column:
    """body(value), with value in the plan once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total, good, drawn, u) -> F.Column:
    """The number of good ones among `drawn` of `total`, by inversion at u.

    Sums the law from eight deviations below its mean to eight above; the mass outside is below 1e-13.
    """

    def spread(a):
        t = F.greatest(a["total"], F.lit(2)).cast("double")
        mean = a["drawn"] * a["good"] / F.greatest(a["total"], F.lit(1)).cast("double")
        return F.struct(a.alias("a"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), mean * (1 - a["good"] / t) * (a["total"] - a["drawn"]) / (t - 1))).alias("spread"))

    def bounds(s):
        a = s["a"]
        low = F.greatest(F.lit(0), a["drawn"] + a["good"] - a["total"], F.floor(s["mean"] - 8 * s["spread"] - 2).cast("long"))
        high = F.least(a["good"], a["drawn"], F.ceil(s["mean"] + 8 * s["spread"] + 2).cast("long"))
        return F.struct(a.alias("a"), low.alias("low"), high.alias("high"))

    def first(b):
        a, low = b["a"], b["low"]
        terms = [(1, a["good"]), (-1, low), (-1, a["good"] - low), (1, a["total"] - a["good"]), (-1, a["drawn"] - low), (-1, a["total"] - a["good"] - a["drawn"] + low), (-1, a["total"]), (1, a["drawn"]), (1, a["total"] - a["drawn"])]
        signs, values = F.array(*[F.lit(float(k)) for k, _ in terms]), F.array(*[v.cast("long") for _, v in terms])
        return F.struct(a.alias("a"), low.alias("low"), b["high"].alias("high"), F.exp(F.aggregate(F.zip_with(signs, values, lambda k, n: k * ln_factorial(n)), F.lit(0.0), lambda x, y: x + y)).alias("p"))

    def picked(c):
        a, low, high = c["a"], c["low"], c["high"]

        def step(s, k):
            over = s["sum"] + s["p"] > a["u"]
            ratio = (a["good"] - k).cast("double") * (a["drawn"] - k) / ((k + 1) * (a["total"] - a["good"] - a["drawn"] + k + 1).cast("double"))
            moved = F.struct((s["p"] * ratio).alias("p"), (s["sum"] + s["p"]).alias("sum"), (k + 1).alias("x"))
            return F.when(over | (s["x"] < k), s).otherwise(moved)

        state = F.struct(c["p"].alias("p"), F.lit(0.0).alias("sum"), low.alias("x"))
        found = F.aggregate(F.sequence(low, F.greatest(low, high - 1)), state, step)["x"]
        return F.when(low >= high, high).otherwise(F.least(found, high)).cast("long")

    given = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"))
    return let(given, lambda a: let(spread(a), lambda s: let(bounds(s), lambda b: let(first(b), picked))))


def dealt(parts: str, name: str, total, open_, seed: int, width: int) -> F.Column:
    """For each of the array `parts` of (..., name, n) how many of its n go to the left: the multivariate law, one part after the other."""

    def fold(s, part):
        x = hypergeometric(s["rest"], part["n"], s["open"], unit(F.lit(seed), F.col("node"), F.lit(width), part[name]))
        return F.struct((s["rest"] - part["n"]).alias("rest"), (s["open"] - x).alias("open"), F.concat(s["left"], F.array(x)).alias("left"))

    return F.aggregate(parts, F.struct(total.alias("rest"), open_.alias("open"), F.array().cast("array<long>").alias("left")), fold)["left"]


def split_tree(counts: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """(source, shard, quota, first): exact parts of counts(source, n) for `shards` (a power of two) equal shards.

    One level of the tree for each halving. A node's left half is first dealt among groups of about `GROUP`
    sources, then each group's part among its sources, so that a row holds a group's sources at most: parts of
    parts have the same law as parts of the whole.
    """
    groups = max(1, -(-counts.count() // GROUP))
    level = counts.select(F.lit(0).alias("node"), F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int").alias("group"), "source", F.col("n").cast("long").alias("n"))
    width = shards
    while width > 1:
        group = level.groupBy("node", "group").agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "n"))).alias("parts"), F.sum("n").alias("total"))
        half = F.shiftright(F.col("total") + F.pmod(F.col("node"), F.lit(2)), 1)
        # what shuffles is written before the laws are worked out, so that their long expressions are planned once
        if groups == 1:
            ready = scratch.keep(group.withColumn("open", half))
        else:
            node = scratch.keep(group.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("group", F.col("total").alias("n")))).alias("groups"), F.sum("total").alias("total")))
            opened = scratch.keep(node.select("node", "groups", dealt("groups", "group", F.col("total"), half, seed, width).alias("left"))).select("node", F.inline(F.arrays_zip("groups", "left")))
            ready = scratch.keep(group.join(opened.select("node", F.col("groups.group").alias("group"), F.col("left").alias("open")), ["node", "group"]))
        cut = ready.select("node", "group", "parts", dealt("parts", "source", F.col("total"), F.col("open"), seed, width).alias("left")).select("node", "group", F.inline(F.arrays_zip("parts", "left")))
        side = lambda k, n: F.struct((F.col("node") * 2 + k).alias("node"), F.col("group").alias("group"), F.col("parts.source").alias("source"), n.alias("n"))
        level = scratch.keep(cut.select(F.inline(F.array(side(0, F.col("left")), side(1, F.col("parts.n") - F.col("left"))))))
        width //= 2
    w = Window.partitionBy("source").orderBy("node")
    return level.select("source", F.col("node").alias("shard"), F.col("n").alias("quota"), (F.sum("n").over(w) - F.col("n")).alias("first"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 16, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, draws (array of (pass, shard, words, place)).

    `place` orders a shard's documents; `words` is how many of the document's words the draw takes, fewer
    than its size only for the one document of a source at which its partial pass ends. A document that the mix leaves out has no draws. Explode
    draws and partition by shard to write the mix.
    """
    scratch = Scratch(docs.sparkSession, "op4")
    sizes = scratch.keep(sized(docs))
    wanted = scratch.keep(targets(sizes, scratch, weights, most))
    plan = wanted.withColumn("whole", F.least(F.lit(most), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-12)).cast("int"))
    plan = plan.withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("blocks", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS)).cast("long"))
    plan = scratch.keep(plan)
    placed = sizes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    u = unit(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("key"))
    placed = placed.withColumn("u", u).withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))
    placed = scratch.keep(placed.select("doc_id", "source", "size", "key", "source_size", "target", "whole", "part", "blocks", "u", "block"))
    # how far the partial pass reaches, first by blocks, then in the block where it ends
    block = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first("whole").alias("whole"))
    along = Window.partitionBy("source").orderBy("block")
    block = scratch.keep(block.withColumn("before", F.sum("words").over(along) - F.col("words")))
    reach = block.select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    inside = placed.join(reach, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    within = Window.partitionBy("source", "block").orderBy("u", "doc_id", "key", "size")
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    drawn = inside.withColumn("start", start).withColumn("extra", (F.col("part") > 0) & (F.col("start") < F.round("part")))
    # exact quotas of blocks: each pass's blocks, the partial pass up to where it reaches
    passes = block.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("whole") - F.when(F.col("part") > F.col("before"), 0).otherwise(1))).alias("pass"), "whole", "part", "before").where("pass >= 0 and (pass < whole or part > before)")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.col("source"), F.col("pass"), F.col("block")), "pass", "block")
    ranked = scratch.keep(passes.select("source", "block", "pass", (F.row_number().over(order) - 1).alias("rank")))
    quotas = split_tree(ranked.groupBy("source").agg(F.count("*").alias("n")), shards, seed, scratch)
    q = quotas.where("quota > 0").select(F.col("source").alias("s"), "shard", "first", "quota")
    dealt = ranked.join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("quota")))
    by_block = dealt.groupBy("source", "block").agg(F.collect_list(F.struct("pass", "shard")).alias("shards")).select(F.col("source").alias("s2"), F.col("block").alias("b2"), "shards")
    out = drawn.join(by_block, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")), "left")
    mine = F.filter(F.coalesce("shards", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: (d["pass"] < F.col("whole")) | F.col("extra"))
    draws = F.transform(F.sort_array(mine), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] < F.col("whole"), F.col("size")).otherwise(F.least(F.col("size"), F.round("part").cast("long") - F.col("start"))).alias("words"), F.xxhash64(F.lit(seed), d["shard"], d["pass"], F.col("doc_id"), F.col("key")).alias("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"))
