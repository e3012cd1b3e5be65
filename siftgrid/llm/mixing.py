"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and `most` copies, the ones closest in
relative entropy to an even rate are sought under one token constraint a source:
the rates' tokens meet its target. The optimum is an exponential tilt of the
odds, rate = most / (1 + (most - 1) * exp(-tilt * size / scale)), and the tilts
minimise a convex dual, found by Newton steps.

A rate depends on the source and the size alone. Sizes are dealt into bins (each
size of its own up to 64 words, then 64 bins a doubling), so a source has at most
about 2,000 bins whatever its documents. One aggregation with map-side sums gives
the bins; gradient and curvature are sums over them, for all sources in parallel.

Rounding goes through a source's bins from the largest size down and gives each
bin the whole number of further copies that keeps the tokens taken nearest to the
rates' tokens so far. Which documents of a bin get them goes by the hash of the
document's id and text, so rows without an id spread too: the bin's rows are counted
in slots of the hash, and only the rows of the one slot in which the number runs out
are numbered, so no bin meets in a task.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrid.llm.common import WORD, cut, table

SLOTS = 4096
STEPS = 60


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bin_of(size: Column) -> Column:
    """Sizes to 64 have bins of their own; above, 64 bins a doubling."""
    return F.when(size <= 64, size).otherwise(F.floor(F.log2(size.cast("double")) * 64) - 6 * 64 + 64).cast("int")


def targets(sources: DataFrame, weights: list[float], total_share: float, most: float) -> DataFrame:
    """Target words of each source (source, words): `total_share` of all words by weight, none above `most` times its words.

    What is above is reshared by weight. With the sources in order of most *
    words / weight, those that stop are the first ones, so running sums tell
    where sharing settles. One row a source: the windows see that many rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levelled = (
        weighed.withColumn("limit", most * F.col("words"))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("wanted", total_share * F.sum("words").over(whole))
    )
    share = (F.col("wanted") - F.col("stopped")) / F.col("open_weight")
    settled = levelled.withColumn("share", F.when(F.col("level") >= share, share)).withColumn("share", F.max("share").over(whole))
    return settled.select(
        "source",
        "words",
        F.least("limit", F.coalesce(F.col("share") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _rate(tilt: Column, x: Column, most: float) -> Column:
    return most / (1.0 + (most - 1.0) * F.exp(-tilt * x))


def tilts(bins: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """source, target, words, tilt, bins: the dual's solution of each source.

    Newton steps with a bracket: a step that leaves it is replaced by its middle,
    so every source converges. A target of all `most` copies needs no tilt.
    """
    grouped = bins.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n", "tokens")), asc=False).alias("bins"), F.sum("n").alias("docs")
    )
    joined = grouped.join(goals, grouped["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    scale = F.greatest(F.lit(1.0), F.col("words") / F.col("docs"))
    mean = lambda b: b["tokens"] / b["n"]

    def step(s: Column, _: Column) -> Column:
        tilt = s["tilt"]
        sums = F.aggregate(
            F.col("bins"),
            F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("g")),
            lambda a, b: F.struct(
                (a["f"] + b["tokens"] * _rate(tilt, mean(b) / scale, most)).alias("f"),
                (
                    a["g"]
                    + b["tokens"]
                    * (mean(b) / scale)
                    * _rate(tilt, mean(b) / scale, most)
                    * (1.0 - _rate(tilt, mean(b) / scale, most) / most)
                ).alias("g"),
            ),
        )
        # Bound to a struct so that the sums are made once a step.
        return F.element_at(F.transform(F.array(sums), lambda v: _moved(s, v)), 1)

    def _moved(s: Column, v: Column) -> Column:
        off = v["f"] - F.col("target")
        low = F.when(off < 0, s["tilt"]).otherwise(s["low"])
        high = F.when(off < 0, s["high"]).otherwise(s["high"] * 0 + s["tilt"])
        newton = s["tilt"] - off / F.greatest(v["g"], F.lit(1e-300))
        inside = (newton > low) & (newton < high)
        at = F.when(F.abs(off) <= 1e-9 * F.col("target"), s["tilt"]).when(inside, newton).otherwise((low + high) / 2)
        return F.struct(at.alias("tilt"), low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"))
    solved = F.reduce(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["tilt"]
    return joined.select("source", "words", "target", scale.alias("scale"), "bins", solved.alias("tilt"))


def copies(solved: DataFrame, most: float) -> DataFrame:
    """source, target, bin, base, extra: each document of a bin has `base` copies and `extra` of them one more."""
    r = lambda b: F.when(F.col("target") >= most * F.col("words") * (1 - 1e-12), F.lit(float(most))).otherwise(
        F.when(F.col("target") <= 0, 0.0).otherwise(_rate(F.col("tilt"), b["tokens"] / b["n"] / F.col("scale"), most))
    )

    def take(s: Column, b: Column) -> Column:
        base = F.floor(r(b) + 1e-9)
        # Words owed before this bin's further copies, over the mean size of its documents.
        owed = s["owed"] + b["tokens"] * (r(b) - base)
        extra = F.when((b["tokens"] == 0) | (base >= most), F.lit(0)).otherwise(
            F.greatest(F.lit(0), F.least(b["n"], F.round(owed / (b["tokens"] / b["n"])).cast("long")))
        )
        return F.struct(
            (owed - extra * b["tokens"] / b["n"]).alias("owed"),
            F.concat(s["out"], F.array(F.struct(b["bin"].alias("bin"), b["n"].alias("n"), base.cast("long").alias("base"), extra.cast("long").alias("extra")))).alias("out"),
        )

    start = F.struct(F.lit(0.0).alias("owed"), F.expr("cast(array() as array<struct<bin:int,n:bigint,base:bigint,extra:bigint>>)").alias("out"))
    return solved.select("source", "target", F.inline(F.reduce("bins", start, take)["out"]))


def mix(docs: DataFrame, weights: list[float] | None = None, total_share: float = 1.5, most: int = 2, row_key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, target, copies, taken and the columns `row_key` for every row of docs.

    Sources take the weights in turn, in code-point order, null last and as a
    source of its own. A null text has size 0; such and wordless documents take
    no words. Repeated rows of one id, source and size are alike, so which of
    them gets a copy makes no difference; where their texts matter, row_key names
    hash columns that tell rows apart. Runs agree. Other columns are ignored; an
    empty table gives no rows.
    """
    sized = cut(
        docs.select("doc_id", "source", *row_key, size_of().alias("size"), F.xxhash64(*(row_key or ("doc_id", "text"))).alias("key"))
        .withColumn("bin", bin_of(F.col("size")))
        .withColumn("slot", F.pmod("key", F.lit(SLOTS)).cast("int"))
    )
    bins = sized.groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    goals = targets(bins.groupBy("source").agg(F.sum("tokens").alias("words")), weights or [3.0, 1.0, 2.0], total_share, most)
    plan = cut(copies(tilts(bins, goals, float(most)), float(most)))

    # The slot in which a bin's further copies run out, and how many of them fall into it.
    per_slot = sized.groupBy("source", "bin", "slot").agg(F.count("*").alias("here"))
    some = plan.where("extra > 0 and extra < n")
    p = some.alias("p")
    in_bin = Window.partitionBy("source", "bin").orderBy("slot")
    edges = (
        per_slot.join(p, per_slot["source"].eqNullSafe(F.col("p.source")) & (per_slot["bin"] == F.col("p.bin")))
        .select(per_slot["source"], per_slot["bin"], "slot", "here", "extra")
        .withColumn("upto", F.sum("here").over(in_bin))
        .where("upto - here < extra and upto >= extra")
        .select("source", "bin", F.col("slot").alias("edge"), (F.col("extra") - F.col("upto") + F.col("here")).alias("left"))
    )
    e = edges.alias("e")
    full = plan.alias("q").join(e, F.col("q.source").eqNullSafe(F.col("e.source")) & (F.col("q.bin") == F.col("e.bin")), "left").select(
        "q.*", "e.edge", "e.left"
    )
    f = full.alias("f")
    planned = sized.alias("s").join(f, F.col("s.source").eqNullSafe(F.col("f.source")) & (F.col("s.bin") == F.col("f.bin"))).select(
        "s.*", "f.target", "f.n", "f.base", "f.extra", "f.edge", "f.left"
    )
    on_edge = planned.where("slot <=> edge and edge is not null")
    numbered = on_edge.withColumn("k", F.row_number().over(Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *row_key)))
    clear = planned.where("edge is null or slot <> edge").withColumn("k", F.lit(None).cast("int"))
    one_more = (
        F.when(F.col("extra") >= F.col("n"), 1)
        .when(F.col("edge").isNull(), 0)
        .when(F.col("slot") < F.col("edge"), 1)
        .when(F.coalesce(F.col("k") <= F.col("left"), F.lit(False)), 1)
        .otherwise(0)
    )
    both = clear.unionByName(numbered).withColumn("copies", F.col("base") + one_more)
    return both.select("doc_id", "source", *row_key, "size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    words = mixed.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = words.alias("w")
    return mixed.alias("m").join(w, F.col("m.source").eqNullSafe(F.col("w.source"))).select(
        "m.doc_id", "m.size", "w.source_size", "m.target", "m.taken"
    )
