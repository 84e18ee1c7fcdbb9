"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of words; each of its documents should be
copied target / source size times, which is seldom whole. The whole part is
taken outright. The fractional parts are rounded together: two documents meet,
word mass moves at random from one to the other (so that the expectation of each
is unchanged and their sum is kept) until one of them is in or out, and the
other goes on to meet the next. Groups of documents do this apart from each
other; what each group leaves over meets in the next level of a reduction tree,
until one document a source is left, which goes to the nearer side. A source
therefore misses its target by at most half a document.

All of it is DataFrame expressions; groups hold about `fan` documents at every
level, so a source with a third of all rows is only more groups. Draws are
hashes of document and seed, hence reruns agree.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, ordered last; repeated rows are told apart by a
counter and rounded separately; an empty table gives an empty table; extra
columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.text import count_words
from millrace.llm.work import stored

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: rank, source, source_size, rows, target.

    A source is held at `most` times its size if the common level of words a
    weight at which that happens leaves too few words for the others; this gives
    what repeated resharing of the excess ends with. The windows run over the
    table of sources, not of documents.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = most * F.col("source_size")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("level", "rank").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = share * F.sum("source_size").over(everything)
    capped = F.sum("cap").over(upto) + F.col("level") * F.coalesce(F.sum("weight").over(after), F.lit(0.0)) <= F.col("total")
    marked = ranked.withColumn("total", total).withColumn("capped", capped)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    share_of = F.col("weight") / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return marked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(left * share_of)).select("rank", "source", "source_size", "rows", "target")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


_ITEM = "struct<draw:bigint,doc_id:bigint,k:bigint,size:bigint,mass:double>"
_DONE = "array<struct<doc_id:bigint,k:bigint,size:bigint,up:boolean>>"


def _done(item: Column, up: Column) -> Column:
    return F.array(F.struct(item["doc_id"].alias("doc_id"), item["k"].alias("k"), item["size"].alias("size"), up.alias("up")))


def _with_mass(item: Column, mass: Column) -> Column:
    return F.struct(*(item[c].alias(c) for c in ("draw", "doc_id", "k", "size")), mass.alias("mass"))


def _meet(state: Column, b: Column, seed: int) -> Column:
    """The document left so far meets `b`: one of them is settled."""
    a = state["left"]
    to_a = F.least(a["size"] - a["mass"], b["mass"])
    to_b = F.least(a["mass"], b["size"] - b["mass"])
    raises = _uniform(a["draw"], b["draw"], F.lit(seed)) * (to_a + to_b) < to_b
    total = a["mass"] + b["mass"]
    a_full, b_full = a["size"] <= total, b["size"] <= total
    # Raising a: a is full and b keeps the rest, or b is empty and a has all.
    settled = F.when(raises, F.when(a_full, _done(a, F.lit(True))).otherwise(_done(b, F.lit(False)))).otherwise(F.when(b_full, _done(b, F.lit(True))).otherwise(_done(a, F.lit(False))))
    left = F.when(raises, F.when(a_full, _with_mass(b, total - a["size"])).otherwise(_with_mass(a, total))).otherwise(F.when(b_full, _with_mass(a, total - b["size"])).otherwise(_with_mass(b, total)))
    return F.when(a.isNull(), F.struct(b.alias("left"), state["done"].alias("done"))).otherwise(F.struct(left.alias("left"), F.concat(state["done"], settled).alias("done")))


def _fold(items: Column, seed: int) -> Column:
    start = F.struct(F.lit(None).cast(_ITEM).alias("left"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(F.array_sort(items), start, lambda s, b: _meet(s, b, seed))


def _item(mass: Column) -> Column:
    return F.struct("draw", "doc_id", "k", "size", mass.alias("mass"))


def _numbered(sizes: DataFrame, block: int = 4096) -> DataFrame:
    """One row for each of `n` equal rows, numbered by k from 1.

    A key may stand for a third of all rows (documents without doc_id), so numbers
    are made in blocks, and the blocks dealt out if there are many.
    """
    last = F.floor((F.col("n") - 1) / block)
    blocks = sizes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if (sizes.agg(F.max("n")).first()[0] or 0) > 64 * block:
        blocks = blocks.repartition("doc_id", "_block")
    first = F.col("_block") * block + 1
    return blocks.withColumn("k", F.explode(F.sequence(first, F.least(F.col("n"), first + block - 1)))).drop("_block")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, fan: int = 64, seed: int = 6) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words("text").alias("size"))
    sizes = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets", rows=1)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        _numbered(sizes)
        .join(targets, sizes["source"].eqNullSafe(targets["source"]))
        .select("doc_id", "k", "size", "rank", "rows", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("part"))
    )
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", "k", "size", F.lit(seed)))
    in_tree = (F.col("size") > 0) & (F.col("part") > 0)
    groups = F.ceil(F.col("rows") / fan)
    level = drawn.where(in_tree).groupBy("rank", F.pmod(F.xxhash64("draw"), groups).alias("grp")).agg(_fold(F.collect_list(_item(F.col("part") * F.col("size"))), seed).alias("state"))
    most_rows = targets.agg(F.max("rows")).first()[0] or 0
    width, settled, depth = -(-most_rows // fan), [], 0
    while True:
        level = stored(level, f"mix-level{depth}", rows=total // fan**depth + 1)
        settled.append(level.select("rank", F.explode("state.done").alias("d")).select("rank", "d.*"))
        if width <= 1:
            break
        left = level.where("state.left IS NOT NULL").select("rank", F.expr(f"grp DIV {fan}").alias("grp"), "state.left")
        level = left.groupBy("rank", "grp").agg(_fold(F.collect_list("left"), seed + depth + 1).alias("state"))
        width, depth = -(-width // fan), depth + 1
    last = level.where("state.left IS NOT NULL").select("rank", "state.left.*")
    drawn_last = last.select("rank", "doc_id", "k", "size", (2 * F.col("mass") >= F.col("size")).alias("up"))
    for more in settled:
        drawn_last = drawn_last.unionByName(more)
    whole = drawn.where(~in_tree).select("rank", "doc_id", "k", "size", F.lit(False).alias("up"))
    taken = whole.unionByName(drawn_last).join(targets, "rank")
    copies = F.floor(ratio) + F.when(F.col("up"), 1).otherwise(0)
    return taken.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
