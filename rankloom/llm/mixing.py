"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

Method: the rows of a source are dealt by hash into blocks, and a source whose target is r times its size draws
round(r * blocks) of its permuted blocks, passing over them again where r exceeds one. A binary tree splits those exact
quotas among the output shards: at each node the left half's share of each source is a multivariate-hypergeometric
draw, made by an urn with a seeded hash as its randomness. A leaf thus holds the number of blocks that its shard takes
from each source; the shards take disjoint runs of the source's permuted draws, and each shard is ordered by a hash of
its own. The last block that a source draws is cut at the document where its words come nearest to the target.

Scale: quotas are a table of (shards x sources) counts; the text is read once and never shuffled by source. Documents
meet their block by (source, block), so that a hot source is spread over its blocks.

Defined results: a null or empty text has size 0; null sources are one source, last in order; sources of size 0 have
target 0 and take nothing; repeated rows are separate rows with one hash, hence taken alike except where a cut falls
among them; reruns agree. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, join_small, table

WEIGHTS = (5, 2, 1)
MOST = 3  # a target stops at so many times its source's size
#: Output shards: one for each SHARD_WORDS words, within these bounds; and the blocks that a shard takes on average.
SHARDS, SHARD_WORDS, BLOCKS_PER_SHARD = (16, 4096), 50_000_000, 32
SEED = 17


def size_of(text: str | Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size, ...) with nr (place in order) and target.

    Sources that reach most times their size first are found in the order of that ratio to their weight; what they
    leave is shared by the others by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("nr"), F.lit(len(weights))).cast("int") + 1)
    ranked = sizes.withColumn("nr", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    ranked = ranked.withColumn("nr2", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "nr")))
    up = Window.orderBy("nr2").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("nr2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    shares = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    level = ranked.withColumn("level", left / shares)
    free = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nr2", "level"))).over(every)["level"])
    return free.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("nr2", "level", "cap")


def _uniform(*what) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def _urn(seed: int, level: int):
    """A step of the draw at a node: passes the blocks of one source. Its state: places on the left, blocks not yet
    passed, and what went left of the sources so far."""

    def step(state, x):
        def goes_left(s, i):
            chance = _uniform(F.lit(seed), F.lit(level), F.col("first"), x["nr"], i)
            return F.when(chance * s["rest"] < s["room"], 1).otherwise(0).cast("long")

        def one(s, i):
            return F.struct((s["room"] - goes_left(s, i)).alias("room"), (s["rest"] - 1).alias("rest"))

        blocks = F.when(x["n"] > 0, F.sequence(F.lit(1).cast("long"), x["n"])).otherwise(F.array().cast("array<bigint>"))
        after = F.aggregate(blocks, F.struct(state["room"].alias("room"), state["rest"].alias("rest")), one)
        return F.struct(after["room"].alias("room"), after["rest"].alias("rest"), F.array_append(state["got"], state["room"] - after["room"]).alias("got"))

    return step


def split(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas(nr, n) -> (shard, nr, n): each shard's exact share of every source's blocks, by the splitting tree.

    A node is one row with the array of its sources' counts and the number of shards below it. Its left child takes a
    share of the blocks in proportion to its shards, drawn without replacement: the blocks pass one by one, and one
    goes left with probability (places left on the left) / (blocks not yet passed)."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("nr", F.col("n").cast("long").alias("n")))).alias("own")).select(F.lit(0).alias("first"), F.lit(shards).alias("m"), "own")
    depth = (shards - 1).bit_length()
    for level in range(depth):
        if level == 10:  # enough nodes to spread
            nodes = nodes.repartition("first")
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        half = F.floor(F.col("m") / 2).cast("int")
        nodes = nodes.withColumn("half", half).withColumn("total", total).withColumn("room", F.floor(F.col("total") * half / F.greatest(F.col("m"), F.lit(1))).cast("long"))

        none = F.struct(F.col("room").alias("room"), F.col("total").alias("rest"), F.array().cast("array<bigint>").alias("got"))
        nodes = nodes.withColumn("got", F.aggregate("own", none, _urn(seed, level), lambda s: s["got"]))
        left = F.struct(F.col("first"), F.col("half").alias("m"), F.zip_with("own", "got", lambda x, g: F.struct(x["nr"].alias("nr"), g.alias("n"))).alias("own"))
        right = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("m") - F.col("half")).alias("m"), F.zip_with("own", "got", lambda x, g: F.struct(x["nr"].alias("nr"), (x["n"] - g).alias("n"))).alias("own"))
        nodes = nodes.select(F.explode(F.filter(F.array(left, right), lambda c: c["m"] > 0)).alias("c")).select("c.*")
    return nodes.select(F.col("first").alias("shard"), F.explode("own").alias("x")).select("shard", "x.nr", "x.n")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, shards: int | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """docs with __mix, a struct of size, source_size, target and draws: one (shard, place) for each time that the mix
    takes the row. place orders the rows of a shard at random."""
    own = [f"__{i}" for i in range(len(docs.columns))]  # names that clash with none below
    sized = docs.select(*docs.columns, size_of(text), F.xxhash64(F.lit(seed), key, text), F.col(source)).toDF(*own, "__size", "__hash", "__from")
    slim = cut(docs.select(F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(F.lit(seed), key, text).alias("hash")))
    sizes = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    if shards is None:
        all_words = sizes.agg(F.sum("source_size")).first()[0] or 0
        shards = min(SHARDS[1], max(SHARDS[0], -(-all_words // SHARD_WORDS)))
    sources = targets(sizes)
    total = F.sum("source_size").over(Window.partitionBy())
    blocks = F.greatest(F.lit(1), F.round(shards * blocks_per_shard * F.col("source_size") / F.greatest(total, F.lit(1)))).cast("long")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    sources = cut(sources.withColumn("blocks", blocks).withColumn("passes", F.floor(ratio + 1e-12)).withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))))

    # the words of each permuted block, and how far the last pass of its source goes
    same = slim["source"].eqNullSafe(sources["source"])
    block = F.pmod("hash", "blocks")
    dealt = join_small(slim, sources, same).select("nr", "size", "hash", block.alias("block"), "blocks", "part")
    places = dealt.groupBy("nr", "block", "blocks", "part").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("nr").orderBy(F.xxhash64(F.lit(seed + 1), "nr", "block"), "block")
    before = F.sum("words").over(run) - F.col("words")
    places = places.withColumn("spot", F.row_number().over(run) - 1).withColumn("room", F.col("part") - before)
    places = cut(places.withColumn("how", F.when(F.col("room") <= 0, 0).when(F.col("words") <= F.col("room"), 2).otherwise(1)))
    # the one block of each source where the target falls is cut between its documents
    edge = join_small(dealt, places.where("how = 1").select(F.col("nr").alias("nr_"), F.col("block").alias("block_"), "room"), (F.col("nr") == F.col("nr_")) & (F.col("block") == F.col("block_")))
    up = Window.partitionBy("nr").orderBy("hash")
    cuts = edge.groupBy("nr", "hash", "room").agg(F.sum("size").alias("size")).withColumn("till", F.sum("size").over(up))
    cuts = cuts.where(F.col("till") - F.col("size") / 2 <= F.col("room")).groupBy("nr").agg(F.max("hash").alias("last"))

    drawn = sources.join(places.where("how > 0").groupBy("nr").agg(F.count("*").alias("extra")), "nr", "left")
    quotas = cut(split(drawn.select("nr", (F.col("passes") * F.col("blocks") + F.coalesce("extra", F.lit(0))).alias("n")), shards, seed))
    ends = F.sum("n").over(Window.partitionBy("nr").orderBy("shard"))
    runs = quotas.withColumn("end", ends).where("n > 0").groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("runs"))
    info = sources.join(cut(cuts), "nr", "left").join(runs, "nr", "left").withColumnRenamed("source", "__source")
    per_block = cut(places.select(F.col("nr").alias("nr__"), F.col("block").alias("block__"), "spot", "how"))
    info = cut(info)

    joined = join_small(sized, info, sized["__from"].eqNullSafe(info["__source"]), "left")
    joined = join_small(joined, per_block, (F.col("nr") == F.col("nr__")) & (F.pmod("__hash", "blocks") == F.col("block__")), "left")
    last = (F.col("how") == 2) | ((F.col("how") == 1) & F.coalesce(F.col("__hash") <= F.col("last"), F.lit(False)))
    times = F.col("passes") + F.when(F.col("source_size") == 0, 0).otherwise(last.cast("long"))
    draw = lambda i: F.struct(
        F.filter("runs", lambda r: r["end"] > i * F.col("blocks") + F.col("spot"))[0]["shard"].alias("shard"),
        F.xxhash64(F.lit(seed + 2), F.col("__hash"), i).alias("place"),
    )
    draws = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), draw)).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>"))
    mix = F.struct(F.col("__size").alias("size"), F.col("source_size"), F.col("target"), draws.alias("draws"))
    return joined.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)], mix.alias("__mix"))


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The mix itself with the columns of docs: a row for each time that it is taken, shard by shard, shuffled within."""
    rows = mixed(docs, **how).select(*docs.columns, F.explode("__mix.draws").alias("__draw"))
    return rows.repartition("__draw.shard").sortWithinPartitions("__draw.shard", "__draw.place").select(*docs.columns)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixed(docs)
    return out.select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", (F.size("__mix.draws") * F.col("__mix.size")).alias("taken"))
