"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over exact block quotas.

1. Sizes (words per document) are summed per source. Sources take their weights by rank; targets share the wanted
   total by weight, stop at ``max_epochs`` times their source's size, and the excess is shared again by weight among
   the rest, until none is above its stop: sources are put into the order in which they stop, and running sums give the
   level at which the rest goes on, whatever their number.
2. Each source's documents are put into a random order that a seed fixes. Running totals give every document its
   interval of words: sums per (source, bucket) first, then a window inside a bucket, so a source with a third of
   all rows is spread over all buckets. The mix takes the words [0, target) of the order repeated without end, so it
   meets the target to the word and takes no document more than ``max_epochs`` times.
3. The words a source gives are cut into blocks of ``block_words``. The blocks of all sources are split between the
   two halves of the output shards by a multivariate-hypergeometric draw (one hypergeometric draw per source, each
   under the condition of those before it), and so on down to single shards. Quotas are exact at every node. A
   shard then takes its quota as a run of the source's permuted blocks: runs are disjoint and cover everything.
4. Pieces of a shard get a shuffle key, to be sorted by inside the shard.

The draws invert the distribution function with a hash of (seed, node, source) as the uniform number, so reruns agree.
The tree holds one row per node with one entry per source: metadata, not data. The table of targets is broadcast only
up to ``BROADCAST_ROWS`` sources times shards, else joined by source, where skew is left to Spark's adaptive handling.

Defined cases: NULL text has size 0 and is never taken; a NULL source is a source of its own, ranked last; repeated
rows are documents of their own; an empty table gives an empty mix. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlint.llm.common import globally_ordered, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 4096
SHARDS = 8
SEED = 17
BROADCAST_ROWS = 200_000
ROWS_PER_BUCKET = 4_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the seed and the parts fix."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``rank`` from 0 by code point with NULL last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = globally_ordered(totals, [F.col("source").asc_nulls_last()])
    before = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    return ordered.join(F.broadcast(before), "__part").select(
        "source", "source_size", "n_docs", (F.col("before") + F.col("__at") - 1).alias("rank"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` with ``weight`` and ``target``."""
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = sources.withColumn("weight", by_rank).withColumn("stop", max_epochs * F.col("source_size"))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    # Sources stop in the order of stop by weight. Before each, what is left for it and all later ones, by their weights, is
    # the level of the water; the first that it does not reach sets the level for all that go on.
    ordered = globally_ordered(
        weighted.select("rank", "weight", "stop", (F.col("stop") / F.col("weight")).alias("ratio")), [F.col("ratio"), F.col("rank")])
    own = Window.partitionBy("__part").orderBy("__at")
    running = ordered.select("*", F.sum("stop").over(own).alias("own_stops"), F.sum("weight").over(own).alias("own_weights"))
    parts = ordered.groupBy("__part").agg(F.sum("stop").alias("stops"), F.sum("weight").alias("weights"))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = parts.select("__part", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("stops", "weights")])
    sums = weighted.agg(F.sum("weight")).first()[0] or 0
    spent = F.col("stops_before") + F.col("own_stops") - F.col("stop")
    left = F.lit(sums) - F.col("weights_before") - F.col("own_weights") + F.col("weight")
    level = (F.lit(share * total) - spent) / left
    levels = running.join(F.broadcast(before), "__part").select("ratio", "rank", level.alias("level"))
    first = levels.where(F.col("level") < F.col("ratio")).agg(F.min(F.struct("ratio", "rank", "level")).alias("first")).first()["first"]
    stop = F.col("stop").cast("double")
    return weighted.withColumn("target", stop if first is None else F.least(stop, F.lit(first["level"]) * F.col("weight")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(whole: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Marked among ``drawn`` of ``whole`` with ``marked`` marked: the hypergeometric distribution inverted.

    The range is the mean and ten standard deviations to both sides, within what is possible. Outcomes are laid out
    as the centre, those above it, those below it; their weights follow from the ratio of neighbours, so no factorial
    is needed and a draw holds three numbers.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def with_range(a: Column) -> Column:
        part = a["marked"] / F.greatest(a["whole"], one)
        mean = a["drawn"] * part
        spread = F.sqrt(mean * (1 - part) * (a["whole"] - a["drawn"]) / F.greatest(a["whole"] - 1, one))
        low = F.greatest(zero, a["drawn"] + a["marked"] - a["whole"])
        return F.struct(a["whole"].alias("whole"), a["marked"].alias("marked"), a["drawn"].alias("drawn"),
                        a["uniform"].alias("uniform"), low.alias("low"), F.least(a["marked"], a["drawn"]).alias("high"),
                        mean.alias("mean"), (10 * spread + 2).alias("reach"))

    def with_centre(a: Column) -> Column:
        first = F.least(a["high"], F.greatest(a["low"], F.floor(a["mean"] - a["reach"])))
        last = F.greatest(first, F.least(a["high"], F.ceil(a["mean"] + a["reach"])))
        return F.struct(*(a[x].alias(x) for x in ("whole", "marked", "drawn", "uniform")), first.alias("first"),
                        last.alias("last"), F.least(last, F.greatest(first, F.floor(a["mean"]))).alias("centre"))

    def answer(a: Column) -> Column:
        def ratio(k: Column) -> Column:  # p(k + 1) / p(k)
            return (a["marked"] - k) / (k + 1.0) * (a["drawn"] - k) / (a["whole"] - a["marked"] - a["drawn"] + k + 1.0)

        def walk(upwards: bool, enough: Column | None = None):
            def step(s: Column, k: Column) -> Column:
                at_centre = k == a["centre"]
                weight = F.when(at_centre, F.lit(1.0)).otherwise(
                    s["weight"] * ratio(k - 1) if upwards else s["weight"] / ratio(k))
                return _let(weight, lambda w: _let(
                    s["total"] + (w if upwards else F.when(at_centre, F.lit(0.0)).otherwise(w)),
                    lambda t: F.struct(w.alias("weight"), t.alias("total"), (s["answer"] if enough is None else F.coalesce(
                        s["answer"], F.when(t >= enough, k))).alias("answer"))))
            return step

        def begin(total: Column) -> Column:
            return F.struct(F.lit(1.0).alias("weight"), total.alias("total"), F.lit(None).cast("long").alias("answer"))

        above = F.sequence(a["centre"], a["last"])
        below = F.sequence(a["centre"], a["first"], F.lit(-1).cast("long"))
        both = F.aggregate(below, begin(F.aggregate(above, begin(F.lit(0.0)), walk(True), lambda s: s["total"])),
                           walk(False), lambda s: s["total"])
        return _let(a["uniform"] * both, lambda enough: _let(
            F.aggregate(above, begin(F.lit(0.0)), walk(True, enough)), lambda found: F.coalesce(
                found["answer"], F.aggregate(below, begin(found["total"]), walk(False, enough), lambda s: s["answer"]),
                a["first"])))

    given = F.struct(whole.alias("whole"), marked.alias("marked"), drawn.alias("drawn"), uniform.alias("uniform"))
    return _let(_let(_let(given, with_range), with_centre), answer)


def shard_quotas(blocks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rank``, ``shard``, ``first_block``, ``n``: how many of a source's ``n_blocks`` each shard takes, and from where.

    All shards get the same number of blocks, within one.
    """
    entry = F.struct(F.col("rank").alias("rank"), F.col("n_blocks").alias("n"), F.lit(0).cast("long").alias("first"))
    node = blocks.agg(F.array_sort(F.collect_list(entry)).alias("sources"), F.sum("n_blocks").alias("whole")).select(
        F.lit(0).alias("shard"), F.lit(shards).alias("width"), "sources", F.coalesce("whole", F.lit(0)).alias("whole"))
    width = shards
    while width > 1:
        left_width = F.floor(F.col("width") / 2).cast("int")
        wide = node.withColumn("left", F.when(
            F.col("width") > 1, F.floor(F.col("whole") * left_width / F.col("width")).cast("long"))
            .otherwise(F.col("whole")))

        def split(state: Column, s: Column) -> Column:
            got = F.when(state["drawn"] >= state["whole"], s["n"]).when(state["drawn"] <= 0, F.lit(0).cast(
                "long")).otherwise(_draw(state["whole"], s["n"], state["drawn"], _uniform(
                    F.col("shard"), F.col("width"), s["rank"])))
            return F.struct((state["whole"] - s["n"]).alias("whole"), (state["drawn"] - got).alias("drawn"),
                            F.array_append(state["got"], got).alias("got"))

        start = F.struct(F.col("whole").cast("long").alias("whole"), F.col("left").alias("drawn"),
                         F.array().cast("array<bigint>").alias("got"))
        drawn = wide.withColumn("got", F.aggregate("sources", start, split, lambda s: s["got"]))

        def half(right: bool) -> Column:
            def one(s: Column, i: Column) -> Column:
                got = F.get("got", i)
                return F.struct(s["rank"].alias("rank"), (s["n"] - got if right else got).alias("n"),
                                (s["first"] + got if right else s["first"]).alias("first"))
            return F.transform("sources", one)

        left = F.struct(F.col("shard").alias("shard"), F.when(F.col("width") > 1, left_width).otherwise(
            F.col("width")).alias("width"), half(False).alias("sources"), F.col("left").alias("whole"))
        right = F.struct((F.col("shard") + left_width).alias("shard"), (F.col("width") - left_width).alias("width"),
                         half(True).alias("sources"), (F.col("whole") - F.col("left")).alias("whole"))
        halves = F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(left))
        node = stored(drawn.select(F.explode_outer(halves).alias("h")).select("h.*"), "quotas")
        width = -(-width // 2)
    return node.select("shard", F.explode("sources").alias("s")).select(
        F.col("s.rank").alias("rank"), "shard", F.col("s.first").alias("first_block"), F.col("s.n").alias("n"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS,
         block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per document: ``key``, ``size``, ``source_size``, ``target``, ``pieces``: what the shards take of it,
    as (shard, epoch, from_word, n_words, shuffle_key)."""
    sizes = stored(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                               n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("digest")), "sizes")
    sources = stored(targets(ranked_sources(sizes), weights, share), "targets")
    facts = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs")).first()
    buckets = max(1, -(-facts["docs"] // ROWS_PER_BUCKET))

    order = F.xxhash64(F.lit(SEED), "key", "digest")
    placed = sizes.withColumn("order", order).withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(buckets)))
    own = Window.partitionBy("source", "bucket").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = placed.withColumn("local", F.coalesce(F.sum("size").over(own), F.lit(0)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("offset"))

    wanted = F.round("target").cast("long")
    blocks = sources.select("rank", F.ceil(wanted / F.lit(block_words)).alias("n_blocks"))
    runs = shard_quotas(blocks, shards).where(F.col("n") > 0).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("first_block") * block_words).alias("low"),
        ((F.col("first_block") + F.col("n")) * block_words).alias("high"), "shard"))).alias("runs"))
    wide = sources.join(runs, "rank", "left").select(
        F.col("source").alias("own"), "source_size", "target", wanted.alias("wanted"), "runs")
    wide = F.broadcast(wide) if facts["n"] * shards <= BROADCAST_ROWS else wide

    starts = in_bucket.alias("d").join(
        offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset"),
        F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    joined = starts.join(wide, F.col("source").eqNullSafe(F.col("own"))).withColumn(
        "start", F.col("offset") + F.col("local"))

    def of_epoch(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("start")
        end = F.least(begin + F.col("size"), F.col("wanted"))

        def of_run(run: Column) -> Column:
            low, high = F.greatest(run["low"], begin), F.least(run["high"], end)
            return F.struct(run["shard"].alias("shard"), epoch.alias("epoch"), (low - begin).alias("from_word"),
                            (high - low).alias("n_words"), F.xxhash64(
                                F.lit(SEED), F.lit("shuffle"), "key", "digest", epoch, run["shard"]).alias("shuffle_key"))

        return F.transform(F.filter(F.coalesce("runs", F.array().cast(
            "array<struct<low:bigint,high:bigint,shard:int>>")), lambda r: (r["low"] < end) & (r["high"] > begin)), of_run)

    epochs = F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))
    taken = F.filter(F.flatten(F.transform(epochs, of_epoch)), lambda p: p["n_words"] > 0)
    return joined.select("key", "digest", "source", "size", "source_size", "target", taken.alias("pieces"))


def report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, size, source_size, target and ``taken``, the words the mix takes of it."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"])
    return plan(docs, key, **options).select(
        F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"),
        F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"]))).alias("shards"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: one row per piece with shard, shuffle_key, key, source, epoch, from_word, n_words and the piece's
    words joined by single spaces. Sort by (shard, shuffle_key), or write partitioned by shard sorted that way.

    Documents join their pieces by key and text, so documents that share a key stay apart and repeated rows keep the
    pieces of each.
    """
    pieces = plan(docs, key, text, source, **options).withColumn("p", F.explode("pieces"))
    texts = docs.select(F.col(key).alias("t_key"), F.xxhash64(text).alias("t_digest"), F.col(text).alias("t_text"))
    texts = texts.where(F.col("t_text").isNotNull()).dropDuplicates(["t_key", "t_digest"]).withColumn(
        "found", F.regexp_extract_all("t_text", F.lit(WORD), F.lit(0)))
    same = F.col("key").eqNullSafe(F.col("t_key")) & (F.col("digest") == F.col("t_digest"))
    return pieces.join(texts, same).select(
        F.col("p.shard").alias("shard"), F.col("p.shuffle_key").alias("shuffle_key"), F.col("key").alias(key),
        F.col("source").alias(source), F.col("p.epoch").alias("epoch"), F.col("p.from_word").alias("from_word"),
        F.col("p.n_words").alias("n_words"),
        F.array_join(F.slice("found", F.col("p.from_word").cast("int") + 1, F.col("p.n_words").cast("int")), " ").alias(text))
