"""Mixing sources to target weights, in DataFrame functions only.

Sources, in code point order with null last, weigh 1, 2, 3 and so on in turn, and share the words of all;
no target goes over `most` times its source, and what that leaves is shared again by weight. The documents
of a source, in the order of a hash of their content, are dealt into blocks of so many. Passes over the whole
source and a part of one more make its block quota, in words exactly its target. A splitting tree halves the
output shards again and again and draws from the multivariate hypergeometric law how many of each source's blocks
go to each side, so every shard gets its exact share at random. Blocks of a source, permuted, fill its quotas in turn;
they are disjoint within a pass. Within a shard documents are shuffled by hash.

Ranks and running sums over a source are those of range partitions, each begun at the sums of the ones before, so a
source, or one row repeated, that holds much of the table is spread over tasks. No list holds more than FANOUT sources.

Null text has 0 words; a very long text is a document like any other. A null source is a source. Documents without
words are taken 0 words. Rows with equal ids are drawn one by one; rows that are equal throughout can stand for each
other, so the same rows and seed give the same mix, whatever files and tasks they lie in. Other columns of the table,
whatever their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import WORD, written
from runledger.operators.ordered import running

#: Documents of a block, about, and words of an output shard, about.
BLOCK_DOCS = 512
SHARD_WORDS = 4_000_000
MOST_REPEATS = 3.0
#: Sources, or groups of sources, that share a draw at once.
FANOUT = 64


def _uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that follows from the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def targets(sources: DataFrame, most: float = MOST_REPEATS) -> DataFrame:
    """sources (source, source_size): adds number (from 0, in order), weight and target.

    Water filling in closed form: sources reach their cap in the order of size per weight, so the cap
    holds for a prefix of that order and the others share what is left by weight.
    """
    # The order of code points is that of UTF-8 bytes.
    ranked = running(sources.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").isNull(), F.encode("source", "UTF-8")], {"number": "1L"})
    ranked = ranked.withColumn("weight", F.col("number") % 3 + 1)
    filled = running(ranked, ["_all"], [F.col("source_size") / F.col("weight"), "number"], {"full": "source_size", "heavy": "weight"})
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    # What is left for a source and those after it, if all before it are at their caps.
    level = F.try_divide(F.lit(total[0] or 0) - most * F.col("full"), F.lit(total[1] or 0) - F.col("heavy"))
    shares = filled.withColumns({"level": level, "cap": most * F.col("source_size")})
    # The first source that stays below its cap sets the level for the rest.
    first = shares.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct(F.col("source_size") / F.col("weight"), "number"))).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return shares.select("source", "source_size", "number", "weight", target.cast("double").alias("target"))


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hypergeometric(u: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """The marked ones among `drawn` of `population`, at quantile u.

    Weights relative to the mode come from the ratios of neighbouring probabilities, up and down over
    12 standard deviations and 30 more to each side, which leaves out less than doubles can hold. They are summed and
    walked through one by one, so a draw takes time in proportion to the deviation, and no room.
    """
    p = F.try_divide(marked, population)
    sigma = F.sqrt(drawn * p * (1 - p) * (population - drawn) / F.greatest(population - 1, F.lit(1)))
    mode = F.floor((drawn + 1).cast("double") * (marked + 1) / (population + 2))
    reach = F.ceil(12 * sigma).cast("long") + 30
    low, high = F.greatest(F.lit(0), drawn + marked - population), F.least(drawn, marked)
    bounds = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.greatest(low, F.least(high, mode)).cast("long").alias("mode"), reach.alias("reach"))

    def ratio(k: Column) -> Column:
        """P(k + 1) / P(k)."""
        return (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (population - marked - drawn + k + 1))

    start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
    add = lambda s, w: F.struct(w.alias("weight"), (s["sum"] + w).alias("sum"))

    def drawn_from(b: Column) -> Column:
        first, last, middle = F.greatest(b["low"], b["mode"] - b["reach"]), F.least(b["high"], b["mode"] + b["reach"]), b["mode"]
        up = F.when(last > middle, F.aggregate(F.sequence(middle, last - 1), start, lambda s, k: add(s, s["weight"] * ratio(k)))).otherwise(start)
        down = F.when(first < middle, F.aggregate(F.sequence(middle - 1, first, F.lit(-1).cast("long")), start, lambda s, k: add(s, s["weight"] / ratio(k)))).otherwise(start)

        def walked(ends: Column) -> Column:
            # Counts the cells whose cumulated weight stays below the quantile, from the lowest up.
            state = F.struct(ends["down"]["weight"].alias("weight"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"), (u * (1.0 + ends["up"]["sum"] + ends["down"]["sum"])).alias("least"))

            def step(s: Column, k: Column) -> Column:
                total = s["sum"] + s["weight"]
                return F.struct((s["weight"] * ratio(k)).alias("weight"), total.alias("sum"), (s["k"] + F.when(total < s["least"], 1).otherwise(0)).alias("k"), s["least"].alias("least"))

            return F.least(last, first + F.aggregate(F.sequence(first, last), state, step)["k"])

        return _once(F.struct(up.alias("up"), down.alias("down")), walked)

    return F.when((population <= 0) | (drawn <= 0) | (marked <= 0), F.lit(0).cast("long")).otherwise(_once(bounds, drawn_from))


def _drawn(parents: DataFrame, children: DataFrame, seed: int, level: int) -> DataFrame:
    """children (low, high, group, slots) with left: of a parent's drawn slots (low, high, above, left) those that fall on
    each, child after child; a group's parent is group // FANOUT."""
    listed = children.withColumn("above", F.floor(F.col("group") / FANOUT)).groupBy("low", "high", "above").agg(F.sort_array(F.collect_list(F.struct("group", "slots"))).alias("each"), F.sum("slots").alias("all"))
    start = F.struct(F.col("all").alias("population"), F.col("left").alias("drawn"), F.array().cast("array<struct<group:bigint,slots:bigint,left:bigint>>").alias("out"))

    def draw(s: Column, x: Column) -> Column:
        u = _uniform(seed, F.lit("split"), F.col("low"), F.col("high"), F.lit(level), x["group"])
        k = _hypergeometric(u, s["population"], x["slots"], s["drawn"])
        return _once(k, lambda k: F.struct((s["population"] - x["slots"]).alias("population"), (s["drawn"] - k).alias("drawn"), F.array_append(s["out"], F.struct(x["group"].alias("group"), x["slots"].alias("slots"), k.alias("left"))).alias("out")))

    drawn = listed.join(parents, ["low", "high", "above"]).select("low", "high", F.explode(F.aggregate("each", start, draw)["out"]).alias("d"))
    return drawn.select("low", "high", "d.group", "d.slots", "d.left")


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (number, slots), numbers from 0: the slots of each source that each shard gets, (number, shard, slots).

    Shards differ by at most one slot in all. A node's slots go to its halves by conditional
    hypergeometric draws: first over groups of FANOUT groups, at last over sources.
    """
    now = quotas.select(F.col("number").cast("long").alias("group"), F.col("slots").cast("long"), F.lit(0).alias("low"), F.lit(shards).alias("high"))
    most, levels = quotas.agg(F.max("number")).first()[0] or 0, 1
    while most >= FANOUT**levels:
        levels += 1
    while shards > 1:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        # As many slots to the left as its share of the shards; the odd one by a draw.
        exact = F.col("all") * (middle - F.col("low")) / (F.col("high") - F.col("low"))
        left = F.floor(exact + _uniform(seed, F.lit("odd"), "low", "high")).cast("long")
        drawn = now.groupBy("low", "high").agg(F.sum("slots").alias("all")).select("low", "high", F.lit(0).cast("long").alias("above"), F.least("all", left).alias("left"))
        for level in reversed(range(levels)):
            groups = now.groupBy("low", "high", F.floor(F.col("group") / FANOUT**level).alias("group")).agg(F.sum("slots").alias("slots"))
            found = _drawn(drawn, groups, seed, level)
            drawn = found.select("low", "high", F.col("group").alias("above"), "left")
        halves = F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high"), F.col("left").alias("slots")),
            F.struct(middle.alias("low"), F.col("high").alias("high"), (F.col("slots") - F.col("left")).alias("slots")),
        )
        now = found.select("group", F.explode(halves).alias("h")).select("group", "h.slots", "h.low", "h.high").where("high > low")
        now = written(now, "tree")
        shards = (shards + 1) // 2
    return now.select(F.col("group").alias("number"), F.col("low").alias("shard"), "slots")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None) -> DataFrame:
    """(id, row, source, size, content) of every row, in the shared folder: later steps don't read the texts again."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    id_, text, source = F.col(id_col), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select(id_.alias("id"), row.alias("row"), source.alias("source"), size.alias("size"), F.xxhash64(id_, source, text).alias("content")), "sizes")


def draw(sizes: DataFrame, seed: int = 7, most: float = MOST_REPEATS, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): copies has a row (row, pass, words, shard, place) for each time a document is taken, place
    orders it in its shard; plan has source, source_size, number, weight, target, passes and rest of each source.

    The last document of a source's part is cut to its first words, unless `whole`: then it's taken or left,
    whichever is nearer to the target.
    """
    plan = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    passes = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    plan = written(plan, "plan")

    numbered = sizes.join(plan.select(F.col("source").alias("s"), "number"), F.col("source").eqNullSafe(F.col("s"))).select("number", "row", "size", "content")
    ordered = running(numbered, ["number"], [F.xxhash64(F.lit(seed), F.lit("row"), "content"), "content", "row"], {"position": "1L", "begin": "size"})
    dealt = written(ordered.withColumn("block", F.floor(F.col("position") / BLOCK_DOCS)), "dealt")

    # One row per block from here on: the words before it, the passes that take it.
    blocks = dealt.groupBy("number", "block").agg(F.min("begin").alias("above")).join(plan.select("number", "passes", "rest"), "number")
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    slots = blocks.where(last >= 0).select("number", "block", "above", "passes", "rest", F.explode(F.sequence(F.lit(0), last)).alias("pass"))
    slots = slots.where("pass < passes or above < rest").select("number", "block", "pass")
    slots = running(slots, ["number"], ["pass", F.xxhash64(F.lit(seed), F.lit("turn"), "number", "pass", "block"), "block"], {"slot": "1L"})
    slots = written(slots, "slots")

    total = plan.agg(F.sum("target")).first()[0] or 0
    quotas = split(slots.groupBy("number").agg(F.count("*").alias("slots")), max(1, -int(-total // SHARD_WORDS)), seed)
    ranges = running(quotas.where("slots > 0"), ["number"], ["shard"], {"from": "slots"})
    seats = ranges.select("number", "shard", F.explode(F.sequence("from", F.col("from") + F.col("slots") - 1)).alias("slot"))
    seated = slots.join(seats, ["number", "slot"]).select("number", "block", "pass", "shard")

    taken = dealt.join(seated, ["number", "block"]).join(plan.select("number", "passes", "rest"), "number")
    part = F.when(F.col("begin") + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("begin")))
    words = F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(part).cast("long")
    copies = taken.select("row", "pass", words.alias("words"), "shard", F.xxhash64(F.lit(seed), F.lit("place"), "content", "pass").alias("place"))
    return copies.where("words > 0"), plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, seed: int = 7) -> DataFrame:
    """One row per row of docs: <id_col>, size, source_size, target, taken, shards (of its copies, by pass)."""
    sizes = sized(docs, id_col, text_col, source_col, row_col)
    copies, plan = draw(sizes, seed)
    each = copies.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"), F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    named = plan.select(F.col("source").alias("s"), "source_size", "target")
    return (
        sizes.join(named, sizes["source"].eqNullSafe(named["s"]))
        .join(each, F.col("row") == F.col("r"), "left")
        .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"), *([] if row_col is None else [F.col("row").alias(row_col)]))
    )
