"""Traces: transitions, call graphs, instruction classes, trigger windows, counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scalars import stem
from runledger.operators.ordered import running

#: Fixed value: addresses above this are the kernel's.
KERNEL_BASE = 0x0001000000000000


def successive(df: DataFrame, run: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(run, caller, callee) for each state and the next one, over range partitions: a run may fill many tasks.

    Records that are equal in the order follow each other in the order of a hash of their states.
    """
    states = df.select(*run, *[F.col(c).alias(f"_by_{c}") for c in order], F.col(state).alias("caller"))
    follows = running(states, run, [f"_by_{c}" for c in order], {}, following={"callee": "caller"})
    return follows.select(*run, "caller", "callee").where("callee is not null")


def transition_counts(df: DataFrame, run: Sequence[str]) -> DataFrame:
    """Transitions of each pair, with the run's total beside them."""
    pairs = df.groupBy(*run, "caller", "callee").agg(F.count("*").alias("n"))
    totals = pairs.groupBy(*run).agg(F.sum("n").alias("total"))
    return pairs.join(totals, list(run)) if run else pairs.crossJoin(F.broadcast(totals))


def self_transitions(counts: DataFrame, run: Sequence[str]) -> DataFrame:
    """total, self, cross and the share of self transitions of each run; runs without a self pair have 0."""
    own = F.sum(F.when(F.col("caller").eqNullSafe(F.col("callee")), F.col("n")).otherwise(0))
    out = counts.groupBy(*run).agg(F.sum("n").alias("total"), own.alias("self"))
    return out.withColumn("cross", F.col("total") - F.col("self")).withColumn("rate", F.col("self") / F.col("total"))


def call_graph(counts: DataFrame) -> DataFrame:
    """Edges without self calls, with their weight on a log scale of the largest."""
    edges = counts.where("caller <> callee").groupBy("caller", "callee").agg(F.sum("n").alias("n"))
    most = edges.groupBy().agg(F.max("n").alias("_most"))
    weight = F.coalesce(F.try_divide(F.log(F.col("n").cast("double")), F.log(F.col("_most").cast("double"))), F.lit(1.0))
    return edges.crossJoin(F.broadcast(most)).withColumn("weight", weight).drop("_most")


def nesting(df: DataFrame, thread: Sequence[str], order: Sequence[str], enter: Column) -> DataFrame:
    """seq of every record in its thread, depth, and previous: the number of the latest record at the same depth.

    +1 for entering and -1 for leaving, summed along the thread; a leave has the depth of its enter, which is its previous record.
    Numbers, sums and the latest record of each depth are carried from one range partition to the next: a thread, or one depth
    of it, may fill many tasks.
    """
    steps = df.withColumn("_step", F.when(enter, 1).otherwise(-1))
    numbered = running(steps, thread, order, {"_seq": "1L", "_net": "_step"})
    deep = numbered.withColumns({"seq": F.col("_seq") + 1, "depth": F.col("_net") + F.when(F.col("_step") > 0, 0).otherwise(-1)})
    return running(deep.drop("_seq", "_net", "_step"), [*thread, "depth"], ["seq"], {}, preceding={"previous": "seq"})


#: Fixed value: operands that begin with a capability register.
CAPABILITY_OPERAND = "^c[zr0-9]+,"


def instruction_class(mnemonic: Column, operands: Column) -> Column:
    """ld or st, _pair for ldp and stp, then _cap or _int by the first operand; cheri for bounds settings; else other."""
    load = mnemonic.startswith("ldr") | (mnemonic == "ldp")
    store = mnemonic.startswith("str") | (mnemonic == "stp")
    move = F.when(load, "ld").when(store, "st")
    pair = F.when(mnemonic.isin("ldp", "stp"), "_pair").otherwise("")
    what = F.when(F.coalesce(operands, F.lit("")).rlike(CAPABILITY_OPERAND), "_cap").otherwise("_int")
    return F.when(move.isNotNull(), F.concat(move, pair, what)).when(mnemonic.startswith("scbnds"), "cheri").otherwise("other")


def is_kernel(pc: Column) -> Column:
    return pc.cast("decimal(20,0)") > F.lit(KERNEL_BASE).cast("decimal(20,0)")


def trigger_window(df: DataFrame, line: str, pc: str, start: object = None, stop: object = None, hits: int = 1) -> DataFrame:
    """Lines from the first hit of `start`, inclusive, to the hits-th hit of `stop`, exclusive; both count from the first line.

    Two small aggregates give the bounds, then a range filter: no window over the trace.
    """
    first = df.where(F.col(pc) == F.lit(start)).agg(F.min(line)).first()[0] if start is not None else None
    if start is not None and first is None:
        return df.limit(0)
    out = df.where(F.col(line) >= first) if first is not None else df
    if stop is not None:
        # The hits-th smallest line: a top-k of that many lines, not of all.
        lines = [r[0] for r in df.where(F.col(pc) == F.lit(stop)).select(line).orderBy(line).limit(hits).collect()]
        if len(lines) == hits:
            out = out.where(F.col(line) < lines[-1])
    return out


def per_symbol(counts: DataFrame, symbol: str, classes: str, n: str) -> DataFrame:
    """Instructions by symbol and class, with the symbol's total."""
    each = counts.groupBy(symbol, classes).agg(F.sum(n).alias(n))
    return each.withColumn("total", F.sum(n).over(Window.partitionBy(symbol)))


def call_sites(buckets: DataFrame, symbols: DataFrame, pc: str = "pc", addr: str = "addr", n: str = "n") -> DataFrame:
    """Calls: executions of the first instruction of a symbol."""
    return buckets.join(symbols, buckets[pc] == symbols[addr]).groupBy("name").agg(F.sum(n).alias("calls"))


def baseline_difference(df: DataFrame, key: Sequence[str], target: str, baseline: str, values: Sequence[str], lacking: bool = True) -> DataFrame:
    """Values of each other target minus the baseline's for the same key; a key that one side lacks counts as 0 there.

    Every key of the baseline has a row for each other target; nulls are keys and targets like others. With lacking false, targets have
    no rows for keys that they lack, and nulls equal nothing.
    """
    same = Column.eqNullSafe if lacking else Column.__eq__
    own = df.where(same(F.col(target), F.lit(baseline))).select(*[F.col(c).alias(f"_b_{c}") for c in (*key, *values)])
    rest = df.where(~same(F.col(target), F.lit(baseline)))
    by = [*key, target] if lacking else list(key)
    if lacking:
        own = own.crossJoin(F.broadcast(rest.select(F.col(target).alias(f"_b_{target}")).distinct()))
    joined = rest.join(own, [same(F.col(c), F.col(f"_b_{c}")) for c in by], "full" if lacking else "left")
    named = joined.withColumns({c: F.coalesce(c, f"_b_{c}") for c in by} | {v: F.coalesce(v, F.lit(0)) for v in values})
    return named.select(*key, target, *values, *[(F.col(v) - F.coalesce(f"_b_{v}", F.lit(0))).alias(f"{v}_diff") for v in values])


def rebased(df: DataFrame, group: Sequence[str], ts: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Counters relative to the first value of their iteration, plus one; times relative to its start."""
    first = df.groupBy(*group).agg(F.min_by(value, F.struct(ts, *tie)).alias("_v"), F.min(ts).alias("_t"))
    joined = df.join(first, [df[g].eqNullSafe(first[g]) for g in group])
    for g in group:
        joined = joined.drop(first[g])
    return joined.withColumns({value: F.col(value) - F.col("_v") + 1, f"rel_{ts}": F.col(ts) - F.col("_t")}).drop("_v", "_t")


def per_call(instructions: DataFrame, calls: DataFrame | None, key: Sequence[str], run: Sequence[str], baseline: str, n: str = "n", count: str = "calls", name: str = "insn_per_call") -> DataFrame:
    """Instructions of a call of each function and run, and their difference from the baseline run's.

    Functions that only one side has are left out, as are rows of the baseline; run is one column. Without calls, the instructions
    have their column.
    """
    if calls is None:
        joined = instructions.select(*key, *run, n, count).dropna(subset=[*key, *run])
    else:
        joined = instructions.select(*key, *run, n).join(calls.select(*key, *run, count), [*key, *run])
    each = joined.withColumn(name, F.try_divide(F.col(n).cast("double"), F.col(count)))
    own = each.where(F.col(run[0]) == baseline).select(*key, F.col(name).alias("_b"))
    return each.where(F.col(run[0]) != baseline).join(own, list(key)).withColumn(f"delta_{name}", F.col(name) - F.col("_b")).drop("_b")


def counter_name(name: Column, slot: Column, labels: Mapping[int, str], per_cpu: Mapping[int, int] | None = None) -> Column:
    """Display name of a counter: its name and the label of its slot.

    per_cpu: first slot -> one past the last, of slots that stand for processors; {cpu} in their label is the number.
    """
    label = F.lit(None).cast("string")
    for first, end in (per_cpu or {}).items():
        inside = (slot >= first) & (slot < end)
        label = F.when(inside, F.replace(F.lit(labels[first]), F.lit("{cpu}"), (slot - first).cast("string"))).otherwise(label)
    single = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[slot.cast("int")]
    return F.concat_ws(" ", name, F.coalesce(label, single))


def frame_name(name: Column, file: Column, address: Column) -> Column:
    """Name of a symbol in folded stacks: where it comes from, then the symbol; empty without a symbol at address -1."""
    place = stem(file)
    place = F.when(place.startswith("kernel"), "kernel").otherwise(place)
    unknown = file.isNull()
    return F.when(unknown & (address == -1), "").when(unknown, F.concat(F.lit("??`"), name)).otherwise(F.concat(place, F.lit("`"), name))


def relevance(df: DataFrame, delta: str, name: str = "relevance") -> DataFrame:
    """Share of the total absolute delta; one scalar aggregate."""
    total = df.groupBy().agg(F.sum(F.abs(F.col(delta))).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.try_divide(F.abs(F.col(delta)), F.col("_total"))).drop("_total")


def function_statistics(df: DataFrame, iteration: Sequence[str], function: Sequence[str], value: str) -> DataFrame:
    """Sum of a function in each iteration, then mean, deviation, least and largest over the iterations."""
    sums = df.groupBy(*iteration, *function).agg(F.sum(value).alias("_v"))
    return sums.groupBy(*function).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("iterations"))


def thread_names(processes: DataFrame, threads: DataFrame, events: DataFrame) -> DataFrame:
    """Events with the names of their process and thread; undetected:<pid> and unknown:<tid> where there is none."""
    p = processes.groupBy("pid").agg(F.max("name").alias("process"))
    t = threads.groupBy("pid", "tid").agg(F.max("name").alias("thread"))
    joined = events.join(p, "pid", "left").join(t, ["pid", "tid"], "left")
    return joined.withColumns({"process": F.coalesce("process", F.concat(F.lit("undetected:"), F.col("pid").cast("string"))), "thread": F.coalesce("thread", F.concat(F.lit("unknown:"), F.col("tid").cast("string")))})


def folded(stacks: DataFrame, stack: str = "stack", samples: str = "samples") -> DataFrame:
    """Equal stacks of all iterations added up."""
    return stacks.groupBy(stack).agg(F.sum(samples).alias(samples))


def indented(df: DataFrame, depth: str, text: Sequence[str], indent: str = "  ") -> DataFrame:
    """One line of readable text for each record."""
    return df.select(F.concat(F.repeat(F.lit(indent), F.greatest(F.col(depth), F.lit(0)).cast("int")), F.concat_ws(" ", *[F.col(c).cast("string") for c in text])).alias("value"))
