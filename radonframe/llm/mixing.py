"""Mixing sources to target weights by entropy balancing, all in DataFrame functions.

Each document gets a rate w, the copies it contributes on average. The rates are those closest to 1 in relative entropy
that give each source its target of words and stay within [0, cap]:  w = min(cap, exp(lambda * size / mean size)),
one multiplier lambda per source. The dual is convex and separates by source; Newton's step on its logarithm, kept
within a shrinking bracket, solves it. Each iteration is one distributed aggregation over the counts of (source, size)
cells rather than over documents: documents of a cell have one rate.

Rounding: cumulative rates, from the largest size down, are rounded to whole copies; then one greedy pass from the largest
size down adds or removes the few copies that bring it nearest to the target: a source of ten documents misses it by a
few hundredths, one of fifty by less than 0.3 %. That pass folds over a source's cells in one row: as many as the source has distinct
sizes, not documents. A cell's copies are dealt evenly to its documents, the rest to those that come first by salt (a
hash of id and text), id and a hash of the text; the salt splits each cell into ``SALTS`` parts, so no task orders a hot cell, be it
one of null ids.

Defined cases: null text has size 0; the null source is a source, the last; null ids come first; repeated rows
are documents of their own (of equal ids, sources and texts, which gets an odd copy is not visible); documents of size 0 take nothing; an empty
table gives an empty result; further columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SALTS = 4096
ROUNDS = 60
TOLERANCE = 1e-7


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, _key, _size, _salt, _text, _doc): the source (nulls as ''), the size, the salt, a hash of the text, and the row itself."""
    source = F.col(source_col).cast("string")
    return docs.select(
        id_col,
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).alias("_salt"),
        F.xxhash64(text_col).alias("_text"),
        F.struct(*docs.columns).alias("_doc"),
    )


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_key, source_size, target) from (_key, _size, n): weights repeat over the sources by code point, null last.

    A source stops at ``cap`` times its size, and the excess is shared by weight among the others until none is above.
    The sources that stop are those of least room per weight, so one ordered pass over the sources finds them.
    """
    per = cells.groupBy("_key").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    order, by_room, whole = Window.orderBy(F.col("_key") == "", "_key"), Window.orderBy("at", "_key"), Window.partitionBy()
    kinds = F.array(*[F.lit(float(x)) for x in weights])
    per = (
        per.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("room", F.col("source_size") * F.lit(float(cap)))
        .withColumn("at", F.col("room") / F.col("weight"))
        .withColumn("used", F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("used")) / F.col("left"))
        .withColumn("open", F.col("at") > F.col("level"))
        .withColumn("share", F.max(F.when(F.col("open"), F.col("level"))).over(whole))
    )
    return per.select("_key", "source_size", F.when(F.col("open"), F.col("share") * F.col("weight")).otherwise(F.col("room")).alias("target"))


def _rate(lam: Column, cap: int) -> Column:
    """min(cap, exp(lambda * size / mean)); all of it where lambda is infinite."""
    return F.when(F.col("_size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(lam * F.col("_size") / F.col("mean"))))


def solve(cells: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """targets with mean and lam: Newton iterations on log(words taken) = log(target), one aggregation each."""
    inf = F.lit(float("inf"))
    means = cells.groupBy("_key").agg(F.sum(F.col("_size") * F.col("n")) / F.sum("n"))
    means = means.toDF("_key", "mean")
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12)
    state = stage(
        targets.join(means, "_key").withColumns({
            "lam": F.when((F.col("source_size") > 0) & full, inf).otherwise(F.lit(0.0)),
            "lo": -inf, "hi": inf, "miss": F.when(full, 0.0).otherwise(1.0),
        }),
        "mixing",
    )
    for _ in range(ROUNDS):
        if not state.filter(F.col("miss") > TOLERANCE).limit(1).count():
            break
        rate, free = _rate(F.col("lam"), cap), F.col("lam") * F.col("_size") / F.col("mean") < F.log(F.lit(float(cap)))
        words = F.col("n") * F.col("_size") * rate
        sums = (
            cells.join(state.filter(F.col("miss") > TOLERANCE).select("_key", "lam", "mean"), "_key")
            .groupBy("_key")
            .agg(F.sum(words).alias("f"), F.sum(F.when(free, words * F.col("_size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        low = F.col("f") < F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
        newton = F.when(F.col("slope") > 0, F.col("lam") + (F.log("target") - F.log("f")) * F.col("f") / F.col("slope"))
        middle = F.when(F.col("lo") == -inf, F.col("hi") * 2 - 1).when(F.col("hi") == inf, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        miss = F.abs(F.col("f") / F.col("target") - 1)
        new = (
            state.join(sums, "_key", "left")
            .withColumns({"lo": lo, "hi": hi, "now": F.coalesce(miss, F.lit(0.0))})
            .withColumn("step", F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle))
            .select(
                "_key", "source_size", "target", "mean",
                F.when(F.col("now") > TOLERANCE, F.col("step")).otherwise(F.col("lam")).alias("lam"),
                "lo", "hi", F.when(F.col("hi") - F.col("lo") < 1e-13, 0.0).otherwise(F.col("now")).alias("miss"),
            )
        )
        old, state = state, stage(new, "mixing")
        drop(old)
    return state.select("_key", "source_size", "target", "mean", "lam")


def cell_copies(cells: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """(_key, _size, n, copies, rate, source_size, target): whole copies for each cell."""
    down = Window.partitionBy("_key").orderBy(F.desc("_size"))
    rated = cells.join(solved, "_key").withColumn("rate", _rate(F.col("lam"), cap))
    rounded = rated.withColumn("upto", F.floor(F.sum(F.col("rate") * F.col("n")).over(down) + 0.5)).withColumn(
        "copies", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)), F.col("n") * cap)
    )
    zero = F.lit(0).cast("long")
    parts = F.reverse(F.sort_array(F.collect_list(F.when(F.col("_size") > 0, F.struct("_size", "n", "copies")))))
    gap = (F.first("target") - F.sum(F.col("copies") * F.col("_size"))).cast("long")

    def close(acc: Column, x: Column) -> Column:
        want = F.floor(F.abs(acc["gap"]) / x["_size"] + 0.5)
        k = F.when(acc["gap"] > 0, F.least(want, x["n"] * cap - x["copies"])).otherwise(-F.least(want, x["copies"]))
        return F.struct((acc["gap"] - k * x["_size"]).alias("gap"), F.when(k != 0, F.concat(acc["out"], F.array(F.struct(x["_size"].alias("_size"), k.alias("more"))))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<_size:bigint,more:bigint>>")
    fixes = (
        rounded.groupBy("_key").agg(parts.alias("parts"), gap.alias("gap"))
        .select("_key", F.explode(F.aggregate("parts", F.struct(F.col("gap"), none.alias("out")), close)["out"]).alias("x"))
        .select("_key", "x.*")
    )
    return rounded.join(fixes, ["_key", "_size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", zero)).drop("more", "upto", "lam", "mean")


def with_copies(rows: DataFrame, parts: DataFrame, copies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (of ``keyed``) with copies, rate, source_size and target. parts: the count m of each (_key, _size, _salt)."""
    before = Window.partitionBy("_key", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).join(copies, ["_key", "_size"]).drop("m")
    place = F.col("start") + F.row_number().over(Window.partitionBy("_key", "_size", "_salt").orderBy(id_col, "_text"))
    whole = F.floor(F.col("copies") / F.col("n"))
    dealt = rows.join(plan, ["_key", "_size", "_salt"]).withColumn("place", place)
    return dealt.withColumn("copies", whole + F.when(F.col("place") <= F.col("copies") - whole * F.col("n"), 1).otherwise(0)).drop("place", "start", "n", "_text")


def _plan(base: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    parts = stage(base.groupBy("_key", "_size", "_salt").agg(F.count("*").alias("m")), "mixing")
    cells = stage(parts.groupBy("_key", "_size").agg(F.sum("m").alias("n")), "mixing")
    solved = solve(cells, source_targets(cells, weights, cap), cap)
    return parts, stage(cell_copies(cells, solved, cap), "mixing")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate), one row per document."""
    base = stage(keyed(docs).select("doc_id", "_key", "_size", "_salt", "_text"), "mixing")
    return with_copies(base, *_plan(base, weights, cap)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies", "rate"
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents of the mix: each row as often as it has copies, with the columns of ``docs``."""
    rows = keyed(docs)
    dealt = with_copies(rows, *_plan(rows, weights, cap))
    return dealt.filter(F.col("copies") > 0).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")
