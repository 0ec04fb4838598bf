"""Mixing sources to target token counts by entropy balancing.

Document rates stay as close to 1 as relative entropy allows while each source's expected words meet
its target and no rate exceeds ``MOST``.  The optimum tilts exponentially: rate = min(MOST, exp(x * z)),
z being the document's size over its source's mean size, with one multiplier x per source that solves
the convex dual.  All multipliers take Newton steps together; one step is one aggregation over the
(source, size) histogram, guarded by a bracket around the root.

Rates become copies per (source, size) cell.  Every document gets the whole part; the rest is passed
from cell to cell in order of size, and inside a cell goes to the documents that come first by a hash of
their id.  Cells of many documents are split by that hash, so no window sorts a source's documents.  Then single
documents are added, dropped or swapped until no such move brings a source nearer to its target.  All this is
settled on hashes and sizes; what reaches the texts is where each part's further copies end.

Cases: null text has size 0 and is never taken; null is a source of its own, last in order; equal rows
may be taken unequally often (ties end by id, then by row content); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.tables import own_names
from pathloom.operators.skew import global_index
from pathloom.session import save_shared

MOST = 3  # times a document, or a source, is taken at most
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
CELL = 20_000  # documents a window sorts
BROADCAST_CUTS = 100_000  # rows of some 200 bytes
TOLERANCE = 1e-9
ROUNDS = 200
WIDEST = 1e9  # bounds of a multiplier, far beyond those of any text


def source_key(name: str = "source") -> Column:
    """Source names that tell null from text and keep the order of code points, null last."""
    source = F.col(name).cast("string")
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (key, total) with its target: weighted shares of all words, at most MOST times the total.

    Each round gives sources above their limit just that and shares the rest anew; sources only ever
    join the limited ones, so it ends.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("idx") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    placed = global_index(sources, [F.col("key")]).withColumn("weight", weight).withColumn("full", F.lit(False))
    placed = save_shared(placed, "mix-sources")
    while True:
        row = placed.agg(F.sum("total").alias("all"), F.sum(F.when(F.col("full"), MOST * F.col("total")).otherwise(0)).alias("fixed"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("w")).first()
        level = ((row["all"] or 0) - (row["fixed"] or 0)) / row["w"] if row["w"] else 0.0
        placed = placed.withColumn("now", F.col("full") | (F.col("weight") * F.lit(level) > MOST * F.col("total")))
        if placed.filter("now AND NOT full").isEmpty():
            value = F.when(F.col("full"), (MOST * F.col("total")).cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
            return save_shared(placed.select("key", "total", value.alias("target")), "mix-targets")
        placed = save_shared(placed.withColumn("full", F.col("now")).drop("now"), "mix-sources")


def _rate(x: Column, z: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-700.0), x * z))))


def balance(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """Multiplier x of each source: cells (key, size, n), goals (key, total, target)."""
    means = cells.filter("size > 0").groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    state = goals.join(means, "key").select(
        "key", "target", "words", (F.col("words") / F.col("docs")).alias("mean"), F.lit(0.0).alias("x"),
        F.lit(-WIDEST).alias("low"), F.lit(WIDEST).alias("high"), F.lit(False).alias("done"),
    )
    state = save_shared(state, "mix-state")
    for _ in range(ROUNDS):
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("x"), z)
        words = F.col("size") * F.col("n")
        slope = F.when(rate < MOST, words * z * rate).otherwise(0.0)
        at = cells.filter("size > 0").join(state.select("key", "x", "mean"), "key").groupBy("key").agg(F.sum(words * rate).alias("f"), F.sum(slope).alias("g"))
        gap = F.col("f") - F.col("target")
        step = state.join(at, "key").withColumn("low", F.when(gap < 0, F.col("x")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("x")).otherwise(F.col("high")))
        newton = F.when(F.col("g") > 0, F.col("x") - gap / F.col("g"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        done = F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("words")) | (F.col("target") >= MOST * F.col("words"))
        # Outside the bracket: halve it, or double the multiplier while nothing bounds it yet.
        halved = (F.greatest("low", F.lit(-60.0)) + F.least("high", F.lit(60.0))) / 2
        halved = F.when(F.col("low") >= 59, F.least((F.col("low") + F.col("high")) / 2, 2 * F.col("low"))).when(F.col("high") <= -59, F.greatest((F.col("low") + F.col("high")) / 2, 2 * F.col("high"))).otherwise(halved)
        moved = F.when(inside, newton).otherwise(halved)
        x = F.when(F.col("target") >= MOST * F.col("words"), F.lit(700.0)).when(done, F.col("x")).otherwise(moved)
        state = save_shared(step.select("key", "target", "words", "mean", x.alias("x"), "low", "high", done.alias("done")), "mix-state")
        if state.filter("NOT done").isEmpty():
            return state.select("key", "x", "mean")
    raise ArithmeticError(f"the multipliers did not converge in {ROUNDS} rounds")


def _settled(parts: DataFrame) -> DataFrame:
    """``parts`` (key, size, _salt, n, target, copies) moved towards the targets by single documents.

    A move adds a copy, drops one, or swaps one for another; the document of size 0 stands for the missing
    side.  Each round every source makes the move that leaves it nearest to its target, found by sorting
    its sizes together with the sizes it looks for.  It ends when no move brings any source nearer.
    """
    while True:
        gaps = parts.groupBy("key").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
        gaps = gaps.filter(F.abs("gap") > 0.5)  # sizes are whole numbers
        salt = lambda may: F.min(F.when(may, F.col("_salt")))
        sizes = parts.filter("size > 0").join(gaps, "key").groupBy("key", "gap", "size").agg(
            salt(F.col("copies") < MOST * F.col("n")).alias("more"), salt(F.col("copies") > 0).alias("less")
        )
        none = gaps.select("key", "gap", F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("more"), F.lit(-1).cast("long").alias("less"))
        sizes = sizes.unionByName(none)
        added = sizes.filter("more IS NOT NULL").select("key", "gap", F.col("size").cast("double").alias("at"), F.struct("size", "more").alias("into"), F.lit(None).cast("struct<size:bigint,less:bigint>").alias("out"))
        sought = sizes.filter("less IS NOT NULL").select("key", "gap", (F.col("size") + F.col("gap")).alias("at"), F.lit(None).cast("struct<size:bigint,more:bigint>").alias("into"), F.struct("size", "less").alias("out"))
        upto = [Window.partitionBy("key").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow) for at in (F.col("at"), F.col("at").desc())]
        below, above = [F.last("into", ignorenulls=True).over(w) for w in upto]
        tried = added.unionByName(sought).select("key", "gap", "out", below.alias("below"), above.alias("above")).filter("out IS NOT NULL")
        tried = tried.select("key", "gap", "out", F.explode(F.array("below", "above")).alias("into")).filter("into IS NOT NULL")
        left = F.abs(F.col("gap") - F.col("into.size") + F.col("out.size"))
        best = tried.groupBy("key", "gap").agg(F.min(F.struct(left.alias("left"), "out", "into")).alias("best")).filter(F.col("best.left") < F.abs("gap") - 1e-6)
        moves = best.select("key", F.explode(F.array(
            F.struct(F.col("best.into.size").alias("size"), F.col("best.into.more").alias("_salt"), F.lit(1).cast("long").alias("step")),
            F.struct(F.col("best.out.size").alias("size"), F.col("best.out.less").alias("_salt"), F.lit(-1).cast("long").alias("step")),
        )).alias("m")).select("key", "m.*").filter("_salt >= 0")
        moves = save_shared(moves, "mix-moves")
        if moves.isEmpty():
            return parts
        moved = parts.join(moves, ["key", "size", "_salt"], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")
        parts = save_shared(moved, "mix-parts")


def _cuts(dealt: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (key, size, _salt, n, copies) with how each deals its copies to ``dealt`` (key, size, _salt, u, row).

    Every document gets ``each``; one more goes to those before (cut_u, cut_row) and to the first ``some`` of
    the ``of`` documents that equal it.  Without a cut nobody gets more.
    """
    on = ["key", "size", "_salt"]
    parts = parts.withColumn("each", F.floor(F.col("copies") / F.col("n"))).withColumn("further", F.col("copies") % F.col("n"))
    order = Window.partitionBy(*on).orderBy("u", "row")
    ranked = dealt.join(parts.filter("further > 0").select(*on, "further"), on).select(
        *on, "further", "u", "row", F.row_number().over(order).alias("place"), F.rank().over(order).alias("first"), F.count("*").over(order).alias("last")
    )
    cut = ranked.filter("place = further").select(
        *on, F.col("u").alias("cut_u"), F.col("row").alias("cut_row"), (F.col("place") - F.col("first") + 1).alias("some"), (F.col("last") - F.col("first") + 1).alias("of")
    )
    return parts.drop("further").join(cut, on, "left")


def _mixed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The mix with the documents' columns under names of its own, and these names by the documents'."""
    named, at = own_names(docs)
    named = named.withColumn("_key", source_key(at["source"])).withColumn("_size", word_count(at["text"]))
    # The whole row takes part, so rows that only share the id are still ordered alike in every run.
    named = named.withColumn("_u", F.xxhash64(F.col(at["doc_id"]), F.lit(1))).withColumn("_row", F.xxhash64(*at.values()))
    # Everything is settled on these four; the texts are read once for them and once for the result.
    short = save_shared(named.select(F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_u").alias("u"), F.col("_row").alias("row")), "mix-documents")
    cells = save_shared(short.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-cells")
    goals = targets(cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total")))
    x = balance(cells, goals)

    rate = F.when(F.col("size") > 0, F.coalesce(_rate(F.col("x"), F.col("size") / F.col("mean")), F.lit(0.0))).otherwise(0.0)
    cells = cells.join(goals, "key").join(x, "key", "left").withColumn("rate", rate)
    cells = cells.withColumn("whole", F.floor("rate")).withColumn("rest", F.col("rate") - F.floor("rate"))
    cells = save_shared(cells.withColumn("salts", F.ceil(F.col("n") / CELL).cast("long")).drop("mean", "x"), "mix-cells")

    # Large cells by salt; their counts give each part its share of the cell's remaining copies.
    dealt = short.join(cells.drop("n"), ["key", "size"]).withColumn("_salt", F.pmod(F.shiftright("u", 7), F.col("salts")))
    parts = dealt.groupBy("key", "size", "_salt", "whole", "rest", "target").agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("size", "_salt").rowsBetween(Window.unboundedPreceding, 0)
    # Words still owed, passed on in order of size: a part gets what is owed up to it, in whole copies.
    parts = parts.withColumn("upto", F.sum(F.col("n") * F.col("rest")).over(order))
    quota = F.floor(F.round(F.col("upto"), 6) + 0.5) - F.floor(F.round(F.col("upto") - F.col("n") * F.col("rest"), 6) + 0.5)
    copies = F.col("whole") * F.col("n") + F.least("n", F.greatest(F.lit(0), quota))
    parts = parts.select("key", "size", "_salt", "target", "n", F.least(MOST * F.col("n"), copies).cast("long").alias("copies"))
    parts = _settled(save_shared(parts, "mix-parts"))
    # The copies of a part are dealt evenly, the first documents take what is left over.
    cuts = _cuts(dealt.select("key", "size", "_salt", "u", "row"), parts.drop("target"))
    cuts = cuts.join(cells.select("key", "size", "salts", "total", "target", "rate"), ["key", "size"])
    cuts = save_shared(cuts.drop("n", "copies"), "mix-cuts")

    # Few cuts go to the texts; many meet them by whatever join Spark chooses.
    small = F.broadcast(cuts) if cuts.count() <= BROADCAST_CUTS else cuts
    found = named.join(small, (F.col("_key") == F.col("key")) & (F.col("_size") == F.col("size")) & (F.pmod(F.shiftright("_u", 7), F.col("salts")) == F.col("_salt")))
    same = (F.col("_u") == F.col("cut_u")) & (F.col("_row") == F.col("cut_row"))
    early = (F.col("_u") < F.col("cut_u")) | ((F.col("_u") == F.col("cut_u")) & (F.col("_row") < F.col("cut_row")))
    found = found.withColumn("_more", F.coalesce(early | same, F.lit(False))).withColumn("_split", F.coalesce(same & (F.col("some") < F.col("of")), F.lit(False)))
    if not cuts.filter("some < of").isEmpty():
        # Equal rows of which only some get one more: they alone are numbered.
        place = F.row_number().over(Window.partitionBy("key", "size", "_salt").orderBy("_u", "_row"))
        found = found.filter("NOT _split").unionByName(found.filter("_split").withColumn("_more", place <= F.col("some")))
    copies = F.when(F.col("size") > 0, F.col("each") + F.col("_more").cast("long")).otherwise(F.lit(0)).cast("long")
    made = found.select(
        *at.values(), F.col("size").alias("_words"), F.col("total").cast("long").alias("_source_words"),
        F.col("target").alias("_target"), F.col("rate").alias("_rate"), copies.alias("_copies"),
    )
    return made, at


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` columns plus _words, _source_words, _target, _rate and _copies of every document."""
    made, at = _mixed(docs)
    return made.select(*[F.col(c).alias(name) for name, c in at.items()], "_words", "_source_words", "_target", "_rate", "_copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    made, at = _mixed(docs)
    taken = made.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[F.col(c).alias(name) for name, c in at.items()])
