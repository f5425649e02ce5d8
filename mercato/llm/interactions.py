"""How the filters of a chain act on each other: every order and step, from the survivors of subsets.

One SQL CUBE over the failure flags and the part counts every combination of filters at once: a grouping-set row whose selected flags
are all false counts what that subset lets through. A step of an order takes its filter from the subset before it to the
subset with it, so two joins of subsets give what it removes; the number of documents no longer matters there.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\f\r"
LETTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D of a text without nulls: few words, few different words, many capitals, marks."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (does it fail), n, good, toxic: how many documents of each part fail each combination of filters.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. Texts travel as digests. E is true of all but the rows with the
    smallest id of their text: copies are counted by part and flags before they meet, so a text that a third of all rows have
    costs a row for each part and task. A null text is empty, a null source the part ''. Repeated rows count as often as they come; a row
    with a null id is nobody's copy and has no labels. A document is good (toxic) if one of its label rows says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = [*"ABCD"]
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(text).items()])
    rows = rows.groupBy("doc_id", "part", "digest", *flags).agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    rows = rows.join(said, "doc_id", "left").fillna(0, ["quality", "toxic"])
    copies = rows.groupBy("digest", "part", *flags, "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nobody")
    )
    is_first = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest"))
    pass_e = F.col("nobody") + F.when(is_first, F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n"))))
    rows = copies.withColumn("passing", pass_e).select("part", *flags, "quality", "toxic", both.alias("x")).select("part", *flags, "quality", "toxic", "x.*").where("n > 0")
    return rows.groupBy("part", *flags, "E").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, letters: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """part, subset (bit k: letter k), and the measures over what passes all filters of the subset; subsets without survivors are left out."""
    bit = " + ".join(f"shiftleft(1 - grouping({x}), {k})" for k, x in enumerate(letters))
    clean = " and ".join(f"not coalesce({x}, false)" for x in letters)
    sums = ", ".join(f"sum({m}) as {m}" for m in measures)
    cube = f"select {', '.join(letters)}, part, cast({bit} as int) as subset, grouping(part) as no_part, {sums} from {{counts}} group by cube ({', '.join(letters)}, part)"
    return counts.sparkSession.sql(f"select part, subset, {', '.join(measures)} from ({cube}) where no_part = 0 and {clean}", counts=counts)


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and what the step's filter does there, for all orders of ``letters``, rows of zeros included.

    ``counts``: part, a boolean for each letter, n, good, toxic (``failure_counts``, or any like it). kept and removed are of the step;
    redundant fails its filter but went before; unique_fails fails its filter only; good_lost and toxic_lost are the
    removed ones' labels; shapley is what its filter removes, summed over all orders. An empty table has no part and gives no rows.
    """
    if not 0 < len(letters) < 8:
        raise ValueError("one to seven filters: orders grow as the factorial")
    measures = ("n", "good", "toxic")
    cells = common.table(survivors(counts, letters, measures), "survivors")
    every = (1 << len(letters)) - 1
    steps = []
    for order in permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            after = before | 1 << letters.index(x)
            steps.append(("".join(order), step, x, before, after))
            before = after

    def among(names: str, rows) -> Column:
        return F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names.split(), r)]) for r in rows]))

    def meet(rows: DataFrame, subset: str, prefix: str, of: Sequence[str]) -> DataFrame:
        """``rows`` with the measures of one of its subsets, 0 where nothing survives."""
        side = cells.select(F.col("part").alias("_part"), F.col("subset").alias("_subset"), *[F.col(m).alias(prefix + m) for m in of])
        both = rows.join(side, (F.col("part") == F.col("_part")) & (F.col(subset) == F.col("_subset")), "left").drop("_part", "_subset")
        return both.fillna(0, [prefix + m for m in of])

    parts = cells.where("subset = 0").select("part", F.col("n").alias("all_n"))
    own = parts.select("part", "all_n", among("letter alone rest whole", [(x, 1 << k, every ^ 1 << k, every) for k, x in enumerate(letters)]).alias("x")).select("part", "all_n", "x.*")
    for subset in ("alone", "rest", "whole"):
        own = meet(own, subset, subset + "_", ("n",))
    own = own.select("part", "letter", (F.col("all_n") - F.col("alone_n")).alias("failing"), (F.col("rest_n") - F.col("whole_n")).alias("unique_fails"))
    rows = parts.select("part", among("filter_order step letter before after", steps).alias("x")).select("part", "x.*")
    rows = meet(meet(rows, "before", "b_", measures), "after", "a_", measures)
    removed = F.col("b_n") - F.col("a_n")
    rows = rows.withColumn("shapley", F.sum(removed).over(Window.partitionBy("part", "letter"))).join(own, ["part", "letter"])
    return rows.select(
        "part", "filter_order", "step", F.col("a_n").alias("kept"), removed.alias("removed"), (F.col("failing") - removed).alias("redundant"), "unique_fails",
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"), "shapley",
    )
