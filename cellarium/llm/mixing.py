"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share ``TOTAL_SHARE`` of all words; none gets more than ``CAP`` times its size, and
the excess is shared anew by weight until none is above.

Within a source documents are drawn with unequal probabilities: a document of size class c (its size
has c + 1 binary digits) is expected ``min(CAP, t * 2 ** (c * SIZE_POWER))`` times, and t is
such that the source's expected words are its target.  The whole part of that is allocated for certain.  The
fraction is the inclusion probability p of one copy more: documents are ranked by random odds
u / (1 - u) divided by inclusion odds p / (1 - p), and the first ones are taken until the words that
whole copies leave are spent.

The rank at which that is so is found digit by digit: sums of the source's words by the first
digit tell the digit in which the line lies, then only documents with that digit go on to the next.  So no
task gathers a source, and copies are told from a document and the few numbers of its source and class alone.
The draw is a hash of doc_id, text and seed, so reruns agree.

Cases: null and empty texts have size 0 and nothing is taken of them; a source of
size 0 has target 0; a null source is a source of its own, last; rows that have doc_id and text in
common tie: if the line falls among them all are taken or none, whichever ends nearer to it; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import BROADCAST_ROWS, WHITE, discard, documents, if_small, join_by_key, numbered, packed, unit, written

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CAP = 2.0

SIZE_POWER = 0.5
#: Digits of a rank, and bits of a digit.
DIGITS, DIGIT_BITS = 6, 8
SEED = 9


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target from rows of (source, size).  Only sums over all sources reach the driver."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = written(numbered(per, [F.col("source").asc_nulls_last()], "_i").withColumn("_w", weight), "mix-sources")
    size, weighs = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    total, level, full = share * (size or 0), 0.0, 0
    # Source s gets the smaller of cap * size and level * weight.  Each round shares what full sources leave;
    # the level only rises, and the rounds end when it fills no further source.
    while weighs:
        level = total / weighs
        n, held, weight_held = ranked.agg(
            F.count_if(F.col("source_size") * cap <= level * F.col("_w")),
            F.sum(F.when(F.col("source_size") * cap <= level * F.col("_w"), F.col("source_size"))),
            F.sum(F.when(F.col("source_size") * cap <= level * F.col("_w"), F.col("_w"))),
        ).first()
        if n == full:
            break
        full, total = n, share * size - cap * (held or 0)
        weighs = ranked.agg(F.sum("_w")).first()[0] - (weight_held or 0)
    else:
        level = float("inf")
    return ranked.select("source", "source_size", F.least(F.col("source_size") * cap, F.lit(level) * F.col("_w")).cast("double").alias("target"))


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def size_class(size: Column) -> Column:
    """The place of the highest binary digit; -1 for size 0."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def _expected(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """_s, _c, source_size, target, expected: copies of a document of a source and size class.  At most 64 rows for each source."""
    classes = sizes.filter("size > 0").groupBy("_s", "_c").agg(F.sum("size").alias("_words"))
    weight = F.pow(F.lit(2.0), F.col("_c") * F.lit(SIZE_POWER))
    full = classes.withColumn("_g", weight).join(targets.select(source_key(F.col("source")).alias("_s"), "source_size", "target"), "_s")
    # Classes reach the cap from the largest on; t is right at the first that it doesn't fill.
    down = Window.partitionBy("_s").orderBy(F.desc("_c"))
    held = F.coalesce(F.sum(F.col("_words") * F.lit(cap)).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(F.col("_words") * F.col("_g")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = full.withColumn("_t", (F.col("target") - held) / left)
    fits = F.when(F.col("_t") * F.col("_g") <= cap, F.struct((-F.col("_c")).alias("c"), F.col("_t").alias("t")))
    t = F.min(fits).over(Window.partitionBy("_s"))["t"]
    return full.select("_s", "_c", "_words", "source_size", "target", F.least(F.lit(cap), F.coalesce(t * F.col("_g"), F.lit(cap))).alias("expected"))


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, q, as a whole number: q / (1 + q) lies between 0 and 1 and keeps the order."""
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, F.floor(q / (1 + q) * F.lit(float(1 << DIGITS * DIGIT_BITS))).cast("long"))


def _lines(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """_s, cutoff: the last rank that is taken.  ``rows``: _s, rank, size; ``rest``: _s, rest, the words to take."""
    found = rest.select("_s", "rest", F.lit(0).cast("long").alias("digits"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("words"))
    found, inside = written(found, "mix-lines"), rows
    n = found.count()
    for k in range(1, DIGITS + 1):
        digits = F.shiftright("rank", DIGIT_BITS * (DIGITS - k))
        bins = inside.groupBy("_s", digits.alias("bin")).agg(F.sum("size").alias("sum"))
        order = Window.partitionBy("_s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = bins.join(found.select("_s", "rest", "begin"), "_s").withColumn("end", F.col("begin") + F.sum("sum").over(order))
        first = F.min(F.struct("bin", (F.col("end") - F.col("sum")).alias("begin"), F.col("sum").alias("words")))
        crossed = ends.filter("end >= rest").groupBy("_s").agg(first.alias("c"))
        # A source whose words don't reach the line keeps its last place: all of them are taken.
        after = found.drop("digits", "begin", "words").join(crossed, "_s", "left").select("_s", "rest", F.col("c.bin").alias("digits"), F.col("c.begin").alias("begin"), F.col("c.words").alias("words"))
        last, found = found, written(after, "mix-lines")
        here = found.filter("digits IS NOT NULL").select("_s", F.col("digits").alias("_bin"))
        met = inside.withColumn("_bin", digits).join(if_small(here, n), ["_s", "_bin"], "left_semi").drop("_bin")
        before, inside = inside, written(met, "mix-inside")
        discard(last, *([before] if k > 1 else []))
    discard(inside)
    everything = F.lit(1 << DIGITS * DIGIT_BITS).cast("long")
    # The rows at the line are taken if the middle of their words lies before it: then the sum ends nearer with them than without.
    taken = F.col("digits") - F.when(F.col("begin") + F.col("words") / 2 <= F.col("rest"), 0).otherwise(1)
    return found.select("_s", F.when(F.col("rest") <= 0, F.lit(-1).cast("long")).otherwise(F.coalesce(taken, everything)).alias("cutoff"))


def _drawn(seed: int, doc_id: str, text: str, source: str) -> dict[str, Column]:
    """What the plan and the rows have to agree on; ``_classed`` adds the class."""
    return {"_s": source_key(F.col(source)), "size": word_count(F.col(text)), "u": unit(F.col(doc_id), F.xxhash64(F.col(text)), F.lit(seed))}


def _classed(rows: DataFrame) -> DataFrame:
    """A step of its own, so that words are counted once."""
    return rows.withColumn("_c", size_class(F.col("size")).cast("int"))


def _planned(sizes: DataFrame, cap: float) -> DataFrame:
    """_s, _c, source_size, target, whole, p, cutoff: all that tells the copies of a document."""
    targets = written(source_targets(sizes, cap=cap), "mix-targets")
    expected = _expected(sizes, targets, cap).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("int"))
    expected = written(expected.withColumn("p", F.greatest(F.lit(0.0), F.least(F.col("expected") - F.col("whole"), F.lit(1 - 1e-9)))), "mix-expected")
    rest = expected.groupBy("_s").agg((F.first("target") - F.sum(F.col("whole") * F.col("_words"))).alias("rest"))
    ranked = _met(sizes.filter("size > 0"), expected.select("_s", "_c", "p")).select("_s", _rank(F.col("u"), F.col("p")).alias("rank"), "size")
    ranked = written(ranked.filter("rank IS NOT NULL"), "mix-ranked")
    lines = _lines(ranked, rest)
    planned = written(expected.join(lines, "_s").select("_s", "_c", "whole", "p", "cutoff"), "mix-plan")
    # Classes of size 0 aren't in the plan: nothing is taken of them.
    out = targets.select(source_key(F.col("source")).alias("_s"), "source_size", "target").join(planned, "_s", "left")
    out = written(out, "mix-plans")
    discard(ranked, planned, expected, targets)
    return out


def _met(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their source and class.  A plan of many sources is met by key, hot ones where they are."""
    n = plan.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(plan), ["_s", "_c"])
    return join_by_key(rows, plan, ["_s", "_c"], rows.count())


def _copies() -> Column:
    return F.col("whole") + F.when(_rank(F.col("u"), F.col("p")) <= F.col("cutoff"), 1).otherwise(0)


def mix(docs: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, key (a hash of the text), source, size, source_size, target, expected (copies), copies, taken."""
    kept = {"doc_id": F.col(doc_id), "key": F.xxhash64(F.col(text)), "source": F.col(source)}
    sizes = written(_classed(docs.select(*[c.alias(n) for n, c in (kept | _drawn(seed, doc_id, text, source)).items()])), "mix-sizes")
    plan = _planned(sizes, CAP)
    filled = _met(sizes.filter("size > 0"), plan.filter("_c IS NOT NULL").select("_s", "_c", "source_size", "target", "whole", "p", "cutoff"))
    empty = plan.select("_s", "source_size", "target").distinct()
    wordless = sizes.filter("size = 0").join(if_small(empty), "_s")
    columns = ["doc_id", "key", "source", "size", "source_size", "target"]
    full = filled.select(*columns, (F.col("whole") + F.col("p")).alias("expected"), _copies().cast("int").alias("copies"))
    out = full.unionByName(wordless.select(*columns, F.lit(0.0).alias("expected"), F.lit(0).alias("copies")))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns they came with.  Texts stay where they are."""
    drawn = _drawn(seed, doc_id, text, source)
    sizes = written(_classed(docs.select(F.col(source).alias("source"), *[c.alias(n) for n, c in drawn.items()])), "mix-sizes")
    plan = _planned(sizes, CAP).filter("_c IS NOT NULL").select("_s", "_c", "whole", "p", "cutoff")
    found = _met(_classed(packed(docs, **drawn)), plan).withColumn("_copies", _copies()).filter("_copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op9_pareto_mixing": op9_pareto_mixing}
ORACLE_SQL: dict[str, str] = {}
