"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.shared import fresh, ranked, small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of at most so many documents of a source get exactly the copies planned.
EXACT = 1024
#: Sizes of three digits or fewer are cells of their own, larger ones are cut to three digits: some 900 cells for each further digit.
_CELL = "size - size % cast(pow(10, greatest(length(cast(size as string)) - 3, 0)) as bigint)"


def word_count(text):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target) for a table of (source, source_size) with one row a source; and the written table it reads.

    Sources in code point order, null last, weigh ``weights``, repeating. Targets share the sum of all
    sizes by weight, none above ``most`` times its source's size; what is above goes to the others by
    weight, until none is above. Every step is one aggregation over the table of sources. If ``most``
    is under 1 the caps leave a part of the sum to nobody.
    """
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % n + 1).cast("int"))
    t = ranked(totals.withColumn("_null", F.col(source_col).isNull()), ["_null", source_col], "_rank")
    t = written(t.select(source_col, "source_size", w.alias("weight"), (most * F.col("source_size")).alias("cap")), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while True:
        full = F.col("cap") < F.col("weight") * level if last is not None else F.lit(False)
        r = t.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if not r.w or r.n == last:
            break
        last, level = r.n, (total - r.c) / r.w
    return t.select(source_col, "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target")), t


def _planned(pdf):
    """For one source's cells of sizes, largest first: how many documents of each get the further copy.

    The chance starts as the rate's fraction. What a cell's draw takes more or less than its chance is made up for
    by the chance of the smaller sizes after it, as far as either outcome leaves that between 0 and 1; so over all
    draws each document's probability stays the fraction.
    """
    pdf = pdf.sort_values("cell", ascending=False, kind="stable")
    size, target = float(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    rate = target / size if size > 0 else 0.0
    chance, left, hits = rate - int(rate), size, []
    for n, words, u in zip(pdf.n.tolist(), pdf.words.tolist(), pdf.u.tolist(), strict=True):
        fair = chance * n
        part = fair - int(fair)
        k = int(fair) + (u < part)
        hits.append(k)
        left -= words
        if left > 0 and words and 0 < part < 1:
            step = words / n / left
            room = min(1.0, (1 - chance) / (part * step), chance / ((1 - part) * step))
            chance = min(1.0, max(0.0, chance + room * (fair - k) * step))
    return pdf.assign(hits=hits, whole=int(rate))[["source", "cell", "source_size", "target", "n", "hits", "whole"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The documents with size, source_size, target and copies: how often the mix takes each.

    A source's rate is its target over its size. A document is taken floor(rate) times, and once more by a draw
    that a hash of the seed, its id and its text decides, with the rate's fraction as its probability; reruns agree. The draws
    of a source depend on each other: its documents are grouped in cells of sizes equal to three digits, and of a cell's
    documents those with the least hashes get the copy, as many as ``_planned`` says (in cells of over EXACT
    documents, those whose hash is under that share). So a source misses its target by little more than its smallest
    documents' size, if these make up for the large ones.

    Documents without words (null and empty texts too) have size 0 and are taken as others; a source without words has
    rate 0. A null source is a source. Rows that repeat an id and text share their fate; null ids are ids as others. An empty
    table gives an empty result. Names of added columns replace those of the input.
    """
    added = ["size", "source_size", "target", "copies"]
    sized = docs.drop(*added).withColumn("size", word_count(F.col(text_col)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11) / F.lit(float(1 << 53))
    narrow = written(sized.select(F.col(source_col).alias("source"), F.expr(_CELL).alias("cell"), "size", draw.alias("draw")), "sizes")
    cells = written(narrow.groupBy("source", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    rates, table = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), "source", weights, most)
    rates = small(rates, table).withColumnRenamed("source", "_s")
    seeded = cells.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "cell"), 11) / F.lit(float(1 << 53)))
    plan = seeded.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").groupBy("source").applyInPandas(_planned, f"source {dict(narrow.dtypes)['source']}, cell long, source_size long, target double, n long, hits long, whole long")
    plan = written(plan, "plan")
    exact = plan.where(f"hits > 0 and hits < n and n <= {EXACT}").select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "hits")
    hashes = narrow.join(small(exact, plan), F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c"))).groupBy("_s", "_c").agg(F.sort_array(F.collect_list("draw")).alias("d"), F.first("hits").alias("h"))
    cuts = written(hashes.select("_s", "_c", F.get("d", F.col("h").cast("int")).alias("cut")), "cuts")
    plan = plan.join(small(cuts), F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")), "left")
    s, c, cut = (fresh(docs, x) for x in ("source", "cell", "cut"))
    plan = written(plan.select(F.col("source").alias(s), F.col("cell").alias(c), "source_size", "target", "whole", F.coalesce("cut", F.col("hits") / F.col("n")).alias(cut)), "plan")
    joined = sized.join(small(plan), sized[source_col].eqNullSafe(plan[s]) & (F.expr(_CELL) == plan[c]), "left")
    return joined.withColumn("copies", F.col("whole") + (draw < F.col(cut)).cast("long")).drop(s, c, cut, "whole").select(*[f"`{x}`" for x in docs.columns if x not in added], *added)


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix``, each repeated as often as it is taken, without the columns that ``mix`` added."""
    copy = fresh(mixed, "copy")
    return mixed.withColumn(copy, F.explode(F.expr("filter(sequence(0, cast(copies as int)), x -> x > 0)"))).drop(copy, "size", "source_size", "target", "copies")
