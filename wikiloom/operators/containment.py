"""Which needles are contained in some haystack, without comparing all with all.

A needle of at least ``GRAM`` characters can only be contained in a haystack that
holds each of the needle's character grams. So the needles are matched with the
haystacks by one gram only, the one that the fewest haystacks hold, and verified. A
needle with a gram that no haystack holds is out at once. Shorter needles equal a gram
of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.session import staged

GRAM = 8


def _grams(text: Column, length: int) -> Column:
    """All substrings of one length, each once."""
    starts = F.sequence(F.lit(1), F.length(text) - (length - 1))
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(length)))
    return F.when(F.length(text) >= length, F.array_distinct(cut))


def contained(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Distinct needles contained in at least one haystack.

    Both tables have one text column, ``needle`` and ``haystack``. The empty needle is
    contained in any haystack.
    """
    needles = staged(needles.select("needle").filter("needle IS NOT NULL").distinct(), "needles")
    haystacks = staged(
        haystacks.select("haystack").filter("haystack IS NOT NULL").distinct(), "haystacks"
    )

    # The lengths that short needles have, at most GRAM numbers.
    lengths = [r[0] for r in needles.filter(F.length("needle") < GRAM).select(F.length("needle")).distinct().collect()]
    found = _long_needles(needles, haystacks)
    if any(lengths):
        found = found.unionByName(_short_needles(needles, haystacks, sorted(n for n in lengths if n)))
    if 0 in lengths:
        found = found.unionByName(haystacks.limit(1).select(F.lit("").alias("needle")))
    return found


def _short_needles(needles: DataFrame, haystacks: DataFrame, lengths: list[int]) -> DataFrame:
    """Needles of the given lengths: each equals a gram of its own length."""
    grams = F.flatten(F.array_compact(F.array(*[_grams(F.col("haystack"), n) for n in lengths])))
    short = needles.filter(F.length("needle") < GRAM)
    # The join keeps the few grams that are needles, before any are compared with each other.
    return haystacks.select(F.explode(grams).alias("needle")).join(short, "needle", "left_semi").distinct()


def _long_needles(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    own = needles.filter(F.length("needle") >= GRAM).select("needle", F.explode(_grams(F.col("needle"), GRAM)).alias("gram"))
    wanted = staged(own.select("gram").distinct(), "grams")
    every = haystacks.select("haystack", F.explode(_grams(F.col("haystack"), GRAM)).alias("gram"))
    # Postings of the needles' grams alone, cut once.
    postings = staged(every.join(wanted, "gram", "left_semi"), "postings")
    frequencies = postings.groupBy("gram").agg(F.count("*").alias("haystacks"))
    rarest = (
        own.join(frequencies, "gram", "left")
        .groupBy("needle")
        .agg(
            F.bool_and(F.col("haystacks").isNotNull()).alias("possible"),
            F.min(F.struct("haystacks", "gram")).alias("rarest"),
        )
        .filter("possible")
        .select("needle", "rarest.gram")
    )
    return (
        staged(rarest, "rarest")
        .join(postings, "gram")
        .filter(F.contains("haystack", "needle"))
        .select("needle")
        .distinct()
    )
