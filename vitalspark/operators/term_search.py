"""Searches for a whole table of terms at once, by an inverted index of character grams.

A text can only match a term if it holds every run of plain characters in it. So each term
meets the texts that share its rarest gram, and LIKE decides among those. Grams have three
characters; terms whose longest plain run is shorter use two, one or none, which the index
holds as well, so no term needs a comparison with every text that it can't match.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.operators.equipment import (
    SEARCHED, gym_workout_summary, library_with_gym_count, visible_equipment,
)
from vitalspark.skew import join_shared

Tables = Mapping[str, DataFrame]
GRAM = 3
#: Stands before a text that a term must begin.
START = "\x02"


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters of a text; of size 0 the empty one."""
    if size == 0:
        return F.array(F.lit(""))
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                        lambda i: F.substring(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def gram_index(texts: DataFrame) -> DataFrame:
    """``gram, id, text`` once per different gram of up to three characters of each (id, text).

    Store it to serve many tables of terms; a new text only adds rows. Texts without a column
    ``id`` stand for themselves.
    """
    kept = [c for c in ("id", "text") if c in texts.columns]
    known = texts.select(*kept).filter(F.col("text").isNotNull()).distinct()
    every = F.concat(*[_grams(F.col("text"), n) for n in range(GRAM + 1)])
    return known.select(F.explode(F.array_distinct(every)).alias("gram"), *kept)


def _plain_runs(term: Column) -> Column:
    """Runs of a LIKE pattern that stand for themselves; an escaped character is in none."""
    return F.split(term, r"(?s)\\.|[%_\\]")


def term_grams(terms: DataFrame) -> DataFrame:
    """``term, gram``: the different grams of a term's plain runs, of the greatest size it has."""
    runs = terms.select("term").distinct().withColumn("_runs", _plain_runs(F.col("term")))
    size = F.least(F.array_max(F.transform("_runs", F.length)), F.lit(GRAM))

    def of_runs(n: int) -> Column:
        return F.flatten(F.transform("_runs", lambda r: _grams(r, n)))

    of_size = [F.when(size == n, of_runs(n)) for n in range(GRAM + 1)]
    return runs.select("term", F.explode(F.array_distinct(F.coalesce(*of_size))).alias("gram"))


def match_terms(index: DataFrame, terms: DataFrame, *, anywhere: bool = True) -> DataFrame:
    """``term, id`` of each term and each id with a text that holds it, once each; ``term, text`` without ids.

    ``terms`` has a column ``term``; % and _ in it keep their LIKE meaning, a backslash takes it
    from them. Null terms match nothing, the empty term every text. Matching is by case: lower
    both sides for less. With ``anywhere`` false a text must begin with the term; the texts
    of the index, and the terms here, then carry ``START`` in front.
    """
    wanted = term_grams(terms.filter(F.col("term").isNotNull()))
    held = index.join(wanted.select("gram").distinct(), "gram", "left_semi")
    sizes = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no text has is the rarest of all
    rarest = wanted.join(sizes, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_r")).select("term", "_r.gram")
    pattern = F.concat(F.lit("%") if anywhere else F.lit(""), F.col("term"), F.lit("%"))
    found = rarest.join(held, "gram").filter(F.like("text", pattern))
    # a term has one gram here and a text has it once
    return found.select("term", "id").distinct() if "id" in index.columns else found.select("term", "text")


def _texts(rows: DataFrame, *columns: str) -> DataFrame:
    texts = F.array(*[F.lower(c) for c in columns])
    return rows.select("id", F.explode(texts).alias("text"))


def search_library_terms(t: Tables, terms: DataFrame) -> DataFrame:
    """For each term the visible library entries whose name or brand holds it, case aside, with gym counts.

    Each different text is indexed and compared once; the terms of each different pair of name and
    brand then meet the entries with that pair. No pairs of terms and entries are sorted out.
    """
    pair = {"_name": F.lower("name"), "_brand": F.lower("brand")}
    pairs = visible_equipment(t["equipment_library"]).select(*[c.alias(n) for n, c in pair.items()]).distinct()
    held = pairs.select("*", F.posexplode(F.array(*pair)).alias("_at", "text"))
    matched = match_terms(gram_index(held.select("text")), terms.select(F.lower("term").alias("term")))
    # a term that is in the name as well counts there
    named = F.coalesce(F.like("_name", F.concat(F.lit("%"), "term", F.lit("%"))), F.lit(False))
    hits = held.join(matched, "text").filter((F.col("_at") == 0) | ~named).select(*pair, F.col("term").alias("_low"))
    written = terms.select("term").distinct().withColumn("_low", F.lower("term"))
    rows = library_with_gym_count(t)
    return join_shared(rows.withColumns(pair), hits.join(written, "_low").drop("_low"), list(pair)).select(
        "term", *rows.columns)


def search_gyms_terms(t: Tables, terms: DataFrame) -> DataFrame:
    """For each term the gyms with it in name or city, case aside, or at the start of the zip code.

    Terms of fewer than two characters after trimming find nothing.
    """
    gyms = t["gyms"]
    asked = terms.filter(F.length(F.trim("term")) >= 2)
    low = asked.select(F.lower("term").alias("term"))
    inside = match_terms(gram_index(_texts(gyms, "name", "city")), low).withColumnRenamed("term", "_low")
    zips = gyms.select("id", F.concat(F.lit(START), "zip").alias("text"))
    starts = match_terms(gram_index(zips), asked.select(F.concat(F.lit(START), "term").alias("term")), anywhere=False)
    # zip codes are matched as the term is written
    by_zip = starts.select(F.substring("term", 2, 1 << 30).alias("term"), "id")
    written = asked.select("term").distinct().withColumn("_low", F.lower("term"))
    pairs = written.join(inside, "_low").select("term", "id").unionByName(by_zip).distinct()
    return pairs.join(gym_workout_summary(t).select(*SEARCHED), "id").select("term", *SEARCHED)
