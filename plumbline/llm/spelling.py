"""Spelling variants: words one code point apart, found through wildcard groups without writing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"


def _without(word: Column, at: Column) -> Column:
    """word without its code point number `at`, from 1."""
    return F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1))


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: str = RUN, typo_every: int | None = 31, least: int = 7, n_least: int = 2) -> DataFrame:
    """(word string, n long): the words of at least `least` code points that occur at least n_least times in all texts.

    Words are the maximal runs of `run` with A-Z lower-cased.  With typo_every, a run whose crc32 with its document,
    `<id>:<run>`, is divisible by it loses the code point number crc32 % length, which plants misspellings; null for none.
    A null text has no words, and a null id counts as an empty one; rows that share an id count each; no rows give no words.
    Occurrences are counted within their task before they are shuffled.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(run), F.lit(0))).alias("w"))
    runs = runs.where(F.char_length("w") >= least)
    # lower() also turns other letters, so it only tells the words, most of them, that have nothing to turn
    runs = runs.select("i", F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(F.translate("w", UPPER, LOWER)).alias("w"))
    if typo_every is not None:
        h = F.crc32(F.concat("i", F.lit(":"), "w").cast("binary"))
        runs = runs.select("w", h.alias("h"))
        typo = _without(F.col("w"), F.pmod(F.col("h"), F.char_length("w")).cast("int") + 1)
        runs = runs.select(F.when(F.col("h") % typo_every == 0, typo).otherwise(F.col("w")).alias("w")).where(F.char_length("w") >= least)
    return runs.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= n_least)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near long, near struct<minus_n, word>): how many words are near a word, and the commonest of them.

    words: (word, n), distinct.  Two words are near if one inserted, deleted or replaced code point turns one into the other.

    A word gives one row for each position, keyed by what is left of it without that code point, and one under itself.  Rows
    with one key and position are a group (position, prefix, suffix): its size less one is what each member has near by
    replacement there, and its best is the group's first word, or the second for the first one.  A word under its own key meets
    the words that become it by one deletion (of a run of equal code points only the last is taken, so each once), and
    they meet it.  Every row is worked out from its group's size and top words, so the work grows with the words' letters
    and never with pairs.  A group has as many words as letters fit a place, and a key as many as there are insertions.
    """
    length = F.char_length("word")
    places = F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(i.alias("at"), _without(F.col("word"), i).alias("rest"), (F.substr("word", i, F.lit(1)) != F.substr("word", i + 1, F.lit(1))).alias("last")))
    own = F.array(F.struct(F.lit(0).alias("at"), F.col("word").alias("rest"), F.lit(False).alias("last")))
    rows = words.select("word", "n", F.inline(F.concat(own, F.when(length > 0, places).otherwise(F.slice(places, 1, 0)))))
    # one shuffle, by what is left; both windows and the groups within them use it
    entry = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    rows = rows.withColumn("e", entry)
    place = Window.partitionBy("rest", "at").orderBy("e").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = Window.partitionBy("rest")
    deleted = F.when(F.col("last"), F.col("e"))
    rows = rows.select(
        "word", "n", "at", "rest", "last", "e",
        F.count("*").over(place).alias("size"), F.nth_value("e", 1).over(place).alias("first"), F.nth_value("e", 2).over(place).alias("second"),
    )
    rows = rows.select("*", F.max(F.when(F.col("at") == 0, F.col("n"))).over(key).alias("own_n"), F.count(deleted).over(key).alias("longer"), F.min(deleted).over(key).alias("longest"))
    same_place = F.when(F.col("at") > 0, F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")))
    shorter = F.when(F.col("last") & F.col("own_n").isNotNull(), F.struct((-F.col("own_n")).alias("minus_n"), F.col("rest").alias("word")))
    longer = F.when(F.col("at") == 0, F.col("longest"))
    found = F.col("size") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0) + F.when(F.col("at") == 0, F.col("longer")).otherwise(0)
    return (
        rows.select("word", "n", found.alias("found"), F.least(same_place, shorter, longer).alias("best"))
        .where("found > 0 or at = 0")
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("found").alias("n_near"), F.min("best").alias("near"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) links without cycles: the last word that a word's links lead to, by pointer doubling.

    A word must have one link at most; words without a link are not returned.  A chain of k links takes about log2(k) rounds,
    each a join on the word and a table in the shared folder.
    """
    tables = Tables(forms.sparkSession)
    links = tables.put(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = tables.put(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = moved.where("moved").isEmpty()
        tables.drop(links)
        links = moved
        if done:
            return links.select("word", "root")


def variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long) of every word of (word, n).

    form: of the words near it the one of largest n (ties: the smallest in code-point order), if that n >= ratio * the word's n,
    else null.  root: the last word that forms lead to, the word itself without any.  ratio must be over 1, so that forms
    never go round in a circle.  Null words and counts below 1 are left out; repeated words count together; no rows give no rows.
    """
    if not ratio > 1:
        raise ValueError("ratio must be over 1")
    tables = Tables(words.sparkSession)
    distinct = words.where(F.col("word").isNotNull() & (F.col("n") > 0)).groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n"))
    distinct = tables.put(distinct)
    form = F.when(-F.col("near.minus_n") >= ratio * F.col("n"), F.col("near"))
    found = near_words(distinct).select("word", "n", "n_near", form.alias("form"))
    found = tables.put(found.select("word", "n", "n_near", F.col("form.word").alias("form"), (-F.col("form.minus_n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
