"""Spelling variants: words one edit apart, and the form that each rare spelling goes with.

Words one edit apart are met by an even-partition pigeonhole join. A word of length m is indexed by
its two even segments, the first m div 2 characters and the rest. One edit leaves one of the two
whole, so a word as long or one longer probes with the substrings that lie where that segment would
lie: its head, and its tail shifted by the difference. What lies beside an equal segment differs by
the same one edit. A segment that too many words share (more than `most_pairs` candidates) is
therefore not compared as it is: what is beside it is partitioned again in the same way, and so on, until
few enough words share what is equal. So no candidate is lost, and a common head or tail makes
no square of its words. Candidates are verified within the join, and met twice count once.

A word's form is its near word of largest n, ties to the smallest, if that n is at least `ratio`
times the word's; forms are followed by pointer doubling, so chains of any length need few rounds.

Nulls and edges: a null or empty text holds no words; a null doc_id counts as the empty text; each
of repeated rows counts; texts of any length are read whole; an empty table, or one without words
that are long and frequent enough, gives no rows; extra columns are not looked at.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Runs of letters that count as words.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_N, RATIO = 6, 5, 5
#: Candidates of one segment beyond which it is partitioned again.
MOST_PAIRS = 100_000


def _lower(word: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _slipped(doc_id: Column, word: Column, every: int) -> Column:
    """The word without one of its characters, if `every` divides the crc32 of `<doc_id>:<word>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slips_every: int | None = None, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word and n, its occurrences in all texts, of the words that are long and frequent enough.

    slips_every: plant slips of the pen, a character left out of about one word in so many.
    """
    runs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("doc_id", _lower(F.col("run")).alias("word"))
    if slips_every:
        runs = runs.select(_slipped(F.col("doc_id"), F.col("word"), slips_every).alias("word"))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _segments(rows: DataFrame) -> DataFrame:
    """Each row twice: its key with the head or with the tail, and what is beside that.

    longer: by how much a probe exceeds the words that it looks for; 0 for indexed words.
    """
    rest, m = F.col("rest"), F.length("rest") - F.col("longer")
    half = F.floor(m / 2).cast("int")
    key = lambda side, part: F.concat("key", F.lit(" "), m.cast("string"), F.lit(side), part)
    head = F.struct(key("<", F.substring(rest, F.lit(1), half)).alias("key"), F.substring(rest, half + 1, F.length(rest)).alias("rest"))
    beside = F.length(rest) - (m - half)
    tail = F.struct(key(">", F.substring(rest, beside + 1, F.length(rest))).alias("key"), F.substring(rest, F.lit(1), beside).alias("rest"))
    return rows.select("word", "n", "longer", F.explode(F.array(head, tail)).alias("at")).select("word", "n", "longer", "at.key", "at.rest")


def near_words(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, n, near, near_n of all ordered pairs of words (word, n) that differ by one inserted, deleted or replaced character."""
    start = words.select("word", "n", F.lit("").alias("key"), F.col("word").alias("rest"))
    index = start.withColumn("longer", F.lit(0))
    probe = start.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    found = None
    while True:
        index, probe = _segments(index), _segments(probe)
        held = index.groupBy("key").agg(F.count("*").alias("held"), F.max(F.length("rest")).alias("beside"))
        heavy = held.join(probe.groupBy("key").agg(F.count("*").alias("asked")), "key").where(f"held * asked > {most_pairs} and beside > 1").select("key")
        heavy = saved(heavy)
        again = not heavy.isEmpty()
        asked = probe.select("longer", "key", F.col("rest").alias("own_rest"), F.col("word").alias("own"), F.col("n").alias("own_n"))
        light = (index.drop("longer").join(heavy, "key", "left_anti"), asked.join(heavy, "key", "left_anti")) if again else (index.drop("longer"), asked)
        same = F.expr("longer = 1 or own < word") & (F.levenshtein("rest", "own_rest", 1) == 1)
        pairs = light[0].join(light[1], "key").where(same).select("word", "n", F.col("own").alias("near"), F.col("own_n").alias("near_n"))
        found = pairs if found is None else found.unionByName(pairs)
        if not again:
            break
        index, probe = (saved(x.join(heavy, "key", "left_semi").select(x.columns)) for x in (index, probe))
    found = found.dropDuplicates(["word", "near"])
    return found.select(F.explode(F.expr("array(struct(word, n, near, near_n), struct(near as word, near_n as n, word as near, n as near_n))")).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last form that is reached from it; forms: word and form, without cycles."""
    at = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = saved(at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, ratio: int = RATIO, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the words (word, n)."""
    words = saved(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, most_pairs).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    taken = F.col("form_n") >= F.col("n") * ratio
    made = words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")
    )
    made = saved(made)
    made = made.join(roots(made.where("form is not null")), "word", "left")
    return made.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
