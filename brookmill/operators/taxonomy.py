"""Dictionary joins: terms found in texts, terms resolved, related names, merged candidates."""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions.fuzzy import ratio
from brookmill.functions.text import identity_key, taxonomy_key

from .relational import top_per_key

#: Dictionary entries that a plan holds itself.
INLINE_ENTRIES = 5_000


def phrases(df: DataFrame, id_column: str, text: str, longest: int) -> DataFrame:
    """id, at (word number) and phrase of every run of one to `longest` words of the text's key."""
    words = df.select(id_column, F.split(taxonomy_key(F.col(text)), " ").alias("_words"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (n - 1), F.lit(0))), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_words", i, F.lit(n)), " ").alias("phrase")))
    runs = F.concat(*[F.when(F.size("_words") >= n, run(n)).otherwise(F.array().cast("array<struct<at:int,phrase:string>>")) for n in range(1, longest + 1)])
    return words.select(id_column, F.inline(runs)).where("phrase != ''")


def _fetched(df: DataFrame, entries: list[Row], id_column: str, text: str) -> DataFrame:
    """id, at, phrase, canonical and kind of every place of the entries in the texts: an automaton over all entries reads a text's key once."""
    named: dict[str, list[tuple[str, str, str]]] = {}
    for e in sorted(entries):
        named.setdefault(f" {e.phrase} ", []).append((e.phrase, e.canonical, e.kind))
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("at", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in ("phrase", "canonical", "kind")]])
    keyed = df.select(F.col(id_column), F.concat(F.lit(" "), taxonomy_key(F.col(text)), F.lit(" ")).alias("_key")).where("_key is not null")
    if not named:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ahocorasick.Automaton()
        for phrase in named:
            made.add_word(phrase, phrase)
        made.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, key in enumerate(batch.column("_key").to_pylist()):
                seen = words = 0
                for end, phrase in made.iter(key):
                    # a hit ends with the space behind its last word: `words` spaces stand up to there
                    words += key.count(" ", seen, end + 1)
                    seen = end + 1
                    at = words - phrase.count(" ") + 1
                    for e in named[phrase]:
                        rows.append(k)
                        found.append((at, *e))
            columns = [list(c) for c in zip(*found)] or [[]] * 4
            values = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(rows, pa.int64())), *values], schema.names)

    return keyed.mapInArrow(run, schema)


def found_terms(df: DataFrame, dictionary: DataFrame, id_column: str, text: str, longest: int = 3, inline: int = INLINE_ENTRIES) -> DataFrame:
    """id, canonical, kind and first place of each dictionary entry of up to `longest` words in each text.

    Up to `inline` entries an automaton of each task holds them. More entries are joined with
    the texts' word runs. Either way the work grows with the texts and not with texts times entries.
    A canonical name beats an alias.
    """
    entries = dictionary.select(taxonomy_key(F.col("alias")).alias("phrase"), "canonical", "kind").where("phrase != ''")
    kind = F.min(F.struct(F.when(F.col("kind") == "canonical", 0).otherwise(1).alias("o"), "kind")).alias("k")
    entries = entries.groupBy("phrase", "canonical").agg(kind).select("phrase", "canonical", "k.kind")
    entries = entries.where(F.size(F.split("phrase", " ")) <= longest)
    few = entries.limit(inline + 1).collect()
    hits = _fetched(df, few, id_column, text) if len(few) <= inline else phrases(df, id_column, text, longest).join(entries, "phrase")
    best = F.min(F.struct(F.when(F.col("kind") == "canonical", 0).otherwise(1).alias("o"), "at", "kind")).alias("best")
    return hits.groupBy(id_column, "canonical").agg(best, F.count("*").alias("hits")).select(id_column, "canonical", "best.kind", F.col("best.at").alias("first_at"), "hits")


def alias_index(entries: DataFrame) -> DataFrame:
    """key, canonical and kind of every name and alias of entries (canonical, aliases); a canonical name beats an alias, then the smallest wins."""
    names = entries.select("canonical", F.lit("canonical").alias("kind"), taxonomy_key(F.col("canonical")).alias("key"))
    aliases = entries.select("canonical", F.explode("aliases").alias("a")).select("canonical", F.lit("alias").alias("kind"), taxonomy_key(F.col("a")).alias("key"))
    best = F.min(F.struct(F.when(F.col("kind") == "canonical", 0).otherwise(1).alias("o"), "canonical", "kind")).alias("b")
    return names.union(aliases).where("key != ''").groupBy("key").agg(best).select("key", "b.canonical", "b.kind")


def normalized(df: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """df with normalized (the canonical name, or the trimmed term), match_type and confidence. Spark picks the join by size."""
    known = index.select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"), F.col("kind").alias("_kind"))
    out = df.join(known, taxonomy_key(F.col(term)) == F.col("_key"), "left")
    kind = F.coalesce("_kind", F.lit("unknown"))
    sure = F.when(kind == "canonical", "high").when(kind == "alias", "medium").otherwise("low")
    return out.withColumns({"normalized": F.coalesce("_canonical", F.trim(term)), "match_type": kind, "confidence": sure}).drop("_key", "_canonical", "_kind")


def unknown_terms(df: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """Distinct terms that aren't noise and that no name or alias of the index spells, marks and spaces aside; the smallest spelling of each, how many there are."""
    loose = index.select(identity_key(F.col("key")).alias("identity")).distinct()
    found = df.select(F.col(term).alias("term")).where(F.col("term").isNotNull() & noise_reason(F.col("term")).isNull())
    found = found.withColumn("identity", identity_key(F.col("term"))).where("identity != ''").groupBy("identity").agg(F.min("term").alias("term"), F.count("*").alias("n"))
    return found.join(loose, "identity", "left_anti")


def resolve_fuzzy(terms: DataFrame, dictionary: DataFrame, term: str, least: float = 94.0, margin: float = 3.0) -> DataFrame:
    """terms with canonical and score: the closest entry at least `least` alike and `margin` ahead of the next.

    Terms of under six characters are left alone. Two strings this alike are d inserted or deleted
    characters apart, d at most (1 - least / 100) times their lengths together, and each of these
    takes three trigrams away at most. So in any one order of trigrams the first 3 d + 1 of either
    string hold a common one: candidates meet there, and none is lost.
    """
    apart = 1 - least / 100
    most = lambda x: F.floor(F.length(x) * apart * (1 + (1 + apart) / (1 - apart)) + 1e-9)

    def keys(x: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))
        # repeated ones are numbered, so that they count apart
        numbered = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")))
        ordered = F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("o"), g.alias("g"))))
        return F.transform(F.slice(ordered, F.lit(1), (3 * most(x) + 1).cast("int")), lambda s: s["g"])

    left = terms.select(term).distinct().withColumn("_t", taxonomy_key(F.col(term))).where(F.length("_t") >= 6).withColumn("_k", F.explode(keys(F.col("_t"))))
    right = dictionary.select("canonical", taxonomy_key(F.col("alias")).alias("_e")).where(F.length("_e") >= 3).withColumn("_k", F.explode(keys(F.col("_e"))))
    near = left.join(right, "_k").where(F.abs(F.length("_t") - F.length("_e")) <= F.least(most(F.col("_t")), most(F.col("_e")))).select(term, "_t", "canonical", "_e").distinct()
    scored = near.withColumn("score", ratio("_t", "_e")).groupBy(term, "canonical").agg(F.max("score").alias("score"))
    ranked = top_per_key(scored, [term], [F.desc("score"), F.asc("canonical")], 2).groupBy(term).agg(F.max(F.struct("score", "canonical")).alias("best"), F.min("score").alias("next"), F.count("*").alias("n"))
    sure = ranked.where((F.col("best.score") >= least) & ((F.col("n") == 1) | (F.col("best.score") - F.col("next") >= margin)))
    return terms.join(sure.select(term, F.col("best.canonical").alias("canonical"), F.col("best.score").alias("score")), term, "left")


def related(names: DataFrame, name: str, stopwords: tuple[str, ...], most: int = 5) -> DataFrame:
    """name, other and shared: for each name the others that share most words, stopwords aside (top `most`)."""
    words = names.select(F.col(name).alias("name"), F.explode(F.array_except(F.array_distinct(F.split(taxonomy_key(F.col(name)), " ")), F.array(*[F.lit(s) for s in stopwords]))).alias("word")).distinct()
    pairs = words.join(words.select(F.col("name").alias("other"), "word"), "word").where("name != other")
    return top_per_key(pairs.groupBy("name", "other").agg(F.count("*").alias("shared")), ["name"], [F.desc("shared"), F.asc("other")], most)


def candidates(terms: DataFrame, term: str, id_column: str, source: str, at: str, samples: int = 10) -> DataFrame:
    """One row for each term identity: the first spelling, how often it occurs, its sources, sample ids, first and last time.

    Samples are kept by rank in partial groups, so a common term's ids are never gathered whole.
    """
    keyed = terms.select(identity_key(F.col(term)).alias("identity"), F.col(term).alias("term"), F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(at).alias("at")).where("identity != ''")
    totals = keyed.groupBy("identity").agg(F.min_by("term", F.struct("at", "id", "term")).alias("term"), F.count("*").alias("occurrences"), F.countDistinct("source").alias("sources"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    kept = top_per_key(keyed.select("identity", "id").distinct(), ["identity"], [F.asc("id")], samples)
    return totals.join(kept.groupBy("identity").agg(F.array_sort(F.collect_list("id")).alias("sample_ids")), "identity")


def first_rule_wins(df: DataFrame, rules: DataFrame, key: str, id_column: str) -> DataFrame:
    """id and category by the lowest ranked rule (rank, word, category) with a word of the key."""
    words = df.select(id_column, F.explode(F.array_distinct(F.split(taxonomy_key(F.col(key)), " "))).alias("word"))
    hits = words.join(rules, "word").groupBy(id_column).agg(F.min_by("category", "rank").alias("category"))
    return df.join(hits, id_column, "left")


# Shapes and words that no skill's name has, in the order in which they are tried.
NOISE_SHAPES = {
    "address": r"@|http|\b[a-z0-9-]+\.(?:com|net|org|io)\b",
    "line_break": r"[\n\r]",
    "bullet": "^[•●▪⦁]",
    "non_breaking_space": "\u00a0",
    "number": r"^(?:\d+(?:\.\d+)?x?|\d+\+?\s*(?:y|yr|yrs|years?))$",
    "state_and_zip": r"\b[a-z]{2}\s+\d{5}(?:-\d{4})?\b",
    "sentence_start": r"^(?:(?:working )?knowledge of|experience (?:applying|with|in)|bachelor(?:'s|’s)? degree|company locations?|looking for|be able to|day to day job duties)\b|^industries?\s*:",
    "table_row": r"^\d{1,3}\s+[a-z]{1,4}\s+.+\d+\+?y\s+(?:remote|onsite|hybrid)\b",
    "verb_start": r"^(?:drive|validate|review|build|create|ensure|develop|manage|improve|support|provide|maintain|coordinate|design|implement|conduct|perform|monitor|assist|lead|work|collaborate|deliver|analyze|analyse|troubleshoot|configure|deploy|write|document|partner|engage|own|define|establish|execute|oversee|install|validated?|tracks?|documents?|follows?|managing|evaluate|remain)\b",
}
LEADING_WORDS = ("and", "or", "if", "with", "including", "particularly", "prior", "strong", "high", "good", "great", "excellent", "solid", "proven", "please", "must", "should", "will", "can", "may", "need", "needs", "ability", "sense", "the", "a", "an", "this", "that", "not", "no", "you", "your", "we", "our", "conduct", "coordinate", "create", "review", "build", "ensure", "develop", "manage", "improve", "support", "provide", "maintain", "design", "implement", "perform", "monitor", "assist", "lead", "work", "collaborate", "drive", "validate", "works", "leads", "helps", "help", "based")
TRAILING_WORDS = ("and", "or", "if", "with", "the", "a", "an", "is", "are", "not", "of", "to", "for", "in", "on", "at", "by")
FILLER_WORDS = ("and", "or", "if", "is", "are", "was", "were", "not", "with", "the", "a", "an", "particularly", "including", "include", "prior", "strong", "high", "sense", "of", "ability", "to", "for", "as", "in", "on", "at", "by", "this", "that", "these", "those", "please", "must", "should", "will", "can", "may", "need", "needs", "needed", "have", "has", "had", "experience", "requires", "required", "preferred", "good", "great", "excellent", "solid", "proven", "demonstrated", "years", "year", "prefer", "presence", "present", "highly", "very", "also", "etc", "such", "like")


def noise_reason(term: Column) -> Column:
    """Why a term can't be a skill's name; null if it may be. Names of persons aren't told."""
    words = F.filter(F.split(F.lower(term), r"[^a-z0-9+#.'-]+"), lambda w: w.rlike("^[a-z]"))
    found = [F.when(F.lower(term).rlike(pattern), F.lit(name)) for name, pattern in NOISE_SHAPES.items()]
    unbalanced = F.length(F.regexp_replace(term, "[^(]", "")) != F.length(F.regexp_replace(term, "[^)]", ""))
    edge = F.get(words, F.lit(0)).isin(*LEADING_WORDS) | F.get(words, F.size(words) - 1).isin(*TRAILING_WORDS)
    fillers = F.size(F.filter(words, lambda w: w.isin(*FILLER_WORDS)))
    filled = (fillers >= 2) | ((fillers >= 1) & (F.size(words) <= 3))
    counted = F.when((F.size(words) == 0) | (F.size(words) > 5), F.lit("word_count"))
    return F.coalesce(*found, F.when(unbalanced, F.lit("parentheses")), counted, F.when(edge, F.lit("edge_word")), F.when(filled, F.lit("filler_words")))
