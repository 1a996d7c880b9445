"""Where the names and aliases of a dictionary stand in raw texts.

An Aho-Corasick automaton over all phrases is built once a worker and reads each text once, so the
work grows with the texts and their hits, not with texts times phrases. A dictionary of more than
`block` phrases is dealt by hash into blocks, each an automaton of its own, so a worker's memory is
bounded; the texts are then read once a block. SQL has no function for this.
"""

import functools
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions.text import taxonomy_key

#: Phrases of one automaton.
BLOCK = 100_000
_ALNUM = frozenset(string.ascii_letters + string.digits)
#: Letters that match an ASCII letter whatever their case; lower-casing them would change a text's length.
_FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    out = text.translate(_FOLDED).lower()
    return out if len(out) == len(text) else "".join(c.lower()[:1] for c in text.translate(_FOLDED))


def phrases(dictionary: DataFrame) -> DataFrame:
    """phrase, canonical and kind to look for: of spellings that differ in marks or case alone the longest, then a canonical one, then the smallest."""
    o = F.when(F.col("kind") == "canonical", 0).otherwise(1)
    best = F.min(F.struct((-F.length("phrase")).alias("n"), o.alias("o"), "phrase", "kind")).alias("b")
    named = dictionary.select(F.trim("alias").alias("phrase"), "canonical", "kind").where("phrase != '' and canonical is not null")
    return named.groupBy(taxonomy_key(F.col("phrase")).alias("_key"), "canonical").agg(best).select("b.phrase", "canonical", "b.kind")


@functools.lru_cache(maxsize=4)
def _automaton(entries: tuple[tuple[str, str, str], ...]) -> ahocorasick.Automaton:
    named: dict[str, dict[str, str]] = defaultdict(dict)
    for phrase, canonical, kind in entries:
        own = named[folded(phrase)]
        if own.get(canonical) != "canonical":
            own[canonical] = kind
    made = ahocorasick.Automaton()
    for phrase, own in named.items():
        made.add_word(phrase, (phrase, sorted(own.items())))
    made.make_automaton()
    return made


def places_in(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, str, int, int]]:
    """canonical, kind, start and end of every phrase that no letter or digit touches; places of one phrase don't overlap."""
    low = folded(text)
    past: dict[str, int] = {}
    for last, (phrase, own) in automaton.iter(low):
        end = last + 1
        start = end - len(phrase)
        if start >= past.get(phrase, 0) and not (start and low[start - 1] in _ALNUM) and not (end < len(low) and low[end] in _ALNUM):
            past[phrase] = end
            for canonical, kind in own:
                yield canonical, kind, start, end


def term_places(df: DataFrame, dictionary: DataFrame, id_column: str, text: str, block: int = BLOCK) -> DataFrame:
    """id, raw_text, canonical, kind, start and end (in characters from 0) of every place of every phrase of the dictionary (alias, canonical, kind).

    Case is ignored; no letter or digit may touch a phrase. Places of different phrases may overlap.
    """
    wanted = phrases(dictionary).collect()  # the dictionary is the stated side; its blocks travel with the tasks
    blocks = max(1, -(-len(wanted) // block))
    dealt: dict[int, list] = defaultdict(list)
    # by the folded spelling, so that the names that share one stay together
    for r in wanted:
        dealt[hash_of(folded(r.phrase)) % blocks].append((r.phrase, r.canonical, r.kind))
    fields = [T.StructField("raw_text", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), *fields])
    rows = df.select(F.col(id_column), F.col(text).cast("string").alias("_text")).where("_text != ''")

    def reader(entries: tuple[tuple[str, str, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = _automaton(entries)
            for batch in batches:
                at, found = [], []
                for k, t in enumerate(batch.column("_text").to_pylist()):
                    own = [(t[p[2] : p[3]], *p) for p in places_in(t, made)]
                    at += [k] * len(own)
                    found += own
                columns = [list(c) for c in zip(*found)] or [[]] * len(fields)
                values = [pa.array(c, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for c, f in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(at, pa.int64())), *values], schema.names)

        return run

    made = [rows.mapInArrow(reader(tuple(sorted(e))), schema) for e in dealt.values()]
    return functools.reduce(DataFrame.unionByName, made) if made else df.sparkSession.createDataFrame([], schema)


def hash_of(text: str) -> int:
    """The same number in every process."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def best_places(places: DataFrame, id_column: str) -> DataFrame:
    """Of each id and canonical name one place: the first of a canonical spelling, else the first."""
    o = F.when(F.col("kind") == "canonical", 0).otherwise(1)
    best = F.min(F.struct(o.alias("o"), "start", "end", "kind", "raw_text")).alias("b")
    return places.groupBy(id_column, "canonical").agg(best).select(id_column, "canonical", "b.raw_text", "b.kind", "b.start", "b.end")
