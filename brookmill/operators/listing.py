"""Lists and looks at single rows: sorts with nulls placed, ranked search, bounded lists, sets of an array and JSON objects."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions.fuzzy import ratio
from brookmill.functions.text import taxonomy_key


def sorted_list(df: DataFrame, *order: tuple[str, str]) -> list[Column]:
    """Order columns from (name, how): asc or desc, `_last` or `_first` for nulls, and `_fold` for text whatever its case."""
    out = []
    for name, how in order:
        column = F.lower(name) if how.endswith("_fold") else F.col(name)
        parts = how.removesuffix("_fold").split("_")
        place = parts[1] if len(parts) > 1 else ("last" if parts[0] == "asc" else "first")
        out.append(getattr(column, f"{parts[0]}_nulls_{place}")())
    return out


def search_rank(df: DataFrame, name: str, query: str, least: int = 75, most: int = 50) -> DataFrame:
    """The `most` names that fit a query best, with rank_score: 300 less the length where they start
    with it, 200 less the place where they hold it, else their likeness in percent (queries of four
    characters or more); under `least` they are left out. A cap of results is the feature.
    """
    wanted = df.sparkSession.range(1).select(taxonomy_key(F.lit(query)).alias("k")).first().k
    keyed = df.withColumn("_key", taxonomy_key(F.col(name)))
    likeness = F.floor(ratio(F.col("_key"), F.lit(wanted))).cast("int") if len(wanted) >= 4 else F.lit(0)
    score = F.when(F.col("_key").startswith(wanted), 300 - F.length("_key")).when(F.col("_key").contains(wanted), 201 - F.instr("_key", wanted)).otherwise(likeness)
    return keyed.withColumn("rank_score", score).drop("_key").where(F.col("rank_score") >= least).orderBy(F.desc("rank_score"), F.lower(name), name).limit(most)


def oldest_batch(df: DataFrame, touched: str, id_column: str, size: int) -> DataFrame:
    """The `size` rows that were touched longest ago, those never touched first. A bounded batch is the feature."""
    return df.orderBy(F.asc_nulls_first(touched), id_column).limit(size)


def united(*lists: Column) -> Column:
    """All values of several arrays, each once, in the order of their first place; nulls are empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, empty) for x in lists])))


def still_missing(requested: Column, extra: Column, filled: Column) -> Column:
    """What is requested, by either list, and not filled."""
    return F.array_except(united(requested, extra), F.coalesce(filled, F.array().cast("array<string>")))


def other_names(aliases: Column, more: Column, own: Column) -> Column:
    """All aliases but the own name, sorted."""
    return F.array_sort(F.array_remove(united(aliases, more), own))


def lacking(required: Column, granted: Column) -> Column:
    """Permissions that are required and not granted; `*` grants all."""
    granted = F.coalesce(granted, F.array().cast("array<string>"))
    return F.when(F.array_contains(granted, "*"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(required, granted)))


def folded_once(values: Column) -> Column:
    """An array without values that differ from an earlier one in case or outer space only, and without empty ones."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    return F.filter(kept, lambda v, i: F.array_position(F.transform(kept, lambda w: F.lower(w)), F.lower(v)) == i + 1)


def holds_any(records: Column, field: str, value: str) -> Column:
    """Whether the array `field` of any record holds the value; no for null records."""
    return F.coalesce(F.exists(records, lambda r: F.coalesce(F.array_contains(r[field], value), F.lit(False))), F.lit(False))


def least_confidence(records: Column, field: str = "parse_confidence") -> Column:
    """The least confidence of the records, a missing one being 0; 0 without records."""
    return F.coalesce(F.array_min(F.transform(records, lambda r: F.coalesce(r[field], F.lit(0.0)))), F.lit(0.0))


def json_length(x: Column) -> Column:
    """Items of a JSON array; 0 where there is none."""
    return F.coalesce(F.json_array_length(x), F.lit(0))


def json_kind(x: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; SQL null where it is none."""
    first = F.substring(F.trim(x), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(F.try_parse_json(x).isNotNull(), kind)


def merged(old: Column, new: Column) -> Column:
    """Two maps as one, in which a key of both has the new value."""
    empty = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def with_rest(df: DataFrame, fixed: list[str], rest: str = "detail") -> DataFrame:
    """The fixed columns, and all others of the row as one JSON object."""
    others = [c for c in df.columns if c not in fixed]
    return df.select(*fixed, F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias(rest))
