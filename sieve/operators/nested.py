"""Completeness inside nested values: structs, arrays, maps and JSON texts.

A nested type is unfolded into paths: ``a.b`` for a field of a struct, ``a[]`` for the elements of an array, ``a{}`` for the values of a
map, and so on inwards. Each path is an expression that gives an array of flags for a row (one for each value the path leads to: is it
missing?), so that all paths of a table are counted in one aggregate over one scan, with nothing exploded.

What counts: a field of a null struct is missing; a null array or map is missing itself and has no elements; an empty one is there.
Strings may be asked not to be empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.operators.base import Outcome, row_check
from sieve.operators.duplicates import free_name

Flags = Callable[[Column], Column]


def _unfold(kind: T.DataType, empty: bool) -> Iterator[tuple[str, Flags]]:
    """(path from here, value -> array of flags)."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            for path, flags in _unfold(f.dataType, empty):
                yield f".{f.name}{path}", lambda c, n=f.name, flags=flags: flags(c.getField(n))
        return
    if isinstance(kind, (T.ArrayType, T.MapType)):
        yield "", lambda c: F.array(c.isNull())
        mark, inner = ("[]", kind.elementType) if isinstance(kind, T.ArrayType) else ("{}", kind.valueType)
        values = (lambda c: c) if mark == "[]" else F.map_values
        for path, flags in _unfold(inner, empty):
            yield f"{mark}{path}", lambda c, flags=flags, values=values: F.coalesce(
                F.flatten(F.transform(values(c), lambda x: flags(x))), F.array().cast("array<boolean>"))
        return
    blank = empty and isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
    yield "", lambda c: F.array(c.isNull() | (F.coalesce(c == "", F.lit(False)) if blank else F.lit(False)))


def paths(df: DataFrame, columns: list[str], check_empty_strings: bool = True, wanted: list[str] | None = None) -> dict[str, Column]:
    """Path -> its flags, in the order of the schema. ``wanted`` keeps some of them; one that does not exist is an error."""
    found = {f"{c}{path}": flags(F.col(c)) for c in columns for path, flags in _unfold(df.schema[c].dataType, check_empty_strings)}
    if wanted is None:
        return found
    if unknown := [p for p in wanted if p not in found]:
        raise ValueError(f"no path {', '.join(unknown)}; there are {', '.join(found)}")
    return {p: found[p] for p in wanted}


def _missing(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def path_counts(df: DataFrame, columns: list[str], check_empty_strings: bool = True, wanted: list[str] | None = None) -> DataFrame:
    """Per path: ``path``, ``total_values``, ``missing_values`` and ``missing_percentage`` (null where there are no values)."""
    found = paths(df, columns, check_empty_strings, wanted)
    aggs = []
    for i, flags in enumerate(found.values()):
        aggs += [F.coalesce(F.sum(F.size(flags)), F.lit(0)).cast("bigint").alias(f"t{i}"), F.coalesce(F.sum(_missing(flags)), F.lit(0)).cast("bigint").alias(f"m{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"t{i}").alias("total_values"), F.col(f"m{i}").alias("missing_values"))
                               for i, p in enumerate(found)]))
    rows = df.agg(*aggs).select(each.alias("p")).select("p.*")
    share = F.when(F.col("total_values") > 0, F.round(F.col("missing_values").cast("double") / F.col("total_values") * 100, 4))
    return rows.withColumn("missing_percentage", share)


def nested_completeness(df: DataFrame, columns: list[str], wanted: list[str] | None = None, check_empty_strings: bool = True) -> Outcome:
    """Rows with a missing value on any path. Violations have ``missing_paths``: an array of (path, positions), the positions being those
    of the missing values among all the path leads to in the row (0 for a path without arrays or maps). A row predicate, so a
    suite counts it in the table's one scan."""
    found = paths(df, columns, check_empty_strings, wanted)
    any_missing = reduce(or_, [F.exists(flags, lambda x: x) for flags in found.values()])
    listed = []
    for path, flags in found.items():
        places = F.array_compact(F.transform(flags, lambda x, i: F.when(x, i)))
        listed.append(F.when(F.size(places) > 0, F.struct(F.lit(path).alias("path"), places.alias("positions"))))
    return row_check(df, any_missing, metadata={"columns_checked": list(columns), "paths": list(found), "check_empty_strings": check_empty_strings},
                     annotate={free_name(df, "missing_paths"): F.array_compact(F.array(*listed))})


def json_schema(df: DataFrame, column: str) -> T.StructType | None:
    """The type all JSON texts of a column fit into, from one pass over them; None if none of them is an object."""
    name = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
    kind = T._parse_datatype_string(name.replace("OBJECT<", "STRUCT<")) if name and name.startswith("OBJECT<") else None
    return kind if isinstance(kind, T.StructType) else None


def parsed_json(df: DataFrame, column: str, schema: T.StructType, out: str) -> DataFrame:
    """``df`` with the struct ``out``; null where the text is null or no JSON."""
    return df.withColumn(out, F.when(F.try_parse_json(F.col(column)).isNotNull(), F.from_json(F.col(column), schema)))


def json_path_counts(df: DataFrame, column: str, schema: T.StructType | str | None = None, check_empty_strings: bool = True) -> DataFrame:
    """``path_counts`` of the JSON texts of a column, whose first row (path ``column`` itself) counts texts that are null or no JSON; the paths within
    count texts that are JSON. ``schema``: what to look for, by default what all texts hold together (a pass of its own)."""
    schema = json_schema(df, column) if schema is None else T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = F.col(column).cast("string")
    whole = F.try_parse_json(text)
    top = df.agg(F.count(F.lit(1)).cast("bigint").alias("t"), F.count_if(whole.isNull()).cast("bigint").alias("m"))
    top = top.select(F.lit(column).alias("path"), F.col("t").alias("total_values"), F.col("m").alias("missing_values"),
                     F.when(F.col("t") > 0, F.round(F.col("m").cast("double") / F.col("t") * 100, 4)).alias("missing_percentage"))
    if schema is None:
        return top
    rows = parsed_json(df.select(text.alias("__text")), "__text", schema, column).where(F.col(column).isNotNull()).select(column)
    return top.unionByName(path_counts(rows, [column], check_empty_strings))
