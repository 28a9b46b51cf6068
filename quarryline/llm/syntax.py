"""Source files that do not parse (problem 2).

The bundled grammar of the language that the path's suffix names is compiled
into an LR table once per process; each file is cut into tokens and recognised
in full, and the first token after which no reading survives is reported.

Defined results: null and blank contents are accepted, paths of other suffixes
give no row, repeated rows of one id give one result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

from .parsers import LANGUAGE_OF_SUFFIX

_SUFFIX = r"(?i)\.({})$".format("|".join(LANGUAGE_OF_SUFFIX))


def grammar_language(path: Column) -> Column:
    """The bundled grammar a path's suffix stands for, null for others."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF_SUFFIX.items() for x in kv])
    return F.when(path.rlike(_SUFFIX), names[F.lower(F.regexp_extract(path, _SUFFIX, 1))])


def first_errors(df: DataFrame, *, path: str = "relative_path", text: str = "content", out: str = "syntax") -> DataFrame:
    """The rows of parseable suffixes with a struct (language, line, token): the first error, null if there is none."""

    @arrow_udf("struct<line:long,token:string>")
    def check(g: pd.Series, t: pd.Series) -> pd.DataFrame:
        from .parsers import first_error

        rows = [first_error(a, b) or (None, None) for a, b in zip(g, t)]
        return pd.DataFrame({"line": pd.array([r[0] for r in rows], dtype="Int64"), "token": [r[1] for r in rows]})

    g = grammar_language(F.col(path))
    found = df.where(g.isNotNull()).withColumn("__syntax", check(g, F.col(text)))
    return found.withColumn(out, F.struct(g.alias("language"), F.col("__syntax.line").alias("line"), F.col("__syntax.token").alias("token"))).drop("__syntax")
