"""The codec of log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS


def level_code(level: Column) -> Column:
    """The code of a level's name, case-sensitive; null for other names."""
    code = F.lit(None).cast("int")
    for i, name in enumerate(LEVELS):
        code = F.when(level == name, i).otherwise(code)
    return code


def level_name(code: Column) -> Column:
    """The name of a level's code; another code is an error."""
    names = F.array(*map(F.lit, LEVELS))
    return F.when(code.between(0, len(LEVELS) - 1), F.get(names, code)).when(code.isNotNull(), F.raise_error(F.concat(F.lit("unknown level code "), code.cast("string"))).cast("string"))
