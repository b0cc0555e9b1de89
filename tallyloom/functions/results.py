"""Columns that hold a value or an error, and steps that pass errors on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.enums import ErrorCode

ERROR = "struct<code:string,message:string>"


def success(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast(ERROR).alias("error"))


def failure(message: Column | str, kind: str, code: str = ErrorCode.INVALID_TRANSACTION.value) -> Column:
    """An error in place of a value of Spark type kind."""
    told = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(None).cast(kind).alias("value"), F.struct(F.lit(code).alias("code"), told.alias("message")).alias("error"))


def checked(value: Column, kind: str, message: Column | str) -> Column:
    """The value, or an error where it is null."""
    return F.when(value.isNotNull(), success(value.cast(kind))).otherwise(failure(message, kind))


def then(result: Column, step: Callable[[Column], Column], kind: str) -> Column:
    """step, which gives a result of its own, over the value; an error stays what it was. kind is the type of step's value."""
    passed = F.struct(F.lit(None).cast(kind).alias("value"), result["error"].alias("error"))
    return F.when(result["error"].isNull(), step(result["value"])).otherwise(passed)


def mapped(result: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """f over the value; an error stays what it was."""
    return then(result, lambda v: success(f(v).cast(kind)), kind)


def value_or_raise(result: Column, kind: str) -> Column:
    """The value; an error ends the query with its message."""
    return F.when(result["error"].isNull(), result["value"]).otherwise(F.raise_error(result["error"]["message"]).cast(kind))
