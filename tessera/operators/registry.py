"""User functions beside the built-in enrichments and labeling functions.

A function has a name, typed inputs (columns of the table it is applied to) and a
declared result type, and is one of three kinds: a builder of a Column, a SQL
expression over its inputs, or an Arrow-vectorised function on pandas series (for what
the built-in functions cannot express). It is checked when it is registered, on an
empty table of its inputs: that needs the analyser only and runs no job. Afterwards it
is used by name, like a built-in one, in ``enrich`` and ``apply_lfs``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class UserFunction:
    """A registered function; ``build`` makes its column from those of the inputs."""
    name: str
    inputs: T.StructType
    returns: T.DataType
    build: Callable[[dict[str, Column]], Column]

    def column(self, df: DataFrame) -> Column:
        """The function over a table; its inputs must be there, in their declared types."""
        for field in self.inputs.fields:
            if field.name not in df.columns:
                raise ValueError(f"{self.name}: no column '{field.name}'")
            if df.schema[field.name].dataType != field.dataType:
                raise TypeError(f"{self.name}: column '{field.name}' is {df.schema[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}")
        return self.build({field.name: F.col(field.name) for field in self.inputs.fields}).alias(self.name)


class FunctionRegistry:
    """Named user functions. ``taken`` are names that are in use already."""

    def __init__(self, spark: SparkSession, taken: list[str] | None = None):
        self.spark = spark
        self.functions: dict[str, UserFunction] = {}
        self.taken = set(taken or [])

    def _add(self, name: str, inputs: str, returns: str, build: Callable[[dict[str, Column]], Column]) -> UserFunction:
        if not name.isidentifier():
            raise ValueError(f"'{name}' is no name")
        if name in self.functions or name in self.taken:
            raise ValueError(f"'{name}' is taken")
        made = UserFunction(name, T.StructType.fromDDL(inputs), T.StructType.fromDDL(f"r {returns}")[0].dataType, build)
        # the analyser finds unknown columns and functions, and the type
        found = self.spark.createDataFrame([], made.inputs).select(made.build({f.name: F.col(f.name) for f in made.inputs.fields}).alias("r")).schema[0].dataType
        if found != made.returns:
            raise TypeError(f"'{name}' gives {found.simpleString()}, not {made.returns.simpleString()}")
        self.functions[name] = made
        return made

    def column(self, name: str, inputs: str, returns: str, build: Callable[[dict[str, Column]], Column]) -> UserFunction:
        """Registers a builder that gets the input columns by name."""
        return self._add(name, inputs, returns, build)

    def sql(self, name: str, inputs: str, returns: str, expression: str) -> UserFunction:
        """Registers a SQL expression over the inputs' names."""
        return self._add(name, inputs, returns, lambda columns: F.expr(expression))

    def arrow(self, name: str, inputs: str, returns: str, function: Callable) -> UserFunction:
        """Registers a function of pandas series, one for each input in their order,
        that gives a series of as many values. Arrow converts to the declared type."""
        if not T.StructType.fromDDL(inputs).fields:
            raise ValueError(f"'{name}' needs an input")
        vectorised = F.pandas_udf(function, returns, F.PandasUDFType.SCALAR)
        return self._add(name, inputs, returns, lambda columns: vectorised(*columns.values()))

    def __contains__(self, name: str) -> bool:
        return name in self.functions

    def __getitem__(self, name: str) -> UserFunction:
        return self.functions[name]
