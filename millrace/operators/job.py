"""Jobs: one map and one reduce step, with the sink at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.sources.sinks import write_text

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Job:
    """``mapper`` turns input rows into records, ``reducer`` folds them. Both only declare a plan."""

    mapper: Step
    reducer: Step

    def run_simple(self, source: DataFrame) -> DataFrame:
        """Map and reduce share one record type; raises TypeError if they don't."""
        mapped = self.mapper(source)
        reduced = self.reducer(mapped)
        kinds = [[f.dataType for f in df.schema.fields] for df in (mapped, reduced)]
        if kinds[0] != kinds[1]:
            raise TypeError(f"a simple job reduces {kinds[0]} to the same type, not {kinds[1]}")
        return reduced

    def run_complete(self, source: DataFrame) -> DataFrame:
        """The reducer's records have a type of their own."""
        return self.reducer(self.mapper(source))

    def run_to_text(self, source: DataFrame, path: str, gather: bool = True) -> None:
        write_text(self.run_complete(source), path, gather)
