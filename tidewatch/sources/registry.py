"""Named sources as plug-ins: a name, a type and a function that returns items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators.items import union_sources

Reader = Callable[[SparkSession, dict], DataFrame]


class SourceRegistry:
    """Readers by source name, with a fallback reader per source type."""

    def __init__(self) -> None:
        self._readers: dict[str, tuple[str, Reader]] = {}
        self._by_type: dict[str, Reader] = {}

    def register(self, name: str, source_type: str, reader: Reader) -> None:
        self._readers[name] = (source_type, reader)

    def register_type(self, source_type: str, reader: Reader) -> None:
        self._by_type[source_type] = reader

    def names(self) -> list[str]:
        return sorted(self._readers)

    def read(self, spark: SparkSession, name: str, config: dict | None = None) -> DataFrame | None:
        """Items of one source, or None when neither the name nor its type is known."""
        config = config or {}
        source_type, reader = self._readers.get(name, (config.get("type", "web"), None))
        reader = reader or self._by_type.get(source_type)
        if reader is None:
            return None
        return (reader(spark, config).withColumn("source_type", F.lit(source_type))
                .withColumn("source_name", F.lit(name)))

    def read_all(self, spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
        parts = [self.read(spark, name, config) for name, config in configs.items()]
        return union_sources(*[p for p in parts if p is not None])
