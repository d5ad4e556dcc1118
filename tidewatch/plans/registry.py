"""Registration of the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.views import Views
from tidewatch.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a function of the sample views under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Views(tune(spark), sf_dir))

    QUERIES[build.__name__] = run
    return build
