"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tapevigil
from tapevigil.plans.views import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once."""
    context = spark.sparkContext
    if getattr(context, "tapevigil_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(tapevigil.__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="run-package-", dir="/tmp"), "tapevigil")
    context.addPyFile(shutil.make_archive(base, "zip", root, "tapevigil"))
    context.tapevigil_shipped = True


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under `name`, with equivalent SQL when there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # HotSpot never compiles longer methods; such stages then run operator by operator.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return rounded(fn(spark, sf), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from tapevigil.plans import (  # noqa: F401
        alert_queries,
        chain_queries,
        feature_queries,
        market_queries,
        series_queries,
        social_queries,
        stream_queries,
    )
