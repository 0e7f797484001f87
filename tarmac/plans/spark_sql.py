"""The analyses as SQL text over the view ``airline_delays``.

For users who write SQL rather than DataFrame code: ``register(spark, df)``
the cleaned fact table, then ``run(spark, key)`` or ``spark.sql(statement(key))``
for any key of :data:`STATEMENTS`. ``register_functions(spark)`` adds the
library's scalar functions to the session as Spark SQL functions (month names,
seasons, parts of the day, routes, rounding); they are expanded into the
statement that calls them, so nothing leaves generated code.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from tarmac.plans import portable

VIEW = "airline_delays"
STATEMENTS = portable.STATEMENTS
FORMS = portable.FORMS


def statement(key: str) -> str:
    return portable.text((STATEMENTS | FORMS)[key])


def register(spark: SparkSession, flights: DataFrame, name: str = VIEW) -> None:
    flights.createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of this session; returns their names."""
    for name, parameters, result, body in portable.FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in portable.FUNCTIONS]


def run(spark: SparkSession, key: str) -> DataFrame:
    return spark.sql(statement(key))


_VIEW_LOCK = threading.Lock()


def sql_query(key: str):
    """Registered-query form: ``(spark, sf_dir) -> DataFrame`` over the cleaned table.

    ``spark.sql`` binds the view when it analyses the text, so registering
    and running under one lock keeps concurrent calls for different folders
    from seeing each other's table.
    """

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tarmac.sources.flights import prepare

        flights = prepare(spark, sf_dir).flights
        with _VIEW_LOCK:
            register(spark, flights)
            register_functions(spark)
            return run(spark, key)

    q.__name__ = f"sql_{key}"
    return q
