"""chafe — review-friction analytics as Spark DataFrame dataflows.

Sub-packages:
  sources/    table loading, domain adapters, sinks
  functions/  column expressions (text cleaning, keys, lexicon scoring, p-values)
  operators/  DataFrame -> DataFrame operators (prep, aggregates, ranks, stats,
              distributions, topics, model scoring)
  plans/      the registered analysis queries over the driver tables
  streaming/  incremental scoring with Structured Streaming
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDF closures, so
    Python workers need not have ``chafe`` installed or on their path."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pyspark: ship with --py-files instead
        pass


_ship_by_value()
