"""patchtrace: find copies of known-vulnerable code at corpus scale, as Spark jobs.

Layout
------
sources/    scans and sinks (feeds, source trees, vector files, reports)
functions/  column-expression helpers shared by the operators (regex classes, trims)
operators/  the DataFrame -> DataFrame operators (cve, diffs, verdict, extract, embed, match)
plans/      derived fixtures, the end-to-end composition and the query registry
streaming/  incremental and streamed use of the batch operators
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDFs and ``mapInPandas`` closures,
    so Python workers never need to import the package (no files to ship, no
    PYTHONPATH on executors)."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle without the hook
        pass


_ship_by_value()
