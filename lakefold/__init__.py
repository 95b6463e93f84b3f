"""lakefold: content extraction and file-lake analytics as plain Spark jobs.

``functions``  column expressions (no shuffle, no Python workers unless stated)
``sources``    file scans, container and stream readers, sinks
``operators``  DataFrame -> DataFrame operators (joins, windows, aggregates)
``streaming``  the event-log and ingest operators on Structured Streaming
``plans``      registered queries over the benchmark tables, with their SQL twins
"""

import sys

from pyspark import cloudpickle

# Ship the few Arrow helpers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
