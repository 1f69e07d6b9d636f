"""gridmine: table-corpus analytics expressed as PySpark DataFrame operators.

Layout
    functions/  Column -> Column building blocks (predicates, text, units, vectors, ...)
    operators/  DataFrame -> DataFrame building blocks (unnest, joins, ordering, ...)
    sources/    readers and writers
    plans/      composed user-level queries (similarity search, corpora, labelled sets)
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
