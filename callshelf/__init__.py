"""callshelf: a deduplicated shelf of Python callables, built as Spark jobs.

Source files come in as a DataFrame (or are listed from folders), callables are
extracted, checked and identified, and two catalog tables (``codes`` and
``metadata``) are kept up to date, in batch or as a stream.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Worker functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
