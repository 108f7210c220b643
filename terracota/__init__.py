"""Property listing analytics on Spark: tables of stored advert pages in, typed listing tables out.

Functions that run inside tasks, and the objects of our own that they use, are pickled with their code, so executors need no copy of
the package: only the driver has it on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
