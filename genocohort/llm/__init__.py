"""Training-data operators over a table of documents (doc_id, text, lang, source).

Nothing outside this subpackage imports it.  Functions that run inside Python
workers are pickled by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
