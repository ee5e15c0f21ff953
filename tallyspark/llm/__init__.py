"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Functions sent to executors are
pickled by reference when workers can import the package (its root is on
PYTHONPATH or is the working directory) and by value otherwise.
"""

import os

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_PLACES = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}

if os.path.realpath(_ROOT) not in _PLACES:
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
