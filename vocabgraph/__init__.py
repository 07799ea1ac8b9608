"""Knowledge-graph queries and large-scale data preparation over vocabulary tables, as Spark plans."""

import sys

from pyspark import cloudpickle

# executors need not have the package installed: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def __getattr__(name: str):
    from importlib import import_module

    api = import_module(f"{__name__}.api")
    if name in api.__all__:
        return getattr(api, name)
    raise AttributeError(name)
