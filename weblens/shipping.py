"""Ships the package's Python code with each job, so executors need no installation."""

from pyspark import cloudpickle

import weblens


def ship_package() -> None:
    cloudpickle.register_pickle_by_value(weblens)
