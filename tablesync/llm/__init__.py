"""Operators for preparing training text; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle


def ships(name: str) -> None:
    """Send the functions of this module to the workers with their code; they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
