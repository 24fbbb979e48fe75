"""Timed-transcript and content-feed analytics as plain PySpark DataFrame functions."""

from pyspark.cloudpickle import register_pickle_by_value as _by_value

import wordloom as _self

_by_value(_self)  # functions sent to Python workers carry their code; workers need no install
