"""tierline: a Spark-native bronze -> silver -> gold, feature and model library.

Every operator is a function from DataFrames to a DataFrame, expressed with
built-in Spark SQL / DataFrame operators so Catalyst can prune, push down and
plan the shuffles.  ``tierline.plans`` registers the concrete queries that run
over the driver tables.
"""

from tierline.session import build_session, scratch_path, checkpoint_root

__all__ = ["build_session", "scratch_path", "checkpoint_root"]
