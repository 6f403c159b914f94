"""Seller-portfolio analytics as Spark DataFrame operators.

Layers:
  sources    logical input schemas, loaders, test-data bindings, sinks
  functions  column helpers: exact ratios, date windows, fixed label maps, calendar
  operators  marts (order-line facts -> seller x day/month/item) and the
             period/scope measures and report tables built on them
  plans      registered query plans, the daily bundle, size-checked broadcast
  streaming  incremental (available-now) refresh of the daily marts
"""

from sellerlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
