"""lacuna: scan-coverage analytics on Spark.

Every public operator is ``DataFrame -> DataFrame``; the plans stay lazy and
Catalyst chooses the physical strategy.
"""
