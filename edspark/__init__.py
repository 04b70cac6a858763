"""edspark: emergency-department analytics as Spark DataFrame operators.

Every public operator is ``DataFrame -> DataFrame`` (or ``Column -> Column``
for the rule helpers in :mod:`edspark.functions`).  Nothing here collects data
to the driver; the only driver-side values are fixed code tables and
parameters.
"""

from edspark.session import get_spark, scratch_dir  # noqa: F401

__all__ = ["get_spark", "scratch_dir"]
