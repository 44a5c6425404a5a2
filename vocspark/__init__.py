"""vocspark — customer-feedback analytics as Spark DataFrame operators.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame. Nothing inside collects whole tables to the driver; the only
driver-side values are bounded config (lexicons, taxonomy) and scalar
subqueries over tables whose size is bounded by the number of categories or
months.
"""

from vocspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
