"""cohortflow: survival-cohort cleaning, synthesis and quality scoring on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (plus small ``fit_*``
functions that return parameter DataFrames). Nothing row-sized is collected to
the driver; only parameter tables (columns x at most a few thousand values)
are brought back where a later expression needs them as literals.
"""

from cohortflow.schema import SurvivalSchema

__all__ = ["SurvivalSchema"]
