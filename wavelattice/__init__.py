"""wavelattice: time-series graph analytics and large-scale series preparation on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` transform.  Nothing here
imports the optional ``llm`` subpackage.
"""

__version__ = "0.1.0"
