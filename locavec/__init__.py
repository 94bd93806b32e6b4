"""Located-vector analytics as Spark DataFrame operators.

``functions``  column expressions and batch encoders
``sources``    readers, writers and the dataset catalogue
``operators``  cleaning, folds, joins, statistics, models, summaries
``plans``      multi-step jobs built from the operators
``streaming``  the row-wise operators on a streaming DataFrame
``registry``   the named queries used by the correctness check and the benchmark
"""

__version__ = "0.1.0"
