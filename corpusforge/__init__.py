"""corpusforge: parallel-corpus preparation and MT evaluation on Spark.

Every operator takes DataFrames and returns DataFrames; only the plans in
``corpusforge.plans`` and the writers trigger actions.
"""

__version__ = "0.1.0"
