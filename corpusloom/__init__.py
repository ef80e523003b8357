"""corpusloom: a Spark-native engine for preparing and analysing text corpora.

Every operator is a ``DataFrame -> DataFrame`` function.  The subpackage
``corpusloom.llm`` holds the operators for training data; nothing outside it
imports it.
"""

__version__ = "0.1.0"
