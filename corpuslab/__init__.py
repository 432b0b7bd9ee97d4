"""corpuslab: Spark-native analytics for text corpora and experiment run logs.

Every operator takes and returns DataFrames. Sub-packages:

* ``functions`` - column expressions (hash draws, scalar parsers, token arrays, vectors)
* ``sources``   - table scans and sinks
* ``operators`` - relational operators (text prep, sampling, joins, run logs, statistics,
  count language models, decoding, vectors, ranking)
* ``plans``     - derived views and the registered query catalogue
* ``streaming`` - Structured Streaming versions of the stateful operators
"""

from corpuslab.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
