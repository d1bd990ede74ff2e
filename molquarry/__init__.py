"""molquarry: Spark-native analytics over molecule tables, embeddings and training corpora.

Sub-packages: ``functions`` (column expressions and the SMILES reader), ``operators`` (relational
operators as lazy DataFrame builders), ``sources`` (readers, writers, versioned snapshots),
``streaming`` (micro-batch centre libraries), ``plans`` (registered queries with their SQL) and the
optional ``llm`` (training-data operators, imported by nothing else).
"""

__version__ = "0.1.0"
