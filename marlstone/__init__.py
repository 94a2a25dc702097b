"""marlstone: Spark jobs for document retrieval, answer ledgers, evaluation and training-data preparation."""
