"""DataFrame operators: profiling, preparation, retrieval, corpus preparation."""
