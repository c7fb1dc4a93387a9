"""DataFrame operators: derivation steps, periods, lineage, the dictionary, retrieval and jobs."""
