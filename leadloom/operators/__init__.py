"""DataFrame -> DataFrame operators: classification, merging, threads, reports."""
