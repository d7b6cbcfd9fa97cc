"""DataFrame -> DataFrame steps of the pipeline."""
