"""Training-data operators: ten corpus operators used by the pipeline and the ``opN_*`` queries."""
