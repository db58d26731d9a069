"""A PySpark engine for curating labelled corpora and evaluating classifiers."""
