"""wayfold: DataFrame operators for observation streams and the labelled data sets built from them."""

__version__ = "0.1.0"
