"""Functions of the dialect, as builders of Spark columns."""
