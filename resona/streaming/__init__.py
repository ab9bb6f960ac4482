"""The shuffle-free scoring stages on a stream of landed thread pages."""
