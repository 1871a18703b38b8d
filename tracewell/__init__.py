"""Evidence analytics on PySpark: facts, graphs, search, deltas and guarded SQL as DataFrame operators."""
