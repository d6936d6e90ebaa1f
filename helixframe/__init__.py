"""A PySpark engine that finds DNA polymorphisms in short reads, with training-data operators beside it."""
