"""quern: model pre- and postprocessing, and training-data operators, as lazy Spark DataFrame transformations."""
