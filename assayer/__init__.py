"""A Spark engine that inspects fleets of model artifacts before anything is loaded or executed."""
