"""tellsift: find the sentences of a filing that tell of an event, on Spark."""
