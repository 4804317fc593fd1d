"""Graph analytics, graph layout and training-data operators on Spark."""
