"""Document-page analytics on Spark: page geometry, line text, evaluation and training-data operators as DataFrame plans."""
