"""Extension: conversions of a stream of inputs with the batch operators."""
