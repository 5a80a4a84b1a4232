"""Complete reports put together from the operators."""
