"""Ready-made pipelines put together from the operators."""
