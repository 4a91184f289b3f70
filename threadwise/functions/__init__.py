"""Column-level building blocks: portable regex classes and text normalisation."""
