"""Training-data operators: one module for each, and the queries over them in ``queries``."""
