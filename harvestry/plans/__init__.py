"""Query plans: the recipe compiler and the catalogue of registered queries."""
