"""Views over the benchmark tables and the catalogue of registered queries."""
