"""Stage jobs and the catalogue of named queries."""
