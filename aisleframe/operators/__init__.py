"""DataFrame-to-DataFrame operators: cleaning, features, marts, market structure, models."""
