"""Training-data operators: one module per operator, `entries` has their registered queries."""
