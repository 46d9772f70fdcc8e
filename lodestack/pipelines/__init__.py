"""The three dataset pipelines as plans over the operators, and their command line."""
