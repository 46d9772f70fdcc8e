"""DataFrame-to-DataFrame operators; parameters are column names, never table names."""
