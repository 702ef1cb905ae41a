"""A small strict relational engine on Spark: SQL front end, DataFrame operators, durable store."""
