"""Event-log read models, temporal monitors, document cleaning, clause building and retrieval, as Spark plans."""
