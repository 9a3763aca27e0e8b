"""stringloom: strings, indicators and corpus preparation as Spark plans."""
