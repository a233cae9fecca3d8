"""fathom: retrieval analytics as Spark plans."""
