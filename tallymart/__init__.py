"""tallymart: multi-tenant commerce analytics as Spark jobs."""
