"""formloom: intake-form analytics as Spark DataFrame jobs."""
