"""linewise: analysis and cleaning of line-structured text as Spark DataFrame jobs."""
