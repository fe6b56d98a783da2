"""factloom: evidence-grounded curation pipelines as Spark DataFrame plans."""
