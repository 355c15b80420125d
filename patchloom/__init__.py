"""patchloom: template-edit analytics expressed as Spark DataFrame transformations."""
