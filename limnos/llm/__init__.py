"""Training-data pipeline operators; nothing outside this subpackage imports it but ``__spark_entry__``."""
