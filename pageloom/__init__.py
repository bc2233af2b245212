"""pageloom: web pages and semi-structured payloads to clean tables, on Spark."""
