"""Readers: parquet tables, page bodies, sitemaps, robots rules and links."""
