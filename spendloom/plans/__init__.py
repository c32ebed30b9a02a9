"""End-to-end jobs: files in, tables out."""
