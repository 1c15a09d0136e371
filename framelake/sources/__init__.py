"""Python data sources and sinks for containers and index files."""
