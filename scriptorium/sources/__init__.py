"""Sources and sinks: tables, listings, Markdown and JSON files, a paged works source, chunk and index stores."""
