"""Landed-file readers, source-field mappers, schemas and sinks."""
