"""Readers and writers for sequencing file formats."""
