"""Readers and writers: file trees, captured event streams, suites, chunk stores."""
