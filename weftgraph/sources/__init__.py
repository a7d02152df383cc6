"""Readers: tables, documents, conversations, relational sources."""
