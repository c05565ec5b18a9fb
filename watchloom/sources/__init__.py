"""Readers, writers, envelope decoding and table generators."""
