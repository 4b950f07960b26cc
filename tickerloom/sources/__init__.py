"""Readers and writers: flat files, frame captures, configuration, stored tables."""
