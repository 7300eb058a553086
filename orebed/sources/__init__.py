"""Readers and writers of the data sets that the operators work on."""
