"""Readers (format dispatch, CSV sniffing, ARFF, headerless) and sinks."""
