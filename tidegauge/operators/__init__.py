"""Operators on event tables, segments, sampled series and spectra."""
