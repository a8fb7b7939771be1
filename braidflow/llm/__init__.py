"""Operators of a training-data pipeline: extraction, scans, scoring, near duplicates,
decontamination, mixing and binary output. Nothing else in the library imports this
subpackage; ``queries.py`` registers its queries."""
