"""Operators that prepare training data from the gate's enriched records.

A record is a row of ``enriched_records``: ``job_id`` (any orderable type) and ``cleaned_text``.
Nothing else in the package imports from here.
"""
