"""Training-data operators over procurement report texts, and their queries.

A report is a row with a ``procurement_id`` of any type and its ``report_text``.
Nothing else in the library imports this subpackage.
"""
