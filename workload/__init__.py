"""The registered queries: every operator over the given tables, beside its SQL.

Each module holds `QUERIES` (name -> function of session and folder) and `SQL` (name ->
the same result in SQL).  Messy text, requests and responses are derived from the tables,
so they grow with them.
"""


def modules():
    from workload import audits, requests, series, tables

    return [tables, series, requests, audits]
