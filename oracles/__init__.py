"""Independent SQL for the registered queries, written for DuckDB over the driver's tables."""


def all_sql() -> dict[str, str]:
    from oracles import alerts, columns, reports, streams, tables

    return {**reports.SQL, **columns.SQL, **tables.SQL, **alerts.SQL, **streams.SQL}
