"""Queries over the driver's tables, one or more for each operator family."""


def registry():
    """(queries, sql, decorator): the decorator registers a function of (spark, sf_dir) under its name with its SQL twin."""
    found, sql = {}, {}

    def query(twin: str | None = None):
        def add(f):
            found[f.__name__] = f
            if twin:
                sql[f.__name__] = twin
            return f

        return add

    return found, sql, query
