def rows(df, *columns):
    """The rows of a result as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda t: [(v is None, str(type(v)), v) for v in t])
