def table(df):
    """Rows as a sorted list of dicts, for comparison."""
    return sorted((r.asDict() for r in df.collect()), key=lambda d: str(sorted(d.items(), key=lambda i: i[0])))


def same_rows(a, b, places=6):
    """Whether two frames hold the same rows, doubles to some places."""
    def rows(df):
        names = sorted(df.columns)
        return sorted(
            tuple(f"{r[n]:.{places}f}" if isinstance(r[n], float) else str(r[n]) for n in names) for r in df.collect()
        )
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
