from __future__ import annotations


def documents(spark, rows):
    """Documents as the tables have them, from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
