"""Writers. None overwrites its input; all go to a path of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def metrics(df: DataFrame, path: str, by: str = "dataset", kind: str = "parquet") -> None:
    """The metric table, a folder per dataset."""
    w = df.write.partitionBy(by) if by in df.columns else df.write
    w.option("header", True).format(kind).save(path)


def small_csv(df: DataFrame, path: str) -> None:
    """A result table of a few rows as one CSV file."""
    df.repartition(1).write.csv(path, header=True)  # what makes the rows keeps its tasks


def jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def per_document(df: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """A folder per document with its text."""
    df.select(F.col(id_col).alias("doc"), F.col(text_col)).write.partitionBy("doc").text(path)


def annotation_template(df: DataFrame, path: str, rater: str = "", id_col: str = "id", text_col: str = "text") -> None:
    blank = {c: F.lit("") for c in ("sentiment", "emotion", "attachment", "notes")}
    small_csv(df.select(F.col(id_col).alias("id"), F.substring(text_col, 1, 2000).alias("text"), F.lit(rater).alias("rater_name")).withColumns(blank), path)


def latex(rows: Sequence[Row], caption: str) -> str:
    """Rows of a small collected result as a LaTeX table."""
    if not rows:
        return ""
    cols = list(rows[0].asDict())
    esc = lambda v: ("" if v is None else str(v)).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = "\n".join(" & ".join(esc(r[c]) for c in cols) + r" \\" for r in rows)
    return f"\\begin{{table}}\n\\caption{{{esc(caption)}}}\n\\begin{{tabular}}{{{'l' * len(cols)}}}\n{' & '.join(map(esc, cols))} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"


def report(sections: dict[str, Sequence[Row]]) -> str:
    """Titled sections of small collected results as plain text."""
    out = []
    for title, rows in sections.items():
        out += [title, "=" * len(title), *("  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows), ""]
    return "\n".join(out)


def html(sections: dict[str, Sequence[Row]], title: str) -> str:
    """The same as one HTML page."""
    from html import escape

    def table(rows):
        if not rows:
            return "<p>no rows</p>"
        cols = list(rows[0].asDict())
        head = "".join(f"<th>{escape(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if r[c] is None else str(r[c]))}</td>" for c in cols) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>" + "".join(f"<h2>{escape(k)}</h2>{table(v)}" for k, v in sections.items()) + "</body></html>"
