"""Report feeds and markup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.safe import f_beta
from boolsieve.operators import analytics


def derived(results: DataFrame) -> DataFrame:
    """Result rows with F1, F3, F50, the group by number of positives, and the number of operators.

    The operators of the size record must be those of the string, NOT aside; a row where they are not is an error.
    """
    p, r = F.col("pubmed_precision"), F.col("pubmed_recall")
    size = F.col("query_size")
    words = lambda w: F.size(F.regexp_extract_all("pubmed_query", F.lit(rf"(?<![A-Za-z]){w}(?![A-Za-z])"), 0))
    ors = size["ORs"] + size["added_ORs"] + size["synonym_ORs"]
    total = words("AND") + words("OR") + words("NOT")
    checked = F.when((words("AND") == size["ANDs"]) & (words("OR") == ors) & (words("NOT") == size["NOTs"]), total).otherwise(F.raise_error(F.lit("a query's size is not that of its string")).cast("int"))
    out = results.withColumns({"f1": f_beta(p, r, 1), "f3": f_beta(p, r, 3), "f50": f_beta(p, r, 50)})
    return out.withColumn("num_positive_bucket", F.when(F.col("num_positive") < 50, "<50").otherwise(">=50")).withColumn("logical_operators", checked)


def result_table(results: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean, deviation and count of the measures by group, and for all."""
    return analytics.group_stats(results, by, measures)


#: Rows that a table may have; a report with more must be cut or aggregated first.
TABLE_ROWS = 1000


def markup_table(rows: DataFrame, columns: list[str], best: dict[str, str] | None = None, digits: int = 4) -> str:
    """A table in Markdown of all of a report's rows; ``best`` names columns whose "max" or "min" is set bold.

    Raises ValueError if there are more than TABLE_ROWS.
    """
    data = [r.asDict() for r in rows.select(*columns).limit(TABLE_ROWS + 1).collect()]
    if len(data) > TABLE_ROWS:
        raise ValueError(f"more than {TABLE_ROWS} rows for a table")
    tops = {c: (max if how == "max" else min)(r[c] for r in data if r[c] is not None) for c, how in (best or {}).items() if any(r[c] is not None for r in data)}

    def show(c: str, v: object) -> str:
        text = "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
        return f"**{text}**" if c in tops and v == tops[c] else text

    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(show(c, r[c]) for c in columns) + " |" for r in data]])


def highlight(query: str, words: set[str], mark: str = "**") -> str:
    """A query with some of its terms marked."""
    import re

    return re.sub(r"[A-Za-z0-9-]+", lambda m: f"{mark}{m[0]}{mark}" if m[0] in words else m[0], query)


#: What LaTeX reads as its own, and how it is written.
LATEX_MARKS = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(query: str, strong: set[str] | None = None, colours: dict[str, str] | None = None) -> str:
    """A query in LaTeX: its own marks escaped, some words (operators by default) bold, some in a colour."""
    import re

    strong = {"AND", "OR", "NOT"} if strong is None else strong

    def one(word: str) -> str:
        text = "".join(LATEX_MARKS.get(c, c) for c in word)
        text = rf"\textcolor{{{colours[word]}}}{{{text}}}" if colours and word in colours else text
        return rf"\textbf{{{text}}}" if word in strong else text

    return re.sub(r"[A-Za-z0-9-]+|[^A-Za-z0-9\s-]", lambda m: one(m[0]), query)


def outer_operators(query: str, mark: str = "**") -> str:
    """A query with those operators marked that stand in no brackets and no quotes."""
    import re

    depth, out = 0, []
    for part in re.findall(r'"[^"]*"|[A-Za-z0-9-]+|.', query, re.DOTALL):
        depth += (part == "(") - (part == ")")
        out.append(f"{mark}{part}{mark}" if not depth and part in ("AND", "OR", "NOT") else part)
    return "".join(out)


def shade(value: float | None, low: float, high: float, steps: int = 5) -> int | None:
    """Which of ``steps`` equal parts of low to high a value is in, from 0; values outside go to the ends, none stays none."""
    if value is None:
        return None
    if high <= low:
        return 0
    return min(steps - 1, max(0, int((value - low) / (high - low) * steps)))


def query_entries(results: DataFrame) -> DataFrame:
    """Result rows with ``terms`` and ``nested`` (an OR of ANDs of ORs of terms) of their query; null if it can't be read."""
    from boolsieve.functions import boolean

    def read(query):  # type: ignore[no-untyped-def]
        if query is None or not boolean.is_valid(query):
            return None
        node = boolean.parse(query)
        return [t.text for t in boolean.terms_of(node)], boolean.nested(node)

    parsed = F.udf(read, "struct<terms:array<string>,nested:array<array<array<string>>>>", useArrow=True)
    return results.withColumn("_q", parsed("pubmed_query")).select(*results.columns, "_q.terms", "_q.nested")


#: Rows that a figure may have; a feed with more must be aggregated first.
FIGURE_ROWS = 20_000


def figure(rows: DataFrame, kind: str, x: str, y: str, series: str | None = None, size: str | None = None) -> object:
    """A line, bar, scatter or heat map of a report feed, as a matplotlib figure (if that is installed).

    Of a scatter ``size`` is the column of multiplicities, of a heat map that of the values.
    """
    import matplotlib.pyplot as plt

    names = list(dict.fromkeys(c for c in (x, y, series, size) if c))
    data = rows.select(*names).limit(FIGURE_ROWS + 1).toPandas()
    if len(data) > FIGURE_ROWS:
        raise ValueError("the feed has too many rows for a figure")
    fig, ax = plt.subplots()
    if kind == "heat":
        grid = data.pivot(index=y, columns=x, values=size).fillna(0)
        ax.imshow(grid.to_numpy(), origin="lower", aspect="auto")
    else:
        for label, part in data.groupby(series) if series else [(None, data)]:
            part = part.sort_values(x)
            if kind == "line":
                ax.plot(part[x], part[y], label=label)
            elif kind == "bar":
                ax.bar(part[x].astype(str), part[y], label=label)
            elif kind == "scatter":
                ax.scatter(part[x], part[y], s=part[size] * 4 if size else None, label=label)
            else:
                raise ValueError(f"there is no figure {kind!r}")
        if series:
            ax.legend()
    ax.set_xlabel(x)
    ax.set_ylabel(y)
    return fig


def annotated(query: str, counts: dict[str, int]) -> str:
    """A query with the number of documents behind each of its terms that has one."""
    import re

    def shown(n: int) -> str:
        return str(n) if n < 1000 else f"{n / 1000:.1f}k" if n < 10_000 else f"{n / 1000:.0f}k" if n < 1_000_000 else f"{n / 1e6:.2f}m" if n < 10_000_000 else f"{n / 1e6:.1f}m"

    return re.sub(r'"[^"]*"|[A-Za-z0-9-]+', lambda m: f"{m[0]} ({shown(counts[k])})" if (k := m[0].strip('"')) in counts else m[0], query)


def label(name: str) -> str:
    """A column's name as a heading: words apart, the first letter large, known short forms as they are read."""
    # fixed values: short forms of measures
    short = {"f1": "F1", "f3": "F3", "f50": "F50", "ands": "ANDs", "ors": "ORs", "nots": "NOTs", "ndcg": "nDCG", "mrr": "MRR", "map": "MAP"}
    words = [short.get(w.lower(), w) for w in name.replace("_", " ").split()]
    text = " ".join(words)
    return text[:1].upper() + text[1:]
