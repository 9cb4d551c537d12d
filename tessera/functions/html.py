"""Tables of HTML mails as rows of cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

TABLES = "array<struct<rows:array<array<string>>,row_count:int,column_count:int>>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown.
HIDDEN = frozenset(("script", "style", "template"))


class _Tables(HTMLParser):
    """Folds the stream of tags and texts with a stack of open elements. A row belongs to every open table and a cell to every open
    row, so an outer table holds the rows of those inside it, too; an end tag closes all up to its start tag, or nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list | None]] = []
        self.tables: list[list] = []

    def handle_starttag(self, tag, attrs):
        own: list | None = None
        if tag == "table":
            own = []
            self.tables.append(own)
        elif tag == "tr":
            own = []
            for name, table in self.stack:
                if name == "table":
                    table.append(own)
        elif tag in ("td", "th"):
            own = []
            for name, row in self.stack:
                if name == "tr":
                    row.append(own)
        if tag not in VOID:
            self.stack.append((tag, own))

    def handle_endtag(self, tag):
        if any(name == tag for name, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        text = data.strip()
        if text and not any(name in HIDDEN for name, _ in self.stack):
            for name, cell in self.stack:
                if name in ("td", "th"):
                    cell.append(text)


def parse_tables(html: str | None) -> list[dict]:
    """Each table with a cell: its rows of cell texts, their number and the number of cells in the first."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    found = ([["".join(cell) for cell in row] for row in table if row] for table in p.tables)
    return [{"rows": rows, "row_count": len(rows), "column_count": len(rows[0])} for rows in found if rows]


def html_tables(html: Column) -> Column:
    """The tables of an HTML text; a null text has none."""
    return pandas_udf(lambda s: pd.Series([parse_tables(x) for x in s], dtype="object"), TABLES)(html)
