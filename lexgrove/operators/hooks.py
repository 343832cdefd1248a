"""Per-book hooks: functions on a stage's table, applied to the rows of the books that have them.

A hook takes a DataFrame and the other tables of the stage and returns a DataFrame of
the same columns.  Books that share a function go through it together: rows get the
function's number by a join with the books' small table, so a stage is read once for each
different function, however many books have one.  `rows_hook` adapts a function on lists
of dicts, run for each book in its own group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("post_segment", "post_strip", "post_annotate", "post_page_map", "post_chapter_detect", "post_ref_parse", "post_index_parse")


class Hooks:
    """Hooks by book and stage; a stage without a hook is the identity."""

    def __init__(self) -> None:
        self._held: dict[str, dict[str, Callable[..., DataFrame]]] = {s: {} for s in STAGES}

    def register(self, book_key: str, stage: str, function: Callable[..., DataFrame]) -> None:
        if stage not in self._held:
            raise ValueError(f"no such stage: {stage}; there are {', '.join(STAGES)}")
        self._held[stage][book_key] = function

    def apply(self, stage: str, df: DataFrame, **tables: DataFrame) -> DataFrame:
        """df with the hooked books' rows replaced by what their function returns for them."""
        held = self._held[stage]
        if not held:
            return df
        functions = list(dict.fromkeys(held.values()))
        place = {f: n for n, f in enumerate(functions)}
        # a row for each hooked book: the registry's size
        books = F.broadcast(df.sparkSession.createDataFrame([(key, place[f]) for key, f in held.items()], "book_key string, _hook int"))
        told = df.join(books, "book_key", "left")
        out = told.where("_hook IS NULL").select(*df.columns)
        for n, function in enumerate(functions):
            own = books.where(F.col("_hook") == n).select("book_key")
            inside = {name: t.join(own, "book_key", "left_semi") for name, t in tables.items()}
            made = function(told.where(F.col("_hook") == n).select(*df.columns), **inside)
            out = out.unionByName(made.join(own, "book_key", "left_semi").select(*df.columns))
        return out


def rows_hook(function: Callable[[list[dict], dict], Iterable[dict]], meta: dict | None = None, order: str | None = None) -> Callable[..., DataFrame]:
    """A hook from a function of (rows of one book as dicts, meta) to rows."""

    def hook(df: DataFrame, **_: DataFrame) -> DataFrame:
        import pandas as pd

        columns = df.columns

        def run(book: pd.DataFrame) -> pd.DataFrame:
            if order:
                book = book.sort_values(order)
            rows = [{c: None if isinstance(v, float) and v != v else v for c, v in r.items()} for r in book.to_dict("records")]
            return pd.DataFrame(list(function(rows, meta or {})), columns=columns)

        return df.groupBy("book_key").applyInPandas(run, df.schema)

    return hook
