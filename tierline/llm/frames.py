"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierline.session import scratch_path

#: The white space of all word contracts: space and the controls TAB..CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage durably (the files survive a lost executor), computes the
    input exactly once, and gives Spark true file sizes, so that a small side
    of a later join is broadcast by its measured size only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are dealt to fewer tasks than the session's shuffle
#: partitions: so many rows each, but ``FEW_TASKS`` tasks at least.
FEW_ROWS, TASK_ROWS, FEW_TASKS = 200_000, 5_000, 8


def dealer(rows: int):
    """A function that puts a DataFrame of about ``rows`` rows into few tasks behind a
    shuffle; it leaves one of more than ``FEW_ROWS`` rows as it is.

    Iterative operators make many small tables; with a task of each for every shuffle
    partition the tasks' overhead would take most of the time.
    """
    tasks = max(FEW_TASKS, -(-rows // TASK_ROWS))
    return (lambda df: df.coalesce(tasks)) if rows <= FEW_ROWS else (lambda df: df)


_HELD: dict = {}


def held(key, build):
    """What ``build()`` makes, kept by this Python worker from task to task.

    A worker serves all operators of an application one after another, so it keeps
    the state of the latest only: vocabularies and caches of different operators
    do not add up in its memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def shielded(df: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``df`` with positional column names, the old names, and the name prefix.

    Operators that keep every input column work on the positional names, so no
    input column can clash with a working column; ``unshielded`` restores them.
    """
    prefix = "in_"
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))]), df.columns, prefix


def inner_name(names: list[str], column: str) -> str:
    """Positional name of an input column (exact match first, then any case)."""
    if column in names:
        return f"in_{names.index(column)}"
    lowered = [n.lower() for n in names]
    if column.lower() not in lowered:
        raise ValueError(f"no column {column!r} among {names}")
    return f"in_{lowered.index(column.lower())}"


def unshielded(df: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    """Input columns under their own names plus ``added``; an added column
    replaces an input column of the same name (in any case)."""
    taken = {a.lower() for a in added}
    cols = [F.col(f"in_{i}").alias(n) for i, n in enumerate(names) if n.lower() not in taken]
    return df.select(*cols, *added)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null text: empty)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.array_remove(parts, "")


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.size(words_of(text)).cast("long")
