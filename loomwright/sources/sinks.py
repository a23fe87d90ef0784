"""Writers. Nothing is overwritten in place: every export goes to a path of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_json(parents: DataFrame, children: DataFrame, key: str, name: str, order: str, path: str | None = None) -> DataFrame:
    """One JSON text per parent, its children nested in order; written as text if a path is given."""
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (key, order)]))).alias(name))
    rows = parents.join(nested, key, "left")
    out = rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))
    if path:
        out.select("json").write.text(path)
    return out


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def flat(df: DataFrame, lists: list[str], sep: str = ";") -> DataFrame:
    """Lists joined for a flat format."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), sep) for c in lists})


def csv(df: DataFrame, path: str, lists: list[str] = (), sep: str = ",") -> None:
    flat(df, list(lists)).write.option("header", True).option("escape", '"').option("sep", sep).csv(path)


def plain_field(c: Column) -> Column:
    """A free-text field for readers without quoting: commas to semicolons, double quotes to single ones."""
    return F.translate(c, ',"', ";'")


def subsets(df: DataFrame, path: str, parts: dict[str, Column]) -> None:
    """One export for each condition, below one path."""
    for name, keep in parts.items():
        df.where(keep).write.json(f"{path}/{name}")


def versioned(path: str, version: str) -> str:
    """A path for a new version, so that the one before it stays as the back-up."""
    return f"{path.rstrip('/')}/version={version}"


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has left to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def report_lines(title: str, rows: DataFrame, template: Column) -> DataFrame:
    """A text report: a title and a line a row, numbered."""
    head = rows.sparkSession.createDataFrame([(0, title)], "n long, line string")
    from ..operators.ranking import global_rank

    body = global_rank(rows.select(template.alias("line")), [F.col("line")], "n").select("n", "line")
    return head.unionByName(body)
