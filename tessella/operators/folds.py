"""Sequential folds inside a group, where a row's fate depends on those kept before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def suppressed(events: DataFrame, key: str, at: str, tie: str, hold: float) -> DataFrame:
    """(tie, key, fires): an event fires only if more than ``hold`` seconds went by since the last that fired."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([at, tie])
        last, fires = None, []
        for x in group[at]:
            go = last is None or x - last > hold
            fires.append(go)
            last = x if go else last
        return pd.DataFrame({tie: group[tie], key: group[key], "fires": fires})

    return events.groupBy(key).applyInPandas(fold, f"{tie} long, {key} long, fires boolean")


def floor_filter(rows: DataFrame, group: str, order: list[str], amount: str, total: str, floor: str) -> DataFrame:
    """Rows in order are taken out while what is left of the group's ``total`` stays at ``floor`` or above; a row that
    would break the floor is passed over and takes nothing."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        left, taken = float(pdf[total].iloc[0]) if len(pdf) else 0.0, []
        for x, low in zip(pdf[amount], pdf[floor], strict=True):
            go = left - x >= low
            taken.append(go)
            left -= x if go else 0
        return pdf.assign(taken=taken)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", taken boolean"
    return rows.groupBy(group).applyInPandas(fold, schema)


def expanding_shares(rows: DataFrame, group: str, order: list[str], value: str, key: str) -> DataFrame:
    """(key, seen, share): how many values came before in the group, and the share of them that is below, ties half. A
    sorted list takes each value once, so a group of n rows costs about n log n."""
    from bisect import bisect_left, bisect_right, insort

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        before: list[float] = []
        out = []
        for k, x in zip(pdf.sort_values(order)[key], pdf.sort_values(order)[value], strict=True):
            low, high = bisect_left(before, x), bisect_right(before, x)
            out.append((k, len(before), (low + high) / 2 / len(before) if before else None))
            insort(before, x)
        return pd.DataFrame(out, columns=[key, "seen", "share"])

    return rows.groupBy(group).applyInPandas(fold, f"`{key}` long, seen long, share double")
