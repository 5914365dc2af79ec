"""Functions of the user's own in the place of a model: scorers, frame scorers and turn providers.

A hook is a function from one pandas frame to another that runs in tasks, a
batch at a time. What it takes is checked when the plan is made, what it gives
back in every batch: names, number of rows, and types, which Arrow converts or
refuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Hook:
    """``function`` gets the columns ``takes`` of a batch and returns the columns of the DDL text ``gives``."""

    function: Callable[[pd.DataFrame], pd.DataFrame]
    takes: tuple[str, ...]
    gives: str

    def names(self) -> list[str]:
        """Columns given back; needs a session, so it is asked where the plan is made."""
        return T.StructType.fromDDL(self.gives).fieldNames()

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.takes if c not in df.columns]
        if missing:
            raise ValueError(f"the hook takes columns that are not there: {', '.join(missing)}")

    def __call__(self, batch: pd.DataFrame, names: list[str], rows: int | None) -> pd.DataFrame:
        made = self.function(batch[list(self.takes)])
        if not isinstance(made, pd.DataFrame):
            raise TypeError(f"the hook returned {type(made).__name__}, not a frame")
        if sorted(made.columns) != sorted(names):
            raise ValueError(f"the hook returned columns {sorted(made.columns)}, not {sorted(names)}")
        if rows is not None and len(made) != rows:
            raise ValueError(f"the hook returned {len(made)} rows for {rows}")
        return made[names]


def scored(df: DataFrame, hook: Hook) -> DataFrame:
    """Add the columns a hook gives to every row: a scorer of (ref, hyp) pairs, or a scorer of frames.

    One row comes back for each that goes in, in its order. Columns of the
    names the hook gives are replaced. No shuffle.
    """
    hook.check(df)
    names = hook.names()
    keep = [c for c in df.columns if c not in names]
    given = df.select(*df.columns)
    schema = T.StructType([*df.select(*keep).schema.fields, *T.StructType.fromDDL(hook.gives).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            made = hook(batch, names, len(batch)).reset_index(drop=True)
            yield pd.concat([batch[keep].reset_index(drop=True), made], axis=1)

    return given.mapInPandas(run, schema)


def provided_turns(rows: DataFrame, provider: Hook, span: float, at: str = "start") -> DataFrame:
    """Speaker turns that a hook finds in a recording's rows (words or frames): recording_id, seq, start, end, label.

    The hook gives ``start``, ``end`` and ``label`` and gets ``span`` units of
    ``at`` of one recording at a time, in order, so that a long recording is
    many tasks' work; a turn over an edge is two. Turns are numbered in the
    order they are given, and their numbers rise with time. A NULL recording or
    time is a group of its own, first in order.
    """
    provider.check(rows)
    names = provider.names()
    if sorted(names) != ["end", "label", "start"]:
        raise ValueError(f"a turn provider gives start, end and label, not {names}")
    part = F.coalesce(F.floor(F.col(at) / span), F.lit(0)).cast("long").alias("_part")
    cut = rows.select(part, *dict.fromkeys(["recording_id", at, *provider.takes]))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        made = provider(batch.sort_values(at, kind="stable", na_position="first"), names, None)
        made = made.assign(recording_id=batch["recording_id"].iloc[0])
        made["seq"] = int(batch["_part"].iloc[0]) * 1_000_000 + pd.RangeIndex(len(made))
        return made[["recording_id", "seq", "start", "end", "label"]]

    return cut.groupBy("recording_id", "_part").applyInPandas(run, "recording_id string, seq long, start double, end double, label string")
