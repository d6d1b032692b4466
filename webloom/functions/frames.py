"""What batch functions hand back to Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd


def safe(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run with columns that Arrow takes whatever they hold: strings and empty columns as plain objects."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            odd = [c for c in out.columns if isinstance(out[c].dtype, pd.StringDtype) or (not len(out) and out[c].dtype != object)]
            yield out.astype(dict.fromkeys(odd, object)) if odd else out

    return wrapped
