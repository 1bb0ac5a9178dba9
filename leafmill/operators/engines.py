"""Injected engines over rows, with retries: character recognition of images and the like.

An engine is made once a task by a function without arguments; what it raises becomes the row's error, after as many
further tries as the error's kind allows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def with_retry(call: Callable, tries: int = 3, initial_ms: float = 100.0, factor: float = 2.0, cap_ms: float = 1000.0, again: Callable[[Exception], bool] = lambda e: isinstance(e, (OSError, TimeoutError)), sleep: Callable[[float], None] = time.sleep):  # noqa: E501
    """`call` tried again after errors that `again` accepts, with growing pauses and none after the last try."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as e:
                if k == tries - 1 or not again(e):
                    raise
                sleep(min(initial_ms * factor**k, cap_ms) / 1000)

    return run


def recognise(images: DataFrame, key: str, engine: Callable[[], Callable[[bytes, str], tuple[str, float]]], languages: tuple[str, ...] = ("eng",), least: float = 0.0, tries: int = 1) -> DataFrame:
    """(key, text, confidence, language, error) of `images` (key, content): the first of `languages` whose reading reaches
    the confidence `least`, else the surest."""
    kind = dict(images.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = with_retry(engine(), tries)
        for batch in batches:
            rows = []
            for content in batch["content"]:
                best, error = None, None
                for language in languages:
                    try:
                        text, sure = read(content, language)
                    except Exception as e:  # noqa: BLE001 - the engine's failures are data
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if best is None or sure > best[1]:
                        best = (text, float(sure), language)
                    if sure >= least:
                        break
                rows.append((*best, None) if best else (None, None, None, error))
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "confidence", "language", "error"])], axis=1)

    return images.select(key, "content").mapInPandas(work, f"{key} {kind}, text string, confidence double, language string, error string")
