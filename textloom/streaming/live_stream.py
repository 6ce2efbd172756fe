"""The live fold as a stateful stream: the same fold, its state kept by document between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.live import FOLDED, ContextModel, EditorConfig, Fold


def stream_alerts(words: DataFrame, model: ContextModel, config: EditorConfig = EditorConfig()) -> DataFrame:
    """Alerts of a stream (doc_id, token_idx, words). Rows of a micro-batch are sorted by token before they are folded."""
    held = words.sparkSession.sparkContext.broadcast(model)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold()
        if state.exists:
            tail, count = state.get
            fold = Fold(list(tail), count)
        pdf = pd.concat(list(batches)).sort_values("token_idx")
        rows = []
        for i, out in zip(pdf["token_idx"], pdf["words"], strict=True):
            rows += [(key[0], i, kind, at, a, b, v) for kind, at, a, b, v in fold.feed(list(out), held.value, config)]
        state.update((fold.tail, fold.count))
        yield pd.DataFrame(rows, columns=["doc_id", "input_idx", "alert_type", "out_idx", "original", "replacement", "ppl"]).astype({"ppl": "float64"})

    return words.groupBy("doc_id").applyInPandasWithState(run, FOLDED, "tail array<string>, count long", "append", GroupStateTimeout.NoTimeout)
