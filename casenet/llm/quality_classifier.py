"""Quality classifier: a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own and its neighbours' shape;
the forward-backward marginals, weighted by line length, give the share of
good text, and a logistic scale fitted on the same sample makes it a score.

Edge cases: a null text counts as empty; an empty text is one empty line and
gets a score like any other; a text of any length is read whole, its lines in
blocks side by side; repeated rows are scored alike, each for itself; a score
equal to the threshold is accepted, and a marginal of one half is a good line;
an empty table gives an empty result; other columns are passed through by
``classify`` unless they bear the name of an output column, which then wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casenet.llm import textkernel as tk
from casenet.llm.linemodel import LineModel, fit_line_model, forward_backward, good_share, held_out, line_table

OUTPUTS = ("score", "predicted", "good_share", "n_lines", "n_bad_lines")


def score_documents(docs: DataFrame, model: LineModel, threshold: float = 0.3) -> DataFrame:
    """Add ``score``, ``predicted``, ``good_share``, ``n_lines`` and ``n_bad_lines`` to each row."""
    docs = docs.drop(*OUTPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                table = line_table(data, offsets)
                bad, _, _ = forward_backward(model.step, table.x @ model.weight, table.first)
                good = good_share(1 - bad, table.chars, table.first)
                score = model.score(good)
                arrays = [*batch.slice(lo, hi - lo).columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(good), pa.array(np.diff(table.first)), pa.array(np.add.reduceat((bad > 0.5).astype(np.int64), table.first[:-1]))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *OUTPUTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int", "good_share double", "n_lines bigint", "n_bad_lines bigint"])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 4000) -> DataFrame:
    """Fit on the labelled documents outside the held-out fifth and score all of ``docs``; adds ``held_out`` too."""
    return score_documents(docs, fit_line_model(docs, labels, max_docs), threshold).withColumn("held_out", held_out())


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 4000) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns only."""
    extra = {f"__{name}": F.col(name) for name in OUTPUTS if name in docs.columns}
    carried = docs.withColumns(extra)
    kept = score_documents(carried, fit_line_model(docs, labels, max_docs), threshold).where(F.col("predicted") == 1)
    return kept.select(*(F.col(f"__{c}").alias(c) if f"__{c}" in extra else F.col(c) for c in docs.columns))
