"""Records of a dataset in one call: from its file listing to written records with counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ordered import MAX_GROUP_ROWS
from tallyfield.operators.records import complete_frames, gate_records, stride_by_position
from tallyfield.sources.tables import write_counted

STATUS = ("accepted", "rejected_box", "rejected_points")


def generate_records(
    records: DataFrame,
    files: DataFrame,
    labels: DataFrame,
    path: str,
    *,
    frame: Sequence[str],
    sequence: Sequence[str],
    label_on: str | Sequence[str],
    stride: int = 1,
    mode: str = "error",
    rows_per_file: int = 0,
    limit: int = MAX_GROUP_ROWS,
    **gates: int,
) -> dict[str, int]:
    """Complete frames, every ``stride``-th of a sequence, with labels and a gate status, written.

    ``files`` lists (frame, kind); a frame without its image or depth file makes no record. The
    stride counts complete frames from the first of a sequence. ``labels`` has at most one row per
    ``label_on``; records without one stay, with nulls, and the gates judge them so. Returns counters
    from the writing job: records, labelled, and one per status.
    """
    frame, on = list(frame), [label_on] if isinstance(label_on, str) else list(label_on)
    whole = complete_frames(files, frame).where("complete").drop("complete")
    d = records.join(whole, frame, "left_semi")
    if stride > 1:
        d = stride_by_position(d, stride, sequence, [c for c in frame if c not in sequence], limit)
    d = gate_records(d.join(labels.withColumn("_labelled", F.lit(True)), on, "left"), **gates)
    counters = {
        "records": F.count(F.lit(1)),
        "labelled": F.count("_labelled"),
        **{s: F.count(F.when(F.col("status") == s, 1)) for s in STATUS},
    }
    return write_counted(d, path, counters, mode, rows_per_file, drop=["_labelled"])
