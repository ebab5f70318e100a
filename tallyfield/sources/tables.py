"""Record, prediction, statistics and log tables on files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values: tables or files with such a name hold no records
SIDE_FILES = (r"/[^/]*stats\.parquet(/|$)", r"/[^/]*\.fit\.[^/]*(/|$)")


def _not_side_file(path: Column) -> Column:
    out = F.lit(True)
    for pattern in SIDE_FILES:
        out = out & ~path.rlike(pattern)
    return out


def read_records(
    spark: SparkSession,
    dirs: Sequence[str],
    pattern: str = "*.parquet",
    max_files: int = 0,
    schema: StructType | None = None,
) -> DataFrame:
    """Record tables of several folders without their side files, plus column ``file``.

    The file name test is a metadata filter: side files are not opened.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*dirs)
    if max_files:
        kept = [f for f in df.inputFiles() if not re.search("|".join(SIDE_FILES), f)]
        df = limit_files(df, max_files, files=kept)
    df = df.where(_not_side_file(F.col("_metadata.file_path")))
    return df.select("*", F.col("_metadata.file_path").alias("file"))


def limit_files(
    df: DataFrame, n: int, unit: str = r".*", files: Sequence[str] | None = None
) -> DataFrame:
    """Only the first ``n`` files by name of a table that was just read (studies of how results grow).

    ``unit`` is a pattern: files in which it matches the same text, say a folder, count as one. Names
    come from the listing that the table has already made, so no row is read to find them, and the
    scan opens the named files alone.
    """
    found: dict[str, list[str]] = {}
    for f in df.inputFiles() if files is None else files:
        at = re.search(unit, f)
        if at:
            found.setdefault(at.group(0), []).append(f)
    # local names are written with one slash or with three
    names = [re.sub("^file:/+", start, f) for u in sorted(found)[:n] for f in sorted(found[u]) for start in ("file:/", "file:///")]
    # a filter on the file's name prunes the listing
    return df.where(F.col("_metadata.file_path").isin(names))


def write_counted(
    df: DataFrame, path: str, counters: Mapping[str, Column], mode: str = "error", rows_per_file: int = 0,
    drop: Sequence[str] = (),
) -> dict[str, int]:
    """Writes records and counts while they are written: aggregates by name, from the same job.

    Columns of ``drop`` are counted but not written.
    """
    seen = Observation(f"write-{uuid.uuid4().hex}")
    watched = df.observe(seen, *[c.alias(n) for n, c in counters.items()])
    write_records(watched.drop(*drop), path, rows_per_file, mode)
    return dict(seen.get)


def write_records(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "error") -> None:
    """Records in one file per task, or in files of at most ``rows_per_file`` rows if given."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_predictions(df: DataFrame, path: str, method: str, split: str) -> None:
    """Appends one batch of predictions under its method and split."""
    tagged = df.withColumn("method", F.lit(method)).withColumn("split", F.lit(split))
    tagged.write.mode("append").partitionBy("method", "split").parquet(path)


def rate(samples: Column, seconds: Column) -> Column:
    """Samples per second over a run."""
    return F.sum(samples) / F.greatest(F.sum(seconds), F.lit(1e-9))


def write_stats(df: DataFrame, path: str) -> None:
    """A small table of counters as one JSON file per job."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Appends log rows as JSON lines; NULL cells are left out, so keys stay sparse.

    Every call adds whole new files, which is what a file stream can follow.
    """
    df.write.mode("append").json(path)


def load_all(
    loaders: dict[str, Callable[[], DataFrame]],
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """All tables of a registry under each other, and (name, reason) of those that failed."""
    out: DataFrame | None = None
    skipped: list[tuple[str, str]] = []
    for name, load in loaders.items():
        try:
            part = load().withColumn("rig", F.lit(name))
        except Exception as exc:  # one broken dataset must not stop the others
            skipped.append((name, str(exc).splitlines()[0] if str(exc) else type(exc).__name__))
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, skipped


def latest_version(df: DataFrame, name: str = "version") -> DataFrame:
    """The highest ``v<X.Y>[-suffix]`` name, compared as numbers."""
    digits = F.split(F.regexp_extract(F.col(name), r"^v([^-]*)", 1), r"\.")
    numbers = F.transform(F.filter(digits, lambda d: d.rlike(r"^\d+$")), lambda d: d.cast("int"))
    return df.agg(F.max_by(F.col(name), numbers).alias(name))


def select_members(
    df: DataFrame, sequences: Sequence[int], stride: int, name: str = "member"
) -> DataFrame:
    """Archive members to keep: all CSV files, and every ``stride``-th frame of the sequences."""
    pattern = r"seq_(\d{6})_(\d{4})"
    seq = F.regexp_extract(name, pattern, 1)
    frame = F.regexp_extract(name, pattern, 2)
    wanted = seq.try_cast("int").isin(list(sequences)) & (frame.try_cast("int") % stride == 0)
    return df.where(F.col(name).endswith(".csv") | ((seq != "") & wanted))


def normalise_labels(df: DataFrame, betas: int = 10) -> DataFrame:
    """Label rows of one group in record form.

    Position is the body translation plus the camera offset, the box is centre +- 100 scale,
    shapes are cut to ``betas`` numbers, the frame name loses its suffix.
    """
    half = F.col("scale") * 200.0 / 2.0
    cx, cy = F.col("center")[0], F.col("center")[1]
    return df.select(
        F.regexp_replace("imgname", r"\.png$", "").alias("frame"),
        F.slice("pose_cam", 1, 3).alias("global_orient"),
        F.slice("pose_cam", 4, 69).alias("body_pose"),
        F.slice("shape", 1, betas).alias("betas"),
        F.array(*[F.col("trans_cam")[i] + F.col("cam_ext")[i][3] for i in range(3)]).alias("transl"),
        F.array(cx - half, cy - half, cx + half, cy + half).alias("bbox"),
        F.coalesce(F.col("gender"), F.lit("")).alias("gender"),
    )
