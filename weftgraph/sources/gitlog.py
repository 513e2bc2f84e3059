"""Commit logs: read from a repository in pieces, parsed by expressions."""

from __future__ import annotations

import os
import subprocess
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.staging import shared_dir

START = "\x1e"
BLOCKS = 20_000  # commits that are held at once
PIECE = 1 << 20


def _command(folder: str, most: int = 0, since: str | None = None) -> list[str]:
    ask = ["git", "-C", folder, "log", f"--pretty=format:{START}%n%H%n%at%n%s", "--name-status", "--no-merges", "--diff-filter=ACMR", "-M50%"]
    return ask + [f"-n{most}"] * bool(most) + [f"--since={since}"] * bool(since)


def read_log(folder: str, most: int = 0, since: str | None = None, seconds: int = 120) -> str:
    """The log of a repository as text; empty if there is none, or git fails or takes too long."""
    try:
        return subprocess.run(_command(folder, most, since), capture_output=True, text=True, errors="replace", timeout=seconds, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def _blocks(folder: str, most: int, since: str | None, seconds: int) -> Iterator[str]:
    """One text for each commit, while git writes."""
    with subprocess.Popen(_command(folder, most, since), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as git:
        timer = threading.Timer(seconds, git.kill)
        timer.start()
        try:
            rest = ""
            while piece := git.stdout.read(PIECE):
                *whole, rest = (rest + piece).split(START)
                yield from whole
            yield rest
        finally:
            timer.cancel()
            git.kill()
    if git.returncode not in (0, None):
        raise OSError(f"git ended with {git.returncode}")


def stage_log(spark: SparkSession, folder: str, most: int = 0, since: str | None = None, seconds: int = 3600) -> DataFrame | None:
    """seq, block: one row for each commit, written to the shared folder some thousand at a time; None without a log."""
    import uuid

    path, rows, at = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", [], 0

    def flush() -> None:
        if rows:
            spark.createDataFrame(rows, "seq long, block string").write.mode("append").parquet(path)
            rows.clear()

    try:
        for at, block in enumerate(_blocks(folder, most, since, seconds)):
            if block.strip():
                rows.append((at, block))
            if len(rows) >= BLOCKS:
                flush()
    except OSError:
        return None
    if not rows and at < BLOCKS:
        return None
    flush()
    return spark.read.parquet(path)


def _asked(folder: str, *what: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", *what], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def is_repository(folder: str) -> bool:
    return _asked(folder, "--git-dir") is not None


def root(folder: str) -> str | None:
    """The top folder of the repository that holds ``folder``."""
    return _asked(folder, "--show-toplevel")


def prefix(folder: str) -> str:
    """``folder`` seen from the repository's top, '' for the top itself."""
    top = root(folder)
    inside = os.path.relpath(os.path.realpath(folder), os.path.realpath(top)) if top else "."
    return "" if inside == "." else inside


def scope(commits: DataFrame, inside: str, column: str = "file") -> DataFrame:
    """Rows of files below the folder ``inside`` (as :func:`prefix` gives it), with paths seen from there."""
    if not inside:
        return commits
    head = inside.rstrip("/") + "/"
    return commits.filter(F.startswith(F.col(column), F.lit(head))).withColumn(column, F.substring(column, len(head) + 1, 1 << 20))


def parse(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_blocks` of a log that is held as one text."""
    return parse_blocks(spark.createDataFrame([(text,)], "text string").select(F.posexplode(F.split("text", START)).alias("seq", "block")))


def parse_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits: seq, hash, ts, message, file; renames: seq, old, new) of rows seq, block. Blocks without files or with a bad time are left out."""
    lines = blocks.filter("trim(block) <> ''").select("seq", F.split(F.regexp_replace("block", r"^\n", ""), "\n").alias("l"))
    head = lines.select("seq", F.col("l")[0].alias("hash"), F.expr("try_cast(l[1] as bigint)").alias("ts"), F.get("l", F.lit(2)).alias("message"), F.explode(F.slice("l", 4, F.size("l"))).alias("line"))
    status = F.split("line", "\t")
    rows = head.filter("ts is not null").select("seq", "hash", "ts", "message", status.alias("s")).filter(F.size("s") >= 2)
    renamed = F.startswith(F.col("s")[0], F.lit("R")) & (F.size("s") >= 3)
    commits = rows.select("seq", "hash", "ts", "message", F.when(renamed, F.get("s", F.lit(2))).otherwise(F.col("s")[1]).alias("file"))
    return commits, rows.filter(renamed).select("seq", F.col("s")[1].alias("old"), F.get("s", F.lit(2)).alias("new"))
