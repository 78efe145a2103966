"""Git state read from files, and diffs as rows of changed line ranges."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def head(root: str) -> dict[str, str | None]:
    """``branch`` and ``commit`` of a checkout, without running git; both None outside one."""
    folder = Path(root) / ".git"
    if folder.is_file():  # a work tree points to its folder
        text = folder.read_text(encoding="utf-8").strip()
        folder = (Path(root) / text.removeprefix("gitdir:").strip()).resolve()
    start = folder / "HEAD"
    if not start.is_file():
        return {"branch": None, "commit": None}
    text = start.read_text(encoding="utf-8").strip()
    if not text.startswith("ref:"):
        return {"branch": None, "commit": text or None}
    ref = text.removeprefix("ref:").strip()
    common = folder / "commondir"
    places = [folder] + ([(folder / common.read_text(encoding="utf-8").strip()).resolve()] if common.is_file() else [])
    return {"branch": ref.removeprefix("refs/heads/"), "commit": next((c for p in places if (c := _resolve(p, ref))), None)}


def _resolve(folder: Path, ref: str) -> str | None:
    loose = folder / ref
    if loose.is_file():
        return loose.read_text(encoding="utf-8").strip()
    packed = folder / "packed-refs"
    for line in packed.read_text(encoding="utf-8").splitlines() if packed.is_file() else []:
        if line.endswith(" " + ref) and not line.startswith(("#", "^")):
            return line.split(" ", 1)[0]
    return None


class GitUnavailable(RuntimeError):
    """git is missing, or refuses the ref or the folder; the message says which."""


def read_diff(root: str, ref: str = "HEAD", pathspec: str | None = None) -> str:
    """Unified diff without context of a ref, or ``a..b``, as git prints it."""
    command = ["git", "diff", "--unified=0", "--no-color", "--find-renames", ref, *(["--", pathspec] if pathspec else [])]
    try:
        done = subprocess.run(command, cwd=root, capture_output=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitUnavailable(f"git diff: {type(e).__name__}") from e
    if done.returncode:
        raise GitUnavailable(done.stderr.decode("utf-8", "replace").strip() or f"git diff ended with {done.returncode}")
    return done.stdout.decode("utf-8", "replace")


def diff_rows(spark: SparkSession, text: str) -> DataFrame:
    """``text``: the diff of each file, one row each."""
    return spark.createDataFrame([("diff --git " + x,) for x in re.split(r"(?m)^diff --git ", text)[1:]], "text string")


def hunks(diffs: DataFrame) -> DataFrame:
    """``path, status, lo, hi, added, removed`` of diffs(text): one row for each changed range of the new side.

    A file without ranges (a rename) has one row without them; a pure deletion is a range of one line.
    Counts of lines are the file's. A row may hold the diffs of several files; each file is read by itself.
    """
    one = diffs.select(F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("piece")).where(F.col("piece").startswith("diff --git "))
    lines = one.select(F.split("piece", "\n").alias("lines"))
    is_range = lambda x: x.startswith("@@ ")
    at = F.array_position(F.transform("lines", is_range), F.lit(True)).cast("int")
    cut = lines.withColumn("at", F.when(at > 0, at).otherwise(F.size("lines") + 1))
    cut = cut.select(F.slice("lines", F.lit(1), F.col("at") - 1).alias("head"), F.slice("lines", F.col("at"), F.size("lines")).alias("body"))
    has = lambda p: F.exists("head", lambda x: x.startswith(p))
    rest = lambda p: F.get(F.transform(F.filter("head", lambda x: x.startswith(p)), lambda x: F.trim(F.substring(x, F.lit(len(p) + 1), F.length(x)))), F.lit(0))
    status = F.when(has("new file mode"), "A").when(has("deleted file mode") | has("+++ /dev/null"), "D").when(has("rename to "), "R").otherwise("M")
    count = lambda p: F.size(F.filter("body", lambda x: x.startswith(p))).cast("long")
    first = lambda x: F.regexp_extract(x, r"^@@ -\S+ \+(\d+)", 1).cast("int")
    size = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^@@ -\S+ \+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    ranges = F.transform(F.filter("body", is_range), lambda x: F.struct(first(x).alias("lo"), (first(x) + F.greatest(size(x), F.lit(1)) - 1).alias("hi")))
    path = F.coalesce(rest("rename to "), rest("+++ b/"), rest("--- a/"))
    found = cut.select(path.alias("path"), status.alias("status"), F.explode_outer(ranges).alias("r"), count("+").alias("added"), count("-").alias("removed"))
    return found.where("path IS NOT NULL").select("path", "status", "r.lo", "r.hi", "added", "removed")
