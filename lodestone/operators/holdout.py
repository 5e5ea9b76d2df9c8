"""Holdout cases: reading them, finding their checkouts, and scoring all of them against one analysis a program."""

from __future__ import annotations

import os
import shutil
import subprocess
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evaluate as E
from lodestone.operators import history

# Where things are unless said.
CASES, RUNS, CHECKOUTS = "benchmarks/holdout/cases.toml", "benchmarks/holdout/runs.json", "holdout-checkouts"
MARKER = ".lodestone-commit"
ROOT_FILE = "Cargo.toml"
CAVEAT = "Holdout numbers are only worth something while nobody has tuned against the cases; each scored run uses some of that up."


class NoCheckout(RuntimeError):
    """A case whose code is not there; its outcome is unavailable, with this reason."""


@dataclass(frozen=True)
class Case:
    """A known defect in a repository at a commit."""

    id: str
    repo: str
    commit: str
    path: str
    handler: str
    cls: str
    severity: str = ""
    source: str = ""

    @property
    def folder(self) -> str:
        """The checkout's name; with the commit in it another commit is another folder."""
        return f"{self.id}-{self.commit[:12]}"


def load_cases(path: str = CASES) -> list[Case]:
    with open(path, "rb") as f:
        rows = tomllib.load(f).get("case", [])
    return [Case(r["id"], r["repo"], r["commit"], r["path"], r["handler"], r["class"], r.get("severity", ""), r.get("source", "")) for r in rows]


def clone(repo: str, commit: str, folder: str) -> None:
    """One commit of a repository, without its history's files; a failed one is removed."""
    try:
        subprocess.run(["git", "clone", "--filter=blob:none", "--no-checkout", "--quiet", repo, folder], check=True, capture_output=True, text=True, timeout=600)
        subprocess.run(["git", "checkout", "--quiet", commit], cwd=folder, check=True, capture_output=True, text=True, timeout=600)
    except (subprocess.SubprocessError, OSError) as e:
        shutil.rmtree(folder, ignore_errors=True)
        raise NoCheckout(f"git failed: {(getattr(e, 'stderr', '') or str(e)).strip()}") from e


def checkout(case: Case, folder: str = CHECKOUTS, offline: bool = False, fetch: Callable[[str, str, str], None] = clone) -> str:
    """The folder with a case's code. Its marker has to name the commit; a folder without one was left half made and is fetched anew."""
    target = os.path.join(folder, case.folder)
    marker = os.path.join(target, MARKER)
    if os.path.isfile(marker):
        with open(marker, encoding="utf-8") as f:
            held = f.read().strip()
        if held != case.commit:
            raise NoCheckout(f"{target} holds {held}, the case names {case.commit}")
        return target
    if offline:
        raise NoCheckout(f"no checkout at {target}, and offline")
    shutil.rmtree(target, ignore_errors=True)
    os.makedirs(folder, exist_ok=True)
    fetch(case.repo, case.commit, target)
    with open(marker, "w", encoding="utf-8") as f:
        f.write(case.commit)
    return target


def program_root(folder: str, path: str) -> str:
    """The nearest folder above a file, within its checkout, that holds a package file."""
    folder = os.path.normpath(folder)
    full = os.path.normpath(os.path.join(folder, path))
    if not os.path.exists(full):
        raise NoCheckout(f"{path} is not in the checkout")
    at = os.path.dirname(full)
    while at == folder or at.startswith(folder + os.sep):
        if os.path.isfile(os.path.join(at, ROOT_FILE)):
            return at
        at = os.path.dirname(at)
    raise NoCheckout(f"no {ROOT_FILE} above {path} in the checkout")


def unreachable(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Classes of cases that no detector reports (``known`` has their classes), with the number of their cases."""
    return cases.join(known.select("class").distinct(), "class", "left_anti").groupBy("class").agg(F.count(F.lit(1)).alias("cases"))


def warning(cases: list[Case], known: Iterable[str]) -> str | None:
    """What to say of cases that can only be missed."""
    lost = [c for c in cases if c.cls not in set(known)]
    if not lost:
        return None
    return f"{len(lost)} of {len(cases)} case(s) are of classes that no detector here reports ({', '.join(sorted({c.cls for c in lost}))}); they can only be missed."


def score(spark: SparkSession, cases: list[Case], folder: str = CHECKOUTS, offline: bool = False, fetch: Callable[[str, str, str], None] = clone) -> DataFrame:
    """(case, class, handler, outcome, reported_on, reason) of all cases.

    Checkouts are found one by one; cases of one program share it, and all
    programs are analyzed together in one job. A program without handlers was not
    analyzed in any useful sense, so its cases are unavailable, not missed.
    """
    from lodestone.lang.analyze import analyze
    from lodestone.sources.corpus import source_tree

    rows = []
    for c in cases:
        try:
            rows.append((c.id, c.handler, c.cls, program_root(checkout(c, folder, offline, fetch), c.path), None))
        except NoCheckout as e:
            rows.append((c.id, c.handler, c.cls, None, str(e)))
    targets = spark.createDataFrame(rows, "case string, handler string, class string, program string, reason string")
    roots = sorted({r[3] for r in rows if r[3]})
    files = None
    for root in roots:
        one = source_tree(spark, "file://" + os.path.abspath(root)).select(F.lit(root).alias("program"), "path", "text")
        files = one if files is None else files.unionByName(one)
    if files is None:
        return targets.select("case", "class", "handler", F.lit("unavailable").alias("outcome"), F.lit(None).cast("string").alias("reported_on"), "reason")
    r = analyze(files)
    parsed = r.program.handlers.select("program").distinct().withColumn("parsed", F.lit(True))
    empty = F.concat("program", F.lit(" parsed into 0 handlers"))
    told = targets.join(parsed, "program", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("parsed").isNull(), empty))).withColumn("available", F.col("reason").isNull())
    # a program's name goes with its handlers' names, so that programs do not answer for each other
    own = lambda c: F.concat_ws("\n", F.coalesce("program", F.lit("")), c)
    found = r.findings.select("class", own(F.col("handler")).alias("handler"), F.transform("absorbed_handlers", lambda h: own(h)).alias("absorbed_handlers"))
    out = E.holdout(told.select("case", own(F.col("handler")).alias("handler"), "class", "available"), found)
    bare = lambda c: F.substring_index(c, "\n", -1)
    return out.select("case", "class", bare("handler").alias("handler"), "outcome", bare("reported_on").alias("reported_on")).join(told.select("case", "reason"), "case")


def record(path: str, outcomes: DataFrame, run_id: str, version: str, tracks: tuple[str, ...] = ("static",), force: bool = False) -> dict:
    """Append a scored run to the record; a second one only by force."""
    s = E.summarize_holdout(outcomes).first().asDict()
    row = {"run_id": run_id, "tool_version": version, "tracks": list(tracks)} | s | {"is_complete": s["scored"] == s["targets"]}
    history.append_holdout(path, row, force)
    return row
