"""Mutation runs: every program and every mutant analyzed in one job, and compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import line_count
from lodestone.lang import detectors, suppression
from lodestone.lang.ir import program
from lodestone.lang.mutations import mutants
from lodestone.lang.resolution import gate, variants
from lodestone.lang.units import units
from lodestone.operators import evaluate as E
from lodestone.operators.model_track import Review, review
from lodestone.session import stored


@dataclass
class Run:
    """Labels, differences, the summary by class and view, the noise floor, and the mutants that the gate rejected."""

    labels: DataFrame
    differences: DataFrame
    summary: DataFrame
    noise: DataFrame
    rejected: DataFrame | None = None


def static_findings(files: DataFrame) -> DataFrame:
    """Unmerged findings of all programs, suppressed ones left out."""
    p = program(files)
    return suppression.apply(p, detectors.run(p))[0]


def model_findings(files: DataFrame, path: str, client: Callable[[], object], top_k: int = 5, vectors: DataFrame | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Review:
    """The model track over all programs at once, from the index below ``path``."""
    p = program(files)
    return review(units(p, files), p.handlers.select("program", "name", "file", "line"), path, client, top_k, vectors, embed)


class NoModel(RuntimeError):
    """The model track was asked for and gave nothing: a zero in the series would read as a regression."""


def run(files: DataFrame, static: bool = True, model: Callable[[DataFrame], Review] | None = None, gated: bool = False) -> Run:
    """Evaluate tracks on programs of files (program, path, text).

    ``model`` reviews files of many programs; findings of the tracks are not
    merged, as merging would lose which track found a defect. ``gated`` leaves out
    mutants whose names do not resolve. A clean program is analyzed once.
    """
    made = stored(mutants(program(files), files), "mutants")
    rejected = None
    if gated:
        made, rejected = gate(files, made)
        made = stored(made, "gated-mutants")
    case = F.concat("program", F.lit("/"), F.concat_ws("-", "operator", "id"))
    labels = made.select(case.alias("case"), "program", "handler", "class", "operator")
    every = files.unionByName(variants(files, made))
    found = [static_findings(every)] if static else []
    if model is not None:
        seen = model(every)
        if not seen.examined:
            raise NoModel("the model examined no unit")
        found.append(seen.findings)
    columns = [c for c in found[0].columns if all(c in f.columns for f in found)]
    both = found[0].select(*columns)
    for more in found[1:]:
        both = both.unionByName(more.select(*columns))
    both = stored(both, "variants")
    cases = labels.select("case", F.col("program").alias("clean"))
    mutated = both.withColumnRenamed("program", "case").join(cases, "case")
    known = both.select(F.col("program").alias("clean"), "track", "handler", "class").distinct().withColumn("known", F.lit(True))
    differences = mutated.join(known, ["clean", "track", "handler", "class"], "left").withColumn("introduced", F.col("known").isNull()).drop("known")
    loc = files.agg(F.sum(line_count(F.col("text")))).first()[0] or 0
    return Run(labels, differences, E.summarize(differences, labels), E.noise_floor(differences, loc), rejected)
