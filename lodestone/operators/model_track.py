"""The model track: units with their documents to prompts, replies to findings, citations checked against what was offered.

The client is any object with ``complete(system, user, schema) -> str``;
``Replay`` answers from recorded replies, so that everything here can be tested
without a model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.clients.models import HttpProblem, Refused, Unavailable  # noqa: F401
from lodestone.clients.pool import WORKERS, Stop, in_order
from lodestone.constants import BACKFILL, OVERFETCH, SEVERITIES
from lodestone.functions.score import clamp_confidence, parse_severity
from lodestone.functions.text import stable_id
from lodestone.operators import index
from lodestone.operators.embedding import embed_documents
from lodestone.operators.findings import resolve_citations
from lodestone.operators.retrieval import grounded, knn, rrf, scores_pairs
from lodestone.session import scratch, ship, stored
from lodestone.sources.archives import readable

FINDINGS = "findings"
_NEEDED = {"class": str, "severity": str, "confidence": (int, float), "handler": str, "evidence": str, "citations": list}
REPLY = "array<struct<class:string,severity:string,confidence:double,handler:string,line:int,evidence:string,citations:array<string>>>"


class ReplyProblem(ValueError):
    """A reply that does not fit the schema."""


#: What a reply has to look like. An object around the list: a decoder bound to a bare list may close it at once.
ITEM = {
    "type": "object",
    "properties": {
        "class": {"type": "string"}, "severity": {"type": "string", "enum": list(SEVERITIES[::-1])}, "confidence": {"type": "number"}, "handler": {"type": "string"},
        "line": {"type": ["integer", "null"]}, "evidence": {"type": "string"}, "citations": {"type": "array", "items": {"type": "string"}},
    },
    "required": list(_NEEDED),
}
SCHEMA = {"type": "object", "properties": {FINDINGS: {"type": "array", "items": ITEM}}, "required": [FINDINGS]}
SYSTEM = (
    "You read one instruction handler of an on-chain program and look for checks that are missing. Only report what the source shows, and cite the documents that say why it matters by their ids. "
    'Answer with JSON alone: an object with a list "findings", empty if there is nothing to report.'
)


@dataclass
class Replay:
    """Answers from recorded replies, in order for each prompt; an exhausted or unknown prompt is unavailable."""

    replies: dict[str, list[str]]
    asked: list[str] = field(default_factory=list)

    def complete(self, system: str, user: str, schema: dict | None = None) -> str:
        self.asked.append(user)
        for key, left in self.replies.items():
            if key in user and left:
                return left.pop(0)
        raise Unavailable("no recorded reply")


def unfenced(reply: str) -> str:
    return "\n".join(x for x in reply.split("\n") if not x.lstrip().startswith("```"))


def array_spans(text: str) -> list[str]:
    """The balanced [...] stretches, not inside one another; brackets in strings do not count."""
    out, i = [], text.find("[")
    while i >= 0:
        depth, quoted, j = 0, False, i
        while j < len(text):
            c = text[j]
            if quoted:
                if c == "\\":
                    j += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    break
            j += 1
        if j < len(text):
            out.append(text[i : j + 1])
            i = text.find("[", j + 1)
        else:
            i = text.find("[", i + 1)
    return out


def _row(x: object) -> dict:
    if not isinstance(x, dict):
        raise ReplyProblem("a finding is not an object")
    for k, kind in _NEEDED.items():
        if k not in x or not isinstance(x[k], kind) or isinstance(x[k], bool):
            raise ReplyProblem(f"`{k}` is missing or of another type")
    if any(not isinstance(c, str) for c in x["citations"]):
        raise ReplyProblem("`citations` holds something else than strings")
    line = x.get("line")
    if line is not None and (not isinstance(line, int) or isinstance(line, bool) or line < 0):
        raise ReplyProblem("`line` is not a line number")
    return {k: x[k] for k in _NEEDED} | {"line": line}


def parse_reply(reply: str) -> list[dict]:
    """The findings of a reply.

    An object with a list under "findings" is decisive, even if empty or wrong;
    else the stretch in brackets that reads as the most findings, and where none
    reads, the fault of the widest.
    """
    text = unfenced(reply)
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    if isinstance(whole, dict) and FINDINGS in whole:
        if not isinstance(whole[FINDINGS], list):
            raise ReplyProblem(f"`{FINDINGS}` is not a list")
        return [_row(x) for x in whole[FINDINGS]]
    best, fault = None, None
    for span in array_spans(text):
        try:
            rows = [_row(x) for x in json.loads(span)]
        except (ValueError, ReplyProblem) as e:
            if fault is None or len(span) > fault[0]:
                fault = (len(span), str(e))
            continue
        if best is None or len(rows) > len(best):
            best = rows
    if best is not None:
        return best
    raise ReplyProblem(fault[1] if fault else "the reply has no JSON list")


def complete(client, system: str, user: str) -> tuple[list[dict], str | None]:
    """(findings, problem): ask once, ask again with the fault, then give the unit up."""
    try:
        return parse_reply(client.complete(system, user, SCHEMA)), None
    except ReplyProblem as first:
        again = f"{user}\n\nThe last reply was refused: {first}. Reply with a JSON list that fits the schema and nothing else."
    try:
        return parse_reply(client.complete(system, again, SCHEMA)), None
    except ReplyProblem as second:
        return [], str(second)


def prompts(units: DataFrame, hits: DataFrame) -> DataFrame:
    """(seq, user) of units (seq, handler, source) and their documents (seq, rank, doc_id, title, text), each shown with its id."""
    entry = F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("> "), F.col("title"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    # as many documents a unit as were asked for
    shown = hits.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "").alias("shown"))
    user = F.concat(F.lit("Documents, each with its id in angle brackets:\n\n"), "shown", F.lit("Review the handler `"), "handler", F.lit("` in this source:\n\n```rust\n"), "source", F.lit("\n```\n"))
    return units.join(shown, "seq").select("seq", user.alias("user"))


def replies(units: DataFrame, client: Callable[[], object], system: str = SYSTEM, workers: int = WORKERS) -> DataFrame:
    """Ask the model about units (seq, user) on the executors: (seq, status, problem, findings), in the order of a task's units.

    ``client`` makes a client in each thread; a task has ``workers`` requests under
    way. Once the model is unavailable to one task, all tasks mark the units that
    are left and do not try them.
    """
    spark = ship(units.sparkSession)
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("problem", T.StringType()), T.StructField("findings", T.StringType())])
    flag = scratch(spark, "model-gone")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop = Stop(flag if readable(flag) else None)
        for b in batches:
            rows = []
            for (seq, _), got, problem in in_order(zip(b["seq"], b["user"]), client, lambda c, unit: complete(c, system, unit[1]), stop, workers):
                if problem is None:
                    found, fault = got
                    rows.append((seq, "dropped" if fault else "examined", fault, json.dumps(found)))
                elif isinstance(problem, str):
                    rows.append((seq, "unavailable", problem, "[]"))
                elif isinstance(problem, (HttpProblem, Refused)):  # this unit is lost, the next may not be
                    rows.append((seq, "dropped", str(problem), "[]"))
                else:
                    raise problem
            yield pd.DataFrame(rows, columns=["seq", "status", "problem", "findings"])

    return units.select(F.col("seq").cast("long").alias("seq"), "user").mapInPandas(run, schema).withColumn("findings", F.from_json("findings", REPLY))


def validated(answers: DataFrame, offers: DataFrame, handlers: DataFrame, programs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, diagnostics): findings must cite an offered document and name a known handler.

    ``handlers`` has name, file and line; an unknown or zero line becomes the handler's.
    With ``programs`` (seq, program), handlers are those of the unit's own program.
    """
    flat = answers.select(F.col("seq").alias("unit"), F.posexplode("findings").alias("ix", "f")).select("unit", "ix", "f.*")
    keyed = flat.withColumn("seq", F.xxhash64("unit", "ix"))
    own = offers.withColumnRenamed("seq", "unit").join(keyed.select("unit", "seq"), "unit")
    cited = resolve_citations(keyed.withColumn("cited", F.col("citations")).drop("citations"), own)
    known = handlers.select(*([] if programs is None else ["program"]), F.col("name").alias("handler"), "file", F.col("line").alias("handler_line"))
    if programs is None:
        j = cited.join(known, "handler", "left")
    else:
        j = cited.join(programs.select(F.col("seq").alias("unit"), "program"), "unit").join(known, ["program", "handler"], "left")
    lost = j.where("file is null").select(F.lit("unknown handler").alias("kind"), F.concat(F.lit("no handler `"), "handler", F.lit("`")).alias("message"))
    line = F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.col("handler_line"))
    n = F.size("citations")
    kept = j.where("file is not null").select(
        "seq", stable_id(F.col("handler"), F.col("class"), line.cast("string")).alias("id"), "class", parse_severity(F.col("severity")).alias("severity"), clamp_confidence(F.col("confidence"), n).alias("confidence"), F.lit("llm").alias("track"),
        "file", line.alias("line"), "handler", "evidence", "citations", F.lit(None).cast("string").alias("subject"), F.array().cast("array<string>").alias("absorbed_handlers"), *([] if programs is None else ["program"]),
    )
    return kept, lost


@dataclass
class _Asker:
    """What embeds, as an object that a task makes."""

    embed: Callable[[list[str]], list[list[float]]]


def retrieved(spark: SparkSession, path: str, queries: dict[str, str] | DataFrame, top_k: int, vectors: DataFrame | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Fused hits of many queries at once: (query_id, rank, doc_id, rrf, dense, bm25), from the index below ``path``.

    Queries are stated, or rows (query_id, text), which are embedded in tasks.
    Without vectors, or where embedding fails, the dense leg is null.
    """
    if isinstance(queries, dict):
        queries = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    n = OVERFETCH * max(0, top_k)
    sparse = stored(index.search(spark, path, queries, n).withColumn("doc_id", F.col("doc_id").cast("string")), "sparse-legs")
    lists = sparse.select("query_id", "rank", "doc_id")
    asked = None
    if vectors is not None and embed is not None:
        try:
            asked = embed_documents(queries.select(F.col("query_id").alias("doc_id"), "text"), lambda: _Asker(embed)).withColumnRenamed("doc_id", "query_id")
        except HttpProblem:
            asked = None
    if asked is not None:
        dense = stored(knn(vectors, asked, n).withColumn("doc_id", F.col("doc_id").cast("string")), "dense-legs")
        lists = lists.unionByName(dense.select("query_id", "rank", "doc_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc_id"))  # a few times top_k rows a query
    fused = stored(rrf(lists).withColumn("place", place), "fused")
    kind = index.open_sparse(spark, path).schema["doc_id"].dataType
    there = index.existing(spark, path, fused.select(F.col("doc_id").cast(kind).alias("doc_id"))).select(F.col("doc_id").cast("string").alias("doc_id"))
    hits = fused.join(there, "doc_id").join(sparse.select("query_id", "doc_id", F.col("score").alias("bm25")), ["query_id", "doc_id"], "left")
    if asked is None:
        hits = hits.withColumn("dense", F.lit(None).cast("double"))
    else:
        first = fused.where(F.col("place") <= BACKFILL * top_k).select("query_id", "doc_id")
        cosines = scores_pairs(vectors, asked, first).unionByName(dense.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("dense"))
        hits = hits.join(cosines, ["query_id", "doc_id"], "left")
    return hits.withColumn("rank", place).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", "rrf", "dense", "bm25")


@dataclass
class Review:
    """What the model track gives: findings, diagnostics and how many of its units were examined."""

    findings: DataFrame
    diagnostics: DataFrame
    units: int
    examined: int


def review(units: DataFrame, handlers: DataFrame, path: str, client: Callable[[], object], top_k: int = 5, vectors: DataFrame | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Review:
    """Retrieve for all units of a program, leave out ungrounded ones, ask, read replies, and check what they cite and name.

    ``units`` has handler, file, line, source and query; ``handlers`` name, file
    and line. Where both have ``program``, many programs are reviewed at once. An
    unreachable model stops the track with one diagnostic. Queries stay rows.
    """
    spark = units.sparkSession
    keyed = "program" in units.columns and "program" in handlers.columns
    numbered = stored(units.withColumn("seq", F.xxhash64(*(["program"] if keyed else []), "file", "handler", "line")), "units")
    asked = numbered.select(F.col("seq").cast("string").alias("query_id"), F.col("query").alias("text"))
    hits = stored(retrieved(spark, path, asked, top_k, vectors, embed).withColumn("seq", F.col("query_id").cast("long")), "hits")
    kept = grounded(hits).where("grounded").select(F.col("query_id").cast("long").alias("seq"))
    docs = index.described(spark, path, hits.select("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    source_url = F.col("source_url") if "source_url" in docs.columns else F.lit("")
    offered = hits.join(docs.select("doc_id", "title", "text", source_url.alias("source_url")), "doc_id")
    answers = stored(replies(prompts(numbered.join(kept, "seq", "left_semi"), offered), client), "answers")
    offers = offered.select("seq", F.col("rank").alias("offer"), "doc_id", "source_url", "title")
    findings, lost = validated(answers, offers, handlers, numbered.select("seq", "program") if keyed else None)
    states = {r.status: r["count"] for r in answers.groupBy("status").count().collect()}
    note = lambda kind, message: (F.lit(kind).alias("kind"), message.alias("message"))
    dropped = answers.where("status = 'dropped'").join(numbered.select("seq", "file", "handler"), "seq")
    notes = lost.select(F.lit(None).cast("string").alias("file"), F.lit("skipped").alias("kind"), "message")
    notes = notes.unionByName(dropped.select("file", *note("skipped", F.concat(F.lit("handler `"), "handler", F.lit("` was not reviewed: "), F.coalesce("problem", F.lit(""))))))
    if states.get("unavailable"):
        why = answers.where("status = 'unavailable'").agg(F.min("problem")).first()[0]
        notes = notes.unionByName(spark.createDataFrame([(None, "track skipped", f"the model track stopped after {states.get('examined', 0)} unit(s): {why}")], "file string, kind string, message string"))
    return Review(findings, notes, numbered.count(), states.get("examined", 0))


def unit_coverage(answers: DataFrame, units: int) -> DataFrame:
    """(total, examined): how many units there were and how many the model answered about."""
    return answers.agg(F.lit(units).cast("long").alias("total"), F.count_if(F.col("status") == "examined").alias("examined"))
