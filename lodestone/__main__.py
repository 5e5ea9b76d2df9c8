"""Command line: analyze, ir, eval, mutate, holdout, and the corpus commands fetch, index, query and hash."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.clients.models import LOCAL_HOST, LOCAL_MODEL
from lodestone.clients.transport import Transport, urlopen
from lodestone.operators.holdout import CASES, CHECKOUTS, RUNS

#: What opens connections; tests put another one here.
TRANSPORT: Transport = urlopen


def _files(spark: SparkSession, roots: list[str]) -> DataFrame:
    from lodestone.sources.corpus import source_tree

    out = None
    for root in roots:
        one = source_tree(spark, root).select(F.lit(root.rstrip("/").rpartition("/")[2]).alias("program"), "path", "text")
        out = one if out is None else out.unionByName(one)
    return out


def _clients(a: argparse.Namespace) -> tuple[Callable[[], object], Callable[[list[str]], list[list[float]]] | None, str]:
    """What makes a model's client, what embeds queries, and the model's name."""
    from lodestone.clients.models import Embedder, HostedModel, LocalModel

    if a.hosted:
        name, make = HostedModel(a.model).name, lambda model=a.model, via=TRANSPORT: HostedModel(model, transport=via)
    else:
        name, make = LocalModel(a.host, a.model).name, lambda host=a.host, model=a.model, via=TRANSPORT: LocalModel(host, model, via)
    return make, (Embedder(a.host, a.embedder, TRANSPORT).embed if a.embedder else None), name


def tracks(spark: SparkSession, files: DataFrame, path: str, client: Callable[[], object] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, top_k: int = 5, embedder: str = "") -> dict:
    """The static track and, with a client, the model track over one program, merged last.

    The tracks do not know of each other. Where the model track cannot run, the
    static one stands and a diagnostic says why.
    """
    from lodestone.lang.analyze import analyze
    from lodestone.lang.units import units
    from lodestone.operators.findings import ranked
    from lodestone.operators.merging import fold
    from lodestone.operators.model_track import review
    from lodestone.session import stored

    r = analyze(files)
    own = stored(r.findings.withColumn("citations", F.array().cast("array<struct<doc_id:string,source_url:string,title:string>>")), "static")
    notes = r.diagnostics.select("file", "kind", "message")
    out = {"analysis": r, "static": own, "llm": None, "merged": ranked(own, ("subject", "file")), "units": 0, "examined": 0}
    if client is not None:
        names = ["id", "class", "severity", "confidence", "track", "file", "line", "handler", "evidence", "subject", "citations", "absorbed_handlers", "seq"]
        try:
            vectors = _dense(spark, path, embed, embedder)
            handlers = r.program.handlers.select("name", "file", "line")
            seen = review(units(r.program, files), handlers, path, client, top_k, vectors, embed)
            said = stored(seen.findings.select(*names), "said")
            whole = fold(own.select(*names).unionByName(said))
            out |= {"llm": said, "merged": ranked(whole, ("subject", "file")), "units": seen.units, "examined": seen.examined}
            notes = notes.unionByName(seen.diagnostics.select("file", "kind", "message"))
        except AnalysisException as e:  # no index to retrieve from
            notes = notes.unionByName(spark.createDataFrame([(None, "track skipped", f"no index below {path}: {e.getCondition()}")], "file string, kind string, message string"))
    return out | {"diagnostics": notes}


def _analyze(spark: SparkSession, a: argparse.Namespace) -> str:
    from lodestone.functions.text import line_count
    from lodestone.lang.rules import CATALOGUE
    from lodestone.operators import report

    files = _files(spark, [a.path])
    client, embed, model = _clients(a) if a.llm else (None, None, None)
    r = tracks(spark, files, a.index, client, embed, a.top, a.embedder)
    # a report is for a reader: its rows are collected here
    rows = lambda df: [] if df is None else [x.asDict(recursive=True) for x in df.collect()]
    found, notes = rows(r["merged"]), rows(r["diagnostics"])
    if a.format == "sarif":
        return report.sarif(found, CATALOGUE, notes, a.path)
    p = r["analysis"].program
    read = files.agg(F.count(F.lit(1)).alias("files"), F.sum(line_count(F.col("text"))).alias("loc")).first()
    failed = sum(n["kind"] == "parse" for n in notes)
    counts = {"files parsed": f"{read.files - failed}/{read.files}", "handlers": p.handlers.count(), "lines of code": read.loc or 0, "findings": len(found), "suppressed": r["analysis"].suppressed.count(), "units examined": f"{r['examined']}/{r['units']}"}
    if a.format == "json":
        whole = {"schema_version": 1, "model": model, "tracks": {"static": rows(r["static"]), "llm": rows(r["llm"]), "merged": found}, "coverage": counts, "diagnostics": notes}
        return json.dumps(whole, indent=2, ensure_ascii=False, default=str)
    return report.markdown(found, counts, notes, {"model": model}, {"static": rows(r["static"]), "llm": rows(r["llm"])})


def _ir(spark: SparkSession, a: argparse.Namespace) -> str:
    from lodestone.lang.ir import program

    p = program(_files(spark, [a.path]))
    for d in p.diagnostics.collect():
        print(f"{d.kind}: {d.message}", file=sys.stderr)
    parts = {n: [json.loads(r[0]) for r in getattr(p, n).select(F.to_json(F.struct("*"))).collect()] for n in ("handlers", "structs", "states")}
    return json.dumps(parts, indent=2, ensure_ascii=False)


class Absent(RuntimeError):
    """Something that was asked for cannot be had."""


def _dense(spark: SparkSession, path: str, embed: Callable[[list[str]], list[list[float]]] | None, embedder: str) -> DataFrame | None:
    """The vectors of an index, if queries can be embedded as they were."""
    from lodestone.operators import index

    held = index.meta(spark, path)
    return index.open_vectors(spark, path, *held) if held and embed and held[0] == embedder else None


def _eval(spark: SparkSession, a: argparse.Namespace) -> str:
    from lodestone.lang.evaluation import NoModel, model_findings, run
    from lodestone.operators import history, index
    from lodestone.operators.evaluate import rendered
    from lodestone.operators.retrieval import corpus_hash

    said, model, name = [], None, None
    if a.track == "merged":
        said.append("`merged` is a view and no track: both tracks run, as with `all`")
    if a.track != "static":
        client, embed, name = _clients(a)
        vectors = _dense(spark, a.index, embed, a.embedder)
        model = lambda files: model_findings(files, a.index, client, a.top, vectors, embed)
    files = _files(spark, a.paths)
    try:
        r = run(files, static=a.track != "llm", model=model, gated=not a.no_check)
    except (NoModel, AnalysisException) as e:
        if model is None:
            raise
        raise Absent(f"the model track cannot run: {e}") from e
    per_class = r.summary.orderBy("class", "view")
    rows = per_class.withColumns({c: rendered(F.col(c)) for c in ("recall", "precision")}).collect()
    noise = [x.asDict() for x in r.noise.orderBy("view").collect()]
    refused = [] if r.rejected is None else r.rejected.select("program", "operator", "id", "class", "reason").orderBy("program", "operator", "id").collect()
    if a.history:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        track = "all" if a.track == "merged" else a.track
        entry = {"schema_version": 1, "run_id": a.run_id or f"{now}-{track}", "timestamp": now, "per_class": [x.asDict() for x in per_class.collect()], "noise": noise, "cases_rejected": len(refused)}
        if model is not None:
            entry |= {"model": name, "corpus_hash": corpus_hash(index.open_sparse(spark, a.index)).first().corpus_hash}
        history.append(a.history, entry)
    said += [f"{x['class']:<28} {x.view:<8} {x.true_positives}/{x.total_cases} recall {x.recall} precision {x.precision}" for x in rows]
    said += [f"noise {n['view']}: {n['findings']} ({n['per_kloc']:.3f}/KLOC)" for n in noise]
    said.append("validity gate skipped: cases are unverified" if a.no_check else f"validity gate: {len(refused)} case(s) rejected")
    return "\n".join(said + [f"  {x.program}/{x.operator}-{x.id} ({x['class']}): {x.reason}" for x in refused])


def _mutate(spark: SparkSession, a: argparse.Namespace) -> str:
    from lodestone.lang.ir import program
    from lodestone.lang.mutations import mutants
    from lodestone.lang.resolution import gate
    from lodestone.operators import cases
    from lodestone.operators.evaluate import cases_per_operator
    from lodestone.session import stored

    files = _files(spark, [a.path])
    made = stored(mutants(program(files), files), "mutants")
    cases.materialize(a.path, made.orderBy("operator", "id").toLocalIterator(), a.out)
    refused = []
    if not a.no_check:
        made, rejected = gate(files, made)
        refused = [cases.reject(a.out, f"{r.operator}-{r.id}", r.reason) for r in rejected.orderBy("operator", "id").toLocalIterator()]
    counts = cases_per_operator(made).orderBy("operator").collect()
    verdict = "validity gate skipped: cases are unverified" if a.no_check else f"validity gate: {len(refused)} case(s) rejected"
    return "\n".join([f"{c.operator:<28} {c.cases}" for c in counts] + [f"{sum(c.cases for c in counts)} case(s) below {a.out}", verdict] + [f"  {r['name']}: {r['reason']}" for r in refused])


def _holdout(spark: SparkSession, a: argparse.Namespace) -> str:
    from lodestone.lang.detectors import RULES
    from lodestone.operators import evaluate as E
    from lodestone.operators import holdout as H
    from lodestone.session import stored

    held = H.load_cases(a.cases)
    lines = [H.CAVEAT] + [x for x in [H.warning(held, [r[0] for r in RULES])] if x]
    if not a.score:
        return "\n".join([*lines, *[f"{c.id}: {c.cls} in {c.handler}" for c in held], f"{len(held)} case(s); nothing scored"])
    got = stored(H.score(spark, held, a.checkouts, a.offline), "outcomes")
    for r in got.orderBy("case").collect():
        lines.append(f"{r['case']}: {r.outcome}" + (f" on {r.reported_on}" if r.reported_on else "") + (f" ({r.reason})" if r.reason else ""))
    if a.run_id:
        H.record(a.runs, got, a.run_id, "1", force=a.force)
    s = E.summarize_holdout(got).first()
    return "\n".join([*lines, f"scored {s.scored} of {s.targets}, recall {'-' if s.recall is None else format(s.recall, '.3f')}"])


def _corpus(spark: SparkSession, a: argparse.Namespace) -> str:
    from lodestone.operators import index
    from lodestone.operators.chunking import chunk_sources
    from lodestone.operators.evaluate import rendered
    from lodestone.operators.retrieval import corpus_hash, grounded, hybrid
    from lodestone.clients.models import Embedder, HttpProblem
    from lodestone.operators.embedding import embed_documents
    from lodestone.sources.corpus import cached, fetch, load_manifest, require_nonempty
    from lodestone.sources.manifest import with_hashes, write_atomically

    if a.verb == "fetch":
        changes = fetch(load_manifest(spark, a.manifest), a.cache).collect()
        if a.accept:
            with open(a.manifest, encoding="utf-8") as f:
                text = f.read()
            today = datetime.date.today().isoformat()
            write_atomically(a.manifest, with_hashes(text, {c.source_id: (c.new_sha256, today) for c in changes if c.outcome in ("fetched", "changed")}))
        return "\n".join(f"{c.source_id}: {c.outcome}" + (f", {c.size_change}" if c.outcome == "changed" else "") + (f" ({c.status})" if c.status != "ok" else "") for c in sorted(changes, key=lambda c: c.source_id))
    if a.verb in ("index", "hash"):
        chunks = require_nonempty(chunk_sources(cached(load_manifest(spark, a.manifest), a.cache)))
        if a.verb == "hash":
            return corpus_hash(chunks).first().corpus_hash
        dense = None
        if a.embedder:
            first = Embedder(a.host, a.embedder, TRANSPORT)
            dense = lambda docs, host=a.host, model=a.embedder, via=TRANSPORT: embed_documents(docs, lambda: Embedder(host, model, via))
            try:
                width = len(first.embed(["width"])[0])
            except HttpProblem:
                dense, width = None, 0
        index.build(chunks, a.index, dense, a.embedder, width if dense else 0)
        return f"indexed {chunks.count()} chunks" + ("" if dense or not a.embedder else "; no vectors, the embedder cannot be reached")
    docs = index.open_sparse(spark, a.index)
    held = index.meta(spark, a.index)
    vectors = vector = None
    if held:  # the dense leg: the query embedded as the vectors were, or a null leg where that cannot be done
        try:
            vector = Embedder(a.host, a.embedder or held[0], TRANSPORT).embed([a.text])[0]
            vectors = index.open_vectors(spark, a.index, a.embedder or held[0], len(vector))
        except HttpProblem:
            vectors = vector = None
    search, exists = (lambda queries, k: index.search(spark, a.index, queries, k)), (lambda ids: index.existing(spark, a.index, ids))
    hits = hybrid(docs, vectors, a.text, vector, a.top, search, exists)
    hits = hits.join(index.described(spark, a.index, hits.select("doc_id")).select("doc_id", "title"), "doc_id").orderBy("rank")
    shown = hits.select("rank", "doc_id", "title", rendered(F.col("rrf"), 4).alias("rrf"), rendered(F.col("dense"), 4).alias("dense"), rendered(F.col("bm25"), 4).alias("bm25")).collect()
    verdict = grounded(hits.withColumn("query_id", F.lit("q"))).collect()
    return "\n".join([f"{h.rank}. {h.doc_id} rrf {h.rrf} dense {h.dense} bm25 {h.bm25} {h.title}" for h in shown] + [f"grounded: {bool(verdict and verdict[0].grounded)}"])


def _asks(p: argparse.ArgumentParser) -> None:
    """How the model track asks and retrieves."""
    p.add_argument("--hosted", action="store_true", help="ask the hosted model, with the key in the environment")
    p.add_argument("--model", default=LOCAL_MODEL)
    p.add_argument("--host", default=LOCAL_HOST)
    p.add_argument("--embedder", default="")
    p.add_argument("--index", default="corpus/index")
    p.add_argument("--top", type=int, default=5)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestone", description=__doc__)
    verbs = p.add_subparsers(dest="command", required=True)
    a = verbs.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--format", choices=("markdown", "json", "sarif"), default="markdown")
    a.add_argument("--llm", action="store_true", help="run the model track too")
    _asks(a)
    a.set_defaults(run=_analyze)
    i = verbs.add_parser("ir")
    i.add_argument("path")
    i.set_defaults(run=_ir)
    e = verbs.add_parser("eval")
    e.add_argument("paths", nargs="+")
    e.add_argument("--history")
    e.add_argument("--track", choices=("static", "llm", "all", "merged"), default="static", help="which tracks run; merged is a view and means all")
    e.add_argument("--run-id", default="")
    e.add_argument("--no-check", action="store_true", help="score mutants that may not be valid programs too")
    _asks(e)
    e.set_defaults(run=_eval)
    m = verbs.add_parser("mutate")
    m.add_argument("path")
    m.add_argument("out")
    m.add_argument("--no-check", action="store_true", help="keep mutants that may not be valid programs")
    m.set_defaults(run=_mutate)
    h = verbs.add_parser("holdout")
    h.add_argument("--cases", default=CASES)
    h.add_argument("--runs", default=RUNS)
    h.add_argument("--checkouts", default=CHECKOUTS)
    h.add_argument("--score", action="store_true")
    h.add_argument("--offline", action="store_true")
    h.add_argument("--force", action="store_true")
    h.add_argument("--run-id", default="")
    h.set_defaults(run=_holdout)
    c = verbs.add_parser("corpus")
    c.add_argument("verb", choices=("fetch", "index", "query", "hash"))
    c.add_argument("--accept", action="store_true", help="write the new hashes into the manifest")
    c.add_argument("--host", default=LOCAL_HOST)
    c.add_argument("--embedder", default="")
    c.add_argument("text", nargs="?", default="")
    c.add_argument("--manifest", default="corpus/sources.toml")
    c.add_argument("--cache", default="corpus/cache")
    c.add_argument("--index", default="corpus/index")
    c.add_argument("--top", type=int, default=5)
    c.set_defaults(run=_corpus)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    print(a.run(spark, a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
