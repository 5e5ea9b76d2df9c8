"""The command line with recorded servers: dense queries, evaluation of both tracks, the gate of mutants."""

import json
import os

import pytest

from lodestone import __main__ as cli
from lodestone.clients.transport import Unavailable
from lodestone.plans.sample_programs import LOCKER, SIEVE


def embedded(text):
    return [float(text.lower().count("vault")), float(text.lower().count("cheese")), 0.1]


def server(method, url, body, headers, timeout):
    """An embedder, and a model that reports a missing signer where a handler's authority is a plain account."""
    asked = json.loads(body)
    if url.endswith("/api/embed"):
        return 200, json.dumps({"embeddings": [embedded(t) for t in asked["input"]]}).encode()
    if url.endswith("/api/generate"):
        user = asked["prompt"]
        handler = user.split("Review the handler `")[1].split("`")[0]
        cited = user.split("<")[1].split(">")[0]
        found = [{"class": "missing-signer", "severity": "high", "confidence": 0.8, "handler": handler, "line": 0, "evidence": "no signer", "citations": [cited]}] if "owner: AccountInfo" in user else []
        return 200, json.dumps({"response": json.dumps({"findings": found})}).encode()
    return 404, b""


def gone(method, url, body, headers, timeout):
    raise Unavailable("nobody there")


@pytest.fixture
def place(tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "TRANSPORT", server)
    for name, text in (("locker", LOCKER), ("sieve", SIEVE)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "lib.rs").write_text(text)
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/s.txt").write_text("# Vaults\n" + "a vault holds accounts of a signer " * 30 + "\n# Food\n" + "cheese and bread " * 40)
    (tmp_path / "m.toml").write_text('[[source]]\nid = "s"\nurl = "u"\ntitle = "T"\n')
    return tmp_path, ["--manifest", f"file:{tmp_path}/m.toml", "--cache", f"file:{tmp_path}/cache", "--index", f"file:{tmp_path}/index"]


def test_corpus_query_runs_the_dense_leg(spark, place, capsys, monkeypatch):
    tmp, where = place
    assert cli.main(["corpus", "index", *where, "--embedder", "e"]) == 0
    capsys.readouterr()
    assert cli.main(["corpus", "query", "vault", *where]) == 0
    out = capsys.readouterr().out
    top = out.split("\n")[0]
    assert "Vaults" in top and "dense 0." in top and "grounded: True" in out
    assert cli.main(["corpus", "query", "cheese", *where, "--top", "1"]) == 0
    out = capsys.readouterr().out
    assert "Food" in out.split("\n")[0] and "dense -" not in out
    # no score by place: words that stand nowhere are not grounded by the dense leg's nearest
    assert cli.main(["corpus", "query", "zebra", *where]) == 0
    assert "grounded: False" in capsys.readouterr().out
    monkeypatch.setattr(cli, "TRANSPORT", gone)
    assert cli.main(["corpus", "query", "vault", *where]) == 0
    out = capsys.readouterr().out
    assert "dense -" in out and "grounded: True" in out


def test_evaluation_of_tracks(spark, place, capsys):
    tmp, where = place
    assert cli.main(["corpus", "index", *where]) == 0
    past = tmp / "history.json"
    past.write_text("[]")
    at = ["--index", f"file:{tmp}/index", "--history", str(past)]
    table = {}
    for track in ("static", "all", "llm", "merged"):
        capsys.readouterr()
        assert cli.main(["eval", f"file:{tmp}/locker", "--track", track, "--run-id", track, *at]) == 0
        out = capsys.readouterr().out
        table[track] = {tuple(x.split()[:2]): x.split()[2] for x in out.split("\n") if "recall" in x}
        assert ("merged` is a view" in out) == (track == "merged") and "validity gate: 0 case(s) rejected" in out
    signer = [("missing-signer", v) for v in ("static", "llm", "merged")]
    n = table["all"]["missing-signer", "static"].split("/")[1]
    assert [table["all"][k] for k in signer] == [f"{n}/{n}"] * 3
    assert [table["llm"][k] for k in signer] == [f"0/{n}", f"{n}/{n}", f"{n}/{n}"]
    assert [table["static"][k] for k in signer] == [f"{n}/{n}", f"0/{n}", f"{n}/{n}"]
    assert table["merged"] == table["all"]
    runs = json.loads(past.read_text())
    assert [r["run_id"] for r in runs] == ["static", "all", "llm", "merged"] and "model" not in runs[0] and runs[1]["model"].startswith("local/") and len(runs[1]["corpus_hash"]) == 64
    assert all(r["cases_rejected"] == 0 and r["timestamp"] for r in runs)


def test_an_absent_model_is_no_zero(spark, place, monkeypatch):
    tmp, where = place
    assert cli.main(["corpus", "index", *where]) == 0
    past = tmp / "history.json"
    past.write_text("[]")
    monkeypatch.setattr(cli, "TRANSPORT", gone)
    with pytest.raises(cli.Absent):
        cli.main(["eval", f"file:{tmp}/locker", "--track", "all", "--index", f"file:{tmp}/index", "--history", str(past)])
    with pytest.raises(cli.Absent):
        cli.main(["eval", f"file:{tmp}/locker", "--track", "llm", "--index", f"file:{tmp}/nowhere", "--history", str(past)])
    assert json.loads(past.read_text()) == []


def test_mutate_moves_what_does_not_resolve(spark, place, capsys):
    tmp, _ = place
    assert cli.main(["mutate", str(tmp / "sieve"), str(tmp / "out")]) == 0
    out = capsys.readouterr().out
    moved = os.listdir(tmp / "out/rejected")
    assert moved and f"{len(moved)} case(s) rejected" in out and all(m.startswith("account_to_unchecked") for m in moved)
    assert not set(moved) & set(os.listdir(tmp / "out/cases"))
    assert cli.main(["mutate", str(tmp / "sieve"), str(tmp / "out"), "--no-check"]) == 0
    assert "skipped" in capsys.readouterr().out and not os.path.exists(tmp / "out/rejected")
    assert set(moved) <= set(os.listdir(tmp / "out/cases"))
