"""The seeded corpus, read back by the parsers, and the commands over it."""

import json

import pytest

from strataledger.__main__ import main, parser, settings_of
from strataledger.operators import briefs as B
from strataledger.operators import evaluation as E
from strataledger.plans.archive import read_reports
from strataledger.sources import synthetic as S
from strataledger.sources.pdf import pdf_pages


@pytest.fixture(scope="module")
def made(spark):
    return {k: d.cache() for k, d in S.corpus(spark, seed=7).items()}


@pytest.fixture(scope="module")
def archive(made):
    return read_reports(made["docs"])


def test_streams_and_schedule():
    one = S.TENANTS[0]
    assert S.simulate(one, 3, 7) == S.simulate(one, 3, 7) != S.simulate(one, 3, 8)
    days = [(S.schedule(one, k)[0], S.schedule(one, k)[2]) for k in range(8)]
    assert len(set(days)) == 8


def test_ledger_is_what_was_made(made, archive):
    found = E.ledger_parity(archive.ledger, made["events"]).first()
    assert (found.precision, found.recall) == (1.0, 1.0) and found.matched > 60
    again = S.corpus(made["docs"].sparkSession, seed=7)["docs"]
    assert again.exceptAll(made["docs"]).isEmpty()


def test_sentences_have_the_kinds_they_were_made_with(made):
    from strataledger.operators.mitigations import sentence_kind

    rows = made["sentences"].select("label", sentence_kind(made["sentences"]["text"]).alias("kind")).collect()
    assert all(r.label == r.kind for r in rows if r.label != "failure") and {r.label for r in rows} == {"practice", "failure", "neutral"}


def test_planted_patterns_are_found(made, archive):
    brief = B.build_brief(archive, "VES-200", "Vessra", 3500.0)
    keys = [r.asDict() for r in made["patterns"].where("tenant = 'Vessra'").collect()]
    assert E.brief_figures(brief["risks"], keys)["recall"] == 1.0 and brief["verification"]["ok"]
    rig = next(k for k in keys if k["rig"])
    assert E.driver_named(brief["risks"], rig)


def test_pdf_round_trip():
    text = S.daily_text(S.simulate(S.TENANTS[0], 0, 7)[0]) + "\nlast (line) \\ ½"
    assert S.pdf_bytes(text) == S.pdf_bytes(text)
    assert "last (line) \\ ½" in "\n".join(pdf_pages(S.pdf_bytes(text, 10)))


def test_commands(spark, tmp_path, capsys):
    folder, root = tmp_path / "in", f"file://{tmp_path}/root"
    folder.mkdir()
    tenant = S.TENANTS[1]
    for k in range(2):
        days = S.simulate(tenant, k, 7)
        for r in days:
            (folder / f"DDR-{r['entity']}-{r['n']:03d}.txt").write_text(S.daily_text(r))
        for name, _, text, _ in S.write_up(tenant, days):
            (folder / f"{name}.pdf").write_bytes(S.pdf_bytes(text)) if name.startswith("EOWR") else (folder / f"{name}.txt").write_text(text)

    def command(*args):
        code = main(["--root", root, *args], spark)
        return code, capsys.readouterr().out

    assert main(["--root", root, "status"], spark) == 1
    code, out = command("ingest", f"file://{folder}")
    assert code == 0 and sum(json.loads(out)["read"].values()) == len(list(folder.iterdir()))
    code, out = command("npt", "--by", "code")
    assert code == 0 and sum(r["n_events"] for r in json.loads(out)) == sum(len(r["entries"]) for k in range(2) for r in S.simulate(tenant, k, 7))
    assert command("index")[0] == 0
    code, out = command("status")
    assert {r["tenant"]: r["stale"] for r in json.loads(out)} == {"Vessra": False}
    bad = tmp_path / "bad.toml"
    bad.write_text("[risk]\nnone = 1")
    assert main(["--root", root, "--settings", str(bad), "status"], spark) == 1
    own = tmp_path / "root" / "strataledger.toml"
    own.write_text("[retrieval]\ntop_k = 5\nk1 = 1.25")
    (folder / "strataledger.toml").write_text("[retrieval]\nk1 = 1.75\n[costs]\nspread_rate = 5.0")
    args = parser().parse_args(["--root", root, "--set", "costs.spread_rate = 7", "ingest", f"file://{folder}"])
    found = settings_of(spark, args, {"STRATALEDGER_SPREAD_RATE": "6"})
    assert (found.retrieval.top_k, found.retrieval.k1, found.costs.spread_rate) == (5, 1.75, 7.0)
    assert command("--set", "risk.none = 1", "status")[0] == 1
