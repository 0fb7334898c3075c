"""Raw file streams with a quarantine, and model bundles."""

import gzip
import json
import os
import tempfile

import numpy as np
import pytest

from sevscope import bundle
from sevscope.config import preset
from sevscope.operators import fusion, logistic
from sevscope.sources import raw
from sevscope.sources.tickets import tickets
from sevscope.streaming import score

HEADER = "Ticket ID, Ticket Subject,ticket_description,ticket_channel,Issue Category,Priority_Level,Resolution Time"
CFG = preset("documented")


def _scored(spark, folder, fmt, out):
    good, bad = score.stream_raw(spark, folder, fmt, lambda t: score.score_fixed(t, CFG), ("ticket_id", "ticket_priority", "severity_delta"),
                                 "t", out=out)
    return (sorted((r.ticket_id, r.ticket_priority) for r in good.collect()),
            sorted((r.record, r.file) for r in bad.collect()))


def test_csv_stream_quarantines_and_restarts_exactly_once(spark):
    folder, out = tempfile.mkdtemp(), tempfile.mkdtemp() + "/out"
    with open(f"{folder}/a.csv", "w") as f:
        f.write(HEADER + '\nT1,"urgent, down",x,email,t, High ,2 days\nT2,NA,,,t,low,\nBROKEN,7\n1,2,3,4,5,6,7,8,9\n')
    good = [("T1", "high"), ("T2", "low")]
    bad = [("1,2,3,4,5,6,7,8,9", "a.csv"), ("BROKEN,7", "a.csv")]
    for _ in range(2):          # the second run finds nothing new
        assert _scored(spark, folder, "csv", out) == (good, bad)
    with open(f"{folder}/b.csv", "w") as f:
        f.write(HEADER + "\nT3,s,d,email,t,medium,1\nx\n")
    assert _scored(spark, folder, "csv", out) == ([*good, ("T3", "medium")], [*bad, ("x", "b.csv")])


def test_json_stream_quarantines_broken_lines(spark):
    folder, out = tempfile.mkdtemp(), tempfile.mkdtemp() + "/out"
    row = {"Ticket ID": 1, " Ticket Subject": "s", "ticket_description": "line\nbreak", "ticket_channel": None,
           "Priority_Level": "HIGH", "Resolution Time": "3 hours"}
    with open(f"{folder}/a.json", "w") as f:
        f.write(json.dumps(row) + "\n{not json\n" + json.dumps({**row, "Ticket ID": 2}) + '\n{"Ticket ID": 3, "Tick\n')
    assert _scored(spark, folder, "json", out) == (
        [("1", "high"), ("2", "high")], sorted([("{not json", "a.json"), ('{"Ticket ID": 3, "Tick', "a.json")]))


def test_json_names_are_found_behind_larger_files_of_broken_lines(spark):
    folder, out = tempfile.mkdtemp(), tempfile.mkdtemp() + "/out"
    row = {"Ticket ID": 1, "Ticket Subject": "s", "ticket_description": "d" * 5_000, "ticket_channel": None,
           "Priority_Level": "HIGH", "Resolution Time": "3 hours"}
    with gzip.open(f"{folder}/a.json.gz", "wt") as f:
        f.writelines(json.dumps({**row, "Ticket ID": k}) + "\n" for k in range(3))
    for k in range(4):          # larger than the packed file, though it reads as more
        with open(f"{folder}/b{k}.json", "w") as f:
            f.writelines(f'{{"Ticket ID": {n}, "BROKEN\n' for n in range(100))
    good, bad = _scored(spark, folder, "json", out)
    assert good == [("0", "high"), ("1", "high"), ("2", "high")] and len(bad) == 400


def test_raw_streams_refuse_what_they_cannot_read(spark):
    folder = tempfile.mkdtemp()
    with pytest.raises(ValueError):
        raw.raw_ticket_stream(spark, folder, "xml")
    with pytest.raises(ValueError):
        raw.raw_schema(spark, folder, "json")
    with open(f"{folder}/a.csv", "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError, match="ticket_subject"):
        raw.raw_ticket_stream(spark, folder, "csv")


@pytest.fixture(scope="module")
def models(spark, small_dir):
    a = fusion.audit(tickets(spark, small_dir), CFG)
    c = logistic.TextClassifier(1 << 10, np.array([1, 5]), ["email"], np.array([0.5, -1.0, 0.25, 0.1, -0.2]), 0.1, 3)
    return a.model, c


def test_newest_committed_version_is_loaded(spark, models):
    path = tempfile.mkdtemp()
    with pytest.raises(bundle.BundleError):
        bundle.load(spark, path)
    one, two = (bundle.save(spark, path, *models) for _ in range(2))
    assert bundle.versions(spark, path) == [one, two]
    got = bundle.load(spark, path)
    assert got.version == two and got.signal_model.to_json() == models[0].to_json()
    assert got.classifier.weights.tolist() == models[1].weights.tolist() and got.classifier.channels == ["email"]
    assert bundle.load(spark, path, one).version == one


def test_a_stop_between_the_writes_leaves_the_version_before(spark, models, monkeypatch):
    path = tempfile.mkdtemp()
    done = bundle.save(spark, path, *models)
    for step in ("classifier", "manifest"):
        with monkeypatch.context() as m:
            def stop(*_):
                raise KeyboardInterrupt
            m.setattr(logistic.TextClassifier, "save", stop) if step == "classifier" else m.setattr(bundle, "commit", stop)
            with pytest.raises(KeyboardInterrupt):
                bundle.save(spark, path, *models)
        assert bundle.load(spark, path).version == done
    half = max(v for v in os.listdir(path) if v.startswith("v-"))
    assert half != done
    with pytest.raises(bundle.BundleError):
        bundle.load(spark, path, half)


def test_mixed_or_damaged_files_are_refused(spark, models):
    path = tempfile.mkdtemp()
    version = bundle.save(spark, path, *models)
    meta = [f"{path}/{version}/classifier/meta/{f}" for f in os.listdir(f"{path}/{version}/classifier/meta") if f.endswith(".txt")]
    with open(meta[0]) as f:
        text = f.read()
    with open(meta[0], "w") as f:
        f.write(text.replace("0.1", "0.2"))
    os.path.exists(os.path.join(os.path.dirname(meta[0]), "." + os.path.basename(meta[0]) + ".crc")) and os.remove(
        os.path.join(os.path.dirname(meta[0]), "." + os.path.basename(meta[0]) + ".crc"))
    with pytest.raises(bundle.BundleError):
        bundle.load(spark, path)
