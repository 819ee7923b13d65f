"""A scan of a small tree: every detector is in it, ids are single, ignored paths are out."""

import json

from ashlar.operators import scan

KEY = "sk-ant-" + "aB3dE6gH9jK2mN5pQ8sT"
CODE = f'''import openai
from anthropic import Anthropic
client = Anthropic()
password = "h7Gk29sLpqZw"
data = open("a.txt").read()
prompt = data
out = client.messages.create(prompt=data)
token = "aB3$kL9!mQ2@xZ7#pW5%rT8&yU1"
KEY_TOKEN = "{KEY}"
'''
BOOK = {"cells": [{"cell_type": "code", "source": "c = OpenAI()\nc.invoke(1)", "outputs": [{"text": "password: 1"}]}]}


def found(spark, rows, **how):
    return scan.scan(spark.createDataFrame(rows, "repo string, path string, content string"), **how)


def test_every_detector_and_single_ids(spark):
    rows = [
        ("r", "src/a.py", CODE), ("r", "src/b.py", "from a import client, KEY_TOKEN\nclient.create(x)"), ("r", "web/app.min.js", f"var k='{'AKIA' + 'Z' * 16}'"), ("r", "nb.ipynb", json.dumps(BOOK)),
        ("r", "conf/app.yaml", "OPENAI_API_KEY: abcdefg12345"), ("r", "vendor/x.py", CODE), ("r", "tests/t.py", CODE), ("r", "null.py", None), ("r", "empty.py", ""), ("r", "src/a.py", CODE),
    ]
    got = found(spark, rows, ignore=("vendor/",)).collect()
    assert {g["detector"] for g in got} == set(scan.DETECTORS)
    ids = [g["id"] for g in got]
    assert len(ids) == len(set(ids)) and not any(g["path"].startswith("vendor") for g in got)
    by = {(g["path"], g["detector"], g["rule"]): g for g in got}
    assert by["src/a.py", "symbol", "anthropic"]["line"] == 7 and by["src/a.py", "flow", "file_content_to_llm"]["line"] == 5
    assert by["src/a.py", "correlation", "secret_ai_correlation"]["severity"] == 1 and by["src/b.py", "client", "anthropic"]["match"] == "client"
    assert by["src/b.py", "credential", "cross_file_credential"]["policy_status"] == "CRITICAL" and by["web/app.min.js", "bundle", "minified_bundle_secret"]["severity"] == 1
    assert ("nb.ipynb::cell[1]", "notebook", "openai") in by and ("nb.ipynb::cell[1]", "notebook", "notebook_output_secret") in by
    assert by["tests/t.py", "rule", "hardcoded_credential"]["severity"] == 3 and by["src/a.py", "rule", "openai"]["corroboration"] >= 5
    assert by["src/a.py", "rule", "openai"]["confidence"] > by["conf/app.yaml", "rule", "env_file_key"]["confidence"] - 60


def test_judged_and_delta(spark):
    rows = [("r", "src/a.py", CODE), ("r", "docs/a.md", "see openai")]
    got = found(spark, rows)
    ids = sorted(r["id"] for r in got.select("id").collect())
    base = spark.createDataFrame([(ids[0], "kept"), ("gone", "left")], "id string, note string")
    lists = spark.createDataFrame([("openai", "banned")], "rule string, policy_list string")
    triage = spark.createDataFrame([(ids[1], "accepted_risk")], "hash string, status string")
    out = {r["id"]: r for r in scan.judged(got, lists, triage, base).collect()}
    assert [i for i in ids if out[i]["delta_status"] == "unchanged"] == ids[:1] and out[ids[1]]["triage_status"] == "accepted_risk"
    assert {r["policy_status"] for r in out.values() if r["rule"] == "openai" and r["detector"] == "rule"} == {"BANNED"}
    assert all(0 <= r["overall"] <= 100 and r["severity_label"].startswith("Sev-") for r in out.values())
    assert [r["note"] for r in scan.delta_fixed(got, base).collect()] == ["left"]


def test_scan_of_nothing(spark):
    assert found(spark, []).count() == 0
