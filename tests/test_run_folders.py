"""Logs of runs in every layout and in several at once, and the latest artifacts."""

import csv
import json

from chartmill.sources import run_folders as R


def table(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        writer = csv.DictWriter(f, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)


def note(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_stages_by_layout(spark, tmp_path):
    root = tmp_path / "runs (all)"
    table(root / "new" / "stages.csv", {"execution_index": 1, "node_name": "prepare", "duration_seconds": 1.0, "total_tokens": 3}, {"execution_index": 2, "node_name": "draw", "duration_seconds": "", "total_tokens": "4.9"})
    table(root / "new" / "stage_timings.csv", {"execution_index": 1, "node_name": "old"})
    note(root / "new" / "stage_executions" / "1.json", {"node_name": "older"})
    table(root / "split" / "stage_timings.csv", {"execution_index": 1, "node_name": "a", "duration_seconds": 2.0, "total_tokens": 1}, {"execution_index": "", "node_name": "no key", "duration_seconds": 9, "total_tokens": 9})
    table(root / "split" / "stage_tokens.csv", {"execution_index": 1, "node_name": "", "total_tokens": 9}, {"execution_index": 2, "node_name": "b", "total_tokens": "many"})
    (root / "json").mkdir()
    (root / "json" / "stages.csv").write_text("execution_index,node_name\n")  # a table without rows gives way
    note(root / "json" / "artifacts" / "deep" / "003_stage_execution_1.json", {"node_name": "c", "duration_seconds": 0.5, "token_usage": {"total_tokens": 7}})
    note(root / "json" / "artifacts" / "004_stage_execution_2.json", [1])
    note(root / "json" / "artifacts" / "005_stage_execution_3.json", "{broken")
    note(root / "json" / "stage_executions" / "1.json", {"node_name": "less"})
    note(root / "last" / "stage_executions" / "1.json", {"node_name": "d"})
    note(root / "none" / "other.json", {})
    table(root / "stages.csv", {"execution_index": 1, "node_name": "not in a run"})
    logs = R.run_logs(spark, str(root), R.STAGES)
    got = {r["run"]: (r["layout"], r["stage_count"], r["stage_total_tokens"], r["stage_duration_seconds"]) for r in R.stage_summary(logs).collect()}
    assert got == {"new": (0, 2, 7, 1.0), "split": (1, 2, 9, 2.0), "json": (2, 1, 7, 0.5), "last": (3, 1, 0, 0.0)}
    split = {r["place"]: (json.loads(r["record"].toJson()), r["file"]) for r in logs.where("run = 'split'").collect()}
    assert split[1][0] == {"execution_index": "1", "node_name": "a", "duration_seconds": "2.0", "total_tokens": "9"} and split[2][0]["node_name"] == "b" and split[1][1] == "stage_timings.csv+stage_tokens.csv"


def test_model_calls_by_layout(spark, tmp_path):
    table(tmp_path / "a" / "model_calls.csv", {"call_index": 1, "prompt_tokens": 2, "completion_tokens": "", "total_tokens": 2})
    note(tmp_path / "a" / "model_calls" / "1.json", {"token_usage": {"prompt_tokens": 50}})
    note(tmp_path / "b" / "model_calls" / "1.json", {"token_usage": {"prompt_tokens": 5}})
    note(tmp_path / "b" / "model_calls" / "deep" / "2.json", {"token_usage": {"prompt_tokens": 6}})
    table(tmp_path / "c" / "model_call_tokens.csv", {"call_index": 1, "prompt_tokens": 8})
    note(tmp_path / "d" / "artifacts" / "model_call_logs.json", [{"token_usage": {"prompt_tokens": 1}}, 3, {"token_usage": {"prompt_tokens": 4}}])
    note(tmp_path / "e" / "artifacts" / "model_call_logs.json", {"no": "list"})
    got = sorted((r["run"], r["layout"], r["file"], r["prompt_tokens"]) for r in R.run_logs(spark, str(tmp_path), R.CALLS).collect())
    logs = "artifacts/model_call_logs.json"
    assert got == [("a", 0, "model_calls.csv", 2), ("b", 1, "model_calls/1.json", 5), ("c", 2, "model_call_tokens.csv+model_call_timings.csv", 8), ("d", 3, f"{logs}#1", 1), ("d", 3, f"{logs}#3", 4)]


def test_latest_artifacts(spark, tmp_path):
    note(tmp_path / "a" / "nodes" / "002_spec.json", {"n": 2})
    note(tmp_path / "a" / "nodes" / "012_spec_semantic_001_technical_002.json", {"n": 12})
    note(tmp_path / "a" / "nodes" / "020_specification.json", {"n": 20})
    note(tmp_path / "a" / "model_calls" / "999_spec.json", {"n": 999})
    note(tmp_path / "a" / "nodes" / "07_spec.json", {"n": 7})  # two digits are part of the name
    note(tmp_path / "b" / "nodes-1" / "900_spec.json", {"n": 1})
    note(tmp_path / "b" / "nodes" / "001_spec_attempt_1.json", {"n": 2})
    note(tmp_path / "c" / "001_spec.json", {"n": 1})
    note(tmp_path / "c" / "002_spec.json", "{broken")
    note(tmp_path / "c" / "plan.json", {"n": 3})
    got = sorted((r["run"], r["name"], r["file"], r["payload"] and json.loads(r["payload"].toJson())["n"]) for r in R.latest_artifacts(spark, str(tmp_path), ["spec", "plan"]).collect())
    assert got == [("a", "spec", "nodes/012_spec_semantic_001_technical_002.json", 12), ("b", "spec", "nodes-1/900_spec.json", 1), ("c", "plan", "plan.json", 3), ("c", "spec", "002_spec.json", None)]
