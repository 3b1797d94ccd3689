"""Small JSON inputs for rule tests, and a way to run many mutations of one input in a single job."""

import hashlib
import json

from pyspark.sql import functions as F


def mutated(base, changes):
    """(name, JSON text) of the base value and of each change applied to a copy of it."""
    rows = [("valid", json.dumps(base))]
    for name, change in changes.items():
        value = json.loads(json.dumps(base))
        change(value)
        rows.append((name, json.dumps(value)))
    return rows


def by_scope(violations):
    """{scope: set of rule ids} of a violations DataFrame."""
    rows = violations.groupBy("scope").agg(F.collect_set("ruleId").alias("rules")).collect()
    return {row.scope: set(row.rules) for row in rows}


def digest(value):
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(f"{text}\n".encode()).hexdigest()


def native_request():
    model = {"provider": "p", "name": "m", "version": "v1", "decoding": {"temperature": 0}, "seed": 5}
    call = {"id": "c1", "name": "lookup", "arguments": {"q": "bread"}}
    return {
        "requestId": "r1", "model": model, "decodingSettings": {"temperature": 0}, "seed": 5,
        "messages": [
            {"role": "system", "content": "rules"},
            {"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image", "ref": 3}]},
            {"role": "assistant", "content": None, "toolCalls": [call]},
            {"role": "tool", "content": "{\"found\": 2}", "toolCallId": "c1"}],
        "tools": [{"name": "lookup", "description": "", "parameters": {}}],
        "toolCalls": [call], "toolResults": [{"toolCallId": "c1", "result": {"found": 2}}],
        "tierSegments": [
            {"tier": "stable", "content": "rules", "tokenCount": 5, "messageIndices": [0]},
            {"tier": "unstable", "content": "rest", "tokenCount": 9, "messageIndices": [1, 2, 3],
             "toolNames": ["lookup"], "sourceIds": ["t-1"]}]}


def report_manifest():
    sha = "ab" * 32
    model = {"provider": "p", "name": "m", "version": "v1", "decoding": {"temperature": 0.5}, "deterministic": None}
    source_model = {k: v for k, v in model.items() if k != "deterministic"}
    base = {
        "runId": "run", "adapter": {"name": "a", "revision": "1", "contractVersion": "2.0"},
        "tokenizer": {"name": "t", "version": "1"}, "stablePrefix": ["contract"], "seed": 3, "harnessHash": sha,
        "fixtureHash": sha, "rateLimitRpm": 60, "probeTimeoutSeconds": 1.5, "nativeModelEnvelopeVersion": "1.0",
        "concurrency": {"mode": "solo", "factor": 1}}
    source = dict(base, model=source_model, scorerVersion="0.9")
    files = {"manifest.json": sha, "probes.json": sha, "review.json": sha}
    manifest = dict(
        base, model=model, scorerVersion="1.0.0", sourceScorerVersion="0.9", schemaVersion="report-1.0",
        runtime={"name": "a", "revision": "1"}, stablePrefixHash=digest(["contract"]), timestamp="2026-01-01T00:00:00Z",
        scoredAt="2026-01-02T00:00:00+02:00", fixtureId="fx", fixtureSeed=3, generatorVersion="1.0.0",
        configHash=digest(source), sourceConfiguration=source, sessionCount=10,
        results={"status": "completed", "valid": True, "totalCount": 4, "answeredCount": 2, "accuracyDenominator": 2,
                 "incompleteCount": 1, "completionRate": 0.5, "investigationRequired": True, "unattemptedCount": 0,
                 "failureCounts": {"budget": 1, "provider": 0, "adapter": 0, "timeout": 1},
                 "lastCompletedSession": 10, "requestCount": 2},
        recovery={"resumed": False, "checkpointSession": 0, "nextSession": 1},
        everyRequestTierTotals=[{"requestId": f"r{i}", "totalTokens": 5, "tierTokens": {"stable": 1, "semi-stable": 0, "unstable": 3}}
                                for i in (1, 2)],
        sourceManifestHash=sha, scorerHash=sha, judge=None, canonical=False,
        calibration={"approved": True, "calibrationHashes": files, "scorerVersion": "1.0.0"}, calibrationHashes=files,
        actualRunTimeSeconds=4.0, effectiveThroughputRequestsPerSecond=0.5, artifactSizeBytes=10,
        interruptionResumeHistory=[], providerVersionPinned=None,
        artifactHashes={n: sha for n in ("probes.jsonl", "requests.jsonl", "scores.jsonl", "report.json")}, warnings=[])
    manifest["scoringHash"] = digest({k: manifest[k] for k in (
        "sourceManifestHash", "fixtureHash", "scorerVersion", "scorerHash", "judge", "calibrationHashes", "canonical")})
    return manifest
