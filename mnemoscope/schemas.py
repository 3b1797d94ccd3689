"""Fixed table schemas; nothing is inferred from data.

Open JSON values (model, decoding, arguments, judge output) stay JSON text or VARIANT.
"""

from pyspark.sql import types as T

EXPECTED = """struct<matchType:string, acceptedAnswers:array<string>, requiredFactIds:array<string>,
 forbiddenFactIds:array<string>, targetNumber:string, tolerance:string, toleranceMode:string,
 items:array<string>, rubric:string, requiredClaims:array<string>,
 disallowedContradictions:array<string>>"""

TURN = """struct<turnId:string, role:string, text:string, introducedFactIds:array<string>,
 referencedFactIds:array<string>, topicId:string>"""

FACT = """struct<factId:string, value:string, state:string, introducedAt:string, supersedes:string,
 invalidatedAt:string, topicId:string>"""

PROBE = f"""struct<probeId:string, afterSessionId:string, question:string, ability:string,
 answerability:boolean, answerAsOf:string, sessionDistance:int, expected:{EXPECTED}>"""

FIXTURE = f"""schemaVersion string, generatorVersion string, fixtureId string, seed bigint,
 contentHash string, sessions array<struct<sessionId:string, timestamp:string, turns:array<{TURN}>>>,
 facts array<{FACT}>, probes array<{PROBE}>"""

SEGMENT = """struct<tier:string, content:string, tokenCount:bigint, sourceIds:array<string>,
 messageIndices:array<int>, toolNames:array<string>>"""

RETRY = """struct<attempt:int, status:string, error:string, rateWaitSeconds:double,
 backoffSeconds:double>"""

TIER_TOKENS = "struct<stable:bigint, `semi-stable`:bigint, unstable:bigint>"

# Columns of an archived request that the metrics need; the bulky message payload is one separate
# JSON column so that column pruning skips it.
REQUEST = f"""runId string, requestId string, sessionId string, turnId string, probeId string,
 messages string, tools string, tierSegments array<{SEGMENT}>, model string,
 decodingSettings string, seed bigint, tierTokens {TIER_TOKENS}, totalTokens bigint,
 requestOverheadTokens bigint, stablePrefixHash string, status string, category string,
 latencyMs double, attempts int, waitSeconds double, retryHistory array<{RETRY}>,
 providerTokens bigint, modelVersion string, answer string, response string"""

CAPTURED = """runId string, sessionId string, probeId string, timestamp string, latencyMs double,
 status string, category string, error string, requestIds array<string>, answer string,
 eligibleForAccuracy boolean, sourceIds array<string>"""

EVENT = """runId string, position bigint, type string, timestamp string, sessionId string,
 sessionIndex int, turnId string, probeId string, status string, latencyMs double,
 category string, error string, lastCompletedSession int, nextSession int, reason string"""

SCORE = """runId string, probeId string, rawAnswer string, matchingMethod string, judgment string,
 correct boolean, normalizedAnswer string, judgeOutput string, eligibleForAccuracy boolean,
 failureCategory string, fixtureHash string, manifestHash string, scorerVersion string"""


def struct(ddl):
    """The StructType of a column list written as DDL."""
    return T.StructType.fromDDL(ddl)
