"""Canonical JSON and content hashes."""

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(column):
    """Compact JSON with sorted keys and a final newline.

    A VARIANT writes its object keys in sorted order.  Number text is Spark's (1.0 becomes 1), so
    bytes equal an archive's own for strings, booleans, nulls and integers; ``archived_digest``
    reproduces archives that hold fractional numbers.
    """
    return F.concat(F.to_json(F.try_parse_json(column)), F.lit("\n"))


def digest(column):
    """SHA-256 of the canonical form of JSON text."""
    return F.sha2(canonical_json(column), 256)


@F.pandas_udf(T.StringType())
def archived_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of canonical JSON with the archive's own number text, for rows that carry floats."""
    def one(text):
        value = json.loads(text)
        body = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False,
                          allow_nan=False)
        return hashlib.sha256(f"{body}\n".encode()).hexdigest()
    return texts.map(one, na_action="ignore")


def struct_digest(*columns):
    """Hash identity of a row's named columns, in the given order.

    For identities that only have to agree with themselves: fields are length-delimited by the JSON
    quoting, missing values stay visible as null.
    """
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def prefix_hash(prefix):
    """Per-request stable-prefix hash: compact JSON array without a newline."""
    return F.sha2(F.to_json(prefix), 256)


def manifest_prefix_hash(prefix):
    """Manifest stable-prefix hash: canonical JSON array with a newline."""
    return F.sha2(F.concat(F.to_json(prefix), F.lit("\n")), 256)


def run_directory(run_id, config_hash):
    """Directory name of a run: 16 hex digits of its id, a dash and the configuration hash."""
    return F.concat(F.substring(F.sha2(run_id, 256), 1, 16), F.lit("-"), config_hash)


def same_json(left, right):
    """Structural JSON equality that ignores key order."""
    return F.to_json(F.try_parse_json(left)).eqNullSafe(F.to_json(F.try_parse_json(right)))


def projection_digest(fields):
    """An Arrow function: archived digest of the given fields of JSON objects, absent ones left out."""
    wanted = tuple(fields)

    @F.pandas_udf(T.StringType())
    def digest_fields(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text)
                body = json.dumps({name: value[name] for name in wanted if name in value}, sort_keys=True,
                                  separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            except (ValueError, TypeError):
                return None
            return hashlib.sha256(f"{body}\n".encode()).hexdigest()
        return texts.map(one, na_action="ignore")
    return digest_fields
