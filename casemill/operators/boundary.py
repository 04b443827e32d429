"""The privacy boundary: payloads sealed by identity path, texts sealed and swept, one more round, else rejected."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import recognizers
from casemill.functions.text import ALPHABET, PLACEHOLDER, TOKEN_LENGTH, is_blank, normal_text_map

from .context import IdentityField, check_identity
from .redact import sealed

ENTRIES = T.ArrayType(T.StructType().add("path", T.StringType()).add("kind", T.StringType()).add("value", T.StringType()).add("token", T.StringType()))
HELD = re.compile(PLACEHOLDER)
SEALED = T.StructType().add("payload", T.StringType()).add("entries", ENTRIES)


def token_of(kind: str, case: str, value: str, salt: str) -> str:
    """The same placeholder as :func:`casemill.operators.redact.token` makes of columns."""
    digest = hashlib.sha256("|".join((salt, case, kind, value)).encode()).hexdigest()
    return f"[[PII|{kind}|" + "".join(ALPHABET[int(digest[5 * i : 5 * i + 5], 16) % len(ALPHABET)] for i in range(TOKEN_LENGTH)) + "]]"


def _compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def seal_one(payload: str, case: str, fields: Sequence[IdentityField], salt: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """The payload with identity values replaced, and the entries; sealing a sealed payload again changes nothing.

    A subtree is one entry with its JSON text as the value.  Absent, null, blank and empty values stay as they are.
    """
    working, entries = json.loads(payload), []
    for f in fields:
        *above, key = f.path.split(".")
        parent = working
        for step in above:
            parent = parent.get(step) if isinstance(parent, dict) else None
        if not isinstance(parent, dict) or key not in parent:
            continue
        raw = parent[key]
        if isinstance(raw, dict):
            if not f.subtree or not raw:
                continue
            value = _compact(raw)
        elif raw is None or isinstance(raw, list):
            continue
        else:
            value = _compact(raw) if isinstance(raw, bool) else str(raw).strip()
            if not value or HELD.fullmatch(value):
                continue
        parent[key] = token_of(f.kind, case, value, salt)
        entries.append((f.path, f.kind, value, parent[key]))
    return _compact(working), entries


def sealed_payload(df: DataFrame, case: str, payload: str, fields: Sequence[IdentityField], salt: str) -> DataFrame:
    """Adds ``sealed_payload`` and ``payload_entries`` (path, kind, value, token)."""
    check_identity(fields)

    @F.pandas_udf(SEALED)
    def seal(raw: pd.Series, key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, []) if x is None else seal_one(x, k, fields, salt) for x, k in zip(raw, key, strict=True)], columns=["payload", "entries"])

    df = df.withColumn("_sealed", seal(payload, F.col(case).cast("string")))
    return df.withColumns({"sealed_payload": F.col("_sealed.payload"), "payload_entries": F.col("_sealed.entries")}).drop("_sealed")


def passed(df: DataFrame, case: str, text: str, salt: str) -> DataFrame:
    """Adds ``entries``, ``sealed_text`` and ``outcome``: clean, sealed or rejected.

    What a sweep still finds in the sealed text is sealed in one more round; if the sweep finds something after that,
    the case is rejected, and no text of it comes out.
    """
    first = sealed(df, case, text, salt).withColumnsRenamed({"sealed_text": "_text", "entries": "_entries", "refused": "_refused"})
    again = F.when(F.col("_refused"), F.col("_text"))
    second = sealed(first.withColumn("_again", again), case, "_again", salt)
    both = F.array_union("_entries", F.filter("entries", lambda e: ~e["value"].rlike(PLACEHOLDER)))
    second = second.withColumns({"entries": F.when(F.col("_refused"), both).otherwise(F.col("_entries")), "sealed_text": F.when(F.col("_refused"), F.col("sealed_text")).otherwise(F.col("_text"))})
    second = second.withColumn("outcome", F.when(F.col("_refused") & F.col("refused"), "rejected").when(F.size("entries") > 0, "sealed").otherwise("clean"))
    return second.withColumn("sealed_text", F.when(F.col("outcome") != "rejected", F.col("sealed_text"))).drop("_text", "_entries", "_refused", "_again", "refused")


def rejected(passed_cases: DataFrame, case: str) -> DataFrame:
    """The table of refused cases: ids only."""
    return passed_cases.where("outcome = 'rejected'").select(case)


def text_layer(parts: DataFrame, text: str) -> DataFrame:
    """Text parts with ``normalized`` (text, and the way back); blank parts are left out."""
    return parts.where(~is_blank(F.col(text))).withColumn("normalized", normal_text_map(text))


def span_rows(docs: DataFrame, key: str, text: str, profile: str = recognizers.REDACT) -> DataFrame:
    """(key, start, end, kind, name, evidence): a row for each span of personal data; values stay inside."""
    found = recognizers.spans(docs.select(key, F.col(text).alias("_text")), "_text", "_spans", profile)
    return found.select(key, F.explode("_spans").alias("s")).select(key, *[f"s.{c}" for c in ("start", "end", "kind", "name", "evidence")])
