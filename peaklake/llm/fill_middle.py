"""Operator 12: fill-in-the-middle with a sparse exception index between code points and bytes.

Texts stay UTF-8 bytes as Arrow hands them over. For each text only the multibyte characters are recorded: their code
point, their byte and how many bytes beyond one all of them up to there took. A cut between code points and bytes is
then the same number plus the excess found by ``searchsorted``; spans of ASCII need no entry and are plain arithmetic.

Units are tokens (white space and the word after it; white space at the end is one more) or code points. The ends of
tokens are found as bytes and named as code points, cuts in code points are named as bytes: the index serves both ways.

A document is cut twice and put together in the order suffix-prefix-middle (``spm``) or prefix-suffix-middle (``psm``),
each part behind its mark; the draws are digits of the SHA-256 of seed and id, so a task that runs again draws the same.
Texts are handled in slices of about a megabyte; nothing is shuffled.

Defined results: a null text counts as an empty one; empty texts and texts that contain a mark stay plain, with null
cuts; a null id draws like an empty one; repeated rows and ids are cut alike; very long texts are slices of their own;
cuts may fall on either end, so that any part may be empty; an empty table gives no rows; the columns of the input are kept but for those
named like a result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peaklake.llm.common import byte_batches, text_bytes, text_or_empty

# The marks and the draws of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80

RESULT = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "prefix_bytes": "bigint", "middle_bytes": "bigint", "output": "string"}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Rule:
    """What is cut how often: ``unit`` is ``token`` or ``char``."""

    unit: str = "token"
    seed: int = SEED
    fim_percent: int = FIM_PERCENT
    spm_percent: int = SPM_PERCENT

    def __post_init__(self):
        if self.unit not in ("token", "char"):
            raise ValueError(f"unit {self.unit!r} is neither 'token' nor 'char'")


class ExceptionIndex:
    """The multibyte characters of one text: positions in code points and bytes, and the excess bytes so far."""

    def __init__(self, data: np.ndarray):
        self.n_bytes = len(data)
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)
        self.chars = self.bytes - self._before(np.arange(len(self.bytes)))
        self.n_chars = self.n_bytes - (int(self.excess[-1]) if len(self.excess) else 0)

    def _before(self, entries: np.ndarray) -> np.ndarray:
        """Excess bytes of all entries before these."""
        return np.where(entries > 0, self.excess[entries - 1], 0) if len(self.excess) else np.zeros(len(entries), np.int64)

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        chars = np.asarray(chars, np.int64)
        return chars + self._before(np.searchsorted(self.chars, chars, "left"))

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before these bytes, each of which begins a character or ends the text."""
        cuts = np.asarray(cuts, np.int64)
        return cuts - self._before(np.searchsorted(self.bytes, cuts, "left"))


def token_ends(data: np.ndarray) -> np.ndarray:
    """The byte behind each token."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data))


def _cut(data: np.ndarray, h: list[int], rule: Rule) -> tuple:
    """(units, form, prefix and middle in code points, in bytes, output) of one text."""
    if rule.unit == "token":
        ends, index = token_ends(data), None
        n = len(ends)
    else:
        index = ExceptionIndex(data)
        n = index.n_chars
    raw = data.tobytes()
    if not raw or h[2] % 100 >= rule.fim_percent or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None, raw
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if index is None:
        index = ExceptionIndex(data)
        at = np.array([0 if k == 0 else ends[k - 1] for k in (first, last)], np.int64)
        chars = index.to_chars(at)
    else:
        chars = np.array([first, last], np.int64)
        at = index.to_bytes(chars)
    a, b = map(int, at)
    prefix, middle, suffix = PREFIX.encode() + raw[:a], MIDDLE.encode() + raw[a:b], SUFFIX.encode() + raw[b:]
    spm = h[3] % 100 < rule.spm_percent
    out = (suffix + prefix if spm else prefix + suffix) + middle
    return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), a, b - a, out


def transform(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the number of units, the form, prefix and middle in code points and bytes, and the output.

    The text column keeps its name and content; the output stands beside it.
    """
    kept = [f for f in docs.schema.fields if f.name not in RESULT]
    digits = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])
    rows = docs.select(
        F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), text_or_empty(f"`{text_col}`").alias("t"), draws.alias("h")
    )
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in RESULT.items())).fields])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches):
            joined, cuts = text_bytes(batch.column("t"))
            draws = batch.column("h").flatten().to_numpy().reshape(-1, 4)
            found = [_cut(joined[a:b], h, rule) for a, b, h in zip(cuts[:-1], cuts[1:], draws.tolist(), strict=True)]
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(c, kind) for c, kind in zip(columns[:-1], types, strict=False)]
            output = pa.array(columns[-1], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays, output], ["row", *RESULT])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(f.name).alias(f.name) for f in kept], *RESULT)


def restore(output: str = "output", form: str = "form"):
    """The text from which an output was made: a column of built-in functions."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def digest(done: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``transform``'s rows."""
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    # DuckDB's regular expressions take \x escapes; tokens are cut as text here, not as bytes
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draws = ", ".join(f"('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT doc_id, x, regexp_extract_all(x, '{token}') AS t, {draws} FROM docs),
cuts AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b FROM drawn),
parts AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s,
    CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM parts"""
