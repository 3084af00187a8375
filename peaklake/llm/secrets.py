"""Operator 1: secret scan with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one table (``automaton.py``). Each text is
read once, byte by byte; only texts in which a rule fired are read again for the exact extents of that rule. The
table is built once per Python worker and the work is a map over the documents: no shuffle, no driver state.

Defined results: a null text counts as empty (no spans, digest of the empty text); null or repeated ids and
repeated rows give one output row each; very long texts are scanned whole; an empty table gives no rows; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklake.llm.automaton import Scanner
from peaklake.llm.common import small_batches, text_or_empty


class Rule(NamedTuple):
    """``head + body`` is the pattern; a match counts if its body (its whole, without head) has ``least`` characters."""

    kind: str
    head: str
    body: str
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_HEAD = "(" + "|".join(map(either_case, KEYWORDS)) + ")[\"']?\\x20*[:=]\\x20*[\"']?"

#: Only the hex rule carries its least length in the pattern (the longest run is the same either way): hex digits are
#: everywhere and would fire on every text, while counting behind a rare prefix would only multiply the states.
BASE_RULES = (
    Rule("assign", ASSIGN_HEAD, "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", "", "gh[pousr]_[0-9A-Za-z]+", 40),
    Rule("pem", "", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class Span(NamedTuple):
    start: int
    order: int
    end: int


@lru_cache(maxsize=8)
def _compiled(rules: Sequence[Rule]) -> tuple[Scanner, list[Scanner | None]]:
    heads = [Scanner([r.head]) if r.head else None for r in rules]
    return Scanner([r.head + r.body for r in rules]), heads


def find_spans(text: str, rules: Sequence[Rule] = RULES) -> list[Span]:
    """All spans of one text in code points, by start, then in the order of the rules."""
    scanner, heads = _compiled(tuple(rules))
    data = text.encode("utf-8", "surrogatepass")
    spans = []
    for number, found in scanner.matches(data).items():
        head = heads[number]
        for start, end in found:
            body = start + (head.extents(0, data[start:end])[0][1] if head else 0)
            if end - body >= rules[number].least:
                spans.append(Span(start, number, end))
    if spans and not data.isascii():
        at, chars, place = 0, 0, {}
        for offset in sorted({o for s in spans for o in (s.start, s.end)}):
            chars += len(data[at:offset].decode("utf-8", "surrogatepass"))
            at, place[offset] = offset, chars
        spans = [Span(place[s.start], s.order, place[s.end]) for s in spans]
    return sorted(spans)


def _joined(spans: Sequence[Span], rules: Sequence[Rule]) -> str:
    return ",".join(f"{rules[s.order].kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: ``id_col`` and ``spans`` array<struct<kind, start, end>> in code points."""
    rules = tuple(rules)
    key = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches):
            found = [
                [{"kind": rules[s.order].kind, "start": s.start, "end": s.end} for s in find_spans(t, rules)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    return (
        docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
        .mapInArrow(run, f"id {key}, spans array<struct<kind: string, start: bigint, end: bigint>>")
        .withColumnRenamed("id", id_col)
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans as text."""

    def joined(spans):
        part = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(part, ",")

    base = [r.kind for r in BASE_RULES]

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        id_col,
        *[count(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("\\x20", " ").replace("'", "''")


def oracle_sql() -> str:
    """DuckDB: pieces between matches give the offsets; kinds are ranked in the order of the rules."""
    parts = []
    for number, rule in enumerate(RULES):
        body = f"regexp_replace(m, '^{_sql_pattern(rule.head)}', '')" if rule.head else "m"
        parts.append(
            f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, a AS s, a + length(m) AS e FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
    coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS a
  FROM (SELECT doc_id, regexp_extract_all(t, '{_sql_pattern(rule.head + rule.body)}') AS ms,
    string_split_regex(t, '{_sql_pattern(rule.head + rule.body)}') AS ps FROM d)) WHERE length({body}) >= {rule.least}"""
        )
    label = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE_RULES)
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts}, {label} FILTER (kind IN ({base})) AS b, {label} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
