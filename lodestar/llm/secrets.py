"""Secret scans: all rules in one pass over the bytes by one minimal automaton.

The automaton runs over whole batches of texts and tells which rules end a match in which text. Only for those (text,
rule) pairs the rule's own automaton, built the same way, gives the leftmost longest spans. Null and empty texts have no
spans. A private key is found by its BEGIN line; its span runs on to its END line or, where that is missing before the next
BEGIN line, over the lines of base64 that follow. Offsets count code points, the end excluded. Repeated rows are scanned one
by one; other columns pass through `redact` untouched.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import automata
from lodestar.llm.common import map_arrow, struct, texts_of


@dataclass(frozen=True)
class Rule:
    """tail: the fewest characters of an assigned value; least: the fewest of the whole match. Shorter matches are dropped.

    Lengths that are checked afterwards keep the combined automaton small: counters of several rules would multiply. So does
    `runs_on`: the match is the BEGIN line of a key, whose body is added to the span afterwards.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    tail: int = 0
    least: int = 0
    runs_on: bool = False


# Formats of secrets. A run of hex digits that is too short has no longer match inside, so its length may
# stay in the pattern and texts without a long run need no second look.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----", runs_on=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES):
    """The combined automaton and each rule's own."""
    return automata.combined([(r.pattern, r.ignore_case) for r in rules]), [automata.anchored(r.pattern, r.ignore_case) for r in rules]


def _value_length(rule: Rule, value: str) -> int:
    """Characters of the value that ends an assignment: those after the first separator, blanks and a quote."""
    at = min(i for i in (value.find(":"), value.find("=")) if i >= 0)
    rest = value[at + 1 :].lstrip(" ")
    return len(rest[1:] if rest[:1] in ("'", '"') else rest)


_KEY_END = re.compile(rb"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# Line ends, also escaped ones of source code and JSON, with what may stand around a quoted or indented line.
_GAP = rb"""(?:[\s"'`+,>*#|]|\\[nrt]|//\x20)*+"""
_HEADER = rb"(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+"
# Header lines of a key, long runs of base64, shorter ones that fill their line, and the check sum of OpenPGP.
_BODY = re.compile(rb"""(?>%b(?:%b|[A-Za-z0-9+/]{16,}+=*+|[A-Za-z0-9+/]++=*+(?=[\x20\t"'`+,]*+(?:[\r\n]|\\[nr]|\Z))|=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/])))++""" % (_GAP, _HEADER))


def _key_end(data: bytes, start: int, limit: int) -> int:
    """Where a key ends whose BEGIN line ends at `start`, no later than `limit`."""
    found = _KEY_END.search(data, start, limit) or _BODY.match(data, start, limit)
    return found.end() if found else start


def spans_in(texts: list[str], rules: tuple[Rule, ...], machines) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, end, rule number) in code points, by start and then rule."""
    whole, own = machines
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0] + [len(d) + 1 for d in data])
    where, masks = automata.scan(whole, b"".join(d + bytes([automata.BREAK]) for d in data))
    text_of = np.searchsorted(offsets, where, side="right") - 1
    todo = {(int(t), k) for k in range(len(rules)) for t in np.unique(text_of[(masks >> k) & 1 == 1])}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, k in sorted(todo):
        d, rule = data[t], rules[k]
        plain = len(d) == len(texts[t])
        found = automata.matches(own[k], d)
        if rule.runs_on:
            found = [(a, _key_end(d, b, limit)) for (a, b), limit in zip(found, [a for a, _ in found[1:]] + [len(d)], strict=True)]
        for start, end in found:
            if end - start < rule.least or rule.tail and _value_length(rule, d[start:end].decode("ascii")) < rule.tail:
                continue
            at = start if plain else len(d[:start].decode("utf-8", "surrogatepass"))
            out[t].append((at, at + (end - start if plain else len(d[start:end].decode("utf-8", "surrogatepass"))), k))
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in out]


def _named(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every text, by start and then rule."""
    machines = compiled(rules)

    def run(batch):
        found = spans_in(texts_of(batch), rules, machines)
        return {"doc_id": batch.column("doc_id"), "spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in x] for x in found]}

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, struct(f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of spans of each base kind, a hash of the base spans, and all spans as text."""
    found = scan(docs, rules, id_col, text_col)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("bigint").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, every span (overlapping ones as one) replaced by a mark; null texts stay null."""
    machines = compiled(rules)

    def run(batch):
        texts = batch.column(text_col).to_pylist()
        out = []
        for text, spans in zip(texts, spans_in([t or "" for t in texts], rules, machines), strict=True):
            parts, end = [], 0
            for a, b, _ in spans:
                if a >= end:
                    parts += [text[end:a], mark]
                end = max(end, b)
            out.append("".join([*parts, text[end:]]) if spans else text)
        return {name: batch.column(name) for name in batch.schema.names} | {text_col: out}

    return map_arrow(docs, run, docs.schema)
