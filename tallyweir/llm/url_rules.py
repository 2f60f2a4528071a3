"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path``: ``||`` at its start anchors it to the
host or to a subdomain border, ``|`` at either end anchors it there, ``*`` is
any run of characters and ``^`` is one separator or an end; all else is literal.
A token is a maximal run of ASCII letters and digits. A token of a rule is
usable if the pattern bounds it on both sides, as every url that fits the rule
then holds it as a whole token. Each rule is filed under the usable token that
the urls hold least often; a url's tokens fetch its candidate rules, and only
those run their regular expression. Rules without a usable token are candidates
of every url.

Of the rules that fit, the one of the highest priority wins, then the longest
pattern, then the pattern that sorts first. Tables of more than ``BLOCK`` rules
are applied block by block, so what a task holds is bounded.

Defined cases: a null url or one without ``://`` has an empty host and path and
can only fit rules that fit the empty text; an empty table gives no rows;
repeated rows are judged each; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import free_name, in_arrow

BLOCK = 50_000  # rules that one pass sends to the tasks
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str
    name: str | None = None
    priority: int = 0


def split_url(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def usable_tokens(pattern: str) -> list[str]:
    """The tokens that every fitting url holds as whole tokens."""
    body = pattern.removeprefix("||") if pattern.startswith("||") else pattern.removeprefix("|")
    anchored, ended = body != pattern, pattern.endswith("|") and len(body) > 0
    body = body.removesuffix("|") if ended else body
    out = []
    for m in _TOKEN.finditer(body):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = ended if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            out.append(m[0])
    return out


def expression(pattern: str) -> str:
    """The regular expression of a pattern, to be searched in ``host + path``."""
    start, body, end = "", pattern, ""
    if body.startswith("||"):
        start, body = r"\A(?:[^/]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = r"\A", body[1:]
    if body.endswith("|"):
        end, body = r"\Z", body[:-1]
    special = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|\A|\Z|(?<=\.)|(?=\.))"}
    return start + "".join(special.get(c) or re.escape(c) for c in body) + end


def token_counts(urls: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each of the given tokens stands; a row for each token and task at most is moved."""
    wanted = frozenset(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(wanted.intersection(_TOKEN.findall("".join(split_url(value)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    parts = in_arrow(urls.select(url), count, "token string, n long")
    return {r.token: r.n for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # as many rows as rules have tokens, at most


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token to places in ``rules``; the empty token has the rules for every url."""
    out: dict[str, list[int]] = defaultdict(list)
    for place, rule in enumerate(rules):
        tokens = usable_tokens(rule.pattern)
        out[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else ""].append(place)
    return dict(out)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (the winner's name), pattern and verdict to every row."""
    ranked = sorted(set(rules), key=lambda r: (-r.priority, -len(r.pattern), r.pattern, r.verdict, r.name or ""))
    names = []
    for wanted in ("host", "path", "rule", "pattern", "verdict"):
        names.append(free_name([*pages.columns, *names], wanted))
    winner = free_name([*pages.columns, *names], "winner")
    out, at = pages, pages.columns.index(url)
    blocks = [ranked[a : a + BLOCK] for a in range(0, len(ranked), BLOCK)] or [[]]
    for k, block in enumerate(blocks):
        counts = token_counts(pages, url, [t for r in block for t in usable_tokens(r.pattern)])
        out = in_arrow(out, _fitting(block, index_rules(block, counts), at, k, default), T.StructType([*pages.schema.fields, *(T.StructField(n, T.StringType()) for n in names), T.StructField(winner, T.BooleanType())]))
    return out.drop(winner)


def _fitting(block: Sequence[Rule], index: dict[str, list[int]], at: int, k: int, default: str):
    """Earlier blocks hold stronger rules, so a row that already has its winner keeps it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern[str]] = {}
        always = index.get("", [])
        for batch in batches:
            width = batch.num_columns if k == 0 else batch.num_columns - 6
            before = [batch.column(width + i).to_pylist() for i in range(6)] if k else None
            cols: list[list] = [[] for _ in range(6)]
            for row, value in enumerate(batch.column(at).to_pylist()):
                if before and before[5][row]:
                    answer = tuple(before[i][row] for i in range(6))
                else:
                    host, path = split_url(value)
                    target, best = host + path, None
                    for place in sorted({p for t in set(_TOKEN.findall(target)) for p in index.get(t, ())}.union(always)):
                        if place not in compiled:
                            compiled[place] = re.compile(expression(block[place].pattern))
                        if compiled[place].search(target):
                            best = block[place]
                            break
                    answer = (host, path, best.name, best.pattern, best.verdict, True) if best else (host, path, None, None, default, False)
                for c, v in zip(cols, answer, strict=True):
                    c.append(v)
            added = [pa.array(c, pa.string()) for c in cols[:5]] + [pa.array(cols[5], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], names=[str(i) for i in range(width + 6)])

    return rows
