"""URL filter by a bit-parallel wildcard automaton.

Glob rules are packed into Shift-And masks of as many 64-bit words as they
need. A pattern has a start state and one state per literal byte; a wildcard is
a loop on the state before it. One step for all patterns and all URLs of a
chunk at one position is

    D = ((D << 1) & B[byte]) | (D & L[byte])

with the literals in B and the loops in L. URLs are stepped together, longest
first, so that finished ones fall off the end; the few that are longer than all others
are then finished one by one, so a single long URL costs its own length. ``*`` in a host stops at the
first ``/`` (its loop lacks that byte); ``*`` elsewhere takes any byte.

Null URLs and those without ``://`` have empty host and path; no rule fits them
and no glob does unless it accepts the empty string. Of rules that fit, the
longest wins, and of equally long ones the first. The canonical URL is the host
in lower case and the path as it stands. Rows that repeat a page_id, or have none,
are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import U64, buffers

#: (verdict, rule); a rule is host and path as one string, split at its first slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Globs over host and path that block where no rule fits.
GLOBS = ("*spam-farm*", "*cheap-pills*", "*casino*", "*/track/*.gif")
#: Wildcards in patterns; literals are bytes.
ANY, IN_HOST = -1, -2
STEP_ROWS, FEW = 4096, 32


def host_patterns(rule: str) -> list[list[int]]:
    """Patterns of a rule: its host itself or any subdomain, then a path that starts with the rule's."""
    host, slash, path = rule.partition("/")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    heads: list[list[int]] = [[*host.encode()], [IN_HOST, *f".{host}".encode()]]
    return [[*h, *(slash + path).encode(), ANY] for h in heads] if slash else [x for h in heads for x in (h, [*h, ord("/"), ANY])]


def glob_pattern(glob: str) -> list[int]:
    return [ANY if c == ord("*") else c for c in glob.encode()]


class ShiftAnd:
    """All patterns as one automaton."""

    def __init__(self, patterns: Sequence[list[int]]):
        n = sum(1 + sum(x >= 0 for x in p) for p in patterns)
        self.width = max(1, -(-n // 64))
        b, loop = (np.zeros((256, self.width * 64), bool) for _ in range(2))
        start = np.zeros(self.width * 64, bool)
        self.final, at = [], 0
        for p in patterns:
            start[at] = True
            for x in p:
                if x < 0:
                    loop[:, at] = True
                    if x == IN_HOST:
                        loop[ord("/"), at] = False
                else:
                    at += 1
                    b[x, at] = True
            self.final.append(at)
            at += 1
        self.b, self.loop, self.start = (self._pack(x) for x in (b, loop, start[None]))
        self.whole: tuple[list[int], list[int]] | None = None

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.reshape(len(bits), self.width, 64), axis=2, bitorder="little").view("<u8").reshape(len(bits), self.width).astype(U64)

    def _run(self, state: np.ndarray, rest: bytes) -> np.ndarray:
        """The same step with the words as one number, for a single text."""
        if self.whole is None:
            number = lambda x: [int.from_bytes(r.astype("<u8").tobytes(), "little") for r in x]
            self.whole = number(self.b), number(self.loop)
        b, loop = self.whole
        d = int.from_bytes(state.astype("<u8").tobytes(), "little")
        for c in rest:
            d = d << 1 & b[c] | d & loop[c]
        return np.frombuffer(d.to_bytes(8 * self.width, "little"), "<u8").astype(U64)

    def match(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts each pattern accepts: booleans, texts by patterns."""
        n = len(offs) - 1
        out = np.zeros((n, len(self.final)), bool)
        size = np.diff(offs)
        for lo in range(0, n, STEP_ROWS):
            rows = np.arange(lo, min(n, lo + STEP_ROWS))
            rows = rows[np.argsort(-size[rows], kind="stable")]
            d = np.repeat(self.start, len(rows), axis=0)
            begin, length = offs[:-1][rows], size[rows]
            # In step as long as there are many; the few longest then go on one by one.
            shared = int(length[FEW]) if len(rows) > FEW else 0
            for k in range(shared):
                live = int(np.searchsorted(-length, -k, side="left"))
                c, old = data[begin[:live] + k], d[:live]
                new = old << U64(1)
                new[:, 1:] |= old[:, :-1] >> U64(63)
                new &= self.b[c]
                new |= old & self.loop[c]
                d[:live] = new
            for r in range(min(FEW, len(rows))):
                if length[r] > shared:
                    d[r] = self._run(d[r], data[begin[r] + shared : begin[r] + length[r]].tobytes())
            for j, f in enumerate(self.final):
                out[rows, j] = (d[:, f // 64] >> U64(f % 64)) & U64(1) != 0
        return out


def _judge(rules, globs):
    owners, patterns = [], []
    for i, (_, rule) in enumerate(rules):
        for p in host_patterns(rule):
            owners.append(i)
            patterns.append(p)
    patterns += [glob_pattern(g) for g in globs]
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), -i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(patterns)
        names = pa.array([r for _, r in rules], pa.string())
        verdicts = np.array([v for v, _ in rules] + ["allow", "block"], object)
        for b in batches:
            hit = automaton.match(*buffers(b.column(3)))
            best = np.full(b.num_rows, -1)
            for i in order:
                best[hit[:, [k for k, o in enumerate(owners) if o == i]].any(axis=1)] = i
            spam = hit[:, len(owners) :].any(axis=1)
            which = np.where(best >= 0, best, len(rules) + spam)
            rule = names.take(pa.array(np.maximum(best, 0), mask=best < 0)) if len(rules) else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule, pa.array(verdicts[which], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def url_verdicts(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), upper, upper.lower()).alias("host"), F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2).alias("path"))
    return parts.withColumn("canonical", F.concat("host", "path")).mapInArrow(_judge(tuple(rules), tuple(globs)), "page_id long, host string, path string, rule string, verdict string")


ORACLE = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path FROM pages),
rules(verdict, rule, h, q) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
m AS (SELECT p.page_id, p.host, p.path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM p LEFT JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host || path LIKE '%spam-farm%' OR host || path LIKE '%cheap-pills%' OR host || path LIKE '%casino%' OR host || path LIKE '%/track/%.gif' THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
