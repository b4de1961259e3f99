"""URL filters as one bit-parallel wildcard automaton over many URLs at once.

All rules are packed side by side into a multiword Shift-And state: one bit for each symbol of
each rule. A step shifts the state, keeps the bits whose symbol fits the next character, and
lets bits before a ``*`` stay. The columns of a batch advance together: one step handles the
same position of every URL that is long enough, so the work is the batch's characters times
the words of the state, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class HostRule:
    """Fits the host and its subdomains where the path starts with ``path``; the longest rule wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    """Fits a whole canonical URL (host, then path); ``*`` is any run, ``?`` any one character."""

    pattern: str
    verdict: str


#: Globs that decide where no host rule fits; the first that fits wins.
SPAM_GLOBS = (
    GlobRule("*spam*", "block"), GlobRule("*cheap-pills*", "block"), GlobRule("*casino*", "block"),
    GlobRule("*/login*", "block"), GlobRule("*/cart/*", "block"),
)
DEFAULT_VERDICT = "allow"
#: Rules of a table: characters that one automaton packs, and characters that a pass over the URLs sends to its tasks.
BLOCK_CHARS, SENT_CHARS = 20_000, 4_000_000

_OTHER, _LEAD, _SEP = 0, 1, 2


class Automaton:
    """The packed rules. ``_LEAD`` is the dot put before a host, ``_SEP`` the mark between host and path."""

    def __init__(self, hosts: Sequence[HostRule], globs: Sequence[GlobRule]):
        self.hosts, self.globs = list(hosts), list(globs)
        rules: list[list] = []
        for r in self.hosts:
            rules.append(["*", ("is", "."), *(("is", c) for c in r.host), ("sep",), *(("is", c) for c in r.path), "*"])
        for g in self.globs:
            rules.append([c if c == "*" else ("any",) if c == "?" else ("is", c) for c in g.pattern])
        letters = sorted({s[1] for r in rules for s in r if s[0] == "is"})
        self.classes = {c: 3 + i for i, c in enumerate(letters)}
        bits = sum(1 + sum(s != "*" for s in r) for r in rules)
        self.words = max(1, -(-bits // 64))
        fits, stays = np.zeros((3 + len(letters), bits), bool), np.zeros((3 + len(letters), bits), bool)
        start, self.accept, at = np.zeros(bits, bool), [], 0
        for k, rule in enumerate(rules):
            host = k < len(self.hosts)
            first, start[at] = at, True
            for s in rule:
                if s == "*":
                    stays[:, at] = True
                    continue
                at += 1
                if s[0] == "sep":
                    fits[_SEP, at] = True
                elif s[0] == "any":
                    fits[[_OTHER, *range(3, 3 + len(letters))], at] = True
                else:
                    fits[self.classes[s[1]], at] = True
                    fits[_LEAD, at] = host and s[1] == "."
            if not host:
                stays[[_LEAD, _SEP], first : at + 1] = True  # the marks are not part of the URL
            elif rule[0] == "*":
                stays[_SEP, first] = False
            self.accept.append(at)
            at += 1
        self.start, self.fits, self.stays = (self._packed(x) for x in (start, fits, stays))
        known = max([0, *map(ord, letters)]) + 1
        self.table = np.zeros(known + 1, np.uint8 if len(letters) < 250 else np.uint32)
        for c, i in self.classes.items():
            self.table[ord(c)] = i

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        wide = np.zeros((*flags.shape[:-1], self.words * 64), bool)
        wide[..., : flags.shape[-1]] = flags
        return np.packbits(wide, axis=-1, bitorder="little").view("<u8")

    def matches(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """[urls, rules]: which rule fits which URL."""
        n = len(hosts)
        sizes = np.array([len(h) + len(p) + 2 for h, p in zip(hosts, paths)], np.int64)
        flat = np.frombuffer("".join(f".{h}\0{p}" for h, p in zip(hosts, paths)).encode("utf-32-le"), "<u4")
        classes = self.table[np.minimum(flat, len(self.table) - 1)]
        begins = np.cumsum(sizes) - sizes
        classes[begins] = _LEAD
        classes[begins + np.array([len(h) + 1 for h in hosts], np.int64)] = _SEP
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        state = np.tile(self.start, (n, 1))
        for step in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            c = classes[begins[:live] + step]
            state[:live] = (moved & self.fits[c]) | (now & self.stays[c])
        ends = np.array(self.accept, np.int64)
        found = (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(ends)), bool)
        out[order] = found.astype(bool)
        return out


def canonical_parts(url_col: str = "url"):
    """(host, path) columns: host between the first ``://`` and ``/ ? #`` with A-Z lower-cased, path up to ``? #``."""
    url = F.col(url_col).cast("string")
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr(f"substring(cast(`{url_col}` as string), locate('://', cast(`{url_col}` as string)) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(
    pages: DataFrame, host_rules: Sequence[HostRule], glob_rules: Sequence[GlobRule] = SPAM_GLOBS,
    default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, glob.

    The longest fitting host rule decides (of equal length, the first given); where none fits,
    the first fitting glob; else ``default``. ``rule`` and ``glob`` are null unless they decided.

    Defined cases: a null url, or one without ``://``, has empty host and path and is judged
    like any other. Very long URLs are matched whole. Repeated rows and null ids stay. An empty
    table gives an empty result. Other columns of the input are ignored.
    """
    host, path = canonical_parts(url_col)
    ranked = sorted(range(len(host_rules)), key=lambda i: -len(host_rules[i].name))
    hosts = [host_rules[i] for i in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(hosts, glob_rules)
        names = [r.name for r in hosts] + [None] * (len(glob_rules) + 1)
        verdicts = [r.verdict for r in hosts] + [g.verdict for g in glob_rules] + [default]
        globs = [None] * len(hosts) + [g.pattern for g in glob_rules] + [None]
        for batch in batches:
            if not batch.num_rows:
                continue
            fits = automaton.matches(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            first = np.concatenate([fits, np.ones((len(fits), 1), bool)], axis=1).argmax(axis=1).tolist()
            columns = [*batch.columns, *(pa.array([x[i] for i in first], pa.string()) for x in (names, verdicts, globs))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "glob"])

    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, glob string")


def _route(host: str) -> str:
    """The last two labels of a host, on which it agrees with every rule host of two labels or more that fits it; empty for a single label."""
    return ".".join(host.split(".")[-2:]) if "." in host else ""


class RuleBlocks:
    """Rules (host, path, pattern, verdict, place) as automata of bounded size.

    Rules of a host of several labels only meet URLs with the same last two labels; a block holds rules
    of neighbouring routes, and a route of many rules spans several. Globs and rules of a single label meet every URL.
    """

    def __init__(self, rules: list[tuple], block_chars: int = BLOCK_CHARS):
        routed = sorted(((_route(r[0]) if r[2] is None else "", r) for r in rules), key=lambda x: (x[0], _key(x[1])))
        self.blocks: list[list[tuple]] = []
        self.of_route: dict[str, list[int]] = {}
        held = block_chars
        for route, r in routed:
            size = len(r[2]) if r[2] is not None else len(r[0]) + len(r[1]) + 2
            if held + size > block_chars:
                self.blocks.append([])
                held = 0
            held += size
            self.blocks[-1].append(r)
            at = self.of_route.setdefault(route, [])
            if not at or at[-1] != len(self.blocks) - 1:
                at.append(len(self.blocks) - 1)
        self.automata: dict[int, tuple[Automaton, list[tuple]]] = {}

    def _automaton(self, i: int) -> tuple[Automaton, list[tuple]]:
        """The automaton of a block and the order of its rules: what ``_key`` says, which also is what a URL's best so far is compared by."""
        if i not in self.automata:
            ranked = sorted(self.blocks[i], key=_key)
            hosts = [HostRule(r[0], r[1], r[3]) for r in ranked if r[2] is None]
            self.automata[i] = Automaton(hosts, [GlobRule(r[2], r[3]) for r in ranked if r[2] is not None]), [_key(r) for r in ranked]
        return self.automata[i]

    def improve(self, hosts: list[str], paths: list[str], best: list[tuple | None]) -> None:
        """Puts each URL's best rule, as a key, in the place of a worse one."""
        wanted: dict[int, list[int]] = {}
        for u, host in enumerate(hosts):
            route = _route(host)
            for b in {*self.of_route.get("", ()), *self.of_route.get(route, ())}:
                wanted.setdefault(b, []).append(u)
        for b, urls in wanted.items():
            automaton, keys = self._automaton(b)
            fits = automaton.matches([hosts[u] for u in urls], [paths[u] for u in urls])
            for at in np.flatnonzero(fits.any(axis=1)).tolist():
                key, u = keys[int(fits[at].argmax())], urls[at]
                if best[u] is None or key < best[u]:
                    best[u] = key


def _key(r: tuple) -> tuple:
    """Sorts rules by what wins: host rules before globs, long host rules first, then place, name and verdict."""
    host, path, pattern, verdict, place = r
    return (0, -len(host + path), place, host + path, verdict) if pattern is None else (1, 0, place, pattern, verdict)


def filter_urls_by_table(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url",
    block_chars: int = BLOCK_CHARS, sent_chars: int = SENT_CHARS,
) -> DataFrame:
    """``filter_urls`` by a table of any number of rules: host, path, pattern, verdict, place.

    A row with a pattern is a glob, else one with a host is a host rule (a null path counts as the empty
    one). The longest fitting host rule decides, of equal length the one of the smallest place; where
    none fits, the fitting glob of the smallest place; else ``default``. Equal places go by name, then
    verdict. The table is dealt into parts of about ``sent_chars`` characters; each part goes to the
    tasks in one pass over the URLs, which carry their best rule from pass to pass.

    Defined cases: rules without a verdict, or without host and pattern, are left out; a null place comes
    last; repeated rules count once. An empty table of rules gives every page the default. Pages are
    treated as in ``filter_urls``. Columns of other names are ignored in both tables.
    """
    spark = pages.sparkSession
    known = rules.filter("verdict is not null and (host is not null or pattern is not null)").select(
        F.when(F.col("pattern").isNull(), F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("host"),
        F.when(F.col("pattern").isNull(), F.coalesce("path", F.lit(""))).alias("path"), "pattern", "verdict",
        F.coalesce(F.col("place").cast("long"), F.lit((1 << 63) - 1)).alias("place")).distinct()
    chars = F.coalesce(F.length("pattern"), F.length("host") + F.length("path"))
    parts = max(1, -(-(known.agg(F.sum(chars)).first()[0] or 0) // sent_chars))
    known = staged(spark, known.withColumn("part", F.pmod(F.xxhash64("host", "path", "pattern"), F.lit(parts))), "url-rules")
    host, path = canonical_parts(url_col)
    schema = "page_id long, host string, path string, kind int, size int, place long, name string, verdict string"
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[3:])))
    for part in range(parts):
        sent = spark.sparkContext.broadcast([tuple(r) for r in known.filter(F.col("part") == part).drop("part").collect()])  # about sent_chars characters

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = RuleBlocks(sent.value, block_chars)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
            for batch in batches:
                before = zip(*(batch.column(i).to_pylist() for i in range(3, 8)))
                best = [None if b[0] is None else b for b in before]
                blocks.improve(batch.column(1).to_pylist(), batch.column(2).to_pylist(), best)
                told = [pa.array([None if b is None else b[i] for b in best], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *told], names=batch.schema.names)

        urls = urls.mapInArrow(run, schema)
        if part < parts - 1:
            urls = staged(spark, urls, "urls")
    rule, glob = (F.when(F.col("kind") == k, F.col("name")) for k in (0, 1))
    return urls.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"), glob.alias("glob"))
