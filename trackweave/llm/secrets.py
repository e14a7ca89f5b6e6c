"""Secret scan: fixed patterns, and values in credential contexts judged by their guess cost.

The guess cost of a value is the cheapest segmentation into dictionary words, dates, repeats,
keyboard walks and sequences, and brute-force spans, found by dynamic programming over the value; it
is the decimal logarithm of the guesses an informed attacker needs. Values of at least `MIN_LENGTH`
characters that cost `min_cost` or more are reported; placeholders and plain words cost less.

A walk or a repeat may be any part of a maximal one that begins or ends with it (a repeat: in its first
or last period), and brute-force spans and words are any; so values are judged whole, however long, in
time that grows with their length times the longest dictionary word, and with the maximal repeats, whose
lengths add up to little more. No length of a walk, a unit or a value is left out.

The dictionary is a parameter, by default the built-in credential words: so what is reported of a text depends on
that text alone, and no secret can teach it. `frequent_words` counts a richer one from documents, for those who trust
them: words in at least so many different texts, outside of credential contexts.

Base kinds (never changed by the method): assign, access, hex. Added kind: guess, the span of a
credential value. Positions are code points, ends exclusive.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows are each
given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
MIN_LENGTH = 6
MIN_COST = 6.0
#: Different texts that a counted word is in.
LEAST_TEXTS = 1000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs of hex digits; as runs are maximal, asking for 24 at once leaves out just the shorter ones.
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Short context words count at the start of a word, or as the last part of a name in camel case.
_START = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
_CONTEXT = re.compile(
    rf"""(?:{_START}(?:pass|pwd|auth|token|credentials?|secret)|passw(?:or)?d|passphrase|secret|token|api[_-]?key|authorization|(?:private|access|secret|signing)[_-]?key)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|(?!bearer\b)([^\s"',;]+))"""
    r"""|\bbearer[\x20\t]+([A-Za-z0-9._~+/=-]+)"""
    r"""|://[^/\s:@]+:([^/\s@]+)@""",
    re.IGNORECASE | re.ASCII,
)
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "://")

#: Frequent passwords and credential words, most frequent first.
WORDS = (
    "password passw0rd qwerty dragon monkey letmein football baseball welcome master hello login admin root user guest test "
    "default changeme secret token example sample demo placeholder your yours insert replace here none null true false public "
    "private access client server service account database system value string key code pass word love sunshine princess "
    "shadow superman batman michael jordan daniel charlie thomas summer winter spring autumn monday friday january company "
    "office internet computer samsung google apple orange banana cookie pepper cheese coffee flower freedom whatever starwars "
    "ninja trustno mustang access hunter ranger soccer hockey tigger maggie ginger jessica ashley nicole the and for with this "
    "required optional configuration authentication authorization enabled disabled username email missing invalid expired unknown change nothing special "
    "that from have not are was you all can her his one our out day get has him how man new now old see two way who its say she use"
).split()

#: Rows of common keyboards and sequences.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn", "abcdefghijklmnopqrstuvwxyz", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm")

_LEET = str.maketrans("0134578@$!", "oieastbasi")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|[12]\d|3[01])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")
_KIND_COST = math.log10(5)


def _steps() -> set[str]:
    return {pair for row in WALKS for way in (row, row[::-1]) for pair in map("".join, zip(way, way[1:], strict=False))}


_STEPS = _steps()


class Ranks(dict):
    """Words with their ranks, and the length of the longest."""

    longest = 0


def rank_words(words: tuple[str, ...] | list[str] = tuple(WORDS)) -> Ranks:
    """Words with their ranks, the most frequent first; pass a longer list to judge by a richer dictionary."""
    out = Ranks()
    for word in words:
        out.setdefault(word.lower(), len(out) + 1)
    out.longest = max(map(len, out), default=0)
    return out


def _alphabet(value: str) -> int:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 10 if value.isdigit() else 16
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
    return size + 33 * any(c < "\x7f" and not c.isalnum() for c in value) + 100 * any(c >= "\x7f" for c in value)


def _word_cost(part: str, ranks: Ranks) -> float | None:
    lower = part.lower()
    rank, twist = ranks.get(lower), 1
    if rank is None:
        rank, twist = ranks.get(lower.translate(_LEET)), 2
    if rank is None:
        return None
    capital = 1 if part == lower else 2 if part[1:] == lower[1:] or part == part.upper() else 2 ** min(8, sum(c.isupper() for c in part))
    return math.log10(rank * twist * capital + 1)


_MODULUS = (1 << 61) - 1


class _Common:
    """Lengths of common prefixes of suffixes of a string, in logarithmic time by hashes."""

    def __init__(self, value: str):
        self.value, self.hashes, self.powers = value, [0], [1]
        for c in value:
            self.hashes.append((self.hashes[-1] * 1_000_003 + ord(c) + 1) % _MODULUS)
            self.powers.append(self.powers[-1] * 1_000_003 % _MODULUS)

    def ahead(self, a: int, b: int) -> int:
        """How many characters from a and from b (a < b) on agree."""
        low, high = 0, len(self.value) - b
        if not high or self.value[a] != self.value[b]:
            return 0
        while low < high:
            n = (low + high + 1) // 2
            same = (self.hashes[a + n] - self.hashes[a] * self.powers[n] - self.hashes[b + n] + self.hashes[b] * self.powers[n]) % _MODULUS == 0
            low, high = (n, high) if same else (low, n - 1)
        return low


def repeats(value: str) -> list[tuple[int, int, int]]:
    """All maximal repeats as (start, end, period): at least two periods long, and neither end can be moved out.

    Every one has the period of a longest Lyndon word at some place of it, for one of the two orders of
    characters; there are fewer than characters, so their number and the search are nearly linear.
    """
    n, found = len(value), set()
    ahead, back = _Common(value), _Common(value[::-1])
    for sign in (1, -1):
        ends: list[int] = []  # ends of the Lyndon words that follow, the nearest last
        for i in range(n - 1, -1, -1):
            j = i + 1
            while ends and (j < n):
                k = ends[-1]
                same = ahead.ahead(i, j)
                # the word from i swallows the one from j where it is less
                less = j + same < n and sign * (ord(value[i + same]) - ord(value[j + same])) < 0
                if not less:
                    break
                j = k
                ends.pop()
            ends.append(j)
            period = j - i
            start, end = i, j
            if j < n:
                end = j + ahead.ahead(i, j)
            if i:
                start = i - back.ahead(n - j, n - i)
            if end - start >= 2 * period:
                found.add((start, end, period))
    return sorted(found)


def _ways(value: str, lower: str, brute: float, ranks: Ranks) -> Iterator[tuple[int, str, int, float]]:
    """Walks, dates and repeats of a value as (end, kind, start, cost)."""
    n, longest = len(value), ranks.longest
    for found in _DATE.finditer(value):
        yield found.end(), "date", found.start(), math.log10(365 * 60 if found.end() - found.start() > 4 else 60)
    start = 0
    for i in range(1, n + 1):
        if i < n and lower[i - 1 : i + 1] in _STEPS:
            continue
        for size in range(3, i - start + 1):
            yield start + size, "walk", start, math.log10(40 * size)
            if size < i - start:
                yield i, "walk", i - size, math.log10(40 * size)
        start = i
    for start, end, period in repeats(value):
        unit: dict[int, float] = {}

        def cost(a: int, times: int) -> float:
            phase = (a - start) % period  # noqa: B023
            if phase not in unit:  # noqa: B023
                word = _word_cost(value[a : a + period], ranks) if period <= longest else None  # noqa: B023
                unit[phase] = min(brute * period, math.inf if word is None else word)  # noqa: B023
            return unit[phase] + math.log10(times)  # noqa: B023

        for a in range(start, min(start + period, end - 2 * period + 1)):
            for times in range(2, (end - a) // period + 1):
                yield a + times * period, "repeat", a, cost(a, times)
        for b in range(end, max(end - period, start + 2 * period - 1), -1):
            for times in range(2, (b - start) // period + 1):
                yield b, "repeat", b - times * period, cost(b - times * period, times)


def segment(value: str, ranks: Ranks) -> tuple[float, list[tuple[str, int, int]]]:
    """(cost, segments): the cheapest segmentation of a value, segments as (kind, start, end)."""
    n, brute = len(value), math.log10(max(2, _alphabet(value)))
    best, how = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    brute_end = [math.inf] * (n + 1)  # cheapest way to i that ends in a brute-force span, and its start
    brute_from = [0] * (n + 1)
    longest = ranks.longest
    lower = value.lower()
    if len(lower) != n:
        lower = value
    ways: dict[int, list[tuple[str, int, float]]] = {}
    for end, kind, start, cost in _ways(value, lower, brute, ranks):
        ways.setdefault(end, []).append((kind, start, cost))
    for i in range(1, n + 1):
        if best[i - 1] + _KIND_COST < brute_end[i - 1]:
            brute_end[i], brute_from[i] = best[i - 1] + _KIND_COST + brute, i - 1
        else:
            brute_end[i], brute_from[i] = brute_end[i - 1] + brute, brute_from[i - 1]
        best[i], how[i] = brute_end[i], ("brute", brute_from[i])
        for size in range(2, min(longest, i) + 1):
            cost = _word_cost(value[i - size : i], ranks)
            if cost is not None and best[i - size] + cost + _KIND_COST < best[i]:
                best[i], how[i] = best[i - size] + cost + _KIND_COST, ("word", i - size)
        for kind, start, cost in ways.get(i, ()):
            if best[start] + cost + _KIND_COST < best[i]:
                best[i], how[i] = best[start] + cost + _KIND_COST, (kind, start)
    segments, i = [], n
    while i:
        kind, start = how[i]
        segments.append((kind, start, i))
        i = start
    return best[n], segments[::-1]


def scan(text: str, ranks: Ranks, min_cost: float = MIN_COST) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, cost), by start and then kind; cost is 0 for base kinds."""
    found: list[tuple[str, int, int, float]] = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), 0.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), 0.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), 0.0) for m in _HEX.finditer(text)]
    if any(hint in low for hint in _CONTEXT_HINTS):
        for m in _CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            if end - start >= MIN_LENGTH:
                cost, _ = segment(text[start:end], ranks)
                if cost >= min_cost:
                    found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def join_spans(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def frequent_words(docs: DataFrame, text_col: str = "text", least: int = LEAST_TEXTS) -> DataFrame:
    """(word, texts): free-standing words of three letters or more, lower case, in at least `least` different texts, not counting those in credential contexts.

    Copies of a text count once, and a value behind `password:` and the like not at all, so a leaked value is no word however often it was copied.
    """
    texts = docs.select(F.col(text_col).alias("text")).filter("text <> ''").withColumn("of", F.xxhash64("text"))
    plain = F.regexp_replace("text", F.lit(f"(?i){_CONTEXT.pattern}"), F.lit(" = "))
    words = F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(r"(?<![^\s(\"'])(\p{L}{3,24})(?=[.,;:!?)\"']*(?:\s|$))"), F.lit(1)))
    each = texts.select("of", F.explode(words).alias("word")).groupBy("word", "of").agg(F.lit(1).alias("one"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= least)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] | list[str] = tuple(WORDS), min_cost: float = MIN_COST) -> DataFrame:
    """One row per document: id, spans (array of kind, start, end, cost)."""
    ranks = rank_words(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "cost"), x, strict=True)) for x in scan(text.as_py() or "", ranks, min_cost)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,cost:double>>").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] | list[str] = tuple(WORDS)) -> DataFrame:
    """Counts and digests of find_secrets, with the highest guess cost."""
    found = find_secrets(docs, id_col, text_col, words)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["cost"])), F.lit(0.0)).alias("top_cost"),
    )

