"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans come from four fixed patterns. They are the seeds: the words around each seed induce patterns, which are
lexical alone: the word before, the two words before, and the word before with the word after. What else stands in such
a context is an unseen instance, of whatever shape: the token there and the tokens of digits that go on with it, or with
a word after, the up to WIDEST tokens between. Spark scores the graph of patterns and instances in rounds: a pattern by
the mean score of its distinct instances, an instance by its patterns (noisy or), seeds staying at 1. What a trusted
pattern matches is added as a span of its seeds' kind. Base spans stay as they are.

A pattern of S seed values can't be trusted with more than most_unseen(S) other values, so one that has more leaves the
graph, and a task that has seen more stops listing them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, returned, texts

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match from within digits is one from their start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: A trusted pattern: its score, and the distinct seed values that it has at least. Rounds of scoring.
TRUST, SUPPORT, ROUNDS = 0.8, 5, 3
#: Tokens that may lie between the two words of a pattern with a word after.
WIDEST = 8
_WORD = re.compile(r"\S+")
_GOES_ON = re.compile(r"[^\w\s]*\d[\d\W]*")
_LEADING, _TRAILING = "(\"'[{<", ".,;:!?)\"'$%&*#]}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Each match ends at a local part's only @, so the matches follow from the places of @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order; matches that fail their check are dropped, and not tried again shorter."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def number(*words: str) -> int:
    """A signed 64-bit hash of words."""
    return xxhash.xxh3_64_intdigest("\0".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


#: Patterns by their words: the one before, the two before, the one before and the one after; in a pattern's lowest bits.
BEFORE, TWO, AROUND = 1, 2, 3


def pattern_of(form: int, *words: str) -> int:
    return number(*words) & ~3 | form


def most_unseen(support: int) -> int:
    """The values beside its seeds that a pattern of so many seed values may have to reach TRUST, an unseen value
    counting for less than half a seed: from (S + U / 2) / (S + U + 1) >= TRUST."""
    return int(((1 - TRUST) * support - TRUST) / (TRUST - 0.5) + 1e-9)


def patterns_at(before: list[str], after: str | None) -> list[int]:
    """The patterns of a place, by the words before it (two at most) and the word after; the word before comes first."""
    found = [pattern_of(BEFORE, before[-1])] if before else []
    if len(before) > 1:
        found.append(pattern_of(TWO, *before[-2:]))
    if before and after is not None:
        found.append(pattern_of(AROUND, before[-1], after))
    return found


def seeds(text: str, spans: list[tuple[int, int, int]]):
    """(kind, value, patterns) of the spans. Words are whole; what touches a seed counts as a word if it is more than
    punctuation around it."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)] if spans else []
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    for a, kind, b in spans:
        i, j = bisect_right(starts, a) - 1, bisect_right(ends, b - 1)
        before = [text[x:y].lower() for x, y in words[max(0, i - 2) : i]]
        if glued := text[words[i][0] : a].lstrip(_LEADING):
            before.append(glued.lower())
        after = text[slice(*words[j + 1])].lower() if j + 1 < len(words) else None
        if glued := text[b : words[j][1]].rstrip(_TRAILING):
            after = glued.lower()
        yield KINDS[kind], number(text[a:b]), patterns_at(before[-2:], after)


class Contexts:
    """The patterns whose contexts a task lists: patterns by number, each with the most unseen values that it may have and
    the pattern of its word before alone. One that has more is dropped."""

    def __init__(self, patterns: dict[int, tuple[int, int]]):
        self.patterns, self.live, self.values = patterns, set(patterns), {}
        self.before, self.around = Counter(), Counter()
        for x, (_, head) in patterns.items():
            (self.around if x & 3 == AROUND else self.before)[head] += 1
        self._heads: dict[str, int] = {}

    def head(self, word: str) -> int:
        if word not in self._heads:
            if len(self._heads) > 100_000:
                self._heads.clear()
            self._heads[word] = pattern_of(BEFORE, word)
        return self._heads[word]

    def listed(self, pattern: int, value: int) -> bool:
        """Whether an instance is to be listed; one too many is, too, and tells that the pattern has too many."""
        if pattern not in self.live:
            return False
        most, head = self.patterns[pattern]
        values = self.values.setdefault(pattern, set())
        values.add(value)
        if len(values) > most:
            self.live.remove(pattern)
            del self.values[pattern]
            own = self.around if pattern & 3 == AROUND else self.before
            own[head] -= 1
            if not own[head]:
                del own[head]
        return True


def unseen(text: str, spans: list[tuple[int, int, int]], contexts: Contexts):
    """(start, end, value, pattern) of what stands in live contexts and overlaps no span."""
    words, lower, head_of, live = None, text.lower().split(), contexts.head, contexts.live
    for i in range(1, len(lower)):
        head = head_of(lower[i - 1])
        before, around = head in contexts.before, head in contexts.around
        if not before and not around:
            continue
        if words is None:
            words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            lower = [text[a:b].lower() for a, b in words]
            starts, reach, furthest = [s[0] for s in spans], [], 0
            for s in spans:
                furthest = max(furthest, s[2])
                reach.append(furthest)

        def taken(x):
            last = bisect_right(starts, words[x][1] - 1) - 1
            return last >= 0 and reach[last] > words[x][0]

        if taken(i):
            continue
        end = i + 1
        if _DIGIT.search(lower[i]):
            while end < len(lower) and _GOES_ON.fullmatch(lower[end]) and not taken(end):
                end += 1
        candidates = [(end, x) for x in patterns_at(lower[max(0, i - 2) : i], None) if x in live] if before else []
        for end in range(i + 1, min(i + WIDEST, len(lower) - 1) + 1) if around else ():
            if taken(end - 1):
                break
            if (x := pattern_of(AROUND, lower[i - 1], lower[end])) in contexts.patterns:
                if x in live:
                    candidates.append((end, x))
                break
        for end, pattern in candidates:
            whole = text[words[i][0] : words[end - 1][1]]
            value = whole.lstrip(_LEADING)
            a = words[i][0] + len(whole) - len(value)
            if value := value.rstrip(_TRAILING):
                yield a, a + len(value), number(value), pattern


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


_ROW = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<start:long,end:long,kind:string,value:long,patterns:array<long>>>"


def _scan(found):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for batch in found:
        counts, hashes, bases, all_found = [], [], [], []
        for text in batch.column(1):
            text = text.as_py()
            spans = base_spans(text)
            counts.append([sum(s[1] == k for s in spans) for k in range(4)])
            bases.append(listed((a, KINDS[k], b) for a, k, b in spans))
            hashes.append(hashlib.sha256(bases[-1].encode()).hexdigest())
            all_found.append([{"start": a, "end": b, "kind": kind, "value": value, "patterns": patterns} for (a, _, b), (kind, value, patterns) in zip(spans, seeds(text, spans), strict=True)])
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "found"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(hashes, pa.string()), pa.array(bases, pa.string()), pa.array(all_found, kind)], names)


def _unseen_places(docs: DataFrame, supported: DataFrame) -> DataFrame:
    """(doc_id, start, end, value, pattern) of what stands in the supported patterns' contexts. The patterns go to all
    tasks, 24 bytes each; there are at most three for SUPPORT seeds."""
    patterns = {r["pattern"]: (most_unseen(r["support"]), r["head"]) for r in supported.select("pattern", "support", "head").collect()}
    patterns = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(found):
        contexts = Contexts(patterns.value)
        for batch in found:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                out += [(doc, a, b, value, x) for a, b, value, x in unseen(text, base_spans(text), contexts) if contexts.listed(x, value)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "end", "value", "pattern"])

    return docs.mapInArrow(run, "doc_id long, start long, end long, value long, pattern long")


def supported_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, head, kind, support) of the patterns with SUPPORT seed values; a pattern stands for the kind that most of its seeds have."""
    seeded = edges.where("kind is not null").groupBy("pattern", "head", "kind").agg(F.countDistinct("value").alias("support")).where(F.col("support") >= SUPPORT)
    return seeded.groupBy("pattern", "head").agg(F.max(F.struct("support", "kind")).alias("b")).select("pattern", "head", "b.kind", "b.support")


def trusted_patterns(edges: DataFrame, supported: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (pattern, value, kind or null), distinct: the supported patterns that are trusted, with their kind."""
    best = supported.select("pattern", F.col("kind").alias("stands_for"), "support")
    values = edges.join(best, "pattern").groupBy("pattern", "support").agg(F.countDistinct("value").alias("n"))
    most = F.floor((F.lit(1 - TRUST) * F.col("support") - TRUST) / (TRUST - 0.5) + 1e-9)
    best = best.drop("support").join(values.where(F.col("n") - F.col("support") <= most).select("pattern"), "pattern")
    graph = edges.join(best, "pattern").select("pattern", "stands_for", "value", (F.col("kind") == F.col("stands_for")).alias("seed"))
    graph = graph.groupBy("pattern", "stands_for", "value").agg(F.max(F.coalesce("seed", F.lit(False)).cast("double")).alias("score"))
    graph = scratch.keep(graph.withColumn("seed", F.col("score")), "graph")
    for _ in range(ROUNDS - 1):
        patterns = graph.groupBy("pattern", "stands_for").agg((F.sum("score") / (F.count("*") + 1)).alias("p"))
        doubt = F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.99)))))
        values = graph.join(patterns, ["pattern", "stands_for"]).groupBy("stands_for", "value").agg((1 - doubt).alias("v"))
        # what several patterns point at counts for at most half of a seed
        graph = graph.join(values, ["stands_for", "value"]).withColumn("score", F.greatest("seed", F.col("v") / 2)).drop("v")
        graph = scratch.keep(graph.select("pattern", "stands_for", "value", "score", "seed"), "graph")
    scored = graph.groupBy("pattern", "stands_for").agg((F.sum("score") / (F.count("*") + 1)).alias("p"), F.sum("seed").alias("support"))
    return scored.where((F.col("p") >= TRUST) & (F.col("support") >= SUPPORT)).select("pattern", F.col("stands_for").alias("kind"), "p")


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 are of base spans alone; spans has those and the added ones as kind:start:end, by start, then
    kind in the order of KINDS; places are code points, ends exclusive. Null texts are empty; rows without doc_id are
    left out; rows that repeat a doc_id are documents of their own and give a row each.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    docs, back = keyed(texts(docs), scratch)
    rows = scratch.keep(docs.mapInArrow(_scan, _ROW), "rows")
    edges = rows.select(F.explode("found").alias("f")).select(F.explode("f.patterns").alias("pattern"), F.element_at("f.patterns", 1).alias("head"), "f.value", "f.kind").distinct()
    edges = scratch.keep(edges, "edges")
    supported = scratch.keep(supported_patterns(edges), "supported")
    unseen = scratch.keep(_unseen_places(docs, supported), "unseen")
    edges = edges.drop("head").unionByName(unseen.select("pattern", "value", F.lit(None).cast("string").alias("kind")).distinct())
    trusted = scratch.keep(trusted_patterns(edges, supported, scratch), "trusted")
    # of the instances at one place, the one of the best pattern, and then the longest
    places = unseen.join(trusted, "pattern").groupBy("doc_id", "start").agg(F.max(F.struct("p", "end", "kind")).alias("b")).select("doc_id", "start", "b.end", "b")
    number = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    added = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", number[F.col("b.kind")].alias("number"), "end", F.col("b.kind").alias("kind"))).alias("added"))
    base = F.transform(
        F.filter("found", lambda f: f["kind"].isNotNull()),
        lambda f: F.struct(f["start"].alias("start"), number[f["kind"]].alias("number"), f["end"].alias("end"), f["kind"].alias("kind")),
    )
    spans = F.array_sort(F.concat(base, F.col("added")))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = rows.join(added, "doc_id", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.when(F.col("added").isNull(), F.col("base")).otherwise(text).alias("spans"), F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).cast("long").alias("n_added")
    )
    return returned(found, back)
