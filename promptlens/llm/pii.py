"""Personal data by bootstrapped contextual extraction.

Seeds are what the base expressions match (email, ip, card, phone) and long
hex strings (secret). The two words before an entity are a lexical pattern.
Patterns and instances form a graph of (pattern, instance) edges; Spark scores
it in rounds: a pattern is confident in a kind if most of its instances are
trusted as that kind and most places where its two words occur introduce one;
an instance becomes trusted by confident patterns (noisy-or). Confident
patterns then discover identifiers that no expression describes: whatever token
follows them. Learning looks at tokens with a digit only.

Base spans always stay; discovered spans never overlap them. Learning and
finding read every whole text. Scores stay in Spark: confident patterns meet
the corpus counts of their words there, and all that pass, without a limit,
come to the driver and go to the tasks.

Defined results: null and empty texts have no spans; repeated rows and ids are
rows of their own and null ids stay; an instance counts once per pattern however
many copies hold it. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import parted, stored, table

#: Fixed value: kinds in the order of their spans.
BASE = ("email", "ip", "card", "phone")
# The base expressions. A look-behind or a possessive run only
# keeps a start inside the same run of digits from being tried again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_QUOTES = "\"'`()[]{}<>,;:.!?"

MIN_INSTANCES, CONFIDENCE, PRECISION, ROUNDS = 5, 0.8, 0.5, 3
LONGEST_WORD, LONGEST_VALUE = 40, 128
#: Patterns up to which tasks count only them; beyond, all pairs of words are
#: counted and joined. The result is the same.
SENT_PATTERNS = 200_000


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and not _NOT_LOCAL.match(text, left - 1):
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            yield left, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in BASE, end), sorted."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _token(text: str, start: int) -> int:
    """Where the white-space token that holds ``start`` begins."""
    while start and not text[start - 1].isspace():
        start -= 1
    return start


def _key(first: str, second: str) -> str | None:
    """The pattern of two words, if they are words; a long one stands as a
    digest, so that a pattern is of bounded size."""
    words = [w.lower() for w in (first, second)]
    if any(_DIGIT.search(w) for w in words):
        return None
    return " ".join(w if len(w) <= LONGEST_WORD else "#" + hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest() for w in words)


def pattern(text: str, start: int) -> str | None:
    """The two words before the token at ``start``, if they are words."""
    words, end = [], _token(text, start)
    while len(words) < 2:
        while end and text[end - 1].isspace():
            end -= 1
        if not end:
            return None
        start = _token(text, end - 1)
        words.append(text[start:end])
        end = start
    return _key(words[1], words[0])


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without quotes and end marks around it."""
    while start < end and text[start] in _QUOTES:
        start += 1
    while end > start and text[end - 1] in _QUOTES:
        end -= 1
    return start, end


def introduced(text: str, patterns: dict, seconds: tuple[str, ...]):
    """(start, end, kind) of every token that a confident pattern introduces,
    whatever it is made of."""
    low = text.lower()
    if not any(w in low for w in seconds):
        return
    first = second = None
    for m in _TOKEN.finditer(text):
        token = m[0]
        if second is not None and second.lower() in patterns[None]:
            kind = patterns.get(_key(first, second)) if first is not None else None
            if kind:
                a, b = _bare(text, *m.span())
                if a < b:
                    yield a, b, kind
        first, second = second, token


def candidates(text: str, spans: list[tuple[int, int, int]]):
    """(start, end) of tokens with a digit that overlap no base span, without
    quotes and end marks around them."""
    at, n, i = 0, len(text), 0
    while m := _DIGIT.search(text, at):
        start = _token(text, m.start())
        end = m.end()
        while end < n and not text[end].isspace():
            end += 1
        at = end
        while start < end and text[start] in _QUOTES:
            start += 1
        while end > start and text[end - 1] in _QUOTES:
            end -= 1
        while i < len(spans) and spans[i][2] <= start:
            i += 1
        if 6 <= end - start <= LONGEST_VALUE and not any(s[0] < end and s[2] > start for s in spans[i:i + 4]):
            yield start, end


@dataclass(frozen=True)
class Model:
    """Confident patterns and the kind that each introduces."""

    patterns: dict

    @cached_property
    def seconds(self) -> tuple[str, ...]:
        """Second words of the patterns, as they have to stand in a text; of
        digests nothing can be asked for."""
        words = {p.split(" ")[1] for p in self.patterns}
        return ("",) if any(w.startswith("#") for w in words) else tuple(sorted(words))

    @cached_property
    def keyed(self) -> dict:
        """The patterns and, under None, a test of second words."""
        return {**self.patterns, None: _Any() if "" in self.seconds else frozenset(self.seconds)}

    def spans(self, text: str | None) -> tuple[list, list]:
        """Base spans, and all spans as (start, order, kind, end). A token that
        a pattern introduces counts where no base span overlaps it."""
        base = base_spans(text)
        named = [(a, k, BASE[k], b) for a, k, b in base]
        if text and self.patterns:
            kinds = [*BASE, *sorted(set(self.patterns.values()) - set(BASE))]
            i = 0
            for a, b, kind in introduced(text, self.keyed, self.seconds):
                while i < len(base) and base[i][2] <= a:
                    i += 1
                if not any(s[0] < b and s[2] > a for s in base[i:i + 4]):
                    named.append((a, kinds.index(kind), kind, b))
        return base, sorted(named)


class _Any:
    """Holds every word."""

    def __contains__(self, word) -> bool:
        return True


def _edges(docs: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, kind) with the number of places; kind is
    null for a candidate that is no seed. An instance is kept as a digest."""

    def build(batches):
        for batch in batches:
            n: Counter = Counter()
            for value in batch.column("text"):
                text = value.as_py()
                if not text:
                    continue
                base = base_spans(text)
                seeds = [(a, b, BASE[k]) for a, k, b in base]
                seeds += [(a, b, "secret" if _SECRET.fullmatch(text, a, b) else None) for a, b in candidates(text, base)]
                for a, b, kind in seeds:
                    if p := pattern(text, a):
                        n[p, hashlib.blake2b(text[a:b].encode(), digest_size=8).hexdigest(), kind] += 1
            keys = list(n)
            yield pa.RecordBatch.from_pydict({
                "pattern": pa.array([k[0] for k in keys], pa.string()), "instance": pa.array([k[1] for k in keys], pa.string()),
                "kind": pa.array([k[2] for k in keys], pa.string()), "places": pa.array(list(n.values()), pa.int64())})

    found = docs.select("text").mapInArrow(build, "pattern string, instance string, kind string, places long")
    return found.groupBy("pattern", "instance", "kind").agg(F.sum("places").alias("places"))


def _confident(edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """pattern, kind, share, instances, places (of trusted instances)."""
    known = edges.join(trusted.withColumnRenamed("kind", "as_kind"), "instance", "left")
    size = known.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    by_kind = known.filter("as_kind is not null").groupBy("pattern", "as_kind").agg(
        F.countDistinct("instance").alias("good"), F.sum("places").alias("places"))
    told = by_kind.filter(F.col("good") >= MIN_INSTANCES).join(size, "pattern")
    told = told.withColumn("share", F.col("good") / F.col("n")).filter(F.col("share") >= CONFIDENCE)
    return told.select("pattern", F.col("as_kind").alias("kind"), "share", F.col("good").alias("instances"), "places")


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often the two words of each of ``patterns`` (stored, distinct)
    occur in all texts."""
    few = patterns.count() <= SENT_PATTERNS
    shared = docs.sparkSession.sparkContext.broadcast({tuple(r[0].split(" ")) for r in patterns.collect()} if few else None)

    def count(batches):
        wanted = shared.value
        for batch in parted(batches):
            n: Counter = Counter()
            for text in batch.column("text"):
                words = (text.as_py() or "").lower().split()
                pairs = zip(words, words[1:])
                n.update(pairs if wanted is None else (p for p in pairs if p in wanted))
            yield pa.RecordBatch.from_pydict({"pattern": pa.array([" ".join(p) for p in n], pa.string()),
                                              "all": pa.array(list(n.values()), pa.int64())})

    counted = docs.select("text").mapInArrow(count, "pattern string, all long")
    if not few:
        counted = counted.join(patterns, "pattern", "left_semi")
    return counted.groupBy("pattern").agg(F.sum("all").alias("all"))


def _precise(docs: DataFrame, confident: DataFrame) -> DataFrame:
    """pattern, kind, share of the stored ``confident`` patterns whose places
    mostly introduce an instance; of several kinds the best supported."""
    met = _occurrences(docs, stored(confident.select("pattern").distinct(), "patterns"))
    passed = confident.join(met, "pattern", "left").filter(
        F.col("places") >= PRECISION * F.greatest(F.coalesce("all", F.lit(0)), F.lit(1)))
    best = passed.groupBy("pattern").agg(F.min(F.struct((-F.col("instances")).alias("i"), "kind", "share")).alias("b"))
    return best.select("pattern", "b.kind", "b.share")


def learn(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Bootstrap over all of ``docs`` (text)."""
    edges = stored(_edges(docs), "pattern-edges")
    trusted = edges.filter("kind is not null").select("instance", "kind").distinct()
    seeds, most = trusted, 0
    good = None
    for _ in range(rounds):
        confident = stored(_confident(edges, trusted), "confident-patterns")
        if confident.isEmpty():
            break
        good = stored(_precise(docs, confident), "precise-patterns")
        if (n := good.count()) in (0, most):
            break
        most = n
        # noisy-or of the patterns that hold an instance
        new = (edges.select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind")
               .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))).alias("score"))
               .filter(F.col("score") >= CONFIDENCE).select("instance", "kind"))
        trusted = stored(seeds.union(new.join(seeds, "instance", "left_anti")).distinct(), "trusted")
    return Model({r["pattern"]: r["kind"] for r in good.collect()} if good is not None else {})


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches):
        for batch in parted(batches):
            counts, digests, spans = ([], [], [], []), [], []
            for value in batch.column("text"):
                base, named = shared.value.spans(value.as_py())
                for k in range(len(BASE)):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
                spans.append(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in named))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tell, schema)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by [KIND]; overlapping
    spans by the kind of the first. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text):
        if not text:
            return text
        out, done = [], 0
        for a, _, kind, b in shared.value.spans(text)[1]:
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join(out) + text[done:] if out else text

    def apply(batches):
        for batch in parted(batches):
            texts = pa.array([clean(t.as_py()) for t in batch.column("text")], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    return docs.mapInArrow(apply, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, learn(docs))
