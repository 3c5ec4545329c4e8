"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches of each kind's pattern that
pass its test (octets at most 255, 14 to 19 digits with a valid check digit, 10
to 15 digits); a match that fails is dropped and not retried.

The random field reads *regions*: runs of neighbouring words with a digit or an
@, joined by up to ``MOST_GAP`` characters of white space of any kind.  Words of any length
are split at punctuation that numbers and addresses do not have, as in ``tel:645-555-3345``,
JSON or CSV.  A region is cut into segments of one kind each (one to ``MOST_WORDS`` words) or
of single other words; whole-segment features (digit count, shape, separators,
check digit, octets, @ and dots, brackets, the word before) and transitions score
a segmentation, and dynamic programming over (end, kind) picks boundaries and
kinds jointly.  It is learnt by maximum likelihood from the base spans of a
bounded sample of documents (``max_docs``, 2000; ``max_regions`` of their regions, 1500) and from made-up regions of forms
the patterns miss (national phone numbers, grouped numbers, numbers that are
nothing).  A decoded span is added where it meets no base span.

Defined results
* null or empty text: no spans.  Texts are read whole and words and regions decoded whole, however long.
* null ids and repeated rows pass through row by row; empty table: no rows.
* extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels as K

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MOST_WORDS, MOST_GAP, TAUGHT_WORDS = 6, 4, 24
_SPACE = re.compile(r"\s+")
_PIECE = re.compile(r"[^\"'<>\[\]{},;:=|&/\\?!#*~^`$]+")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True
_MARK = re.compile(r"[0-9@]")
_STRIP = ".,;:!?\"'<>[]{}"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ is looked at once, from the longest run of local characters before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then by kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a word with a digit or @."""
    for m in _PIECE.finditer(text, start, end):
        if _MARK.search(text, *m.span()):
            yield m.span()


def regions(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Runs of neighbouring words with a digit or @: the word before, and the words' spans."""
    found: list[tuple[str, list[tuple[int, int]]]] = []
    done = 0
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        for start, at in _pieces(text, start, end):
            gap = text[found[-1][1][-1][1] : start] if found and start - found[-1][1][-1][1] <= MOST_GAP else ""
            if gap.isspace():
                found[-1][1].append((start, at))
            else:
                before = re.findall(r"[^\s\"]+", text[max(0, start - 24) : start])
                found.append((before[-1].strip(_STRIP + "()").lower() if before else "", [(start, at)]))
        done = end
        m = _MARK.search(text, end)
    return found


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The segment without punctuation around it, and without brackets that have no partner."""
    while start < end and (text[start] in _STRIP or text[start] == ")" or text[start] == "(" and ")" not in text[start:end]):
        start += 1
    while start < end and (text[end - 1] in _STRIP or text[end - 1] == "(" or text[end - 1] == ")" and "(" not in text[start:end]):
        end -= 1
    return start, end


def segment_features(s: str, n_words: int, before: str) -> list[str]:
    """Features of a whole segment; white space counts as one space."""
    s = _SPACE.sub(" ", s)
    digits = "".join(c for c in s if "0" <= c <= "9")
    shape = re.sub(r"[0-9]+", lambda m: f"{min(len(m.group()), 9)}d", re.sub(r"[^\W\d_]+", "a", s))
    parts = s.split(".")
    out = [f"digits={min(len(digits), 20)}", f"words={n_words}", f"before={before}"]
    if len(shape) <= 24:
        out.append(f"shape={shape}")
    out.append("letters" if any(c.isalpha() for c in s) else "no letters")
    if s.count("@") == 1:
        name, _, host = s.partition("@")
        out.append(f"at={bool(name)}{'.' in host.strip('.')}")
    if s.startswith("+"):
        out.append("plus")
    if "(" in s:
        out.append("bracket")
    if len(digits) >= 13:
        out.append(f"check={luhn(digits)}")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts):
        out.append(f"octets={all(int(p) <= 255 for p in parts)}")
    out.append("seps=" + "".join(sorted({c for c in s if c in " -.()/:_=,"})))
    return out


class SemiMarkovField:
    """Weights of (kind, segment feature) and (kind, kind) pairs."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = dict(weights or {})

    def _ending(self, text: str, before: str, words: list[tuple[int, int]], b: int) -> Iterator[tuple[int, str, list[str]]]:
        """(first, kind, features) of every candidate segment that ends at word ``b``."""
        for a in range(max(0, b - MOST_WORDS), b):
            prior = before if a == 0 else text[slice(*words[a - 1])].strip(_STRIP + "()").lower()[:12]
            s, e = trimmed(text, words[a][0], words[b - 1][1])
            f = segment_features(text[s:e], b - a, prior)
            if b == a + 1:
                yield a, "other", f
            if e > s:
                for kind in KINDS:
                    yield a, kind, f

    def _segments(self, text: str, before: str, words: list[tuple[int, int]]):
        """The candidate segments by end."""
        return [[]] + [list(self._ending(text, before, words, b)) for b in range(1, len(words) + 1)]

    def _score(self, kind: str, features: list[str]) -> float:
        return sum(self.w.get((kind, f), 0.0) for f in features)

    def decode(self, text: str, before: str, words: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best segmentation: (first word, end word, kind) of its segments that are of a kind."""
        names = ("other", *KINDS, "start")
        # Scores of the last ends only; of each end and kind, one byte tells the length and the prior kind.
        best: dict[int, dict[str, float]] = {0: {"start": 0.0}}
        back, width = bytearray((len(words) + 1) * (len(names) - 1)), len(names) - 1
        for b in range(1, len(words) + 1):
            here: dict[str, float] = {}
            for a, kind, f in self._ending(text, before, words, b):
                s = self._score(kind, f)
                for prior, p in best[a].items():
                    t = p + s + self.w.get((prior, kind), 0.0)
                    if kind not in here or t > here[kind]:
                        here[kind] = t
                        back[b * width + names.index(kind)] = (b - a) * len(names) + names.index(prior)
            best[b] = here
            best.pop(b - MOST_WORDS, None)
        out, b = [], len(words)
        kind = max(best[b], key=lambda k: best[b][k])
        while b:
            size, prior = divmod(back[b * width + names.index(kind)], len(names))
            if kind != "other":
                out.append((b - size, b, kind))
            b, kind = b - size, names[prior]
        return out[::-1]

    def learn(self, examples, epochs: int = 5, rate: float = 0.3, l2: float = 1e-4) -> None:
        """AdaGrad on the log likelihood of the right segmentations, by forward and backward sums."""
        seen: dict[tuple[str, str], float] = defaultdict(lambda: 1e-1)
        prepared = [(self._segments(text, before, words), gold) for text, before, words, gold in examples]
        rng = random.Random(5)
        for _ in range(epochs):
            rng.shuffle(prepared)
            for by_end, gold in prepared:
                for key, g in self._gradient(by_end, gold).items():
                    g -= l2 * self.w.get(key, 0.0)
                    seen[key] += g * g
                    self.w[key] = self.w.get(key, 0.0) + rate * g / math.sqrt(seen[key])

    def _gradient(self, by_end, gold: list[tuple[int, int, str]]) -> dict[tuple[str, str], float]:
        n = len(by_end) - 1
        right = {(a, b, k) for a, b, k in gold}
        covered = {i for a, b, _ in gold for i in range(a, b)}
        right |= {(i, i + 1, "other") for i in range(n) if i not in covered}
        scored = [[(a, k, f, self._score(k, f)) for a, k, f in row] for row in by_end]
        ahead: list[dict[str, float]] = [{"start": 0.0}]
        for b in range(1, n + 1):
            terms: dict[str, list[float]] = defaultdict(list)
            for a, k, _, s in scored[b]:
                terms[k].extend(p + s + self.w.get((prior, k), 0.0) for prior, p in ahead[a].items())
            ahead.append({k: _log_sum(v) for k, v in terms.items()})
        back: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(ahead[n], 0.0)]
        lists: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n)]
        for b in range(n, 0, -1):
            if b < n:
                back[b] = {k: _log_sum(v) for k, v in lists[b].items()}
            for a, k, _, s in scored[b]:
                if k in back[b]:
                    for prior in ahead[a]:
                        lists[a][prior].append(s + self.w.get((prior, k), 0.0) + back[b][k])
        z = _log_sum(list(ahead[n].values()))
        g: dict[tuple[str, str], float] = defaultdict(float)
        kind_at = {b: k for _, b, k in right}
        for b in range(1, n + 1):
            for a, k, f, s in scored[b]:
                if k not in back[b]:
                    continue
                total = 0.0
                for prior, p in ahead[a].items():
                    q = math.exp(min(0.0, p + s + self.w.get((prior, k), 0.0) + back[b][k] - z))
                    total += q
                    if prior != "start":
                        g[prior, k] -= q
                is_right = (a, b, k) in right
                if is_right and a:
                    g[kind_at[a], k] += 1.0
                d = is_right - total
                if abs(d) > 1e-6:
                    for x in f:
                        g[k, x] += d
        return g


def _log_sum(v: list[float]) -> float:
    top = max(v)
    return top + math.log(sum(math.exp(x - top) for x in v))


def _aligned(text: str, before: str, words: list[tuple[int, int]], spans: list[Span]):
    """An example with its right segments, or None if a base span does not end at words."""
    lo, hi = words[0][0], words[-1][1]
    gold, used = [], -1
    for kind, s, e in spans:
        if s >= hi or e <= lo:
            continue
        fits = [(a, b) for a in range(len(words)) for b in range(a + 1, min(len(words), a + MOST_WORDS) + 1) if trimmed(text, words[a][0], words[b - 1][1]) == (s, e)]
        if not fits or fits[0][0] < used:
            return None
        gold.append((*fits[0], kind))
        used = fits[0][1]
    return text, before, words, gold


def made_up(count: int = 900, seed: int = 3) -> list:
    """Regions of forms that the patterns miss or must not take, with their right segments."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    out = []
    for i in range(count):
        form = i % 9
        kind = None
        if form == 0:
            s, kind = f"({r.randint(200, 999)}) {r.randint(200, 999)}-{d(4)}", "phone"
        elif form == 1:
            s, kind = f"{r.randint(200, 999)}-{r.randint(200, 999)}-{d(4)}", "phone"
        elif form == 2:
            s, kind = f"+{r.randint(1, 99)} {d(2)} {d(4)} {d(4)}", "phone"
        elif form == 3:
            s, kind = f"+{r.randint(1, 9)} ({r.randint(200, 999)}) {r.randint(200, 999)}-{d(4)}", "phone"
        elif form == 4:
            digits = str(r.randint(3, 6)) + d(14)
            digits += next(c for c in "0123456789" if luhn(digits + c))
            sep = r.choice(["", " ", "-"])
            s, kind = sep.join(digits[j : j + 4] for j in range(0, 16, 4)), "card"
        elif form == 5:
            digits = d(16)
            s = digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
        elif form == 6:
            s = r.choice([d(r.randint(1, 7)), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"{d(3)},{d(3)}", f"{d(2)}%", f"a{d(3)}", f"{d(20)}", f"{d(5)}-{d(5)}", "x@y", f"@a{d(2)}"])
        elif form == 7:
            s, kind = ".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"
        else:
            s = r.choice([".".join(str(r.randint(256, 999)) for _ in range(4)), f"{d(18)}", f"{d(8)}{r.choice('abcdef')}{d(7)}", f"password={d(9)}a{d(3)}"])
        out.append((s, [(kind, 0, len(s))] if kind else []))
    # Regions of several forms and of plain numbers in rows, as in tables.
    for i in range(count // 3):
        parts = [r.choice(out[:count]) for _ in range(r.randint(2, 4))]
        for _ in range(2):
            parts.insert(r.randint(0, len(parts)), (" ".join(d(r.randint(1, 5)) for _ in range(r.randint(1, 8))), []))
        s, spans = "", []
        for t, own in parts:
            s += " " if s else ""
            spans += [(k, a + len(s), b + len(s)) for k, a, b in own]
            s += t
        out.append((s, spans))
    return [x for s, spans in out for before, words in regions(s) if (x := _aligned(s, before, words, spans)) is not None]


def _taught(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The regions to learn from; those of more than ``TAUGHT_WORDS`` words in pieces (one that cuts a span is not learnt from)."""
    for before, words in regions(text):
        for a in range(0, len(words), TAUGHT_WORDS):
            prior = before if a == 0 else text[slice(*words[a - 1])].strip(_STRIP + "()").lower()[:12]
            yield prior, words[a : a + TAUGHT_WORDS]


def fit(docs: DataFrame, text: str = "text", row_id: str = "doc_id", max_docs: int = 2000, max_regions: int = 1500) -> SemiMarkovField:
    """The field learnt from the base spans of the ``max_docs`` documents of smallest hashed id, by at most ``max_regions`` distinct regions of them."""
    ids = docs.select(F.col(row_id).alias("__id")).dropna().distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    # max_docs bounds this side, so it may be broadcast at any size of the corpus.
    rows = docs.select(F.col(row_id).alias("__id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "__id").select("text")

    def examples(batches):
        for batch in batches:
            found = []
            for t in _marked(batch.column(0)):
                spans = base_spans(t)
                for before, words in _taught(t):
                    lo, hi = max(0, words[0][0] - 24), words[-1][1]
                    found.append((t[lo:hi], before, [f"{a - lo}-{b - lo}" for a, b in words], [f"{k}:{a - lo}:{b - lo}" for k, a, b in spans if a < hi and b > words[0][0]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array([" ".join(x[2]) for x in found]), pa.array([",".join(x[3]) for x in found])], ["t", "before", "words", "spans"])

    got = rows.mapInArrow(examples, "t string, before string, words string, spans string").distinct().orderBy(F.xxhash64("t"), "t", "before").limit(max_regions).collect()
    learnt = []
    for r in got:
        words = [tuple(map(int, w.split("-"))) for w in r["words"].split(" ")]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        if (one := _aligned(r["t"], r["before"], words, spans)) is not None:
            learnt.append(one)
    field = SemiMarkovField()
    field.learn(made_up() + learnt)
    return field


def _marked(column: pa.Array) -> Iterator[str | None]:
    """The texts with a digit or @, as strings."""
    for i, t in _texts(column):
        if t:
            yield t


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Row and text; the text is left empty where it has no digit and no @."""
    for a, b, buf, off in K.runs(column):
        marks = np.concatenate(([0], np.cumsum(_TRIGGER[buf])))
        has = marks[off[1:]] > marks[off[:-1]]
        raw = buf.tobytes()
        for i in range(b - a):
            yield a + i, raw[off[i] : off[i + 1]].decode("utf-8", "surrogatepass") if has[i] else ""


def _meets(base: list[Span], starts: list[int], longest: int, s: int, e: int) -> bool:
    """Whether a base span meets [s, e); ``base`` is sorted by start."""
    return any(x[2] > s for x in base[bisect_left(starts, s - longest) : bisect_left(starts, e)])


def find(text: str, field: SemiMarkovField | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with what the field adds."""
    base = base_spans(text)
    every = list(base)
    starts, longest = [x[1] for x in base], max((x[2] - x[1] for x in base), default=0)
    if field is not None:
        for before, words in regions(text):
            for a, b, kind in field.decode(text, before, words):
                s, e = trimmed(text, words[a][0], words[b - 1][1])
                if not _meets(base, starts, longest, s, e):
                    every.append((kind, s, e))
    return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: SemiMarkovField | None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points; end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(field.w if field else None)  # of bounded size
    span = "array<struct<kind:string,start:long,end:long>>"
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        own = SemiMarkovField(shared.value) if shared.value is not None else None
        for batch in batches:
            base, every = [], []
            for _, t in _texts(batch.column(1)):
                a, b = find(t, own) if t else ([], [])
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in a])
                every.append([{"kind": k, "start": s, "end": e} for k, s, e in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, struct), pa.array(every, struct)], ["doc_id", "base", "spans"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"doc_id long, base {span}, spans {span}")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans, and all spans as text."""
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    count = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(join(F.col("base")), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join(out) + text[at:]


def sha(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
