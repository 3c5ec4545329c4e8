import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textquarry.llm import kernels as K
from textquarry.llm import quality, toxicity
from textquarry.llm.features import held_out, sample
from textquarry.llm.registry import QUERIES

BAD = ["junk!! SHOUT!! junk!!", "a | b | c | d"]


def prose(rng, n):
    words = [a + b for a in ("ka", "lo", "mi", "re", "tu", "vo") for b in ("n", "rs", "la", "st", "pe", "dum", "tra")]
    return " ".join(rng.choice(words) for _ in range(n))


def rows_and_labels():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = prose(rng, 80) if good else " ".join([rng.choice(BAD)] * 15)
        toxic = good and i % 5 == 0
        if toxic:
            words = text.split()
            for _ in range(1 + i % 6):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "trash"]))
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark, frame):
    rows, labels = rows_and_labels()
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(data):
    docs, labels = data
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_pairwise_term_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    n = 50
    m = quality.FactorisationMachine(0.5, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(0), np.ones(0))
    at, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    got, _ = m.margins(1, np.zeros(4, int), at, x)
    want = 0.5 + m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert got[0] == pytest.approx(want)


def plain_words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text) if lower else text)


def plain_bag(text, bits):
    """Bucket and count of each hashed word, one word at a time."""
    count = Counter()
    for w in plain_words(text):
        h = K.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]
        count[int(h) >> (64 - bits)] += 1
    return count


def plain_stats(text, n_chars):
    raw, w = text.encode(), plain_words(text)
    spaces, lines = b" \t\n\x0b\x0c\r", text.count("\n") + 1
    of = lambda test: sum(map(test, raw)) / max(len(raw), 1)
    n = max(len(w), 1)
    own = plain_words(text, False)
    ends = [x.encode()[-1] for x in own]
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or 48 <= c <= 57
    sign = lambda c: c < 128 and not letter(c) and c not in spaces and chr(c) not in ".,'-"
    triples = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    return [
        math.log1p(len(raw)), math.log1p(len(w)), math.log1p(lines), sum(len(x.encode()) for x in w) / n,
        of(lambda c: 65 <= c <= 90), of(lambda c: 48 <= c <= 57), of(sign), raw.count(b"|") / n, of(lambda c: c in spaces), of(lambda c: c >= 128),
        len(set(w)) / n, max(Counter(w).values(), default=0) / n, len(triples) / max(len(w) - 2, 1), sum(a == b for a, b in zip(w, w[1:])) / n,
        sum(len(x.encode()) <= 2 for x in own) / n, sum(map(sign, ends)) / n, math.log1p(len(raw) / lines), math.log1p(len(raw) if n_chars is None else max(n_chars, 0)),
    ]


def some_texts(odd):
    rows, _ = rows_and_labels()
    return [(r[0], r[1], r[4]) for r in rows[:25]] + [(1000 + i, r[1] or "", r[4]) for i, r in enumerate(odd)]


def test_quality_scores_match_a_plain_machine(spark, frame, data, odd):
    m = quality.fit(*data)
    texts = some_texts(odd)
    got = {r["doc_id"]: r["score"] for r in quality.scores(frame([(d, t, None, None, n) for d, t, n in texts]), m).collect()}
    for d, text, n_chars in texts:
        x = {b: math.log1p(n) for b, n in plain_bag(text, quality.BITS).items()}
        norm = max(math.sqrt(sum(v * v for v in x.values())), 1e-9)
        x = {b: v / norm for b, v in x.items()}
        for i, v in enumerate(plain_stats(text, n_chars)):
            x[(1 << quality.BITS) + i] = min(5, max(-5, (v - m.centre[i]) / m.scale[i])) / 2
        at, values = list(x), np.array(list(x.values()))
        s = m.w0 + m.w[at] @ values
        for f in range(quality.RANK):
            t = m.v[at, f] * values
            s += sum(t[i] * t[:i].sum() for i in range(len(t)))  # every pair once
        assert got[d] == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, s)))), abs=1e-4), d


def test_severities_match_a_plain_model(frame, data, odd):
    m = toxicity.fit(*data)
    texts = some_texts(odd)
    got = {r["doc_id"]: r for r in toxicity.severities(frame([(d, t, None, None, n) for d, t, n in texts]), m).collect()}
    for d, text, _ in texts:
        s = sum(m.w[b] * math.log2(1 + n) for b, n in plain_bag(text, toxicity.BITS).items())
        below = [0.0] + [1 / (1 + math.exp(-min(30, max(-30, t - s)))) for t in m.theta] + [1.0]
        p = np.diff(below)
        assert got[d]["score"] == pytest.approx(1 - p[0], abs=1e-6) and got[d]["severity"] == pytest.approx(sum(i * q for i, q in enumerate(p)), abs=1e-6)
        assert got[d]["grade"] == (0 if 1 - p[0] < m.threshold else 1 + int(np.argmax(p[1:])))


def test_sample_takes_one_text_of_a_repeated_id(spark, frame):
    rows = [(1, t, "en", "s", None) for t in ("one text", "an other text", "one text")] + [(2, "x", "en", "s", 1)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    picks = [sorted((r["doc_id"], r["text"], r["label"]) for r in sample(frame(x), labels, "quality", 10).collect()) for x in (rows, rows[::-1])]
    assert picks[0] == picks[1] and len({p[0] for p in picks[0]}) == len(picks[0])


def test_toxicity_on_held_out_rows(data):
    docs, labels = data
    got = toxicity.toxic_severity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    assert np.mean([r["severity"] for r in got if r["toxic"]]) > 1 > np.mean([r["severity"] for r in got if not r["toxic"]])
    assert all(0 <= r["severity"] <= 3 for r in got)


def test_thresholds_are_ordered_and_shared():
    off, bucket, n = np.arange(0, 91, 1), np.arange(90) % 3, np.ones(90, np.float32)
    model = toxicity.train(off, bucket, n, np.arange(90) % 3)
    p = model.distribution(np.arange(4), np.arange(3), np.ones(3))
    assert (np.diff(model.theta) >= 0).all() and p.sum(axis=1) == pytest.approx(1) and (p.argmax(axis=1) == [0, 1, 2]).all()


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxic_severity])
def test_odd_rows_no_labels_and_empty_table(spark, frame, odd, operator):
    labels = spark.createDataFrame([(9, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert operator(frame(odd, clash=True), labels).count() == len(odd)
    none = operator(frame(odd), labels.limit(0)).collect()
    assert len(none) == len(odd) and len({r["score"] for r in none}) == 1
    assert operator(frame([]), labels).count() == 0


def test_keep_good_keeps_columns(data):
    docs, labels = data
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    want = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    assert len(want - ids) <= 2 and len(ids - want) <= 5


def test_queries_learn_from_no_held_out_row(spark):
    got = QUERIES["op2_factorisation_quality"](spark, "/root/testdata/sf0.001")
    ids = got.select("doc_id", "held_out", held_out().alias("again")).collect()
    import zlib

    assert all(r["held_out"] == r["again"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in ids)
