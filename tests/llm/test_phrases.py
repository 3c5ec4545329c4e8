import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.phrases import Sizes, collocations


def brute(rows, min_count, top, covered=(50, 100)):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < min_count:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= min_count and p in (q[:2], q[1:]) and covered[1] * b >= covered[0] * a for q, b in c.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def sizes(**given):
    """Few counters, so that many words and pairs share one."""
    return Sizes(**({"words": 1 << 6, "pairs": 1 << 17} | given))


@pytest.mark.parametrize(("gather", "split"), [(1 << 20, 1 << 21), (50, 1 << 21), (50, 4), (1 << 20, 4)])
def test_matches_brute_force(frame, corpus, odd, gather, split):
    rows = corpus + odd + [(200 + i, "The cat, the CAT sat. of the of the of the! the the the the\tthe", "de" if i % 3 else None, "s", 1) for i in range(20)]
    assert result(collocations(frame(rows, clash=True), 3, 50, sizes=sizes(gather=gather, split=split))) == brute(rows, 3, 50)


def test_long_texts_in_pieces(frame, corpus):
    text = "".join(r[1] + (". " if i % 4 else "\t") for i, r in enumerate(corpus))
    rows = [(1, text, "en", "s", 1), (2, text[::-1], "fr", "s", 1), (3, "y" * 500 + " a b a b " + "a b, " * 40, "en", "s", 1)]
    for size in (64, 301):
        assert result(collocations(frame(rows), 4, 100, sizes=sizes(run_bytes=size))) == brute(rows, 4, 100)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abAB .,\t\n", max_size=40), st.sampled_from(["en", "", None])), max_size=12), st.integers(1, 4))
def test_any_texts(frame, texts, min_count):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate(texts)]
    assert result(collocations(frame(rows), min_count, 7, sizes=sizes(run_bytes=16))) == brute(rows, min_count, 7)


def test_large_counts_are_exact(spark):
    """The score's arithmetic beyond 64 bits."""
    a, left, right = 123456789012345, 987654321098765, 223456789012345
    got = spark.sql(f"select cast((cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * 1000000) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0))) as long) as s").first()["s"]
    assert got == 1000000 * a * a // (left * right)


def test_empty_table_and_bounds(frame):
    out = collocations(frame([]))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        collocations(frame([]), min_count=300)
