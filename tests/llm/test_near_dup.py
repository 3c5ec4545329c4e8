import re
from itertools import combinations

import pytest

from textquarry.llm.near_dup import keep_first, near_duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, num, den):
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    up = {i: i for i in range(len(rows))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i][1], sets[j][1]
        if sets[i][0] is not None and sets[j][0] is not None and a and b and den * len(a & b) >= num * len(a | b):
            up[max(root(i), root(j))] = min(root(i), root(j))
    group = {}
    for i in range(len(rows)):
        group.setdefault(root(i), []).append(sets[i][0])
    out = []
    for i, (d, s) in enumerate(sets):
        c = None if d is None else min(group[root(i)])
        out.append((d, len(s), c, d is None or d == c))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_matches_brute_force(frame, corpus, odd, k, num, den):
    rows = corpus + [r if r[0] is None else (r[0] + 1000, *r[1:]) for r in odd]
    got = near_duplicates(frame(rows, clash=True), k, num, den)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, num, den)


def test_families_of_partly_similar_texts(frame):
    # A chain of edits: neighbours are similar, ends are not; and a rim that is similar to nothing.
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for j in range(i):
            words[(j * 7) % 60] = f"e{j}"
        rows.append((i, " ".join(words), "en", "s", None))
    got = near_duplicates(frame(rows), 3, 85, 100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 85, 100)


def test_empty_table(frame):
    assert near_duplicates(frame([])).count() == 0


def brute_first(rows, k, num, den):
    """The rows that stay: one of each component, by the smallest id and then any text of that id in it."""
    rows = list(dict.fromkeys((r[0], r[1]) for r in rows if r[0] is not None))
    groups = {}
    for (d, t), c in zip(rows, component_numbers(rows, k, num, den)):
        groups.setdefault(c, []).append((d, t))
    return [(min(d for d, _ in g), {t for d, t in g if d == min(x for x, _ in g)}) for g in groups.values()]


def component_numbers(rows, k, num, den):
    sets, number = [shingles(t, k) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((number[i], number[j]))
            number = [a if x == b else x for x in number]
    return number


def test_keep_first_keeps_one_of_each(frame, corpus, odd):
    """Ids of ``odd`` stand in ``corpus`` too, with other texts: these are documents of their own."""
    kept = [tuple(r) for r in keep_first(frame(corpus + odd, clash=False).limit(10**6), 3, 85, 100).collect()]
    assert sum(r[0] is None for r in kept) == 1
    want = brute_first(corpus + odd, 3, 85, 100)
    got = [(r[0], r[1]) for r in kept if r[0] is not None]
    assert sorted(d for d, _ in got) == sorted(d for d, _ in want)
    for d, texts in want:
        match = [g for g in got if g[0] == d and g[1] in texts]
        assert match
        got.remove(match[0])


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_share_an_id_have_classes_of_their_own(frame, turned):
    a = " ".join(f"a{i}" for i in range(60))
    b = [f"b{i}" for i in range(60)]
    rows = [(5, a), (5, " ".join(b)), (9, " ".join([*b[:-1], "other"])), (7, a.replace("a59", "z")), (7, "an other text of this id"), (8, "an other text of this id")]
    rows = [(*r, "en", "s", None) for r in (rows[::-1] if turned else rows)]
    got = near_duplicates(frame(rows), 3, 85, 100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()}[9] == 5
    kept = sorted((r["doc_id"], r["text"][:2]) for r in keep_first(frame(rows), 3, 85, 100).collect())
    assert kept == [(5, "a0"), (5, "b0"), (7, "an")]
