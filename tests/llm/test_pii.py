import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")


def plain(text):
    """The patterns as they are written."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@- +()25é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_learns_boundaries_and_kinds():
    field = pii.SemiMarkovField()
    field.learn(pii.made_up(600))
    base, every = pii.find("call (645) 555-3345 now, or 10.1.2.3", field)
    assert base == [("ip", 28, 36)] and ("phone", 5, 19) in every and ("ip", 28, 36) in every
    assert pii.find("in 1998 about 12 of 300 rows", field)[1] == []


def test_dynamic_program_finds_the_best_segmentation():
    field = pii.SemiMarkovField()
    field.learn(pii.made_up(300), epochs=2)
    text = "+1 (645) 555-3345 4111111111111111 12"
    words = [m.span() for m in re.finditer(r"\S+", text)]
    by_end = field._segments(text, "", words)

    def every(a, prior):
        if a == len(words):
            yield 0.0, []
        for b in range(a + 1, len(words) + 1):
            for start, kind, f in by_end[b]:
                if start == a:
                    own = field._score(kind, f) + field.w.get((prior, kind), 0.0)
                    for s, rest in every(b, kind):
                        yield own + s, ([(a, b, kind)] if kind != "other" else []) + rest

    assert field.decode(text, "", words) == max(every(0, "start"), key=lambda x: x[0])[1]


def test_field_reads_whole_regions_long_words_and_any_white_space():
    field = pii.SemiMarkovField()
    field.learn(pii.made_up(600))
    phone = "(645) 555-3345"

    def spans(text):
        return {text[s:e] for k, s, e in pii.find(text, field)[1] if k == "phone"}

    for n in range(20, 30):
        text = "12 " * n + phone + " 7" * 20
        assert [len(w) for _, w in pii.regions(text)] == [n + 22] and spans(text) == {phone}, n
    for gap in ("  ", "\t", "\n", "\r\n"):
        assert spans(f"call (645){gap}555-3345 now") == {f"(645){gap}555-3345"}
    filler = '"note":"' + "x" * 80 + '"'
    assert spans("{" + filler + ',"phone":"645-555-3345","n":12}') == {"645-555-3345"}
    assert spans("{" + filler + ',"phone":"(645) 555-3345","n":12}') == {phone}
    assert spans(",".join(["name"] * 20 + ["645-555-3345", "12"])) == {"645-555-3345"}
    for n in (0, 3, 55, 70, 300):  # the same at every length of the word
        assert spans("k" * n + "tel:645-555-3345") == {"645-555-3345"}, n
        assert spans("a;b=" + "k" * n + "-645-555-3345") == set() or n == 0, n
    assert spans('{"a":1,"tel":"645-555-3345"}') == spans("7,645-555-3345,x") == spans("tel=645-555-3345;") == {"645-555-3345"}
    assert [w for _, w in pii.regions("x" * 30 + "9" * 65)] == [[(0, 95)]]
    many = pii.regions("12 " * 100_000)
    assert len(many) == 1 and len(many[0][1]) == 100_000


def test_rows(spark, frame, odd):
    docs = frame(odd, clash=True)
    got = pii.span_digests(pii.personal_data(docs, pii.fit(docs))).collect()
    want = sorted((str(r[0]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(r[1] or "")).encode()).hexdigest()) for r in odd)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    nine = next(r for r in got if r["doc_id"] == 9)
    assert (nine["n_email"], nine["n_ip"], nine["n_card"], nine["n_phone"]) == (1, 1, 0, 1)
    assert pii.personal_data(frame([]), None).count() == 0


def test_redaction():
    text = "write to a@b.example now"
    assert pii.redacted(text, pii.base_spans(text)) == "write to <email> now"
