"""Reading a request in words: intent, topic, and what a query is rewritten to.

Driver-side logic over one request; nothing here touches data.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# Words that carry no topic, and patterns of intents with confidence and specificity.
STOP = frozenset("a an and about are as at be by can do does for from give has have how i in is it me my of on or please show tell that the their this to was were what when where which who why with you".split())
INTENTS = (
    ("list_files", r"\b(list|show|which|what)\b.*\b(files|archives)\b", 0.9, 8),
    ("metadata", r"\bmetadata\b|\babout this archive\b", 0.9, 7),
    ("main_page", r"\b(main|home|front) ?page\b", 0.95, 9),
    ("list_namespaces", r"\b(list|show|what)\b.*\bnamespaces\b", 0.95, 9),
    ("walk_namespace", r"\bwalk\b.*\bnamespace\b|\ball entries\b", 0.9, 9),
    ("browse", r"\bbrowse\b", 0.85, 7),
    ("get_section", r"\bsections?\b.*\b(of|from|in)\b", 0.9, 8),
    ("toc", r"\b(table of contents|toc|contents of)\b", 0.95, 9),
    ("structure", r"\b(structure|outline|headings)\b.*\b(of|for)\b", 0.85, 7),
    ("summary", r"\b(summar(y|ise|ize)|overview)\b", 0.85, 6),
    ("related", r"\b(related|similar)\b.*\b(to|articles)\b", 0.9, 8),
    ("links", r"\b(links?|references)\b.*\b(in|from|of|to)\b", 0.85, 7),
    ("binary", r"\b(image|pdf|video|audio|binary|media)\b.*\b(get|from|of|fetch)\b|\b(get|fetch)\b.*\b(image|pdf|video|audio|binary)\b", 0.85, 7),
    ("suggestions", r"\b(suggest|autocomplete|completions?|titles starting)\b", 0.9, 8),
    ("filtered_search", r"\bsearch\b.*\b(in namespace|within|of type|content type)\b", 0.9, 9),
    ("search_all", r"\bsearch\b.*\b(all|every|across)\b.*\b(files|archives)\b", 0.95, 9),
    ("get_zim_entries", r"\b(get|fetch|read)\b.*\b(articles|entries|pages)\b.*\band\b", 0.8, 7),
    ("find_by_title", r"\b(find|titled|named|called)\b.*\b(title|titled|named|called|article)\b", 0.85, 7),
    ("get_article", r"\b(get|fetch|read|open|show)\b.*\b(article|entry|page)\b", 0.8, 6),
    ("search", r"\b(search|find|look up|look for)\b", 0.7, 4),
    ("tell_me_about", r"\b(tell me about|what (is|are|was|were)|who (is|are|was|were)|explain|describe)\b", 0.75, 5),
)
# Misspelt words and their spellings.
MISSPELLINGS = dict(x.split("=") for x in (
    "acommodate=accommodate accomodate=accommodate recieve=receive seperate=separate occured=occurred occurence=occurrence neccessary=necessary neccesary=necessary "
    "truely=truly embarass=embarrass embarrasing=embarrassing goverment=government independant=independent maintainance=maintenance mispell=misspell priviledge=privilege "
    "publically=publicly referal=referral succesful=successful tomatos=tomatoes photosythesis=photosynthesis photosythesise=photosynthesise bilogy=biology "
    "mediterranian=mediterranean mediterrean=mediterranean egiptian=egyptian brittish=british arithmatic=arithmetic asssassination=assassination beggining=beginning "
    "millenium=millennium parralel=parallel tommorow=tomorrow tuesdsay=tuesday wedensday=wednesday hierachy=hierarchy existance=existence inteligence=intelligence ressurection=resurrection"
).split())
OPERATORS = frozenset(("and", "or", "not", "near", "xor", "adj"))


def intent(request: str) -> tuple[str, float]:
    """The intent with the best 0.7 x confidence + 0.3 x specificity / 10; ``search`` if none matches."""
    low = request.lower()
    best = ("search", 0.0)
    for name, pattern, confidence, specificity in INTENTS:
        if re.search(pattern, low):
            score = round(0.7 * confidence + 0.3 * specificity / 10, 6)
            if score > best[1]:
                best = (name, score)
    return best


def topic(request: str) -> str:
    """The request without question words around its topic."""
    tokens = re.findall(r"[^\W_]+(?:['’][^\W_]+)*|[+#&*]+", request)
    while tokens and tokens[0].lower() in STOP:
        tokens.pop(0)
    while tokens and tokens[-1].lower() in STOP:
        tokens.pop()
    return " ".join(tokens)


def snippet_terms(query: str) -> list[tuple[str, bool]]:
    """(term, is prefix) of a folded query: its runs of word characters, without operators and field names; three letters at least, four for prefixes."""
    from textquarry.functions.snippets import LEAST_PREFIX, LEAST_TERM, folded

    plain = re.sub(r"(?<!\w)(?:title|path):", " ", folded(query))
    found = [(m[1], bool(m[2])) for m in re.finditer(r"(\w+)(\*?)", plain)]
    return [(w, prefix) for w, prefix in found if w not in OPERATORS and len(w) >= (LEAST_PREFIX if prefix else LEAST_TERM)]


def respelt(query: str, misspellings: dict[str, str] | None = None, known: Callable[[str], bool] | None = None, excluded: frozenset[str] = frozenset()) -> str:
    """The query with each misspelt word put right; a word that is known as it is, or excluded, stays.

    Punctuation around a word and the end of a possessive are kept.
    """
    misspellings = MISSPELLINGS if misspellings is None else misspellings

    def fix(m: re.Match) -> str:
        word, end = m.group(1), m.group(2) or ""
        right = misspellings.get(word.lower())
        if right is None or word.lower() in excluded or (known is not None and known(word)):
            return m.group(0)
        return (right.capitalize() if word[:1].isupper() else right) + end

    return re.sub(r"([^\W\d_]+)(['’]s)?", fix, query)


def without_article(title: str) -> str:
    return re.sub(r"^(the|an?)\s+", "", title, flags=re.I)


def of_parts(query: str) -> tuple[str, str] | None:
    """(whole, part) of ``part of whole``."""
    m = re.match(r"^(.+?)\s+of\s+(?:the\s+)?(.+)$", query.strip(), re.I)
    return (m.group(2), m.group(1)) if m and m.group(1).lower() not in ("list", "index", "outline") else None


def entities(query: str) -> list[str]:
    """The parts of a list of at least three things; ``a/b`` stays whole."""
    parts = [p.strip() for p in re.split(r"\s*(?:,|;|\band\b|\bvs\.?\b|\bversus\b)\s*", query, flags=re.I)]
    parts = [p for p in parts if topic(p)]
    return parts if len(parts) >= 3 else []


def alternative_archives(query: str, archives: Iterable[str]) -> list[str]:
    """Archives whose name holds a word of the query of at least four letters."""
    words = {w for w in re.findall(r"[a-z0-9]+", query.lower()) if len(w) >= 4}
    return [a for a in archives if any(w in a.lower() for w in words)]


def subject(request: str, kind: str) -> str:
    """What a request of a kind is about: its topic without the words that made it of this kind."""
    words = {
        "summary": r"^(?:summar\w*|(?:an? )?overview)(?: of)?", "toc": r"^(?:(?:the )?(?:table of contents|toc|contents))(?: of| for)?", "structure": r"^(?:(?:the )?(?:structure|outline|headings))(?: of| for)?",
        "get_article": r"^(?:get|fetch|read|open|show)?\s*(?:the )?(?:article|entry|page)(?: on| about| for| titled| named| called)?", "get_section": r"^.*?\bsections?\b\s*(?:of|from|in)", "links": r"^(?:links?|references)\s*(?:in|from|of|to)",
        "related": r"^(?:articles? )?(?:related|similar)(?: articles?)?(?: to)?", "find_by_title": r"^.*?\b(?:titled|title|named|called)\b", "get_zim_entries": r"^(?:get|fetch|read)?\s*(?:the )?(?:articles|entries|pages)(?: on| about| for)?",
        "tell_me_about": r"^(?:tell me about|explain|describe|about)", "binary": r"^(?:get|fetch)?\s*(?:the )?(?:image|pdf|video|audio|binary|media)(?: of| from| for)?",
    }
    text = topic(request)
    if kind in words:
        text = re.sub(words[kind], "", text, flags=re.I).strip()
        text = re.sub(r"^(?:of|for|to|from|in|on|about|the)\s+", "", text, flags=re.I)
    return text or topic(request)


def section_in(request: str) -> str:
    """The section that a request names before the word ``section``."""
    m = re.search(r"(?:the\s+)?([\w -]+?)\s+sections?\b", topic(request), re.I)
    return re.sub(r"^(?:get|show|read|fetch)\s+(?:the\s+)?", "", m.group(1), flags=re.I).strip() if m else topic(request)


def namespace_in(request: str) -> str:
    """The namespace letter or name that a request gives; content without one."""
    m = re.search(r"\bnamespace\s+([A-Za-z-]+)|\b([A-Z-])\s+namespace\b|\bbrowse\s+([A-Z])\b", request)
    return next((g for g in m.groups() if g), "C") if m else "C"


def without_filter(text: str) -> str:
    return re.sub(r"\s*\b(?:in (?:the )?namespace|of (?:content )?type|within)\b.*$", "", text, flags=re.I)


def listed(text: str) -> list[str]:
    """The things of a list in words."""
    return [p.strip() for p in re.split(r"\s*(?:,|;|\band\b)\s*", text) if p.strip()]
