"""Column expressions over titles, paths and texts; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and numbers.
LIST_PREFIX = r"(?i)^((lists?|index|outline|glossary|timeline|bibliography)_of_|listed_)"
LIST_SUFFIX = r"(?i)_(discography|filmography|videography|bibliography|appearances_and_filmography|awards_and_nominations|awards_and_honou?rs|honou?rs_and_awards)$"
PSEUDO_PATHS = ("M/", "X/", "-/")
PSEUDO_TITLES = ("File:", "Category:", "Template:")
MORE_PSEUDO_TITLES = ("User:", "Wikipedia:", "Help:")
ASSET_EXTENSIONS = "jpg jpeg png gif svg webp bmp ico tif tiff eot otf ttf woff woff2 css js mjs json pdf zip gz mp4 webm mp3 ogg wav avi mov m4a".split()
ASSET_MIMES = (
    "text/css application/javascript text/javascript application/json application/pdf application/zip application/gzip "
    "application/x-font-ttf application/x-font-woff application/font-woff application/vnd.ms-fontobject"
).split()
ASSET_MIME_PREFIXES = ("image/", "video/", "audio/", "font/")
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def words(c: Column) -> Column:
    """All lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def relevance_tokens(c: Column, least: int = 3) -> Column:
    """Distinct ASCII tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least))


def site_title(c: Column) -> Column:
    """A title without what follows its first `` | ``."""
    return F.trim(F.split_part(c, F.lit(" | "), F.lit(1)))


def without_site(c: Column) -> Column:
    """A title without what follows its last pipe."""
    return F.trim(F.regexp_replace(c, r"\|[^|]*$", ""))


def inverted(c: Column) -> Column:
    """``First Last rest`` of a title ``Last, First rest`` without its site; null where the title is of another form.

    The last name holds no ``:``, ``(`` or pipe; the first name ends before ``:`` or ``(`` and holds no comma or pipe.
    """
    form = r"(?s)^\s*([^,:(|]*[^,:(|\s])\s*,\s*([^,|:(]*[^,|:(\s])\s*([:(].*)?$"
    stripped = without_site(c)
    return F.when(stripped.rlike(form), F.regexp_replace(stripped, form, "$2 $1$3"))


def last_first(c: Column) -> Column:
    """``Last, First rest`` as ``First Last rest``; other titles as they are."""
    return F.regexp_replace(c, r"^([^,:(]+),\s*([^,|:(]+?)(\s*\(.*)?$", "$2 $1$3")


def fold(c: Column) -> Column:
    """Lower case without the accents of the Latin letters of western Europe."""
    return F.translate(F.lower(c), *ACCENTS)


def plain_path(c: Column) -> Column:
    """A path as a title."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z-]/", ""), "_", " "))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_links(c: Column) -> Column:
    """Markdown links as their text."""
    return F.regexp_replace(c, r"\[([^\]\n]*)\]\((?:\\.|[^\n)\\])*\)", "$1")


def without_bold(c: Column) -> Column:
    return F.regexp_replace(c, r"\*\*", "")


def without_votes(c: Column) -> Column:
    """Text without a leading line that only holds a vote count."""
    return F.regexp_replace(c, r"^\n*[+-]?\d+\n\n*", "")


def size_text(c: Column) -> Column:
    """Bytes as B, KB, MB or GB, cut to a tenth."""
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = F.concat(c.cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        tenths = F.floor(c * 10 / size)
        out = F.when(c >= size, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def count_text(c: Column) -> Column:
    """A count as it is, from a thousand on in K: with a tenth below ten of them."""
    k = c / F.lit(1000.0)
    return F.when(c < 1000, c.cast("string")).when(k < 10, F.format_string("%.1fK", k)).otherwise(F.concat(F.floor(k).cast("string"), F.lit("K")))


def token_estimate(c: Column) -> Column:
    """Tokens of a text at four characters each, with a margin of a twentieth."""
    return (F.floor(F.length(c) / F.lit(4.0) * F.lit(1.05)) + 1).cast("long")


def cleaned_input(c: Column) -> Column:
    """A request without control characters other than line ends and tabs."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def one_line(c: Column, most: int = 1024) -> Column:
    """A text as one line of a log: runs of control characters as a space, cut with a note of what is left out."""
    line = F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " ")
    kept = F.rtrim(F.substring(line, 1, most))
    note = F.concat(kept, F.lit("... [+"), (F.length(line) - F.length(kept)).cast("string"), F.lit(" chars elided]"))
    return F.when(F.length(line) > most, note).otherwise(line)


def word_number(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def is_list_article(path: Column) -> Column:
    """Whether a path (without its namespace of up to two characters) names a list or catalogue."""
    name = F.regexp_replace(path, r"^[^/]{0,2}/(?=.)", "")
    return name.rlike(LIST_PREFIX) | name.rlike(LIST_SUFFIX)


def is_disambiguation(path: Column) -> Column:
    return F.lower(path).rlike(r"[_ ]\(disambiguation\)$")


def is_pseudo_entry(path: Column, title: Column, extended: bool = False) -> Column:
    """Whether an entry is of the archive's own and no article; ``extended`` adds user, project and help pages."""
    out = F.lit(False)
    for p in PSEUDO_PATHS:
        out = out | path.startswith(p)
    for t in PSEUDO_TITLES + (MORE_PSEUDO_TITLES if extended else ()):
        out = out | title.startswith(t)
    return out


def starts_with_word(c: Column, prefix: Column) -> Column:
    """Whether ``prefix`` begins ``c`` and ends at a word's end."""
    after = F.substring(c, F.length(prefix) + 1, F.lit(1))
    return F.startswith(c, prefix) & ~after.rlike(r"[\p{L}\p{N}_]")


def shares_stem(a: Column, b: Column) -> Column:
    """Whether two tokens are equal, or one of at least four characters begins the other."""
    longer = lambda x, y: (F.length(y) >= 4) & F.startswith(x, y)
    return (a == b) | longer(a, b) | longer(b, a)


def covers(candidate: Column, topic: Column) -> Column:
    """Strong match of token arrays: equal, the candidate goes on from the topic, or the topic by one more token."""
    n, m = F.size(candidate), F.size(topic)
    ahead = (n >= m) & (F.slice(candidate, F.lit(1), F.greatest(m, F.lit(1))) == topic)
    behind = (m == n + 1) & (F.slice(topic, F.lit(1), F.greatest(n, F.lit(1))) == candidate)
    return (n > 0) & (m > 0) & (ahead | behind)


def strong_title(topic: Column, title: Column) -> Column:
    """A strong match of a topic with a title as it is, without its site, or with ``Last, First`` turned."""
    ok = F.lit(False)
    for form in (title, site_title(title), last_first(site_title(title))):
        ok = ok | (covers(words(form), words(topic)) & (F.length(form) >= 3) & (F.length(topic) >= 3))
    return ok


def _covers_long(candidate: Column, topic: Column) -> Column:
    """``covers``, with at least three characters on both sides unless the tokens are equal."""
    long = lambda a: F.length(F.array_join(a, "")) >= 3
    return ((F.size(topic) > 0) & (candidate == topic)) | (covers(candidate, topic) & long(candidate) & long(topic))


def strong_form(topic: Column, candidate: Column) -> Column:
    """A strong match of a topic with a path or title as it is, without its site, or turned from ``Last, First``.

    The turned form counts only for topics of as many words as the turned name has.
    """
    t, turned = words(topic), inverted(candidate)
    name = F.regexp_extract(turned, r"(?s)^([^:(]*)", 1)
    by_name = F.coalesce(_covers_long(words(turned), t) & (F.size(t) >= F.size(words(name))), F.lit(False))
    return _covers_long(words(candidate), t) | _covers_long(words(without_site(candidate)), t) | by_name


def one_typo(query: Column, title: Column) -> Column:
    """Whether the title is the query with one transposition, or (five letters on) one edit of a letter."""
    q, t = F.lower(query), F.lower(title)
    swap = F.lit(False)
    same_length = F.length(q) == F.length(t)
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda i: F.substring(q, i, F.lit(1)) != F.substring(t, i, F.lit(1))))
    turned = F.concat(F.substring(q, F.lit(1), at - 1), F.substring(q, at + 1, F.lit(1)), F.substring(q, at, F.lit(1)), F.substring(q, at + 2, F.length(q)))
    swap = same_length & (q != t) & F.coalesce(turned == t, F.lit(False))
    return (F.length(q) >= 4) & (swap | ((F.length(q) >= 5) & (F.levenshtein(q, t) == 1)))
