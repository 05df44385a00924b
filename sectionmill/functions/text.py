"""Labels, names and Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters as Python's strip and split know them; Java's own class lacks the separators.
WS = r"[\s\x1c-\x1f]"
#: Blank characters but the line feed.
HSPACE = r"(?:[^\S\n]|[\x1c-\x1f])"
#: Fixed values.
DEFAULT_JURISDICTION = "England & Wales"
DEFAULT_LEVELS = 12
SEPARATOR = " › "
_DOTTED = rf"(?Ud)^{WS}*\[?(\d+(?:\.\d+)+[A-Za-z]?)\]?\.{WS}*(.+?){WS}*$"
_PLAIN = rf"(?Ud)^{WS}*(\d+[A-Za-z]?)\.{WS}*(.+?){WS}*$"
_VOLUME = rf"(?Ud)^(.*?){WS}*\((Volume\b.*)\){WS}*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{WS}+|{WS}+\z", "")


def filled(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def split_number_heading(label: Column) -> tuple[Column, Column]:
    """(number, heading) of a label; the number is empty if there is none."""
    text = F.coalesce(label, F.lit(""))
    dotted, plain = text.rlike(_DOTTED), text.rlike(_PLAIN)
    number = F.when(dotted, F.regexp_extract(text, _DOTTED, 1)).when(plain, F.regexp_extract(text, _PLAIN, 1)).otherwise("")
    heading = F.when(dotted, F.regexp_extract(text, _DOTTED, 2)).when(plain, F.regexp_extract(text, _PLAIN, 2)).otherwise(strip(text))
    return number, heading


def split_title_volume(name: Column) -> tuple[Column, Column]:
    """(title, volume) of a name such as ``Agency (Volume 1 (2022))``; the volume may be null."""
    text = F.coalesce(name, F.lit(""))
    hit = text.rlike(_VOLUME)
    return F.when(hit, strip(F.regexp_extract(text, _VOLUME, 1))).otherwise(strip(text)), F.when(hit, strip(F.regexp_extract(text, _VOLUME, 2)))


def _parts(counts: Column) -> Column:
    return F.filter(F.split(F.coalesce(counts, F.lit("")), r"\|"), lambda x: x != "")


def extract_to_level(counts: Column) -> Column:
    """One more than the number of counts, or the default without counts."""
    n = F.size(_parts(counts))
    return F.when(n > 0, n + 1).otherwise(DEFAULT_LEVELS)


def has_descendant_counts(counts: Column) -> Column:
    """Whether any count is positive or isn't a whole number."""
    return F.exists(_parts(counts), lambda x: F.coalesce(strip(x).try_cast("bigint") > 0, F.lit(True)))


def slug(text: Column, max_len: int = 80) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", "")
    dashed = F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.left(dashed, F.lit(max_len)), F.lit("-"))
    return F.when(cut == "", "untitled").otherwise(cut)


def short_id(urn: Column) -> Column:
    text = F.coalesce(urn, F.lit(""))
    core = F.regexp_extract(text, "urn:contentItem:([0-9A-Za-z-]+)", 1)
    return F.regexp_replace(F.when(core != "", core).otherwise(text), "-00000-00$", "")


def jurisdiction(publication: Column, default: str = DEFAULT_JURISDICTION) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(publication, F.lit(""))), F.lit("hong kong")), "Hong Kong").otherwise(default)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?U){WS}+"), lambda w: w != ""))


def section_label(number: Column, heading: Column) -> Column:
    return F.when(filled(number), F.concat(number, F.lit(". "), heading)).otherwise(heading)


def postprocess(markdown: Column) -> Column:
    """Tidy rendered Markdown: footnote markers, blanks and blank lines."""
    steps = [
        (r"\{FN-(\d+)\}", "[^$1]"),
        (rf"(?U){HSPACE}+", " "),  # before all that begins with blanks: of a long run each place would be tried
        (rf"(?U){HSPACE}+(\[\^\d+\])", "$1"),
        (rf"(?U)(\[\^\d+\]){HSPACE}+([,.;:)\]])", "$1$2"),
        (rf"(?U){HSPACE}*\n{HSPACE}*", "\n"),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        markdown = F.regexp_replace(markdown, pattern, to)
    return strip(markdown)


def footnote_lines(footnotes: Column) -> Column:
    """``[^n]: text`` lines of an array of (n, text)."""
    return F.array_join(F.transform(footnotes, lambda f: F.concat(F.lit("[^"), f["n"], F.lit("]: "), f["text"])), "\n")


def assemble(number: Column, heading: Column, body: Column, footnotes: Column) -> Column:
    """A standalone document: title, body and footnotes. The title repeats no number it starts with."""
    head = strip(F.coalesce(heading, F.lit("")))
    sn = F.rtrim(strip(F.coalesce(number, F.lit(""))), F.lit("."))
    word = lambda c: F.coalesce(c.rlike(r"(?U)^\w"), F.lit(False))
    edge = word(F.right(sn, F.lit(1))) != word(F.substr(head, F.length(sn) + 1, F.lit(1)))
    title = F.when(filled(number) & ~(F.startswith(head, sn) & edge), strip(F.concat(sn, F.lit(". "), head))).otherwise(head)
    notes = footnote_lines(F.coalesce(footnotes, F.array().cast("array<struct<n:string,text:string>>")))
    parts = F.array(F.when(title != "", F.concat(F.lit("# "), title)), F.when(filled(body), body), F.when(notes != "", notes))
    return F.concat(F.regexp_replace(F.array_join(parts, "\n\n"), rf"(?U){WS}+\z", ""), F.lit("\n"))


#: Parts of login urls (a site adds its own sign-in hosts), and phrases of refusals.
LOGIN_HINTS = ("/idp/", "shibboleth", "/connect?session", "openathens")
BLOCK_HINTS = ("unusual activity", "access denied", "are you a robot", "request blocked")
CONTAINER = r"class=[\"'](?:[^\"']*\s)?(?:SS_contentdocument|SS_HK|document-content-container|section-content-container)(?:\s[^\"']*)?[\"']"


def triage(url: Column, title: Column, html: Column, *, container: str = CONTAINER, login_hints: tuple[str, ...] = LOGIN_HINTS, block_hints: tuple[str, ...] = BLOCK_HINTS) -> Column:
    """What a captured page is: ok, session_expired, blocked or not_found."""
    page, low = F.coalesce(html, F.lit("")), F.lower(F.coalesce(html, F.lit("")))
    has = lambda text, hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(text, h))
    login = has(F.lower(F.coalesce(url, F.lit(""))), login_hints) | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("sign in"))
    return F.when(page.rlike(container), "ok").when(login, "session_expired").when(has(low, block_hints), "blocked").otherwise("not_found")
