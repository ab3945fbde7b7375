"""Citations of the rarer source types as text, italics between asterisks, and their pinpoints.

Like marginalia.operators.normalise these are rules in SQL text, over the columns of a table of sources and `pin`, the
rendered pinpoint. What a type needs and lacks is written as [MISSING: field]. A bibliography entry has no pinpoint and its
first author inverted, unless that is a body.
"""

from __future__ import annotations

from collections.abc import Callable

from marginalia.functions.dialect import Spark
from marginalia.operators.normalise import trimmed

# Words of bodies' names, and particles that begin a family name.
BODY_WORDS = "commission committee department authority institute bureau council government court corporation board office university society association commonwealth parliament tribunal organisation organization agency ministry division directorate ombudsman bank union federation foundation academy college service services centre center group trust party reform law coalition network alliance taskforce force panel"
PARTICLES = "de da di del della der den des du dos das van von ter ten le la bin binti ibn al el"
# What stands before a pinpoint of each kind, for one and for several.
LABELS = {
    "section": ("s", "ss"), "part": ("pt", "pts"), "division": ("div", "divs"), "schedule": ("sch", "schs"), "regulation": ("reg", "regs"), "rule": ("r", "rr"), "clause": ("cl", "cls"),
    "article": ("art", "arts"), "chapter": ("ch", "chs"), "annex": ("annex", "annexes"), "volume": ("vol", "vols"), "book": ("bk", "bks"), "column": ("col", "cols"),
}


def given(x: str) -> str:
    return f"coalesce({x}, '') <> ''"


def needed(x: str) -> str:
    return f"coalesce(nullif({x}, ''), '[MISSING: {x}]')"


def optional(before: str, x: str, after: str = "") -> str:
    return f"CASE WHEN {given(x)} THEN '{before}' || {x} || '{after}' ELSE '' END"


def italic(x: str) -> str:
    return f"'*' || {x} || '*'"


def quoted(x: str) -> str:
    return f"'‘' || {x} || '’'"


def comma_list(d: Spark, *parts: str) -> str:
    """The parts that are not null, between commas."""
    return d.join(d.keep(d.array(parts), lambda x: f"{x} IS NOT NULL"), ", ")


# ---- names


def is_body(d: Spark, name: str, flag: str = "bodies") -> str:
    return f"coalesce({flag}, coalesce({d.has(f'lower({name})', rf'(^|[^a-z])(?:{BODY_WORDS.replace(' ', '|')})([^a-z]|$)')}, false))"


def surname(d: Spark, name: str) -> str:
    """The family name of a person with the particles that begin it; a body's name whole."""
    return f"CASE WHEN {is_body(d, name)} THEN {name} ELSE {d.sub(name, rf'^\S.*?\s+((?i:(?:(?:{PARTICLES.replace(" ", "|")})\s+)*)\S+)$', r'\1')} END"


def inverted(d: Spark, name: str) -> str:
    return f"CASE WHEN {is_body(d, name)} THEN {name} ELSE {d.sub(name, rf'^(\S.*?)\s+((?i:(?:(?:{PARTICLES.replace(" ", "|")})\s+)*)\S+)$', r'\2, \1')} END"


def names(d: Spark, people: str = "authors", et_al: str = "et_al", first: str | None = None) -> str:
    """A; A and B; A, B and C; A et al for more than three or where the source says so. Null without names."""
    first, n = first or d.at(people, 1), d.size(people)
    middle = d.each(d.first(people, f"greatest({n} - 1, 1)"), lambda x: x)
    rest = d.join(d.rest(middle), ", ")
    return (
        f"CASE WHEN {n} = 0 THEN NULL WHEN coalesce({et_al}, false) OR {n} > 3 THEN {first} || ' et al' WHEN {n} = 1 THEN {first} "
        f"ELSE {first} || CASE WHEN {n} > 2 THEN ', ' || {rest} ELSE '' END || ' and ' || {d.at(people, -1)} END"
    )


def authors(d: Spark, entry: bool) -> str:
    return names(d, first=inverted(d, d.at("authors", 1)) if entry else None)


def editors(d: Spark) -> str:
    return f"{names(d, 'editors', 'false')} || CASE WHEN {d.size('editors')} > 1 THEN ' (eds)' ELSE ' (ed)' END"


def lead(d: Spark, entry: bool) -> str:
    """Authors and a comma; nothing without them."""
    return f"coalesce({authors(d, entry)} || ', ', '')"


def edition(d: Spark, x: str = "edition") -> str:
    """2 gives 2nd ed, rev gives rev ed."""
    n = f"TRY_CAST({x} AS INT)"
    tail = f"CASE WHEN {n} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
    return f"CASE WHEN {given(x)} THEN {x} || CASE WHEN {n} IS NOT NULL THEN {tail} ELSE '' END || ' ed' END"


def ordinal(x: str, after: str) -> str:
    """54 sess gives 54th sess; null without a number."""
    n = f"TRY_CAST({x} AS INT)"
    tail = f"CASE WHEN {n} IS NULL THEN '' WHEN {n} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
    return f"CASE WHEN {given(x)} THEN {x} || {tail} || {after} END"


# ---- pinpoints


#: Numbers of more digits stay whole in spans.
_SPAN_DIGITS = 12


def _short_end(a: str, b: str) -> str:
    """The digits of b that differ from a, of the same length; two digits for a teen."""
    teen = f"substr({b}, length({b}) - 1, 1) = '1'"
    tails = " ".join(f"WHEN substr({a}, 1, {k}) = substr({b}, 1, {k}) THEN CASE WHEN length({b}) = {k + 1} AND {teen} THEN substr({b}, {k}) ELSE substr({b}, {k + 1}) END" for k in range(_SPAN_DIGITS - 1, 0, -1))
    return f"CASE {tails} ELSE {b} END"


def pinpoints(d: Spark, pins: str = "pinpoints") -> str:
    """All pinpoints: a comma between those of one kind and after a volume or book, else a space. Made in steps, each of which looks at what the one before made."""
    span = rf"^([0-9]{{1,{_SPAN_DIGITS}}})–([0-9]{{1,{_SPAN_DIGITS}}})$"

    def shortened(t: str) -> str:
        """Of each span in a list the second number without the digits that it shares."""
        a, b = d.group(t, span, 1), d.group(t, span, 2)
        return f"CASE WHEN {a} <> '' AND length({a}) = length({b}) AND {a} < {b} THEN {d.let(d.array([a, b]), lambda of: f'{d.at(of, 1)} || {chr(39)}–{chr(39)} || {_short_end(d.at(of, 1), d.at(of, 2))}', 'of_span')} ELSE {t} END"

    bare = d.sub("x.v", r"^\[+|\]+$")
    keep = {"kind": "x.kind", "many": "x.many", "v": "x.v", "dashed": "x.dashed"}
    steps: list[dict[str, str]] = [
        {"kind": "x.kind", "many": "coalesce(x.plural, false)", "v": trimmed(d, "x.value")},
        {"kind": "x.kind", "many": "x.many", "v": "x.v", "dashed": d.sub(f"CASE WHEN x.kind = 'paragraph' THEN {bare} ELSE x.v END", "--?", "–")},
        keep | {"span": d.join(d.each(d.all("x.dashed", r"[0-9.]+(?:–[0-9.]+)?|[^0-9.]+"), lambda t: shortened(t), "t"), "")},
    ]
    out = f"CASE x.kind WHEN 'page' THEN x.span WHEN 'footnote' THEN CASE WHEN x.v LIKE '% n %' THEN x.v ELSE 'n ' || x.v END"
    out += " WHEN 'paragraph' THEN '[' || CASE WHEN x.dashed LIKE '%]%' THEN x.dashed ELSE replace(x.dashed, '–', ']–[') END || ']'"
    number = "CASE WHEN x.v = '' THEN '' WHEN x.many THEN ' ' || x.span ELSE ' ' || replace(x.v, ')-(', ')–(') END"
    for name, (one, several) in LABELS.items():
        out += f" WHEN '{name}' THEN CASE WHEN x.many THEN '{several}' ELSE '{one}' END || {number}"
    made = pins
    for step in steps:
        made = d.rename(made, step)
    texts = d.each(made, lambda x: f"{out} ELSE x.v END")
    between = d.each_after(pins, lambda x, before: f"CASE WHEN {before} IS NULL THEN '' WHEN ({before}).kind = {x}.kind OR ({before}).kind IN ('volume', 'book') THEN ', ' ELSE ' ' END")
    return f"coalesce({d.join(d.glued(between, texts), '')}, '')"


def clean_pinpoints(d: Spark, pins: str = "pinpoints") -> str:
    """Labels written into a value go, [5] as a page is a paragraph, closing punctuation goes."""
    bare = trimmed(d, d.sub(trimmed(d, "x.value"), r"^(?i:(?:pages?|pp?\.?|paragraphs?|paras?\.?|sections?|ss?\.?)\s+)"))
    bracketed = d.has(bare, r"^\[.+\]$")
    value = d.sub(d.sub(bare, r"[\s.,;:]+$"), r"^\[+|\]+$")
    kept = f"CASE WHEN x.kind = 'paragraph' OR x.kind = 'page' AND {bracketed} THEN {value} ELSE {d.sub(bare, r'[\s.,;:]+$')} END"
    return d.rename(pins, {"kind": f"CASE WHEN x.kind = 'page' AND {bracketed} THEN 'paragraph' ELSE x.kind END", "value": kept, "plural": "x.plural"})


# ---- types


def _pin(before: str = " ") -> str:
    return optional(before, "pin")


_URL = optional(" <", "url", ">") + " || " + optional(", archived at <", "archived_url", ">")
_ONLY_URL = optional(" <", "url", ">")
_SPEAKER = f"CASE WHEN {given('speaker')} THEN ' (' || speaker || {optional(', ', 'speaker_position')} || ')' ELSE '' END"


def book_chapter(d: Spark, entry: bool) -> str:
    translated = f"coalesce(', tr ' || {names(d, 'translators', 'false')}, '')"
    published = comma_list(d, "nullif(publisher, '')", edition(d), needed("year"))
    who = f"coalesce({authors(d, entry)}, '[MISSING: authors]')"
    return f"{who} || ', ' || {quoted('chapter_title')} || {translated} || ' in ' || coalesce({editors(d)}, '[MISSING: editors]') || ', ' || {italic('book_title')} || ' (' || {published} || ') ' || {needed('starting_page')} || {_pin(', ')}"


def research_paper(d: Spark, entry: bool) -> str:
    kind = f"{needed('document_type')} || {optional(' No ', 'document_number')}"
    by_author = f"{d.size(d.keep('authors', lambda x: f'{x} = institution'))} > 0"
    parts = comma_list(d, kind, f"CASE WHEN NOT {given('institution')} THEN '[MISSING: institution]' WHEN {by_author} THEN NULL ELSE institution END", needed("date"))
    return f"{lead(d, entry)} || {quoted('title')} || ' (' || {parts} || ')' || {_pin()} || {_ONLY_URL}"


def newspaper(d: Spark, entry: bool) -> str:
    where = f"CASE WHEN {given('url')} AND NOT {given('page')} THEN 'online' ELSE {needed('place')} END"
    daily = f"', ' || {optional('*', 'section', '*, ')} || {italic('newspaper')} || ' (' || {where} || ', ' || {needed('date')} || ')'"
    periodical = f"' (' || {needed('date')} || ') ' || {italic('newspaper')}"
    pin = f"CASE WHEN {given('page')} THEN {_pin(', ')} ELSE {_pin()} END"
    return f"{lead(d, entry)} || {quoted('title')} || CASE WHEN coalesce(periodical, false) THEN {periodical} ELSE {daily} END || {optional(' ', 'page')} || {pin} || {_URL}"


def website(d: Spark, entry: bool) -> str:
    own = f"{d.size('authors')} = 1 AND {d.at('authors', 1)} = website_name"
    return f"CASE WHEN {own} THEN '' ELSE {lead(d, entry)} END || {quoted('title')} || ', *' || {needed('website_name')} || '* (' || coalesce(nullif(document_type, ''), 'Web Page') || {optional(', ', 'date')} || ')' || {_pin()} || {_URL}"


def speech(d: Spark, entry: bool) -> str:
    parts = comma_list(d, "coalesce(nullif(lecture, ''), 'Speech')", needed("forum"), needed("date"))
    return f"coalesce({authors(d, entry)}, '[MISSING: authors]') || ', ' || {quoted('title')} || ' (' || {parts} || ')' || {_pin()} || {_ONLY_URL}"


def media_release(d: Spark, entry: bool) -> str:
    release = f"coalesce(nullif(release_type, ''), 'Media Release') || {optional(' ', 'document_number')}"
    own = f"{d.size(d.keep('authors', lambda x: f'{x} = body'))} > 0"
    parts = comma_list(d, release, f"CASE WHEN {own} THEN NULL ELSE nullif(body, '') END", needed("date"))
    return f"{lead(d, entry)} || {quoted('title')} || ' (' || {parts} || ')' || {_pin()} || {_ONLY_URL}"


def _online(offline: str) -> str:
    return f"CASE WHEN coalesce(online, false) OR {given('retrieved')} THEN ' (online at ' || {needed('retrieved')} || ')' ELSE {offline} END"


def dictionary(d: Spark, entry: bool) -> str:
    which = comma_list(d, "nullif(entry_designation, '')", "'def ' || nullif(definition, '')")
    printed = f"' (' || {comma_list(d, edition(d), needed('year'))} || ')'"
    return f"'*' || {needed('title')} || '*' || {_online(printed)} || ' ‘' || {needed('entry')} || '’' || CASE WHEN {which} <> '' THEN ' (' || {which} || ')' ELSE '' END || {_pin()}"


def legal_encyclopedia(d: Spark, entry: bool) -> str:
    subject = d.join(d.keep(d.array(["nullif(title_number, '')", "nullif(title_name, '')"]), lambda x: f"{x} IS NOT NULL"), " ")
    printed = f"{optional(', vol ', 'volume')} || {optional(' (at ', 'date', ')')}"
    chapter = f"CASE WHEN {given('chapter')} THEN CASE WHEN {subject} <> '' THEN ',' ELSE '' END || ' ‘' || chapter || '’' ELSE '' END"
    return f"{needed('publisher')} || ', *' || {needed('title')} || '*' || {_online(printed)} || CASE WHEN {subject} <> '' THEN ' ' || {subject} ELSE '' END || {chapter} || {_pin()}"


def social_media(d: Spark, entry: bool) -> str:
    when = f"{needed('date')} || {optional(', ', 'time')} || {optional(' ', 'time_zone')}"
    return f"{needed('username')} || {optional(' (', 'author_name', ')')} || {optional(', ‘', 'title', '’')} || ' (' || {needed('platform')} || ', ' || {when} || ')' || {_pin()} || {_URL}"


def parliamentary_debates(d: Spark, entry: bool) -> str:
    return f"{needed('jurisdiction')} || ', *Parliamentary Debates*, ' || {needed('chamber')} || ', ' || {needed('date')} || {_pin(', ')} || {_SPEAKER}"


def convention_debates(d: Spark, entry: bool) -> str:
    return f"'*' || {needed('title')} || '*, ' || {needed('location')} || ', ' || {needed('date')} || {_pin(', ')} || {optional(' (', 'speaker', ')')}"


def submission(d: Spark, entry: bool) -> str:
    who = f"CASE WHEN bodies = false THEN {inverted(d, 'author')} ELSE author END" if entry else "author"
    return f"CASE WHEN {given('author')} THEN {who} || ', ' ELSE '' END || 'Submission' || {optional(' No ', 'submission_number')} || ' to ' || {needed('body')} || {optional(', ', 'legislature')} || {optional(', *', 'inquiry', '*')} || {optional(' (', 'date', ')')} || {_pin()}"


def committee_evidence(d: Spark, entry: bool) -> str:
    return f"'Evidence to ' || {needed('committee')} || ', ' || {needed('legislature')} || ', ' || {needed('location')} || ', ' || {needed('date')} || {_pin(', ')} || {_SPEAKER}"


def explanatory_memorandum(d: Spark, entry: bool) -> str:
    place = f"CASE WHEN {given('jurisdiction')} THEN ' (' || jurisdiction || ')' ELSE ' [MISSING: jurisdiction]' END"
    return f"coalesce(nullif(document_type, ''), 'Explanatory Memorandum') || ', ' || {needed('title')} || ' ' || {needed('year')} || {place} || {_pin()}"


def treaty(d: Spark, entry: bool) -> str:
    """Signed and in force on one day, not yet in force, or with both dates."""
    one_day = f"coalesce(signed, false) AND {given('opened_for_signature')} AND opened_for_signature = entry_into_force"
    force = f"CASE WHEN lower(trim(entry_into_force)) = 'not yet in force' THEN ' (not yet in force)' ELSE ' (entered into force ' || {needed('entry_into_force')} || ')' END"
    two_days = f"', ' || CASE WHEN coalesce(signed, false) THEN 'signed' ELSE 'opened for signature' END || ' ' || {needed('opened_for_signature')} || ', ' || {needed('treaty_series')} || {force}"
    parties = f"CASE WHEN {d.size('parties')} > 0 THEN ', ' || {d.join('parties', '–')} ELSE '' END"
    return f"{italic('title')} || {parties} || CASE WHEN {one_day} THEN ', ' || {needed('treaty_series')} || ' (signed and entered into force ' || opened_for_signature || ')' ELSE {two_days} END || {_pin()}"


def un_document(d: Spark, entry: bool) -> str:
    n = d.size("agenda_items")
    several = f"'Agenda Items ' || {d.join(d.first('agenda_items', f'greatest({n} - 1, 1)'), ', ')} || ' and ' || {d.at('agenda_items', -1)}"
    agenda = f"CASE WHEN {n} = 1 THEN 'Agenda Item ' || {d.at('agenda_items', 1)} WHEN {n} > 1 THEN {several} END"
    number = f"CASE WHEN {given('document_number')} THEN CASE WHEN document_number LIKE '% and %' THEN 'UN Docs ' ELSE 'UN Doc ' END || document_number ELSE '[MISSING: document_number]' END"
    meeting = ordinal("meeting", "CASE WHEN coalesce(plenary, false) THEN ' plen mtg' ELSE ' mtg' END")
    parts = comma_list(d, "nullif(resolution, '')", "nullif(official_records, '')", ordinal("committee", "' Comm'"), ordinal("session", "' sess'"), ordinal("session_part", "' pt'"), meeting, agenda, "'Supp No ' || nullif(supplement, '')", number)
    dated = f"CASE WHEN {given('date')} THEN ' (' || date || {optional(', adopted ', 'adopted')} || ')' ELSE '' END"
    return f"{optional('', 'author', ', ')} || {optional('*', 'title', '*, ')} || {parts} || {dated} || {_pin()}"


def other(d: Spark, entry: bool) -> str:
    return f"coalesce(text, '') || {_pin()}"


#: The rule of each type: of a dialect, and whether it is a bibliography entry (then pin has to be '').
RULES: dict[str, Callable[[Spark, bool], str]] = {
    f.__name__: f for f in (book_chapter, research_paper, newspaper, website, speech, media_release, dictionary, legal_encyclopedia, social_media, parliamentary_debates, convention_debates, submission, committee_evidence, explanatory_memorandum, treaty, un_document, other)
}


def short_name(d: Spark) -> str:
    """What a repeated reference to a source without a short title of its own is called by: one to three family names, or '' for 'repeat in full'."""
    n = d.size("authors")
    family = lambda k: surname(d, d.at("authors", k))
    people = f"CASE WHEN coalesce(et_al, false) OR {n} > 3 THEN {family(1)} || ' et al' WHEN {n} = 1 THEN {family(1)} WHEN {n} = 2 THEN {family(1)} || ' and ' || {family(2)} ELSE {family(1)} || ', ' || {family(2)} || ' and ' || {family(3)} END"
    by_author = "'journal_article', 'book', 'book_chapter', 'research_paper', 'newspaper', 'website', 'speech', 'media_release'"
    party = d.group("name", r"^(.*?)(?: v |$)")
    second = d.group("name", r"^.*? v (.*)$")
    crown = r"^(?i:r|the (?:queen|king)|rex|regina)$"
    plain = lambda x: d.sub(x, r"\s*\[No [0-9]+\]$")
    return (
        f"CASE WHEN type IN ({by_author}) AND {n} > 0 THEN {people} WHEN type IN ({by_author}) THEN coalesce(title, '') WHEN type = 'case' THEN CASE WHEN {d.has(party, crown)} AND {second} <> '' THEN {plain(second)} ELSE {plain(party)} END "
        f"WHEN type = 'report' THEN coalesce({surname(d, 'author')}, title, '') WHEN type = 'submission' THEN coalesce(CASE WHEN bodies = false THEN {surname(d, 'author')} ELSE author END, '') WHEN type = 'social_media' THEN coalesce(username, '') ELSE '' END"
    )


def subsequent(d: Spark, short: str = "short_title", note: str = "first_note") -> str:
    """A repeated reference: 'Short Title (n 3) 42'; United Nations documents keep their number before the note."""
    number = f"CASE WHEN type = 'un_document' THEN {optional(', UN Doc ', 'document_number')} ELSE '' END"
    styled = f"CASE WHEN type IN ('case', 'legislation', 'book', 'report', 'treaty', 'un_document', 'dictionary', 'legal_encyclopedia', 'parliamentary_debates', 'convention_debates') THEN {italic(short)} ELSE {short} END"
    return f"{styled} || {number} || ' (n ' || {note} || ')' || {_pin()}"


