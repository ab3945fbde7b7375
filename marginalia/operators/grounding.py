"""Nothing lost, nothing invented: words and numbers of a text against those of what was made of it.

Rules in SQL text for both dialects of marginalia.functions.dialect. Words are lower-case runs of letters (with an
apostrophe inside) and of digits; full stops of abbreviations are dropped first, so that N.S.W. is nsw.
"""

from __future__ import annotations

from marginalia.functions.dialect import Spark

# Words that say nothing of what a text holds.
NOISE = """
    a an and the of in on for to at by with from as or per via
    p pp para paras paragraph paragraphs s ss sec section sections art arts article articles
    reg regs regulation regulations r rr rule rules cl cls clause clauses pt pts part parts
    div divs division divisions sch schs schedule schedules ch chs chapter chapters
    vol vols volume volumes bk bks book books annex annexes n nn fn fns footnote note notes
    see also cf eg generally contra but especially compare
    ibid id idem supra infra above below op cit loc hereafter hereinafter referred
    ed eds edn edns edition editor editors rev tr trans translated translator
    et al v vs no nos th st nd rd
    opened signature signed entered into force yet
    http https www
""".split()


def words(d: Spark, x: str) -> str:
    plain = f"replace({d.unstopped(f'coalesce({x}, {chr(39)}{chr(39)})')}, '’', chr(39))"
    return d.all_lower(plain, r"[0-9]+|\p{L}+(?:\x27\p{L}+)?")


def is_number(d: Spark, w: str) -> str:
    return d.has(w, "^[0-9]+$")


def bare(d: Spark, w: str) -> str:
    """Without leading zeros."""
    return d.sub(w, r"^0+([0-9])", r"\1")


def tells(d: Spark, w: str) -> str:
    """Is a word more than noise or a single letter?"""
    noise = ", ".join(f"'{w}'" for w in NOISE)
    return f"({w} NOT IN ({noise}) AND (length({w}) > 1 OR {is_number(d, w)}))"


def meaningful(d: Spark, of: str) -> str:
    """Of words: distinct ones in order, without noise and single letters."""
    return d.once(d.keep(of, lambda w: tells(d, w)))


def span_ends(d: Spark, x: str) -> str:
    """Of each shortened span 150–5 of a text the second number in full."""
    span = r"([0-9]+)\s*[–—-]\s*([0-9]+)"
    a, b = (lambda s: d.group(s, span, 1)), (lambda s: d.group(s, span, 2))
    short = d.keep(d.all(f"coalesce({x}, '')", span), lambda s: f"length({b(s)}) < length({a(s)})")
    return d.each(short, lambda s: bare(d, f"substr({a(s)}, 1, length({a(s)}) - length({b(s)})) || {b(s)}"))


def digits(d: Spark, x: str) -> str:
    """The words of a text that are numbers, without a look at the others."""
    return d.all(f"coalesce({x}, '')", "[0-9]+")


def numbers(d: Spark, x: str, of: str) -> str:
    """Distinct numbers of a text and its words without leading zeros; of a shortened span the second one in full too."""
    return d.once(d.chain(d.each(d.keep(of, lambda w: is_number(d, w)), lambda w: bare(d, w)), span_ends(d, x)))


def captured(d: Spark, x: str, of: str) -> str:
    """All that a text can be found to hold, some of it twice: words, numbers, and neighbours written as one."""
    return d.chain(d.keep(d.once(of), lambda w: tells(d, w), "w"), numbers(d, x, digits(d, x)), d.glued_neighbours(of))


def missing(d: Spark, original: str, made: str) -> str:
    """Meaningful words of the original that what was made of it lacks; the halves of a word that was written as one count as held.

    Sets only, so that long texts cost what they are long; what most texts needn't is asked last.
    """

    def padded(lacked: str, held: str) -> str:
        """Numbers that are held without their leading zeros: the held ones with as many zeros as some number has."""
        zeros = d.once(d.each(lacked, lambda w: f"substr({w}, 1, length({w}) - length({bare(d, w)}))", "w"))
        found = d.both(d.each(lacked, lambda w: bare(d, w), "w"), held)
        return d.let(found, lambda f: d.flat(d.each(zeros, lambda z: d.both(d.each(f, lambda h: f"{z} || {h}", "h"), lacked), "z")), "found")

    def lacking(of: str, held: str) -> str:
        lacked = d.keep(d.lacking(of, held), lambda w: tells(d, w), "w")
        numbered = lambda words: d.keep(words, lambda w: f"({w} LIKE '0%' AND {d.has(w, '^0+[0-9]+$')})", "w")
        return d.let(lacked, lambda a: d.let(numbered(a), lambda z: f"CASE WHEN {d.size(z)} = 0 THEN {a} ELSE {d.minus(a, padded(z, held))} END", "zeroed"), "unheld")

    def without_halves(lacked: str, of: str, held: str) -> str:
        def halves(joined: str) -> str:
            # The pairs of neighbours that are also a cut of a held word.
            lengths = d.once(d.each(of, lambda w: f"length({w})", "w"))
            long = d.size(d.keep(joined, lambda h: f"length({h}) > 64", "h"))
            cut = d.let(f"CASE WHEN {long} > 0 THEN {lengths} ELSE array() END", lambda n: d.flat(d.each(joined, lambda h: d.cuts(h, n), "h")), "lengths")
            return d.flat(d.each(d.both(d.glued_neighbours(of, " "), cut), lambda p: d.split(p, " "), "p"))

        return d.let(d.both(d.glued_neighbours(of), held), lambda j: f"CASE WHEN {d.size(j)} = 0 THEN {lacked} ELSE {d.minus(lacked, halves(j))} END", "joined")

    def gone(of: str, held: str) -> str:
        return d.let(lacking(of, held), lambda w: f"CASE WHEN {d.size(w)} = 0 THEN {w} ELSE {without_halves(w, of, held)} END", "lacked")

    def compared(of: str, m: str) -> str:
        # All that was kept of a beginning is held; of its pairs the last word can still be half of one.
        after = f"CASE WHEN {d.first(of, f'size({m})')} = {m} THEN {d.rest(of, f'greatest(size({m}), 1)')} ELSE {of} END"
        found = d.let(after, lambda a: d.let(captured(d, made, m), lambda h: gone(a, h), "held"), "after")
        return f"CASE WHEN {of} = {m} THEN {d.first(of, '0')} ELSE {found} END"

    return d.let(words(d, original), lambda of: d.let(words(d, made), lambda m: compared(of, m), "of_made"), "of_original")


def invented_by_words(d: Spark, original: str, made: str) -> str:
    """Numbers of what was made that the original hasn't, by all words of both."""
    own = d.let(words(d, original), lambda of: numbers(d, original, of), "of_original")
    return d.let(own, lambda known: d.let(words(d, made), lambda m: d.minus(numbers(d, made, m), known), "of_made"), "known")


def invented(d: Spark, original: str, made: str) -> str:
    """The same by digits alone; the original is read only where what was made has numbers, and its spans only where they are not found."""
    unless_none = lambda value, rule, name: d.let(value, lambda n: f"CASE WHEN {d.size(n)} = 0 THEN {n} ELSE {rule(n)} END", name)
    unheld = lambda n: d.minus(n, d.each(digits(d, original), lambda w: bare(d, w)))
    return unless_none(numbers(d, made, digits(d, made)), lambda n: unless_none(unheld(n), lambda u: d.minus(u, span_ends(d, original)), "unheld"), "named")
