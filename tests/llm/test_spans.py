import hashlib
import math
import random
import re
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import secret_scan
from marginalia.llm.pii import _AT_HINT, _DIGIT_WORDS, _SPELLED_HINT, Mapped, detect, identifier_digest, identifiers_in, luhn, spell_digits, write_signs
from marginalia.llm.secret_scan import secret_digest, secrets_in

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1245@.+- ()é", max_size=60))
def test_identifiers_equal_plain_patterns(text):
    assert detect(text) == brute(text)
    base, found = identifiers_in(text)
    assert base == brute(text) and set(base) <= set(found)


def shown(text):
    base, found = identifiers_in(text)
    return [(k, text[a:b]) for k, a, b in found if (k, a, b) not in base]


def test_disguises_map_back_to_source():
    assert shown("write to john [at] mail dot example dot com now") == [("email", "john [at] mail dot example dot com")]
    assert shown("jоhn@exаmple.com!") == [("email", "jоhn@exаmple.com")]
    assert shown("é plus one six five two five five five four five four four.") == [("phone", "plus one six five two five five five four five four four")]
    assert shown("192 dot 168 dot 1 dot 10") == [("ip", "192 dot 168 dot 1 dot 10")]
    assert shown("one nine two dot one six eight dot one dot one") == [("ip", "one nine two dot one six eight dot one dot one")]
    assert shown("4​111111111111111") == [("card", "4​111111111111111")]
    assert shown("vier eins eins eins, eins eins eins eins, eins eins eins eins, eins eins eins eins") == [("card", "vier eins eins eins, eins eins eins eins, eins eins eins eins, eins eins eins eins")]


def test_more_disguises():
    assert shown("call +1 (six five two) five five five-four five four four now") == [("phone", "+1 (six five two) five five five-four five four four")]
    assert shown("card 41l1 1111 1111 11I1") == [("card", "41l1 1111 1111 11I1")]
    assert shown("ask the.72 at mail3.example.com about it") == [("email", "the.72 at mail3.example.com")]
    assert shown("ask jane_doe(at)mail(dot)example(dot)com") == [("email", "jane_doe(at)mail(dot)example(dot)com")]


def test_signs_and_numbers_without_other_hints():
    assert shown("escribe a juan.perez arroba ejemplo.com hoy") == [("email", "juan.perez arroba ejemplo.com")]
    assert shown("voir jean arobase exemple point fr ici") == [("email", "jean arobase exemple point fr")]
    assert shown("voir jean point dupont@exemple point fr") == [("email", "jean point dupont@exemple point fr")]
    assert shown("jean[at]exemple[point]fr") == [("email", "jean[at]exemple[point]fr")]
    assert shown("call +1 six 5 two 5 five 5 four 4 four 4 now") == [("phone", "+1 six 5 two 5 five 5 four 4 four 4")]
    for text in ("look at this point in time", "arrive at home point five", "un point fr"):
        assert identifiers_in(text) == ([], [])


_PARTS = ["one", "six", "un", "neun", "seis", "oh", "plus", "dot", "point", "punto", "DOT", "5", "41", "+", "(", ")", "-", ",", "  ", " at ", " AT ", " arroba ", " arobase ", " point ", " dot ", " @ ", "@", "[at]", "(arobase)", "(a)", "_at_", "_dot_", "com", ". ", "double ", " dash ", "[point]", "{dot}", "a.b", "mail.example", "ab3", ".", "c", "é", "_", "\t"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*_PARTS, " ", " ", " "]), max_size=14).map("".join))
def test_gated_equals_ungated(text):
    m = Mapped(text)
    assert _SPELLED_HINT.search(text) or spell_digits(m).text == text
    assert _AT_HINT.search(text) or write_signs(m).text == text


def test_plain_prose_is_left_alone():
    for text in ("be at the door and dot the i", "one two three go", "meet me at example.com", "un deux trois", "5 at 6", "a+b=c"):
        assert identifiers_in(text) == ([], [])


_DIGIT_NAMES = {lang: words.split() for lang, words in _DIGIT_WORDS.items()}
_WIDE = str.maketrans("0123456789@.", "０１２３４５６７８９＠．")
_CYRILLIC = str.maketrans("aceopxy", "асеорху")


def _spelled(rng, digits, lang="en"):
    out, i = [], 0
    while i < len(digits):
        if lang == "en" and digits[i : i + 2] == digits[i] * 2 and rng.random() < 0.7:
            out.append("double " + _DIGIT_NAMES[lang][int(digits[i])])
            i += 2
        else:
            out.append(_DIGIT_NAMES[lang][int(digits[i])])
            i += 1
    return out


def _email(rng):
    name = rng.choice(["jane", "tom.reed", "a_lopez", "max77", "eva-lind"])
    return name, rng.choice([["gmail", "com"], ["mail", "example", "org"], ["uni-x", "de"], ["post7", "fr"]])


def _card(rng):
    digits = "4" + "".join(rng.choices("0123456789", k=14))
    return next(digits + d for d in "0123456789" if luhn(digits + d))


#: Kinds of disguises: kind of the identifier, and a maker of one.
DISGUISES = {
    "words": ("email", lambda r: (lambda n, h: f"{n} at {' dot '.join(h)}")(*_email(r))),
    "capitals": ("email", lambda r: (lambda n, h: f"{n} AT {' DOT '.join(h)}")(*_email(r))),
    "brackets": ("email", lambda r: (lambda n, h: f"{n} [at] {' [dot] '.join(h)}")(*_email(r))),
    "tight brackets": ("email", lambda r: (lambda n, h: f"{n}(at){'(dot)'.join(h)}")(*_email(r))),
    "half": ("email", lambda r: (lambda n, h: f"{n}(at){'.'.join(h)}")(*_email(r))),
    "letter": ("email", lambda r: (lambda n, h: f"{n} (a) {'.'.join(h)}")(*_email(r))),
    "glued": ("email", lambda r: (lambda n, h: f"{n}_at_{'_dot_'.join(h)}")(*_email(r))),
    "gap": ("email", lambda r: (lambda n, h: f"{n}@{h[0]}. {h[-1]}")(*_email(r))),
    "spaced": ("email", lambda r: (lambda n, h: f"{n} @ {'.'.join(h)}")(*_email(r))),
    "french": ("email", lambda r: (lambda n, h: f"{n} arobase {' point '.join(h)}")(*_email(r))),
    "spanish": ("email", lambda r: (lambda n, h: f"{n} arroba {' punto '.join(h)}")(*_email(r))),
    "cyrillic": ("email", lambda r: (lambda n, h: f"{n}@{'.'.join(h)}".translate(_CYRILLIC))(*_email(r))),
    "wide signs": ("email", lambda r: (lambda n, h: f"{n}@{'.'.join(h)}".translate(_WIDE))(*_email(r))),
    "invisible": ("email", lambda r: (lambda n, h: f"{n[:2]}\u200b{n[2:]}\u200d@{'.'.join(h)}")(*_email(r))),
    "spelled phone": ("phone", lambda r: "plus " + " ".join(_spelled(r, "1" + "".join(r.choices("0123456789", k=9))))),
    "phone with dashes": ("phone", lambda r: "plus " + " dash ".join(" ".join(_spelled(r, "".join(r.choices("0123456789", k=3)))) for _ in range(3))),
    "french phone": ("phone", lambda r: "+" + " ".join(_spelled(r, "33" + "".join(r.choices("0123456789", k=8)), "fr"))),
    "german phone": ("phone", lambda r: "plus " + ", ".join(_spelled(r, "49" + "".join(r.choices("0123456789", k=8)), "de"))),
    "wide phone": ("phone", lambda r: "+1 " + "".join(r.choices("0123456789", k=9)).translate(_WIDE)),
    "ip words": ("ip", lambda r: " dot ".join(str(r.randrange(256)) for _ in range(4))),
    "ip brackets": ("ip", lambda r: "[.]".join(str(r.randrange(256)) for _ in range(4))),
    "spelled ip": ("ip", lambda r: " dot ".join(" ".join(_spelled(r, str(r.randrange(256)), "es")) for _ in range(4))),
    "card of letters": ("card", lambda r: (lambda c: c[0] + re.sub("0", "O", c[1:-1]).replace("1", "l") + c[-1])(_card(r).replace(" ", ""))),
    "invisible card": ("card", lambda r: "\u200b".join(re.findall("....", _card(r)))),
    "spelled card": ("card", lambda r: ", ".join(" ".join(_spelled(r, x)) for x in re.findall("....", _card(r)))),
}


def test_recall_of_disguises():
    rng = random.Random(11)
    for name, (kind, make) in DISGUISES.items():
        hits = 0
        for _ in range(100):
            hidden, before = make(rng), rng.choice(["write to ", "é my number: ", "contact "])
            _, found = identifiers_in(f"{before}{hidden} or so")
            hits += any(k == kind and abs(a - len(before)) <= 5 and abs(b - len(before) - len(hidden)) <= 1 for k, a, b in found)
        assert hits >= 90, (name, hits)


def test_no_identifiers_in_prose():
    rng = random.Random(12)
    words = "we look home and see that house on a road by the lake with some old trees near it then they arrive in time for dinner un deux three seven".split() * 4
    signs = "at dot point a one two double dash (a) (b) . , @ 3 12 punto in. com node.js and/or v2.0 state-at-home all_at_once e.g. Mr. 4pm".split()
    found = sum(len(identifiers_in(" ".join(rng.choices(words + signs, k=40)))[1]) for _ in range(500))
    assert found <= 20  # of 20,000 words, a sixth of them signs: "home at lake dot road"
    for text in ("see step (a) node.js first", "it works at home. Then we go", "a state-at-home.org rule", "sale at shop.com today", "write me jane@gmail. Then wait", "one two dot three", "double five"):
        assert identifiers_in(text) == ([], []), text


def test_long_inputs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "token" * 50_000, "AKIA" * 50_000, " " * 300_000 + "@ "):
        identifiers_in(text)
        secrets_in(text)


def test_time_grows_with_the_text():
    def seconds(find, text):
        start = time.process_time()
        find(text)
        return time.process_time() - start

    pieces = ["a dot ", "a at b ", "x1@mail.com ", "a point ", "a (at) ", "six ", "six dot ", "1 dot ", "a     dot     ", "one" + " " * 200 + "x ", "double ", "+1 ", "é а ", "1l", "( at ", "a_at_", "a. com ", "token=abc1234 ", "aB3xK9qLm2Zr7TyWc5Vd ", "password: aB3xK9qLm2Zr7TyWc5Vd "]
    for find in (identifiers_in, secrets_in):
        for piece in pieces:
            small, large = (min(seconds(find, piece * (n // len(piece)) + " а @ dot ") for _ in range(2)) for n in (30_000, 120_000))
            assert large < 10 * small + 0.2, (find.__name__, piece, small, large)


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "ſecret", "=", ": ", '"', "abc123", "deadbeef" * 3, "AKIA", "ABCDEFGH1234", " ", "é", "x_y"]), max_size=12).map("".join))
def test_secrets_equal_plain_patterns(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    base, found = secrets_in(text)
    assert base == sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    assert set(base) <= set(found)


def test_random_tokens_are_found_and_names_are_not():
    assert secrets_in("key wJalrXUtnFEMI7K7MDENG2bPxRfiCYEXAMPLEKEY x")[1] == [("random", 4, 44)]
    for text in ("document_version_2024_final_copy_12", "internationalisation2000overview", "12345678901234567890", "the quick brown fox " * 20):
        assert secrets_in(text) == ([], [])


def test_random_keys_of_each_alphabet_are_found():
    draw = random.Random(5)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for alphabet in (lower, upper, lower + upper, digits + lower, digits + upper, upper + "234567", digits + "ABCDEF", digits + "abcdef", digits + lower + upper, digits + lower + upper + "+/"):
        for n, least in ((16, 0.82), (18, 0.88), (20, 0.9), (24, 0.94), (32, 0.95), (40, 0.98), (64, 0.98)):
            keys = ["Z" * (alphabet[-1] == "/") + "".join(draw.choices(alphabet, k=n)) for _ in range(200)]
            assert sum(any(k in ("random", "hex") for k, _, _ in secrets_in(f"the key is {key} here")[1]) for key in keys) >= 200 * least, (alphabet, n)
    assert secrets_in("the key is " + "".join(draw.choices(lower + upper, k=70)) + "7Q here")[1]


def test_long_words_and_names_are_not_keys():
    for text in ("Donaudampfschifffahrtsgesellschaftskapitän", "internationalisation", "INTERNATIONALISATION", "getElementsByTagNameNS", "well-known-state-of-the-art", "src/main/java/org/example/HttpClient", "anticonstitutionnellement", "otorrinolaringologo", "MAX_RETRY_COUNT_PER_HOST", "abcdefghijklmnopqrstuvwxyz"):
        assert secrets_in(f"see {text} there") == ([], []), text


def test_tables(spark, docs):
    df = docs([(1, None), (2, ""), (3, "é me@a.bc 1.2.3.4"), (3, "é me@a.bc 1.2.3.4"), (4, "token=abcdef9")])
    rows = {r.doc_id: r for r in identifier_digest(df).collect()}
    assert identifier_digest(df).count() == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1].base_sha256 == rows[2].base_sha256 == empty and rows[1].spans == ""
    assert rows[3].spans == "email:2:9,ip:10:17" and (rows[3].n_email, rows[3].n_ip) == (1, 1)
    assert rows[3].base_sha256 == hashlib.sha256(b"email:2:9,ip:10:17").hexdigest()
    s = {r.doc_id: r for r in secret_digest(df).collect()}
    assert s[4].n_assign == 1 and s[4].spans == "assign:0:13" and s[1].spans == ""
    assert identifier_digest(df.limit(0)).count() == secret_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("context", ["auth={} x", "https://h.example.com/cb?key={}&a=1", "https://h.example.com/api/v1/{}", '{{"value":"{}"}}', "Authorization: Bearer {}", "v={}==", "sk_live_{}"])
@pytest.mark.parametrize("characters", ["0123456789abcdef", string.ascii_uppercase, string.ascii_lowercase, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits])
def test_recall_of_random_keys_in_context(context, characters):
    draw = random.Random(6)
    found = 0
    for _ in range(200):
        key = "".join(draw.choices(characters, k=24))
        text = context.format(key)
        at = text.index(key)
        found += any(a <= at + 1 and b >= at + 23 for _, a, b in secrets_in(text)[1])
    assert found >= 180


def plain_random_tokens(text, rules):
    """All substrings between joins, and the false-discovery step by trying every number of discoveries."""
    pieces = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m.group()) < 16:
            continue
        for value in re.finditer("[^=]+", m.group()):
            for part in [value, *re.finditer("[^/]+", value.group()), *re.finditer("[A-Za-z0-9]+", value.group())]:
                start = m.start() + value.start() + (part.start() if part is not value else 0)
                body = part.group()
                left = len(body) - len(body.lstrip("-_/+"))
                body = body.strip("-_/+")
                pieces.add((start + left, body))
    tried = []
    for start, body in pieces:
        characters = secret_scan._encoding(body)
        if len(body) >= rules.least_length and not body.isdigit() and characters:
            log_p = secret_scan.text_ratio(body, len(characters)) + secret_scan.battery_ratio(secret_scan.uniformity(secret_scan._values(body, characters), len(characters)), rules.crowding)
            tried.append((min(1.0, math.exp(min(0.0, log_p))), len(body) / rules.even_length, start, start + len(body)))
    scale = max([1.0, sum(w for _, w, _, _ in tried) / len(tried)]) if tried else 1.0
    discoveries = 0
    for k in range(1, len(tried) + 1):
        if sum(p * scale / w <= rules.alpha * k / len(tried) for p, w, _, _ in tried) >= k:
            discoveries = k
    chosen = sorted((p * scale / w, a, b) for p, w, a, b in tried)[:discoveries]
    kept = []
    for _, a, b in chosen:
        if all(b <= c or a >= d for c, d in kept):
            kept.append((a, b))
    return sorted(kept)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["auth=", "a/b/", " word ", "==", "-", "/", "=", "thequickbrownfoxjumpsover", "sk_live_"]), st.text(alphabet=string.ascii_letters + string.digits + "+/", min_size=16, max_size=40)), max_size=10))
def test_battery_and_false_discovery_step_equal_a_plain_version(parts):
    rules = secret_scan.RandomnessRules()
    text = "".join(parts)
    assert [(a, b) for _, a, b in secret_scan.random_tokens(text, rules)] == plain_random_tokens(text, rules)
