"""Personal data replaced by keyed surrogates; DataFrame functions only.

Detected: e-mail, IPv4 and IPv6 addresses, phone, payment-card and US social-security numbers,
IBANs, secrets (keyed values, long hex strings, tokens of well-known forms), street addresses and
names after a form of address, and in the same text all further mentions of those names without
one.  Dates, and names that never follow a form of address, are not.  An
entity's canonical form is hashed with the key and an attempt number, and the hash is written
out in the entity's own format: separators, case, digit groups, country code, top-level domain,
script, a card's valid check digit, a given name's gender.  A given name's gender is that of its
list or, where no list has it, of the form of address; its surrogate is the name's own with an
ending for the gender.  The same entity gets the same surrogate in every text and format (coreference).

No part of the pattern repeats a group without a bound or reads far from where it begins: an e-mail
address has at most 64 characters before the @ and 127 labels of 63 behind it.  What is done for an entity or a text grows with its length.

Collision check: the distinct entities of the corpus are listed; one whose surrogate is that of
a smaller entity or is itself an entity of the corpus goes on to its next attempt, until all
surrogates differ.  Later attempts of short shapes grow, so that no corpus can use up a shape.  Only entities past their first attempt, very few, need to be looked up;
everything else is computed in place, so that texts aren't shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from stridelake.operators.scratch import Scratch

MALE = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Pierre", "Jean", "Louis", "Hans", "Karl", "Peter", "Juan", "Carlos", "Pedro", "Miguel"]
FEMALE = ["Mary", "Anna", "Linda", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Emma", "Marie", "Claire", "Sophie", "Greta", "Heidi", "Ursula", "Maria", "Carmen", "Lucia", "Elena"]
MALE_CYR = ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"]
FEMALE_CYR = ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"]
GIVEN = [MALE, FEMALE, MALE_CYR, FEMALE_CYR]
SYLLABLES = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "so", "ta"]
SYLLABLES_CYR = ["ба", "бе", "бо", "да", "де", "до", "га", "го", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "ра", "ре", "ри", "ро", "са", "се", "со", "та", "те", "то"]
ADDRESS = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Господин|Госпожа"
ROAD = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace"
SYLLABLES_GREEK = [c + v for c in "βγδκλμνπρστ" for v in "αεο"]
SYLLABLES_ARMENIAN = [c + v for c in "բգդկլմնպրստ" for v in "աեո"]
#: For each script: its syllables and the endings of men's and women's given names, which are no syllables.
SCRIPTS = {"IsCyrillic": (SYLLABLES_CYR, "н", "лия"), "IsGreek": (SYLLABLES_GREEK, "ς", "λια"), "IsArmenian": (SYLLABLES_ARMENIAN, "ն", "լիա"), "IsLatin": (SYLLABLES, "n", "lia")}
MEN, WOMEN = "Mr|Herr|Monsieur|Señor|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
LETTERS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "а-яё": "абвгдежзиклмнопрстуфхцчшщэюя", "α-ω": "αβγδεζηθικλμνξοπρστυφχψω"}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A word with a capital that isn't a form of address itself.
NAME = rf"(?!(?:{ADDRESS})(?![\p{{L}}'’]))\p{{Lu}}[\p{{L}}'’]+"
PARTS = [
    r"(?=[\p{L}\p{N}])[\p{L}\p{N}._%+\-]{1,64}+(?<=[\p{L}\p{N}])@(?:(?=[\p{L}\p{N}])[\p{L}\p{N}\-]{1,63}+(?<=[\p{L}\p{N}])\.){1,127}\p{L}{2,}",
    r"(?<=[=:\s\"'])(?<=(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{8,}",
    r"[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    r"(?<![_\-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|xox[abprs]-[0-9A-Za-z\-]{10,}|sk-[A-Za-z0-9_\-]{20,}|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})(?![\p{L}\p{N}_\-])",
    r"(?<![:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    rf"(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}(?![\p{L}\p{N}])|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}(?![\p{L}\p{N}])|[0-9]{13,19}(?![\p{L}\p{N}])",
    r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{3,4}(?![\p{L}\p{N}])|\+[0-9]{1,3}(?:[ .\-]\(?[0-9]{1,4}\)?){1,2}(?:[ .\-]?[0-9]{2,8}){1,4}(?![\p{L}\p{N}])|0[1-9](?:[ .\-][0-9]{2}){4}(?![\p{L}\p{N}])|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![\p{L}\p{N}])|(?<!-)[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![\p{L}\p{N}\-])",
    rf"[0-9]{{1,5}}(?: \p{{Lu}}[\p{{L}}'’]+){{1,3}} (?:{ROAD})(?![\p{{L}}\p{{N}}])",
    rf"(?:{ADDRESS})\.? {NAME}(?:[ \-]{NAME}){{0,2}}",
]
#: No entity begins inside a word, which is asked once a place and not by each part.
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'(?:{p})' for p in PARTS)})"
#: Every text with a match of PATTERN has one of these.
MAYBE = rf"[0-9@]|[=:](?:(?<=(?i:token|secret|passw(?:or)?d|key)[\"']?\s{{0,3}}[=:])|(?<=[a-fA-F]:)[a-fA-F:])|[a-fA-F]{{32}}|(?=[gxsAe])(?:gh[opsur]_|xox[abprs]-|sk-[A-Za-z_\-]{{20}}|A[KS]IA|AIza|eyJ)|(?=[{''.join(sorted({a[0] for a in ADDRESS.split('|')}))}])(?:{ADDRESS})\.? \p{{Lu}}"
NAMES = 64  # of a text that its pattern lists; in a text with more every word with a capital is looked up
EXCEPTIONS = 10_000  # entities past their first attempt that travel as a literal map; more are joined


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once and stands once in the plan."""
    return F.transform(F.array(value), body)[0]


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _kind(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(rf"^(?:{ADDRESS})\.? "), "person")
        .when(e.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(e.rlike(rf"^[0-9]{{1,5}} .* (?:{ROAD})$"), "address")
        .when(e.rlike("^[0-9a-fA-F]{1,4}:[0-9a-fA-F:]+$") & e.rlike("^(?:[^:]*:){2}"), "ip6")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike(r"^(?:\+|\()|^[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}$|^0[1-9](?:[ .\-][0-9]{2}){4}$"), "phone")
        .when(e.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$"), "card")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .otherwise("secret")
    )


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _canonical(kind: Column, e: Column) -> Column:
    """What is the same for all formats of an entity."""
    d = _digits(e)
    return (
        F.when(kind.isin("email", "name", "namem", "namef", "ip6"), F.lower(e))
        .when(kind == "phone", F.when(F.length(d) > 10, F.substr(d, F.length(d) - F.lit(9), F.lit(10))).otherwise(d))
        .when(kind.isin("card", "ssn"), d)
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when((kind == "secret") & e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lower(e))
        .otherwise(e)
    )


def _at(h: Column, i: Column, n: int) -> Column:
    """A number below ``n`` from the ``i``-th of the hash's 64 places (from 0)."""
    place = (F.pmod(i, F.lit(64)) * 2 + 1).cast("int")
    return F.pmod(F.conv(F.substr(h, place, F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 7, F.lit(n)).cast("int")


def _letter(c: Column, v) -> Column:
    """A letter of the script of the lower-case ``c``; other letters go to Latin."""
    pick = lambda s: F.substr(F.lit(s), v(len(s)) + 1, F.lit(1))
    return F.when(c.between("а", "я") | (c == "ё"), pick(LETTERS["а-яё"])).when(c.between("α", "ω"), pick(LETTERS["α-ω"])).otherwise(pick(LETTERS["a-z"]))


def _shared(k: Column) -> Column:
    """A kind, alone or before a canonical form; names of either gender are names."""
    return F.regexp_replace(k, r"^name[mf](?![^|])", "name")


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The canonical form of the ``attempt``-th surrogate of a canonical form."""
    seed = F.concat_ws("|", F.lit(key), _shared(kind), norm, attempt.cast("string"))
    h = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256))
    return _let(F.struct(kind.alias("kind"), norm.alias("norm"), h.alias("h"), attempt.alias("attempt")), lambda x: _written(x["kind"], x["norm"], x["h"], x["attempt"]))


def _written(kind: Column, norm: Column, h: Column, attempt: Column) -> Column:
    """A hash in the shape of a canonical form."""
    chars = F.split(norm, "")
    is_hex = norm.rlike("^[0-9a-f]+$")

    def swap(c, i):
        v = lambda n: _at(h, i, n)
        letter = _let(_letter(F.lower(c), v), lambda l: F.when(F.lower(c) != c, F.upper(l)).otherwise(l))
        return F.when(c.rlike("^[0-9]$"), v(10).cast("string")).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    def swap_hex(c, i):
        return F.substr(F.lit("0123456789abcdef"), _at(h, i, 16) + 1, F.lit(1))

    join = lambda f: F.array_join(F.transform(chars, f), "")
    tail = F.regexp_extract(norm, r"(\.\p{L}+)$", 1)
    email = lambda shaped: F.concat(F.substr(shaped, F.lit(1), F.length(norm) - F.length(tail)), tail)
    valid = lambda body: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda n: F.call_function("luhn_check", n))[0]
    card = lambda shaped: F.when(F.call_function("luhn_check", norm), _let(F.concat(F.substring(norm, 1, 1), F.substr(shaped, F.lit(2), F.length(norm) - 2)), valid)).otherwise(F.concat(F.substring(norm, 1, 1), F.substr(shaped, F.lit(2), F.length(norm))))
    private = attempt < 8  # later attempts may leave the private network
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: F.when(private & norm.rlike(r"^(?:10|127)\.") & (i == 0), o).when(private & norm.rlike(r"^192\.168\.") & (i < 2), o).otherwise(_at(h, i * 3, 256).cast("string"))), ".")
    # what later attempts add to shapes that a corpus could use up
    grown = F.substr(h, F.lit(65), F.floor(attempt / 3).cast("int"))
    letters, digits = F.translate(grown, "0123456789", "ghijklmnop"), F.translate(grown, "abcdef", "012345")
    known = F.regexp_extract(norm, r"^(?:AKIA|ASIA|gh[opsur]_|xox[abprs]-|sk-|AIza|eyJ)", 0)
    token = lambda shaped: F.concat(known, F.substr(shaped, F.length(known) + 1, F.length(norm)), letters)
    road = F.regexp_extract(norm, rf" (?:{ROAD})$", 0)
    place = lambda shaped: F.concat(F.substr(shaped, F.lit(1), F.length(norm) - F.length(road)), letters, road)
    iban = lambda shaped: F.concat(F.substring(norm, 1, 2), F.substr(shaped, F.lit(3), F.length(norm)))
    count = F.lit(3) + F.floor(attempt / 4).cast("int")
    say = lambda s: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: _list(s)[_at(h, i, len(s))]), "")

    def named(script):
        syllables, man, woman = SCRIPTS[script]
        family = F.when(norm.endswith("а"), "ва").otherwise("в") if script == "IsCyrillic" else F.lit("")
        return F.concat(say(syllables), F.when(kind == "namem", man).when(kind == "namef", woman).otherwise(family))

    name = named("IsLatin")
    for script in list(SCRIPTS)[:-1]:
        name = F.when(norm.rlike(rf"^\p{{{script}}}"), named(script)).otherwise(name)
    by_shape = _let(join(swap), lambda s: F.when(kind == "email", F.concat(letters, email(s))).when(kind == "card", card(s)).when(kind == "iban", iban(s)).when(kind == "address", place(s)).when(kind.isin("phone", "ssn"), F.concat(s, digits)).otherwise(token(s)))
    groups = F.array_join(F.transform(F.split(norm, ":"), lambda g, i: F.when(F.length(g) > 0, F.conv(_at(h, i * 5 + 1, 256).cast("string"), 10, 16)).otherwise(g)), ":")
    ip6 = F.lower(F.when(attempt < 8, groups).otherwise(F.concat_ws(":", *(F.substring(h, 1 + 4 * i, 4) for i in range(8)))))
    return F.when(kind == "ip", octets).when(kind == "ip6", ip6).when(kind.startswith("name"), name).when((kind == "secret") & is_hex, F.concat(join(swap_hex), grown)).otherwise(by_shape)


def _fit(e: Column, to: Column, kinds: str | None) -> Column:
    """``e`` with its characters of the class ``kinds`` replaced, in order, by those of ``to``; what is left of ``to`` follows.

    Without ``kinds`` all are, and each keeps its case.
    """
    if kinds is None:
        def cased(x):
            each = F.transform(x["e"], lambda c, i: _let(F.get(x["to"], i), lambda n: F.when(F.lower(c) != c, F.upper(n)).otherwise(n)))
            return F.concat(F.array_join(each, ""), F.array_join(F.slice(x["to"], F.size(x["e"]) + 1, F.size(x["to"])), ""))

        return _let(F.struct(F.split(e, "").alias("e"), F.split(to, "").alias("to")), cased)

    def placed(x):
        n = F.size(x["between"]) - 1
        each = F.transform(F.slice(x["between"], 1, n), lambda b, i: F.concat(b, F.coalesce(F.get(x["to"], i), F.lit(""))))
        return F.concat(F.array_join(each, ""), F.element_at(x["between"], -1), F.array_join(F.slice(x["to"], n + 1, F.size(x["to"])), ""))

    return _let(F.struct(F.split(e, kinds, -1).alias("between"), F.split(to, "").alias("to")), placed)


def _given(token: Column) -> Column:
    return F.greatest(*(F.array_contains(_list(names), token).cast("int") for names in GIVEN)) == 1


def _shifted(key: str, token: Column) -> Column:
    """A given name's surrogate: a keyed rotation of its gender's and script's list, never itself."""
    out = token
    for names in GIVEN:
        turn = F.pmod(F.conv(F.substring(F.sha2(F.lit(f"{key}|given|{names[0]}"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(len(names) - 1)).cast("int") + 1
        k = F.array_position(_list(names), token).cast("int")
        out = F.when(k > 0, _list(names)[F.pmod(k - 1 + turn, F.lit(len(names)))]).otherwise(out)
    return out


def _names(e: Column) -> Column:
    """Name tokens of a person, without the form of address."""
    return F.split(F.regexp_replace(e, rf"^(?:{ADDRESS})\.? ", ""), r"[ \-]")


def _tokens(e: Column) -> Column:
    """``t, kind`` of a person's names: all but the last of several have the gender of the form of address."""
    gender = F.when(e.rlike(rf"^(?:{MEN})\.? "), "namem").when(e.rlike(rf"^(?:{WOMEN})\.? "), "namef").otherwise("name")
    return _let(F.struct(_names(e).alias("n"), gender.alias("g")), lambda x: F.transform(x["n"], lambda t, i: F.struct(t.alias("t"), F.when(i < F.size(x["n"]) - 1, x["g"]).otherwise("name").alias("kind"))))


def _keys(e: Column) -> Column:
    """``kind|canonical`` of what has to be told apart in an entity: each unlisted name token, or all of it."""
    names = F.transform(F.filter(_tokens(e), lambda x: ~_given(x["t"])), lambda x: F.concat(x["kind"], F.lit("|"), F.lower(x["t"])))
    return _let(_kind(e), lambda kind: F.when(kind == "person", names).otherwise(F.array(F.concat(kind, F.lit("|"), _canonical(kind, e)))))


def _name(key: str, t: Column, kind: Column, attempt_of) -> Column:
    """One name's surrogate, wherever it stands; in capitals if the name is."""
    plain = F.when(_given(t), t).when(_given(F.initcap(t)), F.initcap(t))
    new = _let(F.struct(F.lower(t).alias("norm"), kind.alias("kind")), lambda x: _surrogate(key, x["kind"], x["norm"], attempt_of(x["kind"], x["norm"])))
    shifted = _let(plain, lambda p: _shifted(key, p))
    out = F.when(plain.isNotNull(), shifted).otherwise(_let(new, F.initcap))
    return F.when(F.upper(t) == t, F.upper(out)).otherwise(out)


def _mentions(found: Column) -> Column:
    """``t, kind`` of the names, as they stand and in capitals, of the persons among a text's entities, sorted."""
    persons = F.filter(found, lambda e: e.rlike(rf"^(?:{ADDRESS})\.? "))
    line = lambda t, kind: F.concat(t, F.lit("|"), kind)  # noqa: E731  names have no such sign; lines, unlike structs, are told apart by hashes
    lines = lambda names: F.concat(F.transform(names, lambda x: line(x["t"], x["kind"])), F.transform(names, lambda x: line(F.upper(x["t"]), x["kind"])))
    apart = lambda l: F.struct(F.substring_index(l, "|", 1).alias("t"), F.substring_index(l, "|", -1).alias("kind"))
    return F.array_sort(F.transform(F.array_distinct(_let(F.flatten(F.transform(persons, _tokens)), lines)), apart))


def _look_up(names: Column, t: Column) -> Column:
    """The kind beside ``t`` in a sorted table, by halving; null if it isn't there."""
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    half = lambda s, m: F.when(F.get(names, m)["t"] <= t, F.struct(m.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high")))
    zero = F.struct(F.lit(0).alias("low"), F.size(names).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(names) + 1)).cast("int"))
    at = lambda s: F.when(F.get(names, s["low"])["t"] == t, F.get(names, s["low"])["kind"])
    return F.when(F.size(names) > 0, F.aggregate(steps, zero, lambda s, _: _let(middle(s), lambda m: half(s, m)), at))


def _with_mentions(names: Column) -> Column:
    """The pattern for a text whose persons have ``names``, those at any place of their own included.

    Of more than ``NAMES``, it takes every word that begins with a capital, for ``_look_up`` to tell.
    """
    listed = F.concat(F.lit(r"|(?<![\p{L}\p{N}'’])(?:"), F.array_join(F.array_distinct(F.transform(names, lambda x: x["t"])), "|"), F.lit(r")(?![\p{L}\p{N}]|['’]\p{L}{2})"))
    any_word = F.lit(r"|(?<![\p{L}\p{N}'’])\p{Lu}\p{L}*+(?:['’]\p{L}{2,}+)*+(?!\p{N})")
    return F.concat(F.lit(PATTERN), F.when(F.size(names) <= NAMES, listed).otherwise(any_word))


def _replacement(key: str, e: Column, attempt_of) -> Column:
    """An entity's surrogate in the entity's own format."""
    title = rf"^(?:{ADDRESS})\.? "

    def surrogate(kind, norm):
        return _let(F.struct(kind.alias("kind"), norm.alias("norm")), lambda x: _surrogate(key, x["kind"], x["norm"], attempt_of(x["kind"], x["norm"])))

    def person(e):
        marks = F.regexp_extract_all(F.regexp_replace(e, title, ""), F.lit(r"[ \-]"), 0)
        names = _let(marks, lambda m: F.array_join(F.transform(_tokens(e), lambda x, i: F.concat(_name(key, x["t"], x["kind"], attempt_of), F.coalesce(F.get(m, i), F.lit("")))), ""))
        return F.concat(F.regexp_extract(e, title, 0), names)

    def rendered(kind, e, norm, to):
        # of a phone number the last ten digits are replaced; what stands before them stays
        whole = F.concat(F.substr(_digits(e), F.lit(1), F.length(_digits(e)) - F.length(norm)), to)
        value = F.when(kind == "phone", whole).otherwise(to)
        return F.when(kind.isin("ip", "ip6"), to).when(kind.isin("phone", "card", "ssn"), _fit(e, value, "[0-9]")).when(kind == "iban", _fit(e, to, "[A-Z0-9]")).otherwise(_fit(e, to, None))

    def plain(x):
        y = F.struct(x["kind"].alias("kind"), x["e"].alias("e"), _canonical(x["kind"], x["e"]).alias("norm"))
        return _let(y, lambda y: _let(surrogate(y["kind"], y["norm"]), lambda to: rendered(y["kind"], y["e"], y["norm"], to)))

    return _let(F.struct(_kind(e).alias("kind"), e.alias("e")), lambda x: F.when(x["kind"] == "person", person(x["e"])).otherwise(plain(x)))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``k`` (``kind|canonical``) of the corpus; combined before the shuffle."""
    found = docs.where(F.col(text).rlike(MAYBE)).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0)).alias("e")).distinct()
    return found.select(F.explode(_keys(F.col("e"))).alias("k")).distinct()


def later_attempts(ents: DataFrame, key: str, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """``k, attempt`` of the entities whose first surrogate collides.

    RuntimeError if some still collide after ``rounds`` attempts.
    """
    kind, norm = F.substring_index("k", "|", 1), F.expr("substr(k, instr(k, '|') + 1)")
    named = lambda df, a: df.select("k", F.concat(_shared(kind), F.lit("|"), _surrogate(key, kind, norm, F.lit(a))).alias("s"))
    taken, waiting, settled = None, ents, None
    for attempt in range(rounds):
        offers = named(waiting, attempt)
        first = offers.groupBy("s").agg(F.min("k").alias("first"))
        good = first.join(ents, first.s == _shared(ents.k), "left_anti")
        if taken is not None:
            good = good.join(taken, "s", "left_anti")
        lost = scratch.keep(offers.join(good, (offers.s == good.s) & (offers.k == good["first"]), "left_anti").select("k"), "lost")
        won = good.select(F.col("first").alias("k"), "s")
        if attempt:
            won = scratch.keep(won, "won")
            here = won.select("k", F.lit(attempt).alias("attempt"))
            settled = here if settled is None else settled.union(here)
            taken = taken.union(won.select("s"))
        else:
            taken = won.select("s")
        if lost.isEmpty():
            return settled if settled is not None else ents.select("k", F.lit(0).alias("attempt")).limit(0)
        waiting = lost
    raise RuntimeError(f"surrogates still collide after {rounds} attempts")


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_entities``, how many were.

    ``key`` decides all surrogates; keep it secret.  A null text stays null with 0 entities;
    texts without personal data stay as they are.  Every row and all other columns pass
    through; a column named ``n_entities`` is replaced.  Equal texts get equal results.
    """
    docs = docs.drop("n_entities")
    scratch = Scratch(docs.sparkSession, "pii")
    ents = scratch.keep(entities(docs, text), "entities")
    later = scratch.keep(later_attempts(ents, key, scratch), "later")
    e = F.coalesce(F.when(F.col(text).rlike(MAYBE), F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0)), F.array().cast("array<string>"))
    found = docs.withColumn("__f", e).withColumn("__names", _mentions(F.col("__f")))
    named = F.size("__names") > 0  # few texts, which are matched again with their own names
    found = found.withColumn("__e", F.when(named, F.regexp_extract_all(F.col(text), _with_mentions(F.col("__names")), 0)).otherwise(F.col("__f")))
    entries = F.transform("__f", lambda e: F.struct(e.alias("t"), F.lit("entity").alias("kind")))
    found = found.withColumn("__table", F.when(F.size("__names") > NAMES, F.array_sort(F.concat("__names", entries))).otherwise(F.col("__names")))
    few = later.limit(EXCEPTIONS + 1).collect()
    if len(few) <= EXCEPTIONS:
        table = F.from_json(F.lit(json.dumps({r.k: r.attempt for r in few})), "map<string,int>") if few else None
        attempt_of = lambda kind, norm: F.coalesce(table[F.concat(kind, F.lit("|"), norm)], F.lit(0)) if few else F.lit(0)
    else:
        found = found.withColumn("__h", F.sha2(F.col(text), 256))
        looked = found.where(F.size("__e") > 0).select("__h", F.explode(F.flatten(F.transform("__e", _keys))).alias("k")).distinct().join(later, "k")
        maps = looked.groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("__m"))
        found = found.join(maps, "__h", "left")
        attempt_of = lambda kind, norm: F.coalesce(F.col("__m")[F.concat(kind, F.lit("|"), norm)], F.lit(0))
    plain = F.when(named, F.split(F.col(text), _with_mentions(F.col("__names")), -1)).otherwise(F.split(F.col(text), PATTERN, -1))

    many = F.size("__names") > NAMES

    def other(e):
        kind = F.when(named, _look_up(F.col("__table"), e))
        return _let(F.struct(e.alias("e"), kind.alias("kind")), lambda x: F.when(x["kind"].startswith("name"), _name(key, x["e"], x["kind"], attempt_of)).when(many & x["kind"].isNull(), x["e"]).otherwise(_replacement(key, x["e"], attempt_of)))

    changed = F.when(many, F.size(F.filter("__e", lambda e: _look_up(F.col("__table"), e).isNotNull()))).otherwise(F.size("__e"))
    new = _let(plain, lambda plain: F.concat(F.array_join(F.transform("__e", lambda e, i: F.concat(plain[i], other(e))), ""), F.element_at(plain, -1)))
    out = [F.when(F.size("__e") > 0, new).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns]
    return found.select(*out, changed.alias("n_entities"))
