"""Personal data replaced by keyed, type-consistent surrogates, with DataFrame functions only.

Found are e-mail addresses, telephone numbers, IPv4 addresses, card numbers, IBANs, social security numbers, secrets
(values after words like token or password, and long hexadecimal strings) and names after a title, with hyphens, apostrophes,
inner capitals, initials and particles; and in the same text every further mention of a word of such a name, without a title
too. Names without any titled mention in their text are not found.

An entity is cut into parts, and a part into elements, each a number within a radix: a letter or digit within its own alphabet,
an octet, a group of a social security number, the leading digit of a group of a telephone number. A part's elements go
through one keyed permutation: two Feistel rounds, a shift that moves every element, and the rounds undone. It has no fixed
point, since a shift has none between a permutation and its inverse either; so equal originals get equal surrogates in the
whole corpus, unequal ones of a type unequal surrogates, and none its original, by construction: no job can fail for it.
Length, punctuation, case, script and kinds of characters stay. So do titles and particles, country codes of IBANs and
telephone numbers, top-level domains, card issuers' first digit. IBANs and cards keep the distance to their valid check
digits (valid ones stay valid); numbers of social security and telephone stay within or without their valid ranges. A first
name that is in the list of a gender becomes another of that list, with and without a surname; another word whose image is
a listed name is permuted on until it is none, so the two don't meet. Letters of scripts beside those of ALPHABETS and RANGES, and
values without any letter or digit, stay as they are. `collisions` counts exceptions over all distinct entities.

Null texts stay null, texts without entities stay as they are, whole texts are read. Other columns pass through unchanged,
whatever their names. Repeated rows get equal results. The permutation stands once in the plan for all types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: titles by gender, particles, first names by gender
MALE = "Mr|Herr|Monsieur|Señor|Sr"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra"
TITLES = f"{MALE}|{FEMALE}|Dr|Prof"
PARTICLES = "van|von|de|der|den|del|della|di|du|da|la|le|el|al|bin|ibn"
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Pierre Jean Louis Hans Karl Peter Juan Carlos Miguel Luis Antonio Pedro".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Anna Marie Claire Sophie Julie Greta Ingrid Heidi Carmen Lucia Elena Rosa Sofia".split()
# fixed values: alphabets
DIGITS = "0123456789"
LATIN, ACCENTS = "abcdefghijklmnopqrstuvwxyz", "àâäáæçèéêëìíîïñòóôöœùúûüÿ"
GREEK, CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
HEX, REST = "abcdef", "ghijklmnopqrstuvwxyz"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Other letters as ranges of code points (first, count, step); step 2 where upper and lower case alternate.
#: Latin extended (five), Armenian, Georgian, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
RANGES = (
    (0x100, 24, 2), (0x14A, 23, 2), (0x139, 8, 2), (0x179, 3, 2), (0x1EA0, 48, 2), (0x531, 38, 1), (0x561, 38, 1), (0x10D0, 33, 1), (0x5D0, 27, 1),
    (0x627, 20, 1), (0x641, 10, 1), (0x905, 53, 1), (0xE01, 46, 1), (0x3041, 86, 1), (0x30A1, 90, 1), (0x4E00, 20_992, 1), (0xAC00, 11_172, 1),
)
#: Ways of cutting a part into elements. Secrets keep hexadecimal letters such, names keep vowels such.
TEXT, SECRET, WORD, PHONE, IP, SSN = range(1, 7)
ALPHABETS = {
    TEXT: [DIGITS, LATIN, ACCENTS, GREEK, CYRILLIC],
    SECRET: [DIGITS, HEX, REST, ACCENTS, GREEK, CYRILLIC],
    WORD: [VOWELS, CONSONANTS, ACCENTS, GREEK, CYRILLIC],
}

CAPITAL = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{Lu}))(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
PARTICLE = rf"(?:(?:{PARTICLES}) ){{0,2}}"
#: Each type with its pattern, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}",
    "secret": r"\b(?i:token|secret|password|passwd|pwd|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}|\b(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # a number does not run on into an address of four octets
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?(?!\d{1,3}(?:\.\d{1,3}){3})\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d)",
    "name": rf"\b(?:{TITLES})\b\.? (?:\p{{Lu}}\. ?)*+{PARTICLE}{CAPITAL}(?: {PARTICLE}{CAPITAL}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Telephone country codes of one and of two digits; the others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(?!$)[ .-]?"
#: Texts without one of these hold none of the above: a cheap look first.
TITLED = rf"\b(?:{TITLES})\b"
HINT = rf"[0-9@]|{TITLED}|(?i)(?:token|secret|passw|pwd|key)"
KEY = "surrogates"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(text: Column, at: str) -> Column:
    """The text cut at a pattern that takes no character."""
    return F.filter(F.split(text, at), lambda x: x != "")


def listing(values: list) -> Column:
    """An array of texts as one literal, cut when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def picked(of: dict[int, Column], mode: Column) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(mode == k, v) if out is None else out.when(mode == k, v)
    return out


#: What an element shows: its text as it is, a letter of the alphabets, a code point, or a number.
AS_IS, LETTER, CODE, NUMBER = range(4)


def element(v: Column, n: Column, how: int, base: Column, raw: Column, step: Column | None = None) -> Column:
    as_int = lambda x: x.cast("int")
    return F.struct(as_int(v).alias("v"), as_int(n).alias("n"), F.lit(how).alias("how"), as_int(base).alias("base"), as_int(F.lit(1) if step is None else step).alias("step"), raw.alias("raw"))


def elements(text: Column, mode: Column) -> Column:
    """The elements of a part: value v below radix n, and how to show it."""
    table = {m: "".join(a) for m, a in ALPHABETS.items()} | {PHONE: "", IP: "", SSN: ""}
    spans = {m: [(sum(map(len, a[:k])), len(x)) for k, x in enumerate(a) for _ in x] for m, a in ALPHABETS.items()}
    starts = picked({m: listing([s for s, _ in x]) for m, x in spans.items()}, mode)
    sizes = picked({m: listing([n for _, n in x]) for m, x in spans.items()}, mode)
    known = F.struct(picked({m: F.lit(x) for m, x in table.items()}, mode).alias("table"), starts.alias("starts"), sizes.alias("sizes"))
    ranges = F.expr("array(" + ", ".join(f"named_struct('first', {a}, 'count', {n}, 'step', {s})" for a, n, s in RANGES) + ")")
    zero = F.lit(0)

    def letter(c: Column, k: Column) -> Column:
        def placed(at: Column) -> Column:
            start = F.element_at(k["starts"], at).cast("int")
            code = F.ascii(c)
            other = lambda r: element(F.floor((code - r["first"]) / r["step"]), r["count"], CODE, r["first"] + (code - r["first"]) % r["step"], c, r["step"])
            inside = F.filter(ranges, lambda r: (code >= r["first"]) & (code < r["first"] + r["count"] * r["step"]))
            far = let(inside, lambda r: F.when(F.size(r) > 0, other(F.element_at(r, 1))).otherwise(element(zero, F.lit(1), AS_IS, zero, c)))
            return F.when(at > 0, element(at - 1 - start, F.element_at(k["sizes"], at), LETTER, start, c)).when(code < 0x100, element(zero, F.lit(1), AS_IS, zero, c)).otherwise(far)

        return let(F.instr(k["table"], F.lower(c)), placed)

    def digit(c: Column, before: Column) -> Column:
        """A leading digit stays among 2 to 9 or among 0 and 1, as valid area codes and trunk prefixes do."""
        d = c.cast("int")
        leads = ~F.coalesce(before.between("0", "9"), F.lit(False))
        return F.when(~c.between("0", "9"), element(zero, F.lit(1), AS_IS, zero, c)).when(leads & (c >= "2"), element(d - 2, F.lit(8), NUMBER, F.lit(2), c)).when(leads, element(d, F.lit(2), NUMBER, zero, c)).otherwise(element(d, F.lit(10), NUMBER, zero, c))

    def group(c: Column) -> Column:
        """Areas are 1 to 899 without 666, here without the gap; groups and serial numbers begin with 1."""
        d, n = c.cast("int"), F.length(c)
        area = (d >= 1) & (d < 900) & (d != 666)
        return F.when((n == 3) & area, element(d - F.when(d > 666, 2).otherwise(1), F.lit(898), NUMBER, F.lit(1), c)).when((n == 2) & (d > 0), element(d - 1, F.lit(99), NUMBER, F.lit(1), c)).when((n == 4) & (d > 0), element(d - 1, F.lit(9999), NUMBER, F.lit(1), c)).otherwise(element(zero, F.lit(1), AS_IS, zero, c))

    chars = F.split(text, "")
    octets = F.transform(cut(text, r"\b"), lambda c: F.when(c == ".", element(zero, F.lit(1), AS_IS, zero, c)).otherwise(element(F.when(c != ".", c).cast("int"), F.lit(256), NUMBER, zero, F.lit(""))))
    groups = F.transform(cut(text, r"\b"), lambda c: F.when(c == "-", element(zero, F.lit(1), AS_IS, zero, c)).otherwise(group(F.when(c != "-", c))))
    phone = F.transform(chars, lambda c, i: digit(c, F.substr(text, i, F.lit(1))))
    return F.when(mode == IP, octets).when(mode == SSN, groups).when(mode == PHONE, phone).otherwise(let(known, lambda k: F.transform(chars, lambda c: letter(c, k))))


def shown(e: Column, mode: Column) -> Column:
    table = picked({m: F.lit("".join(a)) for m, a in ALPHABETS.items()}, mode)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    lower = F.substr(table, e["base"] + e["v"] + 1, F.lit(1))
    number = e["v"] + e["base"] + F.when((mode == SSN) & (e["n"] == 898) & (e["v"] >= 665), 1).otherwise(0)
    return F.when(e["how"] == AS_IS, e["raw"]).when(e["how"] == LETTER, F.when(e["raw"] == F.lower(e["raw"]), lower).otherwise(F.upper(lower))).when(e["how"] == CODE, char(e["base"] + e["v"] * e["step"])).otherwise(F.when(F.length(e["raw"]) > F.length(number.cast("string")), F.lpad(number.cast("string"), F.length(e["raw"]), F.lit("0"))).otherwise(number.cast("string")))


#: Rounds: the side that moves (0 the first half), by what round key, whether by the other side, its sign, and the least step.
ROUNDS = [(0, 1, True, 1, 0), (1, 2, True, 1, 0), (0, 3, False, 1, 1), (1, 4, False, 1, 1), (1, 2, True, -1, 0), (0, 1, True, -1, 0)]


def permuted(state: Column, tweak: Column) -> Column:
    """The elements after the keyed permutation. No row of elements with a radix above 1 is its own image."""
    rounds = F.expr("array(" + ", ".join(f"named_struct('side', {a}, 'key', {b}, 'other', {str(c).lower()}, 'sign', {d}, 'least', {e})" for a, b, c, d, e in ROUNDS) + ")")
    half = F.floor(F.size(state) / 2).cast("int")

    def turn(own: Column, r: Column) -> Column:
        n = F.size(own)
        rest = F.when(r["side"] == 0, F.slice(own, half + 1, n)).otherwise(F.slice(own, F.lit(1), half))
        by = F.when(r["other"], F.array_join(F.transform(rest, lambda x: x["v"].cast("string")), ".")).otherwise("")
        stream = F.sha2(F.concat_ws("/", tweak, r["key"].cast("string"), n.cast("string"), by), 512)
        step = lambda s, i: F.conv(F.substr(s, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")

        def moved(s: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                to = F.pmod(x["v"] + r["sign"] * (r["least"] + step(s, i) % (x["n"] - r["least"])), x["n"])
                return F.when((x["n"] > 1) & ((i < half) == (r["side"] == 0)), x.withField("v", to)).otherwise(x)

            return F.transform(own, one)

        return let(stream, moved)

    return F.aggregate(rounds, state, turn)


def enciphered(text: Column, mode: Column, tweak: Column) -> Column:
    return F.array_join(F.transform(let(elements(text, mode), lambda e: permuted(e, tweak)), lambda e: shown(e, mode)), "")


def cipher(text: Column, mode: Column | int, tweak: Column, walk: Column | None = None) -> Column:
    """One-to-one on texts of the same length and kinds of characters; the same in upper and lower case. With `walk`, images
    that are listed names are permuted on, eight times at most; one-to-one on the others."""
    mode = F.lit(mode) if isinstance(mode, int) else mode
    if walk is None:
        return enciphered(text, mode, tweak)
    listed = listing(MALE_NAMES + FEMALE_NAMES)
    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), text, lambda s, k: F.when((k == 0) | (walk & F.array_contains(listed, F.initcap(s))), enciphered(s, mode, tweak)).otherwise(s))


def part(text: Column, mode: int, tweak: Column, keep: Column | bool = False) -> Column:
    return F.struct(text.alias("text"), F.lit(mode).alias("mode"), tweak.alias("tweak"), (F.lit(keep) if isinstance(keep, bool) else keep).alias("keep"))


def email(m: Column, key: Column) -> Column:
    domain = cut(F.substring_index(m, "@", -1), r"(?<=\.)|(?=\.)")
    host = F.transform(domain, lambda x, i: part(x, TEXT, F.concat(key, F.lit("host")), (x == ".") | (i == F.size(domain) - 1)))
    return F.concat(F.array(part(F.substring_index(m, "@", 1), TEXT, key), part(F.lit("@"), TEXT, key, True)), host)


def secret(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, r"^(?i:(?:token|secret|password|passwd|pwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)", 0)
    return F.array(part(head, TEXT, key, True), part(F.substr(m, F.length(head) + 1, F.length(m)), SECRET, key))


def iban(m: Column, key: Column) -> Column:
    return F.array(part(F.substr(m, F.lit(1), F.lit(4)), TEXT, key, True), part(F.substr(m, F.lit(5), F.length(m)), TEXT, key))


def card(m: Column, key: Column) -> Column:
    return F.array(part(F.substr(m, F.lit(1), F.lit(1)), TEXT, key, True), part(F.substr(m, F.lit(2), F.length(m) - 2), TEXT, key), part(F.substr(m, F.length(m), F.lit(1)), TEXT, key, True))


def phone(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, COUNTRY, 0)
    return F.array(part(head, PHONE, key, True), part(F.substr(m, F.length(head) + 1, F.length(m)), PHONE, key))


def whole(mode: int) -> Callable[[Column, Column], Column]:
    return lambda m, key: F.array(part(m, mode, key))


def name(m: Column, key: Column) -> Column:
    """Titles, particles and what stands between words stay; a listed first name becomes another of its gender's list."""
    words = cut(m, r"(?<=[ .'’-])|(?=[ .'’-])")
    titles = listing(TITLES.split("|"))

    def one(w: Column, i: Column) -> Column:
        def of(plain: Column) -> Column:
            out = F.when((i == 0) & F.array_contains(titles, w) | ~w.rlike(r"^\p{Lu}"), part(w, WORD, key, True))
            for names in (MALE_NAMES, FEMALE_NAMES):
                some = listing(names)
                by = F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(4)), 16, 10).cast("int") % (len(names) - 1) + 1
                other = F.element_at(some, ((F.array_position(some, plain).cast("int") - 1 + by) % len(names) + 1))
                out = out.when(F.array_contains(some, plain), part(F.when(w == plain, other).otherwise(F.upper(other)), WORD, key, True))
            return out.otherwise(part(w, WORD, key))

        return let(F.when((w == F.upper(w)) & (F.length(w) > 1), F.initcap(w)).otherwise(w), of)

    return F.transform(words, one)


MAKERS = {"email": email, "secret": secret, "iban": iban, "ip": whole(IP), "card": card, "ssn": whole(SSN), "phone": phone, "name": name}


def check_digit(digits: Column) -> Column:
    """The digit that makes digits + it a valid card number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return (10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10


def check_pair(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN, as a number."""
    chars = F.split(F.concat(F.regexp_replace(account, "[^A-Z0-9]", ""), country, F.lit("00")), "")
    left = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return 98 - left


def checked(kind: Column, m: Column, made: Column) -> Column:
    """The surrogate with check digits as far from the valid ones as the original's are."""
    bare = lambda x: F.regexp_replace(F.substr(x, F.lit(1), F.length(x) - 1), "[^0-9]", "")
    last = (check_digit(bare(made)) + F.substr(m, F.length(m), F.lit(1)).cast("int") - check_digit(bare(m)) + 10) % 10
    tail = lambda x: F.substr(x, F.lit(5), F.length(x))
    country = F.substr(m, F.lit(1), F.lit(2))
    pair = F.pmod(check_pair(country, tail(made)) + F.substr(m, F.lit(3), F.lit(2)).cast("int") - check_pair(country, tail(m)), F.lit(100))
    return F.when(kind == "card", F.concat(F.substr(made, F.lit(1), F.length(made) - 1), last.cast("string"))).when(kind == "iban", F.concat(country, F.lpad(pair.cast("string"), 2, "0"), tail(made))).otherwise(made)


def kind_of(m: Column) -> Column:
    """The type of an entity; a further mention of a name matches no pattern."""
    out = None
    for kind, pattern in PATTERNS.items():
        held = m.rlike(f"^(?:{pattern})$")
        out = F.when(held, kind) if out is None else out.when(held, kind)
    return out.otherwise(F.when(m.rlike(r"^[\p{L}\p{M}]+$"), "name").otherwise("phone"))


def surrogate(kind: Column, m: Column, key: str) -> Column:
    parts = None
    for k, make in MAKERS.items():
        made = make(m, F.lit(f"{key}/{k}"))
        parts = F.when(kind == k, made) if parts is None else parts.when(kind == k, made)
    text = F.array_join(F.transform(parts, lambda p: F.when(p["keep"], p["text"]).otherwise(cipher(p["text"], p["mode"], p["tweak"], p["mode"] == WORD))), "")
    return let(text, lambda x: checked(kind, m, x))


def pattern_of(text: Column) -> Column:
    """The pattern of a text's entities: that of all texts, and the words of its titled names in any place, in capitals too."""
    titled = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    words = F.flatten(F.transform(titled, lambda m: F.split(F.regexp_replace(m, rf"^(?:{TITLES})\b\.? ", ""), r"[^\p{L}\p{M}]+")))
    words = F.filter(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{M}]") & ~w.rlike(rf"^(?:{TITLES})$"))
    words = F.array_sort(F.array_distinct(F.concat(words, F.transform(words, F.upper))))
    more = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}_])"))
    return F.when(text.rlike(TITLED), F.when(F.size(words) > 0, more).otherwise(F.lit(ANY))).otherwise(F.lit(ANY))


def found(text: Column) -> Column:
    """The entities of a text in order, none where the cheap look finds nothing."""
    return F.when(text.rlike(HINT), let(pattern_of(text), lambda p: F.regexp_extract_all(text, p, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def collisions(docs: DataFrame, key: str = KEY, text: str = "text") -> int:
    """How many surrogates stand for several originals of a type or equal their original, over all distinct entities."""
    entities = docs.select(F.explode(found(F.col(text).cast("string"))).alias("m")).groupBy("m").count()
    made = entities.withColumn("kind", kind_of(F.col("m"))).withColumn("s", surrogate(F.col("kind"), F.col("m"), key))
    met = made.groupBy("kind", "s").agg(F.count("*").alias("n"), F.max(((F.col("s") == F.col("m")) & F.col("m").rlike(r"[\p{L}\p{N}]")).cast("int")).alias("same"))
    return met.where("n > 1 or same = 1").count()


def put_back(text: Column, key: str) -> Column:
    """The text with surrogates for its entities: cut at them and put together again."""

    def replaced_by(pattern: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
        new = lambda m: let(kind_of(m), lambda k: surrogate(k, m, key))
        return F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.when(p["m"].isNull(), "").otherwise(new(p["m"])))), "")

    return F.when(text.rlike(HINT) & text.rlike(ANY), let(pattern_of(text), replaced_by)).otherwise(text)


def replaced(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, all columns kept in their order: one map, no join."""
    return docs.select(*[put_back(F.col(f"`{c}`").cast("string"), key).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, text of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with_count = docs.withColumn("n_entities", F.coalesce(F.size(found(F.col("text"))), F.lit(0)).cast("long"))
    return replaced(with_count, key).select("doc_id", "n_entities", "text")
