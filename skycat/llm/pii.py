"""Personal data: detection and keyed, type-consistent surrogates, in DataFrame functions only.

One alternation finds e-mail addresses, phone numbers, card numbers with a right check digit,
IBANs, IP addresses of both versions, secrets (unquoted ones hold a digit), web tokens and
titled names of any length from left to right without overlap; a full name that a text gives a title
once is also found without it in that text.  A found value stands for one or more entities:
a name for each of its words (given names by gender, family names), a number for its digits,
an address for its lower-case form.  An entity's surrogate is drawn from a keyed SHA-256 of
the entity, so ``Mr. John Doe``, ``Mr John Doe``, ``MR DOE`` and ``John Doe`` stay one
person, and a number stays one number however it is spaced.  The surrogate takes the shape
of the value: title, particles, hyphens, capitals, separators, lengths of numbers and of the
parts of an address, script of the letters, calling code, gender of given names, check digits of card numbers and IBANs.

Collision checks run over the distinct entities of the whole corpus: a surrogate that two
entities share, or that is itself an entity of the corpus, is drawn anew with the next
attempt number until all are distinct; later attempts draw longer names and addresses.

Defined cases: null text stays null; texts without personal data come back unchanged;
repeated rows are rewritten alike; numbers of card length with a wrong check digit stay; all other columns are kept, whatever their names; names
in scripts other than Latin, Cyrillic, Greek and Armenian become Latin; initials are
replaced letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycat.llm.common import fresh, let, written

#: Titles of names.  Beside them, a short capitalised abbreviation before an initial is a title (``Capt. J. Doe``).
_TITLE = r"(?:Mrs?|MRS?|Ms|MS|Miss|MISS|Herrn?|HERRN?|Frau|FRAU|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señor(?:it)?a?|Sra?|Don|Doña|Dr|DR|Prof|PROF|Professor|Sir|г-н|г-жа)"
_ABBREVIATED = r"\p{Lu}\p{Ll}{1,5}\. (?=\p{Lu}\.)"
_PARTICLE = r"(?:van|von|vom|zu|zur|de|der|den|del|della|di|da|dos|du|la|las|los|le|ten|ter|bin|ibn|al|el) "
_LEAD = rf"(?:(?:{_TITLE}\.? (?=\p{{Lu}}|г-|{_PARTICLE}))++|{_ABBREVIATED})"
_INITIALS = r"(?:(?:\p{Lu}\.-?)++ )*+"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:-\p{L}[\p{L}\p{M}]+)*+"
#: Initials, particles and words of a name, as many as there are; possessive, so that no name is too long for the stack.
_NAME = rf"{_INITIALS}(?:{_PARTICLE})*+{_WORD}(?: {_INITIALS}(?:{_PARTICLE})*+{_WORD})*+"
#: What is detected, by type, in order of preference at one place.
PATTERNS: dict[str, str] = {
    "email": r"(?:\G|(?<![\p{L}\p{N}_%+\-]))[\p{L}\p{N}_%+\-]++(?:\.[\p{L}\p{N}_%+\-]++)*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:token|secret|api[_-]?key|password|passwd)\s*[=:]\s*(?:[\"'][^\"'\s]{8,}[\"']|(?=[^\s\"',;]*\d)[^\s\"',;]{7,}[\p{L}\p{N}=_+/\-])",
    "key": r"\b(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2})",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\p{L}\p{N}])\d{3}-\d{3}-\d{4}(?!\d)|(?<![\p{L}\p{N}.,:/\-])(?=(?:\d[ /.\-]?){9,12}(?![ /.\-]?\d))(?:0\d{1,4}[ /\-]\d{3,8}(?:[ \-]\d{2,6})*|0\d(?:[ .\-]\d{2}){4})(?!\d)",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}.:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\p{L}\p{N}])\d{3}-\d{2}-\d{4}(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?\d{1,3}|[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?\d{3})\b",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d(?:[ \-]?\d){12,18})(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_LEAD}{_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NO_EMAIL = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email")
#: Every match of ``NO_EMAIL`` holds one of these, so texts without them and without @ need no search.
SIGNS = rf"[0-9]|[=:]\s*[\"']|AKIA|gh[pousr]_|sk-|eyJ|{_TITLE}\.? |{_ABBREVIATED}"
FEMALE = r"^(?:Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Madame|Mademoiselle|Mme|Mlle|Señor(?:it)?a|Sra|Doña|г-жа)(?![\p{L}])"
#: Signs that a hexadecimal digit becomes in turn, consonant and vowel, and endings of given names, by script.
NAMES = {
    "Cyrillic": ("бвгдзклмнпрстфхш", "аеиоаеиоаеиоаеио", {"f": ["а", "ина", "ела", "ита"], "m": ["ан", "ор", "ил", "ерт"]}),
    "Greek": ("βγδζθκλμνξπρστφχ", "αειοαειοαειοαειο", {"f": ["α", "ινα", "ελα", "ιτα"], "m": ["ος", "ης", "ας", "ων"]}),
    "Armenian": ("բգդզթլխկհմնպսվրտ", "աեիոաեիոաեիոաեիո", {"f": ["ա", "ինա", "ելա", "իտա"], "m": ["ան", "որ", "իլ", "երտ"]}),
    "Latin": ("bdfghklmnprstvwz", "aeioaeioaeioaeio", {"f": ["a", "ina", "ella", "ita"], "m": ["an", "or", "il", "ert"]}),
}
#: Pairs of a consonant and a vowel in a family name (64 ** 6 of them) and before the ending of a given name; later attempts get more.
FAMILY_PAIRS, GIVEN_PAIRS, MOST_PAIRS = 6, 4, 24
#: Lengths of calling codes by their first digits; a national number keeps its 0.
CALLING_CODE = r"^0|^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters outside ASCII that a masked value gets, by script; those of any other script become Latin.
LETTERS = {
    r"(?=\p{IsLatin})\p{Lu}": "ÉÈÊÀÂÎÔÛÄÖÜ", r"\p{IsLatin}": "éèêàâîôûäöü", r"(?=\p{IsCyrillic})\p{Lu}": "БВГДЖЗИКЛМНПРСТУФХЦЧШЭЮЯ", r"\p{IsCyrillic}": "бвгджзиклмнпрстуфхцчшэюя",
    r"(?=\p{IsGreek})\p{Lu}": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"(?=\p{IsArmenian})\p{Lu}": "ԲԳԴԶԹԼԽԿՀՄՆՊՍՎՐՏ", r"\p{IsArmenian}": "բգդզթլխկհմնպսվրտ",
    r"\p{IsHan}": "天地人山水火木金土日月风云花草石", r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてと", r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテト", r"\p{IsHangul}": "가나다라마바사아자차카타파하",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", r"\p{IsThai}": "กขคงจชซญดตถทนบปผฝพฟมยรลวสหอ",
}
#: Rounds in a row that may end with no fewer clashes than before.
ROUNDS = 100
#: Largest measured size of the redrawn rows that are sent to every task.
BROADCAST_BYTES = 16 << 20
NO_STRINGS = "cast(array() as array<string>)"


def _luhn(digits: Column, first: int = 0) -> Column:
    """The Luhn sum of digits from right to left, the rightmost at place ``first``; places of odd number count double."""

    def weight(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when((i + first) % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda total, n: total + n)


def _mod97(signs: Column) -> Column:
    """Capitals and digits modulo 97, a letter standing for 10 to 35."""
    step = lambda rest, c: F.when(c.rlike("[0-9]"), rest * 10 + c.try_cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(signs, ""), F.lit(0), step)


def kind_of(value: Column) -> Column:
    """The first type whose pattern covers the whole value; ``number`` for a card number with a wrong check digit."""
    kinds = (F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items())
    card = F.when(_luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0, F.lit("card")).otherwise(F.lit("number"))
    return let(F.coalesce(*kinds, F.lit("card")), lambda k: F.when(k == "card", card).otherwise(k))


# --- detection -------------------------------------------------------------------------
def _searched(text: Column, search, otherwise: Column) -> Column:
    """``search(pattern)`` with the least pattern that finds all of ``ANY`` in the text; ``otherwise`` where none can match."""
    return F.when(text.contains("@"), search(ANY)).when(text.rlike(SIGNS), search(NO_EMAIL)).otherwise(otherwise)


def detected(text: Column) -> Column:
    """The values of a text from left to right, repeats included, without the untitled mentions; null text has none."""
    return _searched(text, lambda p: F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), F.expr(NO_STRINGS))


def _full_names(values: Column) -> Column:
    """The titled names of two words and more, as they stand without their title."""
    titled = F.filter(values, lambda v: v.rlike(rf"^{_LEAD}\S+ \S") & v.rlike(rf"^(?:{PATTERNS['name']})$"))
    # longer names first, so that none is cut at a shorter one
    return F.transform(F.sort_array(F.array_distinct(F.transform(titled, lambda v: let(F.regexp_replace(v, f"^{_LEAD}", ""), lambda n: F.struct(F.char_length(n).alias("n"), n.alias("name"))))), False), lambda n: n["name"])


def _pattern(names: Column) -> Column:
    """Everything that is detected, and these names without title."""
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.replace(F.array_join(names, "|"), F.lit("."), F.lit("[.]")), F.lit(r")(?![\p{L}\p{N}])"))


def found_in(text: Column) -> Column:
    """struct(between array<string>, found array<struct(value, kind, core, female)>): a text cut at its values.

    ``core`` is a name without its title; an untitled mention has kind ``untitled`` and the
    gender of the first titled one.
    """
    pieces = lambda values, pattern: F.split(text, pattern, -1)  # noqa: E731, ARG005

    def described(values: Column, titled: Column, names: Column) -> Column:
        def one(v: Column) -> Column:
            loose = F.array_contains(names, v)
            kind = F.when(loose, F.lit("untitled")).otherwise(kind_of(v))
            source = F.when(loose, F.element_at(F.filter(titled, lambda t: t.endswith(F.concat(F.lit(" "), v))), 1)).otherwise(v)
            return F.struct(v.alias("value"), kind.alias("kind"), F.when(loose, v).otherwise(F.regexp_replace(v, f"^{_LEAD}", "")).alias("core"), source.rlike(FEMALE).alias("female"))

        return F.transform(values, one)

    def cut(titled: Column) -> Column:
        def by(names: Column) -> Column:
            whole = _pattern(names)
            again = F.struct(F.split(text, whole, -1).alias("between"), described(F.regexp_extract_all(text, F.concat(F.lit("("), whole, F.lit(")")), F.lit(1)), titled, names).alias("found"))
            once = F.struct(_searched(text, lambda p: pieces(titled, p), F.array(text)).alias("between"), described(titled, titled, names).alias("found"))
            return F.when(F.size(names) > 0, again).otherwise(once)

        return F.when(F.size(titled) > 0, let(_full_names(titled), by))

    return let(detected(text), cut)


# --- entities --------------------------------------------------------------------------
def _name_parts(core: Column, female: Column) -> Column:
    """array<struct(text, entity)> of a name: its words and hyphens, with the entity of each part that is one."""
    def split(w: Column, at: Column, last: Column) -> Column:
        role = F.when(at == last, F.lit("family")).otherwise(F.concat(F.lit("given:"), F.when(female, F.lit("f")).otherwise(F.lit("m"))))
        named = w.rlike(r"^\p{Lu}") & ~w.rlike(r"^(?:\p{Lu}\.-?)+$")
        return F.transform(F.split(w, "-"), lambda p, k: F.struct(p.alias("text"), F.when(named, F.concat(role, F.lit("|"), F.lower(p))).alias("entity"), F.when(k > 0, F.lit("-")).when(at > 0, F.lit(" ")).otherwise(F.lit("")).alias("lead")))

    # bound once, not once a word
    return let(F.split(core, " "), lambda words: let(F.size(words) - 1, lambda last: F.flatten(F.transform(words, lambda w, at: split(w, at, last)))))


def _canonical(v: Column) -> Column:
    """What of a value that is no name tells it from others of its kind."""
    value, kind = v["value"], v["kind"]
    return F.when(kind.isin("email", "ip6"), F.lower(value)).when(kind == "phone", F.regexp_replace(value, r"[^+0-9]", "")).when(kind.isin("ssn", "card"), F.regexp_replace(value, r"[^0-9]", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_extract(value, r"^[^=:]*[=:]\s*[\"']?(.*?)[\"']?$", 1)).otherwise(value)


def entities_of(v: Column) -> Column:
    """The entities of a found value, each as kind|canonical form."""
    names = F.filter(F.transform(_name_parts(v["core"], v["female"]), lambda p: p["entity"]), lambda e: e.isNotNull())
    return F.when(v["kind"].isin("name", "untitled"), names).when(v["kind"] == "number", F.expr(NO_STRINGS)).otherwise(F.array(F.concat(v["kind"], F.lit("|"), _canonical(v))))


# --- surrogates ------------------------------------------------------------------------
def _number(digest: Column, at, width: int = 4) -> Column:
    return F.conv(F.substring(digest, at if isinstance(at, Column) else F.lit(at), F.lit(width)), 16, 10).cast("int")


def _masked(value: Column, digest: Column, fixed: Column) -> Column:
    """Each digit and letter after the first ``fixed`` characters drawn from the digest in kind: case and script stay."""

    def one(c: Column, i: Column) -> Column:
        number = _number(digest, F.pmod(i, F.lit(60)) + 1)
        draw = lambda alphabet: F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))
        return F.when(i < fixed, c).when(c.rlike("[0-9]"), draw("0123456789")).when(c.rlike("[a-f]"), draw("abcdef")).when(c.rlike("[g-z]"), draw("ghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{L}"), F.coalesce(*(F.when(c.rlike(p), draw(letters)) for p, letters in LETTERS.items()), draw("éèêàâîôûäöü"))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _spoken(digest: Column, signs: tuple[str, str], pairs: Column) -> Column:
    """A word of so many pairs of a consonant and a vowel."""
    letters = [F.split(F.translate(F.substring(digest, at, MOST_PAIRS), "0123456789abcdef", s), "") for at, s in zip((2, 2 + MOST_PAIRS), signs)]
    return F.substring(F.array_join(F.zip_with(*letters, lambda a, b: F.concat(a, b)), ""), F.lit(1), F.least(pairs, F.lit(MOST_PAIRS)) * 2)


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    """The keyed replacement of an entity, in the same form kind|value; another attempt gives another one."""
    kind, value = F.substring_index(entity, "|", 1), F.regexp_replace(entity, r"^[^|]*\|", "")

    def drawn(d: Column) -> Column:
        domain = F.regexp_extract(value, r"@(.*)\.[^.]*$", 1)
        host = let(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), lambda h: F.concat(F.lit("@"), _masked(domain, h, F.lit(0)), F.lit(".invalid")))
        email = F.concat(_masked(F.regexp_extract(value, r"^[^@]*", 0), d, F.lit(0)), F.when(attempt > 1, F.pmod(_number(d, 50, 6), F.lit(1000000)).cast("string")).otherwise(F.lit("")), host)
        # private addresses first, then the range that is reserved for no use
        lead = F.when(attempt < 2, F.lit(10)).otherwise(240 + F.pmod(_number(d, 20, 2), F.lit(15)))
        ip = F.concat_ws(".", lead.cast("string"), *((F.pmod(_number(d, at), F.lit(254)) + 1).cast("string") for at in (1, 5, 9)))
        family = given = None
        for script, (consonants, vowels, endings) in reversed(NAMES.items()):
            last, first = (_spoken(d, (consonants, vowels), F.lit(n) + (attempt / 3).cast("int")) for n in (FAMILY_PAIRS, GIVEN_PAIRS))
            end = lambda g: F.element_at(F.array(*map(F.lit, endings[g])), F.pmod(_number(d, 1, 1), F.lit(4)) + 1)  # noqa: E731, B023
            first = F.concat(first, F.when(kind == "given:f", end("f")).otherwise(end("m")))
            within = value.rlike(rf"\p{{Is{script}}}")
            family, given = (last, first) if family is None else (F.when(within, last).otherwise(family), F.when(within, first).otherwise(given))
        fixed = F.when(kind == "phone", F.char_length(F.regexp_extract(value, CALLING_CODE, 0))).when(kind == "key", F.lit(4)).otherwise(0)
        country = F.left(value, F.lit(2))
        drawn_part = F.when(kind == "card", F.left(value, F.char_length(value) - 1)).when(kind == "iban", F.substring(value, F.lit(5), F.char_length(value))).otherwise(value)

        def checked(m: Column) -> Column:
            """The drawn signs with the right check digits."""
            pair = F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0")
            return F.when(kind == "card", F.concat(m, F.pmod(-_luhn(m, 1), F.lit(10)).cast("string"))).when(kind == "iban", F.concat(country, pair, m)).otherwise(m)

        new = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "family", family).when(kind.startswith("given"), given).otherwise(let(_masked(drawn_part, d, fixed), checked))
        return F.concat(kind, F.lit("|"), new)

    return let(F.sha2(F.concat_ws("\x1f", F.lit(key), entity, attempt.cast("string")), 256), drawn)


def _rendered(v: Column, key: str, look_up) -> Column:
    """A found value with the surrogates of its entities, in its own shape; ``look_up`` gives an entity's surrogate."""
    value, kind = v["value"], v["kind"]
    new = lambda entity: F.regexp_replace(look_up(entity), r"^[^|]*\|", "")
    initial = lambda text: F.concat(F.substring(F.translate(F.sha2(F.concat_ws("\x1f", F.lit(key), text), 256), "0123456789", "JKLMNOPRST"), 1, 1), F.lit("."))

    def name(p: Column) -> Column:
        initials = F.array_join(F.transform(F.regexp_extract_all(p["text"], F.lit(r"(\p{Lu}\.)"), F.lit(1)), lambda i: F.upper(initial(i))), "")
        apostrophe = F.regexp_extract(p["text"], r"^\p{Lu}(['’])\p{Lu}", 1)
        quoted = lambda s: F.when(apostrophe != "", F.concat(F.left(s, F.lit(1)), apostrophe, F.upper(F.substring(s, 2, 1)), F.substring(s, 3, 999))).otherwise(s)
        cased = let(new(p["entity"]), lambda s: F.when((p["text"] == F.upper(p["text"])) & (F.char_length(p["text"]) > 1), F.upper(s)).otherwise(F.initcap(s)))
        return F.concat(p["lead"], F.when(p["entity"].isNotNull(), let(cased, quoted)).when(p["text"].rlike(r"^(?:\p{Lu}\.)+$"), initials).otherwise(p["text"]))

    whole = F.array_join(F.transform(_name_parts(v["core"], v["female"]), name), "")
    titled = F.concat(F.regexp_extract(value, f"^{_LEAD}", 0), whole)

    def filled(s: Column) -> Column:
        # the signs of the surrogate go where the value has its own
        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
        step = lambda a, c: F.when(c.rlike("[+0-9A-Za-z]"), F.struct(F.concat(a["text"], F.substring(s, a["at"], F.lit(1))).alias("text"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at")))
        return F.aggregate(F.split(value, ""), start, step, lambda a: a["text"])

    def shaped(s: Column) -> Column:
        quoted = F.concat(F.regexp_extract(value, r"^[^=:]*[=:]\s*[\"']?", 0), s, F.regexp_extract(value, r"[\"']$", 0))
        return F.when(kind == "secret", quoted).when(kind.isin("email", "ip6"), F.when(value == F.upper(value), F.upper(s)).otherwise(s)).when(kind.isin("ip", "key"), s).otherwise(filled(s))

    return F.when(kind == "name", titled).when(kind == "untitled", whole).when(kind == "number", value).otherwise(let(new(F.concat(kind, F.lit("|"), _canonical(v))), shaped))


# --- tables ----------------------------------------------------------------------------
def places(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, value): the distinct entities of every distinct text."""
    each = F.array_distinct(F.flatten(F.transform(found_in(F.col(text))["found"], entities_of)))
    return docs.select(F.xxhash64(F.col(text)).alias("text_key"), F.explode(each).alias("value")).distinct()


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(value, texts): every distinct entity and the number of distinct texts that hold it."""
    return places(docs, text).groupBy("value").agg(F.count("*").alias("texts"))


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(value, surrogate) of entities: one-to-one, and no surrogate is an entity of the corpus.

    Rounds go on until no clash is left.  Only a form with too few possible values for the
    corpus (a phone number of few digits, say) brings no progress; that raises an error.
    """
    plain = values.select("value")
    table = written(plain.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("value"), key, F.col("attempt"))), "surrogates")
    least, idle = None, 0
    while idle < ROUNDS:
        # the least value of a shared surrogate keeps it; a window would gather the group
        keeper = table.groupBy("surrogate").agg(F.min("value").alias("keeper"), F.count("*").alias("n"))
        taken = keeper.join(plain.withColumnRenamed("value", "surrogate"), "surrogate", "left_semi").select("surrogate", F.lit(True).alias("taken"))
        clash = keeper.join(taken, "surrogate", "left").where("n > 1 or taken").select("surrogate", "keeper", "taken", "n")
        clash = written(clash, "clashes")
        left = clash.agg(F.sum(F.col("n") - F.when(F.col("taken"), 0).otherwise(1))).first()[0]
        if not left:
            return table.select("value", "surrogate")
        least, idle = (left, 0) if least is None or left < least else (least, idle + 1)
        joined = table.join(clash, "surrogate", "left")
        again = F.col("keeper").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.col("value") != F.col("keeper")))
        attempt = F.col("attempt") + again.cast("int")
        table = written(joined.select("value", attempt.alias("attempt"), F.when(again, surrogate(F.col("value"), key, attempt)).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")
    raise ValueError("surrogates still collide: the space of this type is too small for the corpus")


def replace_personal_data(docs: DataFrame, key: str = "surrogate-key-1", text: str = "text", count: str | None = None) -> DataFrame:
    """Rewrites ``text``; with ``count`` also adds the number of replaced places under that name.

    Surrogates at attempt 0 are computed in the row; only texts that hold an entity whose
    surrogate was drawn anew need the (entity, surrogate) rows of that rest.  Those rows are
    broadcast while they measure at most ``BROADCAST_BYTES``; beyond that the texts with
    personal data, and no others, are shuffled to them.
    """
    held = written(places(docs, text), "places")
    table = surrogate_table(held.select("value").distinct(), key)
    redrawn = table.where(F.col("surrogate") != surrogate(F.col("value"), key, F.lit(0)))
    cut, redraws, text_key = fresh(docs, "pii_cut", "pii_map", "pii_key")
    marked = docs.withColumn(cut, found_in(F.col(text)))
    no_map = F.expr("cast(map() as map<string,string>)")
    none = F.coalesce(F.size(f"{cut}.found"), F.lit(0)) <= 0
    rest = None
    if redrawn.isEmpty():
        marked = marked.withColumn(redraws, no_map)
    else:
        maps = held.join(redrawn, "value").groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("value", "surrogate"))).alias(redraws))
        maps = written(maps.withColumnRenamed("text_key", text_key), "redrawn")
        letters = F.aggregate(F.map_entries(redraws), F.lit(16).cast("long"), lambda total, e: total + F.octet_length(e["key"]) + F.octet_length(e["value"]) + 32)
        size = maps.agg(F.sum(letters)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            maps = F.broadcast(maps)
        else:
            rest, marked = marked.where(none).withColumn(redraws, no_map), marked.where(~none)
        marked = marked.withColumn(text_key, F.xxhash64(F.col(text))).join(maps, text_key, "left").drop(text_key).withColumn(redraws, F.coalesce(redraws, no_map))
        marked = marked if rest is None else marked.unionByName(rest)

    def rewritten(c: Column) -> Column:
        look_up = lambda e: F.coalesce(F.element_at(F.col(redraws), e), surrogate(e, key, F.lit(0)))
        new = F.transform(c["found"], lambda v: _rendered(v, key, look_up))
        return F.array_join(F.flatten(F.zip_with(c["between"], new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

    new_text = F.when(~none, rewritten(F.col(cut))).otherwise(F.col(text))
    kept = [new_text.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    return marked.select(*kept, *([F.greatest(F.coalesce(F.size(F.filter(f"{cut}.found", lambda v: v["kind"] != "number")), F.lit(0)), F.lit(0)).cast("long").alias(count)] if count else []))
