"""Keyed surrogates for personal data, in DataFrame expressions throughout.

Entities are marked in the text, named by type and canonical form, and given surrogates in one
table for the whole corpus, so that a person or number reads the same wherever it occurs and no two
of them read alike. The surrogates are put back in the surface's own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, read_table

#: The key of the query; set your own for data that leave your hands.
KEY = "lodestone"

_OPEN, _SHUT, _ESCAPE = "﷐", "﷑", "﷒"  # noncharacters, which texts don't use; escaped if they do
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d{1,2})"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: What is marked, in the order in which it is tried. Repetitions are bounded, or of one class and
#: tried at the beginning of a run of it alone, so that matching is linear in the text.
_ENTITY = (
    r"(?<![A-Za-z0-9])(?:"
    r"(?:[Pp]assword|PASSWORD|passwd|pwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']++"
    r"|AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}+"
    rf"|(?=[A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}{_GROUP}(?![A-Za-z0-9:]))(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![A-Za-z0-9:])"
    rf"|(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[A-Za-z0-9])"
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    r"|\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}(?![A-Za-z0-9])"
    r"|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?![A-Za-z0-9])"
    r"|\d{3}-\d{2}-\d{4}(?![A-Za-z0-9])"
    r"|\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?![A-Za-z0-9])"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?![A-Za-z0-9])"
    r"|\d{3}[ .\-]\d{3}[.\-]\d{4}(?![A-Za-z0-9])"
    r")"
)
_SECRET = r"^(?:[Pp]assword|PASSWORD|passwd|pwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?"
#: Titles by gender; names are marked only after one.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "κυρία"],
    "n": ["Dr", "Prof"],
}
_WORD = r"\p{Lu}[\p{L}'’\-]++"
#: What may stand, in lower case, between the words of a name.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "bin", "ibn", "al", "el", "y"]
#: Given names by gender and script, and the syllables of family names.
GIVEN = {
    "latin": {
        "m": ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"],
        "f": ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
        "n": ["Alex", "Andrea", "Chris", "Dominique", "Jamie", "Jordan", "Kim", "Luca", "Morgan", "Noa", "Robin", "Sam", "Sascha", "Sidney", "Toni", "Vanja"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Фёдор"],
        "f": ["Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лариса", "Мария", "Нина", "Ольга", "Раиса", "Софья"],
        "n": ["Саша", "Женя", "Валя", "Шура"],
    },
    "greek": {
        "m": ["Άρης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Νίκος", "Πέτρος"],
        "f": ["Άννα", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"],
        "n": ["Αλέξης", "Φώτης"],
    },
}
SYLLABLES = {
    "latin": ["bar", "ben", "dor", "fel", "gan", "hol", "kam", "lin", "mar", "nor", "pel", "ran", "sol", "tam", "ver", "wil"],
    "cyrillic": ["бар", "вен", "гор", "дал", "зан", "кам", "лин", "мор", "нев", "пол", "рад", "сол", "тар", "фел", "хар", "шин"],
    "greek": ["βαρ", "γαλ", "δορ", "ζαν", "θεο", "καλ", "λιν", "μαρ", "νικ", "παν", "ραδ", "σολ", "ταρ", "φελ", "χαρ", "ψαρ"],
}
#: Rounds in which a surrogate that some entity really has is refused too.
SHY_ROUNDS = 8
#: The share of a fixed format's numbers from which its entities are permuted and not drawn.
DENSE = 0.25


def _mark(text: Column) -> Column:
    """text with each entity as OPEN, a letter for its kind, surface, SHUT; noncharacters escaped."""
    for i, x in enumerate((_ESCAPE, _OPEN, _SHUT)):
        text = F.replace(text, F.lit(x), F.lit(f"{_ESCAPE}{i}"))
    text = F.regexp_replace(text, f"({_ENTITY})", f"{_OPEN}x$1{_SHUT}")
    between = rf" (?:(?:{'|'.join(PARTICLES)}) )*+"
    for gender, titles in TITLES.items():
        # a title and a word, then word after word, each from where the one before it ended
        title = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(titles)})\.?[ \u00A0]"
        text = F.regexp_replace(text, rf"({title}|\G(?!\A){between})({_WORD})", f"$1{_OPEN}{gender}$2{_SHUT}")
        # the last word of a name is that of the family
        text = F.regexp_replace(text, f"{_OPEN}{gender}([^{_SHUT}]++){_SHUT}(?!{between}{_OPEN}{gender})", f"{_OPEN}s$1{_SHUT}")
    return text


def _unmark(text: Column) -> Column:
    for i, x in reversed(list(enumerate((_ESCAPE, _OPEN, _SHUT)))):
        text = F.replace(text, F.lit(f"{_ESCAPE}{i}"), F.lit(x))
    return text


def _suspect(text: Column) -> Column:
    """Whether _mark() would mark anything.

    Every entity holds a digit, @, = or :, or is an access key, so the long pattern is tried on texts
    with one of these alone; the titles' pattern looks at a letter before anything else.
    """
    possible = text.rlike("[0-9@=:]") | text.contains("AKIA")
    titles = [t for own in TITLES.values() for t in own]
    first = "".join(sorted({t[0] for t in titles}))
    named = text.rlike(rf"(?=[{first}])(?<![\p{{L}}\p{{N}}])(?:{'|'.join(titles)})\.?[ \u00A0]\p{{Lu}}[\p{{L}}'’\-]")
    return (possible & text.rlike(_ENTITY)) | named


def _kind(piece: Column) -> Column:
    """The type of a marked piece, from its letter or its form."""
    x = F.substring(piece, F.lit(2), F.length(piece))
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    own = (
        F.when(x.rlike(_SECRET), "secret").when(x.contains("@"), "email").when(x.startswith("AKIA"), "key").when(x.rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ipv6")
        .when(x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip").when(x.rlike("^[A-Z]"), "iban").when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(~x.rlike(r"[+(.]") & (digits >= 15), "card").otherwise("phone")
    )
    letter = F.substring(piece, 1, 1)
    script = F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return F.when(letter == "x", own).otherwise(F.concat(F.lit("name."), script, F.lit("."), letter))


def _canon(piece: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common."""
    x = F.substring(piece, F.lit(2), F.length(piece))
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    ahead, behind = groups(F.substring_index(x, "::", 1)), groups(F.when(x.contains("::"), F.substring_index(x, "::", -1)).otherwise(""))
    eight = F.concat(ahead, F.array_repeat(F.lit("0"), 8 - F.size(ahead) - F.size(behind)), behind)
    return (
        F.when(kind == "secret", F.regexp_replace(x, _SECRET, ""))
        .when(kind == "ipv6", F.array_join(F.transform(eight, lambda g: F.lpad(F.lower(g), 4, "0")), ":"))
        .when(kind == "email", F.lower(x)).when(kind == "key", x).when(kind == "ip", F.regexp_replace(x, r"\b0(?=\d)", ""))
        .when(kind == "iban", F.replace(x, F.lit(" "), F.lit(""))).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(x, r"[^0-9+]", ""))
        .otherwise(F.lower(x))
    )


def _hex(key: str) -> Column:
    """Keyed bytes for (type, canon, turn), 128 hex digits of them."""
    seed = lambda k: F.sha2(F.concat_ws("\u0001", F.lit(key), "type", "canon", F.col("turn").cast("string"), F.lit(k)), 256)
    return F.concat(seed("0"), seed("1"))


def _byte(i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 64
    return F.conv(F.substring(F.col("_hex"), at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: Column, i: int) -> Column:
    return F.element_at(options, _byte(i) % F.size(options) + 1)


def _like(text: Column) -> Column:
    """text with each digit and letter replaced by another of its class."""
    hexes = text.rlike("^[0-9a-f]+$") & text.rlike("[0-9]") & text.rlike("[a-f]")

    def other(c: Column, i: Column) -> Column:
        b = _byte(i)
        return (
            F.when(c.rlike("[0-9]"), F.char(b % 10 + 48)).when(c.rlike("[a-z]"), F.char(b % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).otherwise(c)
        )

    # what holds for the whole text is asked outside, so that long texts take linear time
    put = lambda f: F.array_join(F.transform(F.split(text, ""), f), "")
    return F.when(hexes, put(lambda c, i: F.lower(F.hex(_byte(i) % 16)))).otherwise(put(other))


def _country() -> Column:
    """The characters of a phone number that stay."""
    return F.when(F.col("canon").rlike(r"^\+[17]"), 2).when(F.startswith("canon", F.lit("+")), 3).otherwise(0)


def _network(one, two) -> Column:
    """Two octets of an address stay where private and public ones share the first, else one: what is right for it."""
    return F.when(F.col("canon").rlike(r"^(?:172|192)\."), two).otherwise(one)


def _kept_octets() -> Column:
    return _network(F.substring_index("canon", ".", 1), F.substring_index("canon", ".", 2))


def _space() -> Column:
    """Of (type, canon), the numbers that a fixed format has: (stem, high, low), of which high * low share the
    stem; null for formats that are long or grow with the turn. Surrogates are drawn from the same numbers."""
    kind, canon, country = F.col("type"), F.col("canon"), _country()
    free = F.length("canon") - country
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    space = lambda stem, high, low: F.struct(stem.alias("stem"), high.cast("long").alias("high"), low.cast("long").alias("low"))
    return (
        F.when(kind == "ip", space(F.concat(_kept_octets(), F.lit(".")), F.lit(256), _network(F.lit(65536), F.lit(256))))
        .when(kind == "ssn", space(F.lit(""), F.lit(10**4), F.lit(10**5)))
        .when((kind == "phone") & (free <= 12), space(F.left("canon", country), ten(F.floor(free / 2)), ten(free - F.floor(free / 2))))
    )


def _permuted(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate) of entities(type, canon, space): a keyed permutation of all that share a stem and a length.

    The number's two halves are shifted in turn by a keyed function of the other half, so that no
    two numbers get the same one, however many there are.
    """
    high, low = F.col("space.high"), F.col("space.low")
    octet = lambda i: F.element_at(F.split("canon", r"\."), i).cast("long")
    digits = F.substring(F.col("canon"), F.length("space.stem") + 1, F.length("canon")).cast("long")
    number = F.when(F.col("type") != "ip", digits).when(high * low == 1 << 16, octet(3) * 256 + octet(4)).otherwise(octet(2) * 65536 + octet(3) * 256 + octet(4))
    rows = entities.withColumn("_x", number).withColumn("_a", F.floor(F.col("_x") / low)).withColumn("_b", F.col("_x") % low)
    for turn in range(6):
        own, other, size = ("_a", "_b", high) if turn % 2 == 0 else ("_b", "_a", low)
        digest = F.sha2(F.concat_ws("\u0001", F.lit(key), "type", "space.stem", high.cast("string"), low.cast("string"), F.lit(str(turn)), F.col(other).cast("string")), 256)
        rows = rows.withColumn(own, (F.col(own) + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")) % size)
    x = F.col("_a") * low + F.col("_b")
    part = lambda k: (F.floor(x / (1 << k)) % 256).cast("string")
    address = F.concat("space.stem", F.when(high * low == 1 << 16, F.concat_ws(".", part(8), part(0))).otherwise(F.concat_ws(".", part(16), part(8), part(0))))
    padded = F.concat("space.stem", F.lpad(x.cast("string"), F.length("canon") - F.length("space.stem"), F.lit("0")))
    return rows.select("type", "canon", F.when(F.col("type") == "ip", address).otherwise(padded).alias("surrogate"))


def _luhn(digits: Column, skip: int) -> Column:
    """The Luhn sum of a number; with skip = 1, of all but its last digit, as if that were to come."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.try_cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(i >= n - skip, 0).when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x)


def _surrogate(drawn: DataFrame, key: str) -> DataFrame:
    """drawn(type, canon, kind, turn) with the canonical form that stands in for each entity at its turn.

    Shared parts are columns of their own, so that each is one expression in the plan.
    """
    kind, canon, fresh = F.col("kind"), F.col("canon"), F.col("_fresh")
    names = F.lit(None).cast("array<string>")
    for script, genders in GIVEN.items():
        for letter, options in (genders | {"s": SYLLABLES[script]}).items():
            names = F.when(kind == f"name.{script}.{letter}", F.array(*map(F.lit, options))).otherwise(names)
    drawn = drawn.withColumn("_hex", _hex(key)).withColumn("_names", names)
    turn = F.col("turn")
    drawn = drawn.withColumn("_fresh", _like(F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(canon)))
    # later turns lengthen what may be of any length, so that short mailboxes and secrets never run out
    longer = F.concat(fresh, F.substring(F.col("_hex"), F.lit(65), turn - SHY_ROUNDS + 1))
    drawn = drawn.withColumn("_fresh", F.when(kind.isin("email", "secret") & (turn >= SHY_ROUNDS), longer).otherwise(fresh))
    keep = lambda n: F.concat(F.left(canon, n), F.substring(fresh, n + 1, F.length(fresh)))
    drawn = drawn.withColumn("_card", keep(F.lit(1)))
    checked = F.concat(F.left("_card", F.length("_card") - 1), ((10 - _luhn(F.col("_card"), 1) % 10) % 10).cast("string"))
    domain = F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.substring_index(canon, "@", -1)), 256), 1, 8)
    mailbox = F.concat(fresh, F.lit("@h"), domain, F.lit(".example."), _pick(F.array(*map(F.lit, ["com", "net", "org"])), 61))
    octets = [_byte(k).cast("string") for k in range(3)]
    address = F.concat_ws(".", _kept_octets(), _network(octets[0], F.lit(None)), *octets[1:])
    long_address = F.concat(F.lit("2001:0db8:"), F.regexp_replace(F.substring("_hex", 1, 24), "(.{4})(?=.)", "$1:"))
    options = F.col("_names")
    # further turns add syllables and hyphenate more given names, so that neither list ever runs out
    picked = lambda first, n: F.transform(F.sequence(F.lit(first), first + n - 1), lambda i: _pick(options, i))
    family = F.initcap(F.array_join(picked(0, 3 + F.greatest(turn - 3, F.lit(0))), ""))
    given = F.array_join(picked(8, 1 + F.when(turn < SHY_ROUNDS, F.floor(turn / 2)).otherwise(turn - 4).cast("int")), "-")
    out = (
        F.when(kind == "email", mailbox).when(kind == "ip", address).when(kind == "ipv6", long_address).when(kind == "key", keep(F.lit(4)))
        .when(kind == "card", F.when(_luhn(canon, 0) % 10 == 0, checked).otherwise(F.col("_card")))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(fresh, 2, 16))).when(kind == "phone", keep(_country())).when(kind == "iban", keep(F.lit(2)))
        .when(kind.rlike("^name.*[.]s$"), family).when(kind.startswith("name."), given)
    )
    return drawn.withColumn("surrogate", out.otherwise(fresh))


def surrogates(scratch: Scratch, entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate) for every row of entities(type, canon), which are distinct.

    Surrogates are distinct within a type. A column `kind`, if there is one, says what form they
    have; it is the type otherwise.

    In each turn every open entity draws a surrogate from the key. Of those that draw the same one
    the smallest wins; nobody gets one that was given out before, nor one that some entity of the
    type really has. The others draw again. Names, mailboxes and secrets grow with the turn. Of fixed
    formats (addresses, phone and social-security numbers), those with a quarter or more of their
    numbers taken are permuted by the key instead, so that even all of them get surrogates; there,
    what one gets may be what another really has. Of the others, half of the numbers or more are free
    in every turn, so that turns end, and their number grows with the logarithm of the entities.
    Surrogates are compared without case, as names and mailboxes are. The result is the same for any
    order of rows and any number of partitions.
    """
    entities = entities if "kind" in entities.columns else entities.withColumn("kind", F.col("type"))
    real = entities.select("type", F.lower("canon").alias("s"))
    todo, given, turn = entities, None, 0
    spaces = entities.withColumn("space", _space()).where("space IS NOT NULL").groupBy("type", "space").agg(F.count("*").alias("n"))
    # social-security numbers drawn begin with 9; permuted ones may not
    room = F.col("space.high") * F.col("space.low") / F.when(F.col("type") == "ssn", 10).otherwise(1)
    dense = scratch.save(spaces.where(F.col("n") >= DENSE * room).select("type", "space"), "dense")
    if not dense.isEmpty():
        # there are fewer spaces than a few hundred thousand: /16 and /8 networks, and country codes by length
        fixed = scratch.save(_permuted(entities.withColumn("space", _space()).join(dense, ["type", "space"]), key), "permuted")
        given = fixed.select("type", F.col("surrogate").alias("s"), "canon", "surrogate")
        todo = scratch.save(entities.join(fixed, ["type", "canon"], "left_anti"), "drawn")
    while turn == 0 or not todo.isEmpty():
        drawn = _surrogate(todo.withColumn("turn", F.lit(turn)), key)
        drawn = scratch.save(drawn.select("type", "canon", "kind", "surrogate", F.lower("surrogate").alias("s")), f"drawn{turn}")
        won = drawn.groupBy("type", "s").agg(F.min_by(F.struct("canon", "surrogate"), "canon").alias("w"))
        won = won.select("type", "s", "w.*")
        if turn < SHY_ROUNDS:
            won = won.join(real, ["type", "s"], "left_anti")
        if given is not None:
            won = won.join(given, ["type", "s"], "left_anti")
        won = scratch.save(won, f"won{turn}")
        given = won if given is None else given.unionByName(won)
        todo = scratch.save(drawn.join(won, ["type", "canon"], "left_anti").select("type", "canon", "kind"), f"todo{turn}")
        turn += 1
    return given.select("type", "canon", "surrogate")


def _render(piece: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the surface."""
    x = F.substring(piece, F.lit(2), F.length(piece))

    def filled(kept: str) -> Column:
        letters = F.regexp_replace(surrogate, f"[^{kept}]", "")
        nth = lambda i: F.length(F.regexp_replace(F.left(x, i + 1), f"[^{kept}]", ""))
        return F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substring(letters, nth(i), F.lit(1))).otherwise(c)), "")

    same_case = F.when((F.upper(x) == x) & (F.lower(x) != x), F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(x, _SECRET, 0), surrogate)).when(kind.isin("phone", "card", "ssn"), filled("0-9"))
        .when(kind == "iban", filled("A-Z0-9")).when(kind.isin("ip", "key"), surrogate).otherwise(same_case)
    )


def pseudonymise(spark: SparkSession, docs: DataFrame, *, key: str = KEY, counted: bool = True) -> DataFrame:
    """docs in all their columns, surrogates in place of entities in text, and, if counted, n_entities as the last.

    Found are e-mail addresses, phone, card, social-security and IBAN numbers, IPv4 and IPv6
    addresses, access keys, values given to password, token and the like, and names of any number of
    words after a title. All are replaced whole, whatever their length. Equal canonical forms get
    equal surrogates throughout the corpus, distinct ones distinct. Names keep their script, and the
    gender that titles tell: a given name has one surrogate, male or female if all its titles that
    tell a gender agree. Numbers keep their separators, country and card brand and a valid Luhn
    digit, IPv4 addresses their first octet (192 and 172: two), e-mail and names their case; hex
    secrets stay hex. Null and empty texts stay as they are. Every row is its own document, whether
    its id is null, repeated or neither; a clashing column n_entities is replaced.

    Only documents in which something is marked are written, once, with a number for each row, and
    shuffled by it; the table of surrogates is joined to mentions, not to texts. Both are plain
    tables, so that Spark can split an entity that very many documents mention.
    """
    scratch = Scratch(spark)
    columns = [c for c in docs.columns if c != "n_entities" or not counted]
    docs = docs.select(*columns)
    hit = F.coalesce(_suspect(F.col("text")), F.lit(False))
    others = [c for c in columns if c != "text"]
    found = docs.where(hit).select(
        F.monotonically_increasing_id().alias("row"), F.struct(*others or [F.lit(0)]).alias("kept"), F.split(_mark(F.col("text")), f"[{_OPEN}{_SHUT}]").alias("pieces")
    )
    kinds = F.transform("pieces", lambda p, i: F.struct(p.alias("p"), F.when(i % 2 == 1, _kind(p)).alias("kind")))
    found = found.withColumn("pieces", kinds)
    canons = F.transform("pieces", lambda x: F.struct(x.p.alias("p"), x.kind.alias("kind"), F.when(x.kind.isNotNull(), _canon(x.p, x.kind)).alias("canon")))
    found = scratch.save(found.withColumn("pieces", canons), "found")

    named = F.array_distinct(F.transform(F.filter("pieces", lambda x: x.kind.isNotNull()), lambda x: F.struct(_type(x.kind).alias("type"), x.canon.alias("canon"), x.kind.alias("kind"))))
    mentions = scratch.save(found.select("row", F.explode(named).alias("m")).select("row", "m.*"), "mentions")
    told = lambda letter: F.max(F.col("kind").endswith(f".{letter}"))
    entities = mentions.groupBy("type", "canon").agg(F.min("kind").alias("kind"), told("m").alias("m"), told("f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    kind = F.when(F.col("type").endswith(".given"), F.concat(F.regexp_replace("type", "given$", ""), gender)).otherwise(F.col("kind"))
    entities = scratch.save(entities.select("type", "canon", kind.alias("kind")), "entities")
    table = scratch.save(surrogates(scratch, entities, key), "surrogates")
    entry = F.struct(F.concat_ws(":", "type", "canon"), "surrogate")
    own = mentions.select("row", "type", "canon").distinct()
    maps = own.join(table, ["type", "canon"]).groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(entry)).alias("map"))
    joined = found.join(scratch.save(maps, "maps"), F.col("row") == F.col("_row"), "left")

    given = F.transform("pieces", lambda x: F.struct(x.p.alias("p"), x.kind.alias("kind"), F.element_at("map", F.concat_ws(":", _type(x.kind), x.canon)).alias("own")))
    joined = joined.withColumn("given", given)
    put = F.transform("given", lambda x: F.when(x.own.isNull(), x.p).otherwise(_render(x.p, x.kind, x.own)))
    text = _unmark(F.array_join(put, ""))
    count = F.floor(F.size("pieces") / 2).cast("int")
    changed = joined.select(*[text.alias(c) if c == "text" else F.col("kept").getField(c).alias(c) for c in columns], *[count.alias("n_entities")] * counted)
    same = docs.where(~hit)
    return changed.unionByName(same.withColumn("n_entities", F.lit(0)) if counted else same)


def _type(kind: Column) -> Column:
    """What a kind's surrogates are distinct in: given names of a script are of one type, whatever the title."""
    return F.regexp_replace(kind, "^(name[.].*[.])[mfn]$", "$1given")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(spark, docs).select("doc_id", "n_entities", "text")
