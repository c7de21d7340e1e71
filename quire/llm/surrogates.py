"""PII: detected entities are replaced by keyed surrogates of the same type, script, gender and format.

Everything is DataFrame expressions: the texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, join_counted

#: Marks that noise may have put behind each part of an entity.
_N = r"[#*$%&|<>!]{0,4}"
#: What stands between the name of a secret and its value, its opening quote aside.
_IS = r"[\"']?" + _N + r"[ \t]*+[=:]" + _N + r"[ \t]*+"

TITLES = "Mrs|Mr|Ms|Miss|Dr|Prof|Doctor|Professor|Sir|Madam|Herr|Frau|Doktor|Monsieur|Madame|Mademoiselle|Mme|Mlle|Docteur|Professeur|Señora|Señorita|Señor|Sra|Srta|Sr|Doctora|Profesora|Profesor|господин|госпожа|доктор|профессор"

#: Given names by gender and script, and family names by script.
NAMES = {
    ("given", "f", "latin"): "Alice Anna Clara Diana Elena Emma Eva Helen Ida Irene Julia Laura Lena Lucia Maria Martha Nina Nora Paula Rosa Sara Sofia Vera".split(),
    ("given", "m", "latin"): "Adam Albert Anton Bruno Carl Daniel David Emil Erik Felix Hugo Jonas Leo Lucas Martin Max Oscar Otto Paul Peter Simon Theo Victor".split(),
    ("given", "f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья".split(),
    ("given", "m", "cyrillic"): "Антон Борис Виктор Денис Егор Иван Максим Олег Павел Роман".split(),
    ("family", "", "latin"): "Adler Baker Bauer Berg Brandt Carter Dumont Fischer Garcia Garnier Hansen Keller Lambert Lopez Marsh Meyer Moreau Navarro Novak Palmer Romero Vogel Walker Weber".split(),
    ("family", "", "cyrillic"): "Орлов Соколов Лебедев Козлов Новиков Морозов Волков Зайцев Павлов Белов".split(),
}
#: More given names by gender, that are found but not given out.
KNOWN = {
    "f": "Agnes Amelia Andrea Angela Anita Barbara Beatrice Birgit Brigitte Camille Carmen Caroline Catherine Charlotte Christine Claudia Deborah Dolores Dorothy Elizabeth Françoise Gertrud Gisela Hannah Heike Helga Ingrid Isabel Isabelle Jennifer Jessica Johanna Juliette Karen Karin Katharina Linda Lucía Margaret Margarita Marie Mary Mónica Monika Nancy Natalia Nathalie Olivia Patricia Petra Pilar Rebecca Renate Sabine Sandra Sarah Silvia Susan Susanne Teresa Ursula Valérie Virginia Yvonne".split(),
    "m": "Alejandro Alfonso Andreas Andrew Anthony Antoine Benjamin Bernard Bernd Charles Christopher Diego Dieter Dominique Edward Enrique Étienne Fernando Francisco François Frank Franz Frédéric George Gérard Guillaume Günter Hans Heinrich Helmut Henri Henry Hermann Ignacio Jacques James Javier Jean John Jonathan Jorge José Joseph Juan Jürgen Kenneth Klaus Laurent Lorenzo Louis Luis Manuel Marcel Matthew Matthias Michael Michel Miguel Nicolas Patrick Philippe Pierre Rafael Rainer Richard Robert Rodrigo Samuel Stefan Steven Thomas Uwe William Wolfgang".split(),
}
#: Given names that tell a person without a title, if another name follows; and phrases behind which a name stands.
GIVEN = "|".join([*(n for (kind, _, _), names in NAMES.items() if kind == "given" for n in names), *KNOWN["f"], *KNOWN["m"]])
NAMED = r"(?<=(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es) )"
_MORE = r"(?:[ -]\p{Lu}\p{Ll}++)"

#: What the keys of well-known vendors begin with, those of signed tokens among them.
VENDORS = "eyJ|gh[pousr]_|github_pat_|glpat-|xox[abpr]-|sk-|sk_live_|AIza|SG\\."
#: Words before a number that make it a telephone's, whatever its format.
CALLED = r"(?<![\p{L}\p{N}])(?i:tel|phone|telephone|telefon|teléfono|téléphone|mobile|mobil|móvil|handy|cell|fax|whatsapp|call(?: me| us)?(?: at| on)?|reach (?:me|us) (?:at|on))(?:[.:]{1,2}|(?i: number:?| no\.?:?))? {0,2}"

#: Types and their patterns, in order of precedence. None has a capturing group, and none repeats a group without a
#: bound: the matcher recurses for each repetition of a group, so a long text would overflow its stack.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-][\p{L}\p{N}_.-]*\.\p{L}{2,24}(?![\p{L}\p{N}_-])"),
    ("secret", r"(?<![\w])(?i:password|passwd|pwd|secret|api_key)" + _IS + r"(?:\"[^\"'\r\n]{6,}+\"|'[^\"'\r\n]{6,}+'|[\"']?[^\s#*$%&|<>!\"',;]{6,}+)"),
    ("token", r"(?<![\w])(?i:token|key)" + _IS + r"[\"'][0-9A-Za-z_\-+/=.]{16,}+[\"']"),
    ("vendor_key", r"(?<![\w-])(?:" + VENDORS + r")[0-9A-Za-z_-]{16,}+(?:\.[0-9A-Za-z_-]++){0,4}(?![\w])"),
    ("passport", r"(?<![\w])(?i:passport|passeport|pasaporte|reisepass)(?i: number| no\.?| nr\.?|nummer)?:? [A-Z]{0,3}\d[A-Z0-9]{5,8}(?![\w-])"),
    ("cloud_key", r"(?<![\w])(?i:AKIA|ASIA)[0-9A-Za-z]{16}(?![\w])"),
    ("iban", r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
    ("phone", r"(?<![\w+])\+\d{1,3}" + _N + r"[ .-]?(?:\(0\) ?)?\(?\d{2,4}\)?" + _N + r"(?:[ .-]?\d{2,4}" + _N + r"){1,3}(?<![#*$%&|<>!])(?!\d)|(?<![\w+])\(\d{3}\)" + _N + r"[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w-])|" + CALLED + r"\(?\d(?:[ ()/.-]{0,2}\d){6,14}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w])(?:SSN|[Ss]ocial [Ss]ecurity(?: [Nn]umber| [Nn]o\.?)?)[:#]? ?\d{3} ?\d{2} ?\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w)"),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,40}[0-9A-Fa-f]{3})(?=[0-9A-Fa-f:]{0,40}[0-9])(?=[0-9A-Fa-f:]{0,40}::)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])"),
    ("person", r"(?<!\p{L})(?=[\p{Lu}гдп])(?:(?:(?:" + TITLES + r")\.? ){1,4}+\p{Lu}\p{Ll}++" + _MORE + r"{0,3}|(?:" + GIVEN + ")" + _MORE + r"{1,3}|" + NAMED + r"\p{Lu}\p{Ll}++" + _MORE + r"{0,3})(?!\p{L})"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text without any of these has no entity; far cheaper than the patterns, it spares most texts from them.
GATE = r"[0-9@=:]|(?i:AKIA|ASIA)|" + VENDORS + r"|(?<!\p{L})(?=[\p{Lu}гдп])(?:(?:" + TITLES + r")\.? |(?:" + GIVEN + r")[ -]\p{Lu}|" + NAMED + r"\p{Lu})"
FEMALE_TITLES = r"(?:^|[ .])(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Doctora|Profesora|госпожа)\.? "
MALE_TITLES = r"(?:^|[ .])(?:Mr|Sir|Herr|Monsieur|Señor|Sr|Profesor|господин)\.? "
TITLE = r"^(?:(?:" + TITLES + r")\.? ){1,4}"
CARD, IBAN = (dict(PATTERNS)[k] for k in ("card", "iban"))
#: The first digits and lengths that card issuers have.
ISSUERS = r"\A(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11,16}|(?:6011|6[45]\d\d|62\d\d|35\d\d)\d{12,15})\z"

#: Parts of made-up names, for when a list is used up.
SYLLABLES = {"latin": "ba be bo da de do ka ke ko la le lo ma me mo na".split(), "cyrillic": "ба бо ва во да до ка ко ла ло ма мо на но ра ро".split()}
MAX_ATTEMPTS = 24
#: Characters of a value that are permuted within their classes.
LONG = 256
#: Characters of the rest that one key moves.
BLOCK = 60


def kind_of(mention: Column) -> Column:
    """The first type whose pattern is the whole mention."""
    out = F.lit(PATTERNS[-1][0])
    for name, pattern in reversed(PATTERNS):
        out = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def letters_of(c: Column) -> Column:
    """The value of a secret without its name, or the parts that are kept for identity of other types."""
    return F.regexp_replace(c, r"^\w+" + _IS + r"|[\"']", "")


def identity(kind: Column, mention: Column) -> Column:
    """What makes two mentions the same entity: case of an email, and separators of numbers, do not count."""
    value = F.when(kind.isin("secret", "token"), letters_of(mention)).when(kind == "passport", F.regexp_extract(mention, r"[A-Z0-9]+\z", 0))
    country = F.regexp_extract(mention, r"^\+(\d{1,3})(?!\d)", 1)
    abroad = F.concat(country, F.lit("-"), F.regexp_replace(F.substring(mention, F.length(country) + 2, F.length(mention)), r"\D", ""))
    value = value.when((kind == "phone") & (country != ""), abroad).when(kind.isin("phone", "ssn", "card"), F.regexp_replace(mention, r"\D", ""))
    value = value.when(kind.isin("email", "ipv6"), F.lower(mention)).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
    return value.when(kind == "cloud_key", F.upper(mention)).otherwise(mention)


def script_of(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def titled(found: Column) -> Column:
    """The mentions of persons among all of a text: those with a title, a known given name or a phrase before them."""
    return F.filter(found, lambda m: kind_of(m) == "person")


def pattern_with_names(titled: Column) -> Column:
    """ANY, and behind it the full and the family names of a text's titled persons, for where they stand alone."""
    full = F.transform(titled, lambda m: F.regexp_replace(m, TITLE, ""))
    names = F.reverse(F.array_sort(F.array_distinct(F.concat(full, F.transform(full, lambda m: F.substring_index(m, " ", -1))))))
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_])(?=\p{Lu})(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}_])"))


def is_female(mention: Column, told: Column) -> Column:
    """By the mention's own title; without one that tells, by `told` (another title of the name in the text) or a known
    given name."""
    name = F.regexp_replace(mention, TITLE, "")
    known = F.substring_index(F.substring_index(name, " ", 1), "-", 1).isin(*NAMES["given", "f", "latin"], *NAMES["given", "f", "cyrillic"], *KNOWN["f"])
    return F.when(mention.rlike(FEMALE_TITLES), F.lit(True)).when(mention.rlike(MALE_TITLES), F.lit(False)).otherwise(told | known)


def parts_of(kind: Column, mention: Column, female: Column) -> Column:
    """array<struct<kind, gender, value>>: one part, or for persons one for each name, the last being the family's."""
    single = F.array(F.struct(kind.alias("kind"), F.lit("").alias("gender"), identity(kind, mention).alias("value")))
    names = F.split(F.regexp_replace(mention, TITLE, ""), "[ -]")
    gender = F.when(female, F.lit("f")).otherwise(F.lit("m"))
    named = F.transform(names, lambda x, i: F.struct(F.when(i == F.size(names) - 1, F.lit("family")).otherwise(F.lit("given")).alias("kind"), F.when(i == F.size(names) - 1, F.lit("")).otherwise(gender).alias("gender"), x.alias("value")))
    return F.when(kind == "person", named).otherwise(single)


def keystream(key: str, *parts: Column) -> Column:
    """128 hex digits that only the key's owner can foretell."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts), F.lit(key)), 512)


def byte_at(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 % 126 + 1, F.lit(2)), 16, 10).cast("int")


def shifted(text: Column, stream: Column, hexed: Column) -> Column:
    """text with every digit and ASCII letter moved within its own class (a-f within itself if hexed)."""

    def move(c: Column, i: Column) -> Column:
        by, code = byte_at(stream, i), F.ascii(c)
        out = c
        for lo, n, when in (("0", 10, F.lit(True)), ("A", 26, F.lit(True)), ("a", 26, ~hexed), ("a", 6, hexed)):
            inside = (code >= ord(lo)) & (code < ord(lo) + n) & when
            out = F.when(inside, F.char(F.lit(ord(lo)) + F.pmod(code - ord(lo) + by, F.lit(n)))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permute(df: DataFrame, column: str, key: str, label: Column, attempt: int) -> DataFrame:
    """df with `column` under a keyed permutation of the texts of one format: three Feistel rounds between a text's
    halves, each a projection of its own. Different texts of one alphabet never get the same result."""
    text = F.col(column)
    half = (F.length(text) / 2).cast("int")
    df = df.withColumns({"hexed_": text.rlike("^[0-9a-f:]+$"), "salt_": F.concat_ws("|", label, F.length(text), F.lit(attempt)), "l_": F.substring(text, F.lit(1), half), "r_": F.substring(text, half + 1, F.length(text))})
    for n, (moved, other) in enumerate((("r_", "l_"), ("l_", "r_"), ("r_", "l_"))):
        df = df.withColumn("k_", keystream(key, F.lit(n), F.col(other), F.col("salt_"))).withColumn(moved, shifted(F.col(moved), F.col("k_"), F.col("hexed_")))
    return df.withColumn(column, F.concat("l_", "r_")).drop("hexed_", "salt_", "l_", "r_", "k_")


def luhn(digits: Column) -> Column:
    """The check digit that Luhn's rule puts behind the digits."""
    n = F.length(digits)
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, F.when(c > "4", c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)).otherwise(c.try_cast("int")))
    return F.pmod(F.lit(0) - F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10))


def mod_97(text: Column) -> Column:
    """The remainder by 97 of a text's digits and letters as a number, A being 10."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def is_entity(mention: Column) -> Column:
    """Whether what a pattern found is one: a card's number has an issuer and Luhn's check digit, an IBAN its remainder
    of 1; other numbers of that length stay as they are."""
    digits, packed = F.regexp_replace(mention, "[ -]", ""), F.replace(mention, F.lit(" "), F.lit(""))
    n = F.length(digits)
    card = digits.rlike(ISSUERS) & (luhn(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)).try_cast("int"))
    iban = mod_97(F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))) == 1
    return F.coalesce(F.when(mention.rlike(rf"\A(?:{CARD})\z"), card).when(mention.rlike(rf"\A(?:{IBAN})\z"), iban).otherwise(F.lit(True)), F.lit(False))


def candidates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities (kind, gender, value) with the surrogate that each would have at the given attempt."""
    kind, value, n = F.col("kind"), F.col("value"), F.length("value")
    domain = F.substring_index(value, "@", -1)
    safe = F.regexp_extract(domain, r"(?:^|\.)example\.(?:com|net|org)$", 0)
    outer = F.when(safe != "", F.substring(domain, F.lit(1), F.length(domain) - F.length(safe))).otherwise(domain)
    # What is permuted: all but a card's check digit, the two sides of an email, all but the type of a cloud key, the
    # country of a phone number, and country and check digits of an IBAN.
    brand = F.regexp_extract(value, f"^(?:{VENDORS})", 0)
    main = F.when(kind == "vendor_key", F.substring(value, F.length(brand) + 1, n)).when(kind == "card", F.substring(value, F.lit(1), n - 1)).when(kind == "email", F.substring_index(value, "@", 1)).when(kind.isin("cloud_key", "iban"), F.substring(value, F.lit(5), n)).when(kind == "phone", F.substring_index(value, "-", -1))
    df = entities.withColumns({"main": F.when(~kind.isin("ip", "given", "family"), main.otherwise(value)).otherwise(F.lit("")), "host": F.when(kind == "email", outer).otherwise(F.lit("")), "safe": safe})
    df = df.withColumn("body", F.col("main"))
    # Of a very long value the beginning is permuted; the rest is moved within its classes block by block, by keys that
    # the whole value decides. Its collisions show like any other's.
    def rest(c: str) -> Column:
        whole = keystream(key, F.lit(c), kind, value, F.lit(attempt))
        blocks = F.regexp_extract_all(F.substring(c, F.lit(LONG + 1), F.length(c)), F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
        block = lambda k, b, i: shifted(b, keystream(key, k, i), F.lit(False))
        moved = F.transform(F.array(whole), lambda k: F.array_join(F.transform(blocks, lambda b, i: block(k, b, i)), ""))  # whole is hashed once
        return F.when(F.length(c) > LONG, moved[0]).otherwise(F.lit(""))

    df = df.withColumns({"main_rest": rest("main"), "host_rest": rest("host")})
    df = df.withColumns({"main": F.substring("main", 1, LONG), "host": F.substring("host", 1, LONG)})
    df = permute(permute(df, "main", key, kind, attempt), "host", key, F.lit("host"), attempt)
    df = df.withColumns({"main": F.concat("main", "main_rest"), "host": F.concat("host", "host_rest")})

    # A card number stays as valid under Luhn's rule, or as far from valid, as it was.
    last = F.pmod(F.substring(value, n, F.lit(1)).try_cast("int") - luhn(F.col("body")) + luhn(F.col("main")), F.lit(10))
    df = df.withColumn("last", F.when(kind == "card", last).cast("string"))

    df = df.withColumn("ip", F.when(kind == "ip", F.transform(F.split(value, r"\."), lambda o: o.try_cast("int"))))
    for r in range(3):
        at = lambda i: F.get("ip", F.lit(i))
        df = df.withColumn("k", keystream(key, F.lit("ip"), F.lit(attempt), F.lit(r), at(0), at(1)))
        df = df.withColumn("ip", F.when(kind == "ip", F.array((at(2) + byte_at(F.col("k"), F.lit(0))) % 256, (at(3) + byte_at(F.col("k"), F.lit(1))) % 256, at(0), at(1))))

    df = df.withColumns({"script": script_of(value), "k": keystream(key, kind, F.col("gender"), value, F.lit(attempt))})
    name = F.lit(None).cast("string")
    if attempt == 0:
        for (k, g, s), names in NAMES.items():
            pool = F.array(*map(F.lit, names))
            name = F.when((kind == k) & (F.col("gender") == g) & (F.col("script") == s), F.element_at(pool, byte_at(F.col("k"), F.lit(0)) % len(names) + 1)).otherwise(name)
    else:
        for s, syllables in SYLLABLES.items():
            pool = F.array(*map(F.lit, syllables))
            word = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(attempt + 1)), lambda i: F.element_at(pool, byte_at(F.col("k"), i) % len(syllables) + 1)), "")
            name = F.when(F.col("script") == s, F.initcap(word)).otherwise(name)

    out = F.when(kind == "card", F.concat("main", "last")).when(kind == "ip", F.array_join(F.transform("ip", lambda o: o.cast("string")), "."))
    out = out.when(kind == "email", F.concat("main", F.lit("@"), "host", F.when(F.col("safe") != "", F.col("safe")).otherwise(F.lit(".invalid"))))
    out = out.when((kind == "phone") & value.contains("-"), F.concat(F.substring_index(value, "-", 1), F.lit("-"), F.col("main")))
    out = out.when(kind == "vendor_key", F.concat(brand, "main"))
    out = out.when(kind.isin("given", "family"), name).when(kind == "cloud_key", F.concat(F.substring(value, 1, 4), "main"))
    check = F.lpad((F.lit(98) - mod_97(F.concat("main", F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    out = out.when(kind == "iban", F.concat(F.substring(value, 1, 2), check, "main"))
    return df.select("kind", "gender", "value", out.otherwise(F.col("main")).alias("surrogate"))


def wider(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities with surrogates of a wider format than their own, for those whose format has none left: 32 hex digits
    in place of a secret, before a reserved domain, or behind a cloud key's type; 20 more digits; an address of the
    documentation's IPv6 range; a name of 16 syllables."""
    kind, value = F.col("kind"), F.col("value")
    k = keystream(key, F.lit("wider"), kind, F.col("gender"), value, F.lit(attempt))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (byte_at(k, i) % 10).cast("string")), "")
    out = F.when(kind == "email", F.concat(F.substring(k, 1, 32), F.lit("@example.org"))).when(kind == "cloud_key", F.concat(F.substring(value, 1, 4), F.upper(F.substring(k, 1, 32))))
    out = out.when(kind == "ip", F.concat_ws(":", F.lit("2001:db8"), *(F.substring(k, n, 4) for n in range(1, 25, 4))))
    for s, syllables in SYLLABLES.items():
        pool = F.array(*map(F.lit, syllables))
        word = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.element_at(pool, byte_at(k, i) % len(syllables) + 1)), "")
        out = out.when(kind.isin("given", "family") & (script_of(value) == s), F.initcap(word))
    # Numbers are drawn anew as a whole: digits of the own format, then 20 more.
    fresh = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), (byte_at(k, i + 20) % 10).cast("string")).otherwise(c)), "")
    number = F.when(kind.isin("phone") & value.contains("-"), F.concat(F.substring_index(value, "-", 1), F.lit("-"), F.substring_index(fresh, "-", -1), digits)).otherwise(F.concat(fresh, digits))
    out = out.when(kind == "ipv6", F.concat_ws(":", F.lit("2001:db8"), *(F.substring(k, n, 4) for n in range(1, 25, 4))))
    out = out.when(kind.isin("phone", "ssn", "card", "iban", "passport"), number)
    return entities.select("kind", "gender", "value", out.otherwise(F.substring(k, 1, 32)).alias("surrogate"))


def assign(entities: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """entities (kind, gender, value), distinct -> with surrogate; no two of a kind share one, and none is the value
    of an entity of the corpus.

    Each round proposes a surrogate to those that have none yet. Of those with one proposal the least value gets it,
    unless it has been given before, is a real value, or is an address from no public range in place of one from
    there; the others try again. Names come from lists first, then from more and more syllables. What has none after
    `max_attempts`, or holds no letter or digit that could be moved, gets one of a wider format.
    """
    fixed = F.col("kind").isin("secret", "token", "email") & (~F.col("value").rlike("[0-9A-Za-z]") | F.col("value").rlike(r"[^\x00-\x7F]"))
    todo = cut(entities)
    real = todo.select("kind", F.lower("value").alias("taken")).distinct()
    done = todo.limit(0).withColumn("surrogate", F.lit(""))
    for attempt in range(max_attempts + 8):
        drawn = wider(todo, key, attempt) if attempt >= max_attempts else candidates(todo.where(~fixed), key, attempt).union(wider(todo.where(fixed), key, attempt))
        tried = drawn.withColumn("taken", F.lower("surrogate")).persist()  # made anew if an executor is lost
        first = tried.groupBy("kind", "taken").agg(F.min(F.struct("value", "gender")).alias("winner"))
        public = (F.col("kind") == "ip") & F.substring_index("value", ".", 1).try_cast("int").between(1, 223) & ~F.substring_index("surrogate", ".", 1).try_cast("int").between(1, 223)
        given = done.select("kind", F.lower("surrogate").alias("taken")).union(real).distinct()
        fits = tried.join(first, ["kind", "taken"]).where((F.col("winner") == F.struct("value", "gender")) & ~public).join(given, ["kind", "taken"], "left_anti")
        done = cut(done.union(fits.select("kind", "gender", "value", "surrogate")))
        tried.unpersist()
        todo = cut(todo.join(done, ["kind", "gender", "value"], "left_anti"))
        if todo.isEmpty():
            return done
    raise RuntimeError("wider formats of 16 syllables, 20 digits or more were all taken")


def redrawn(mention: Column, value: Column, surrogate: Column, wanted: str) -> Column:
    """mention with its characters of the class `wanted` replaced by the surrogate's, in order."""
    drawn = F.regexp_replace(surrogate, f"[^{wanted}]", "")
    left = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), f"[^{wanted}]", ""))
    inside = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike(f"[{wanted}]"), F.substring(drawn, left(i), F.lit(1))).otherwise(c)), "")
    return F.concat(inside, F.substring(drawn, left(F.length(mention) - 1) + 1, F.length(drawn)))  # what a wider surrogate has more


def rendered(kind: Column, mention: Column, surrogates: Column) -> Column:
    """The replacement of a mention in the mention's own format; surrogates: array<struct<value, surrogate>>."""
    s, value = surrogates[0]["surrogate"], surrogates[0]["value"]
    upper = mention == F.upper(mention)
    email = F.when(upper, F.upper(s)).otherwise(s)
    person = F.concat(F.regexp_extract(mention, TITLE, 0), F.array_join(F.transform(surrogates, lambda x: x["surrogate"]), " "))
    cloud = F.when(upper, s).otherwise(F.lower(s))
    out = F.when(kind.isin("phone", "ssn", "card"), redrawn(mention, value, s, "0-9")).when(kind == "iban", redrawn(mention, value, s, "0-9A-Z"))
    end = F.regexp_extract(mention, r"[\"']?\z", 0)  # the value stands before it; the same word may be the secret's name
    head = F.substring(mention, F.lit(1), F.length(mention) - F.length(value) - F.length(end))
    out = out.when(kind.isin("secret", "token", "passport"), F.concat(head, s, end)).when(kind == "email", email).when(kind == "cloud_key", cloud)
    return out.when(kind == "person", person).otherwise(s)


def matches(texts: DataFrame) -> DataFrame:
    """texts (h, found array<string>) -> h, pos, mention, type, name, stored: a row for each match. type is null if it
    is no entity; name is a person's without titles."""
    each = texts.select("h", F.posexplode("found").alias("pos", "mention"))
    each = each.withColumn("type", F.when(is_entity(F.col("mention")), kind_of(F.col("mention"))))
    return cut(each.withColumn("name", F.when(F.col("type") == "person", F.regexp_replace("mention", TITLE, ""))))


def mentions(each: DataFrame) -> DataFrame:
    """The entities of matches() -> h, pos, mention, type, part, kind, gender, value: a row for each part. What a text's
    titles tell of its names meets these by a join, so a text of any number of names is a row for each."""
    women = each.where(F.col("name").isNotNull() & F.col("mention").rlike(FEMALE_TITLES))
    women = women.select("h", F.explode(F.array("name", F.substring_index("name", " ", -1))).alias("name")).distinct().withColumn("told", F.lit(True))
    each = each.where("type is not null").join(women, ["h", "name"], "left")
    female = is_female(F.col("mention"), F.coalesce("told", F.lit(False)))
    parts = each.select("h", "pos", "mention", "type", F.posexplode(parts_of(F.col("type"), F.col("mention"), female)).alias("part", "p"))
    return parts.select("h", "pos", "mention", "type", "part", "p.kind", "p.gender", "p.value")


def texts_with_entities(docs: DataFrame, text: str) -> DataFrame:
    """(h, pattern, found) of every different text with an entity, stored: its hash, the pattern whose matches are
    replaced, and these. Each text is searched once (an exploded array keeps Spark from searching again for a filter);
    those that name a person are read again for the bare names."""
    body = F.col(text).cast("string")
    searched = F.filter(F.array(F.regexp_extract_all("body", F.lit(ANY), F.lit(0))), lambda f: F.exists(f, is_entity))
    hits = docs.select(body.alias("body")).where(F.col("body").rlike(GATE)).select("body", F.explode(searched).alias("found"))
    told = hits.select("body", "found", titled(F.col("found")).alias("who"))
    named = F.size("who") > 0
    told = told.select("body", "found", "who", F.when(named, pattern_with_names(F.col("who"))).otherwise(F.lit(ANY)).alias("pattern"))
    again = F.when(named, F.regexp_extract_all("body", F.col("pattern"), F.lit(0))).otherwise(F.col("found"))
    return cut(told.select(F.sha2("body", 256).alias("h"), F.when(named, F.col("pattern")).alias("pattern"), again.alias("found")).dropDuplicates(["h"]))


def replacements(texts: DataFrame, key: str) -> DataFrame:
    """texts of texts_with_entities() -> (h, pattern, news, n), stored: what each match becomes, and how many of them
    are entities. Entities that very many texts have are broadcast, so none of them meets in one task."""
    found = matches(texts)
    parts = cut(mentions(found))
    entity = ["kind", "gender", "value"]
    counts = cut(parts.groupBy(*entity).agg(F.count("*").alias("n")))
    named = cut(assign(counts.select(*entity), key).join(counts, entity))
    each = join_counted(parts, named, entity, size=F.octet_length("value") + F.octet_length("surrogate")).groupBy("h", "pos", "mention", "type").agg(F.array_sort(F.collect_list(F.struct("part", "value", "surrogate"))).alias("s"))
    drawn = each.select("h", "pos", rendered(F.col("type"), F.col("mention"), F.col("s")).alias("new"), F.lit(1).alias("ok"))
    same = found.where("type is null").select("h", "pos", F.col("mention").alias("new"), F.lit(0).alias("ok"))
    news = drawn.union(same).groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"), F.sum("ok").alias("n"))
    return cut(texts.join(news, "h").select("h", "pattern", "news", "n"))


#: Replacements measured to be at most so many bytes are broadcast.
MOST_BROADCAST = 8 << 20


#: The setting that holds the key.
KEY_SETTING = "spark.quire.pii.key"


def key_of(spark: SparkSession, key: str | None) -> str:
    """The key given, else the one in the setting; there is no default, for whoever knows the key can undo surrogates."""
    found = key or spark.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"surrogates need a secret key: give one, or set {KEY_SETTING}")
    return found


def replace_pii(docs: DataFrame, key: str | None = None, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the entities in `text` replaced, all other columns as they were; `count` names a column to be added
    with the number of replaced mentions. Without a key the setting KEY_SETTING is taken; one of them must be there.

    Equal entities have equal surrogates in all texts (the key decides which), different ones different surrogates.
    Texts without an entity, empty ones and nulls stay as they are. What replaces what depends on the text alone, so
    texts that occur often are worked on once; repeated rows stay repeated, an empty table stays empty.

    What becomes of a text's matches is told by its hash. A table of replacements that is measured to be small is
    broadcast and the texts are rewritten where they are read; beyond that the texts that a pattern finds something in
    are shuffled by their hash, and no others.
    """
    news = replacements(texts_with_entities(docs, text), key_of(docs.sparkSession, key))
    size = news.agg(F.coalesce(F.sum(F.lit(96) + F.coalesce(F.length("pattern"), F.lit(0)) + F.length(F.array_join("news", "        "))), F.lit(0)).alias("bytes")).first().bytes
    body = F.col("row")[text].cast("string")
    rows = docs.select(F.struct("*").alias("row")).withColumn("h", F.sha2(body, 256))
    if size <= MOST_BROADCAST:
        out = rows.join(F.broadcast(news), "h", "left")
    else:
        some = F.coalesce(body.rlike(GATE) & body.rlike(ANY), F.lit(False))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in news.schema.fields[1:]]
        out = rows.where(some).join(news, "h", "left").select("row", *news.columns[1:]).union(rows.where(~some).select("row", *none))
    between = F.split(body, F.coalesce("pattern", F.lit(ANY)), -1)
    woven = F.array_join(F.zip_with(between, "news", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.when(F.col("n").isNotNull(), woven).otherwise(body)
    kept = [changed.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*kept, *([F.coalesce("n", F.lit(0)).cast("long").alias(count)] if count else []))
