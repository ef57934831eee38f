"""Personal data replaced by keyed surrogates. DataFrame functions only.

Found are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment card and bank account numbers (IBAN), social
security numbers, access keys by their public prefixes and signed tokens, values of passwords and tokens, and names
(known given names, and the surname after one, after a title or after initials, hyphens and particles included). Each distinct
entity, in its canonical form, gets one surrogate for the whole corpus: other spellings of it (another layout of the
same number, another case of the same address) get the same one, so that coreference survives. A surrogate has the
type's form: digits for digits, letters for letters, an area code that can be one, a card number with a valid check
digit where the original's is valid, a given name of the same gender and script, a surname of the same script and
gender ending.

Surrogates come from a keyed hash. A candidate is refused if it is a real entity of its type anywhere in the corpus or
another's surrogate; who is refused draws again, so distinct entities stay distinct. Each further draw makes mailboxes,
secrets and surnames longer, and from draw WIDE on all other types take forms of over 100 bits, so that there is always
a surrogate left however crowded a form is. Given names map one to one onto a
list that shares no name with the known ones.

Edge cases: null and empty texts pass unchanged; rows with the same id and text count as one document and get the same
result; an empty table gives no rows. Other columns are ignored, whatever their names. A secret's value has eight
characters at least and runs on, however long, to a space or a quote; without a closing quote, the punctuation of a
sentence at its end is not part of it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KEY = "melisma"
WIDE = 12

#: Known given names, by gender and script.
GIVEN = {
    "given_f_latin": "Anna Maria Emma Laura Sofia Julia Elena Marta Alice Claire Lucia Carmen Helga Ingrid Susan Linda".split(),
    "given_m_latin": "John Peter Paul Thomas Michael David Robert James Carlos Pedro Hans Klaus Pierre Louis Andrew Martin".split(),
    "given_f_cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "given_m_cyrillic": "Иван Пётр Сергей Алексей Дмитрий Михаил Николай Андрей".split(),
}
#: Surrogates of given names; each list is as long as the known one and shares no name with any.
STAND_IN = {
    "given_f_latin": "Beatrix Cordelia Daphne Eloise Fiona Gwendolyn Harriet Imogen Jocelyn Katrin Leonora Mirabel Noemi Ophelia Paloma Rosalind".split(),
    "given_m_latin": "Alaric Barnaby Cedric Desmond Edgar Fergus Gideon Horace Ignatius Jasper Kendrick Leopold Mortimer Nigel Oswald Percival".split(),
    "given_f_cyrillic": "Аглая Варвара Дарина Злата Клавдия Лидия Майя Римма".split(),
    "given_m_cyrillic": "Богдан Вадим Герман Захар Игнат Лаврентий Мирон Ярослав".split(),
}
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora"
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_SYLLABLES = {
    "latin": "bar cor dal fen gar hol kel lin mor nor pel quin ros sal tor ul ver wes yar zan".split(),
    "cyrillic": "бар вел гор дан жар зел кор лом мир нов пол ров сев тар ум фед хол чер шал юр".split(),
}
_LETTERS = r"(?:\p{IsLatin}{2,24}|\p{IsCyrillic}{2,24})"
_PARTICLE = r"(?:von|van|de|del|della|di|la|le|der|den|ter|zu) "
_SURNAME = rf"(?:(?:{_PARTICLE}){{0,2}}(?=\p{{Lu}})(?:[OD]['’](?=\p{{Lu}}))?{_LETTERS}(?:-(?=\p{{Lu}}){_LETTERS})?)"
#: Public prefixes of access keys and signed tokens.
_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|sk_test_|eyJ)"
_ACCESS = r"(?:A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36,255}|xox[abprs]-[0-9A-Za-z-]{10,255}|sk_(?:live|test)_[0-9A-Za-z]{16,255}|eyJ[\w-]{8,}(?:\.[\w-]{8,}){1,2})"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?"
_IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
_EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z]{2,18}"
_CARD = r"(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})"
_QUOTE = r"\x22\x27\x60“”‘’"
_SPACE = r"\p{Z}\x09-\x0D"
_SECRET = rf"(?<=(?i:password|passwd|token|secret|api_key)\s{{0,2}}[=:]\s{{0,2}}[{_QUOTE}]?)(?=[^{_SPACE}{_QUOTE}]{{0,7}}[\p{{L}}\p{{N}}])(?:[^{_SPACE}{_QUOTE}]{{8,}}(?=[{_QUOTE}])|[^{_SPACE}{_QUOTE}]{{7,}}[^{_SPACE}{_QUOTE}.,;:?)\]}}>])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: One pattern finds every entity, from a place where no word is open.
PATTERN = (
    r"(?<![\p{L}\p{N}_%+])(?:"
    rf"{_SECRET}"
    rf"|{_EMAIL}"
    rf"|{_ACCESS}"
    rf"|{_IBAN}(?![\p{{L}}\p{{N}}])"
    rf"|(?:{_IPV6})(?![\p{{L}}\p{{N}}:])"
    rf"|{_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
    rf"|{_CARD}(?!\d)"
    r"|\d{3}-\d{2}-\d{4}(?!\d)"
    r"|(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    rf"|(?:{_NAMES})(?![\p{{L}}\p{{N}}])"
    rf"|(?=\p{{Lu}}|{_PARTICLE})(?<=(?:{_TITLES})\.? (?:\p{{Lu}}\. ){{0,2}}){_SURNAME}(?![\p{{L}}\p{{N}}])"
    rf"|(?=\p{{Lu}}|{_PARTICLE})(?<=(?:{_NAMES}) (?:\p{{Lu}}\. ){{0,2}}){_SURNAME}(?![\p{{L}}\p{{N}}])"
    r")"
)


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9]", "")


def kind(raw: Column) -> Column:
    out = F.when(raw.rlike(rf"^{_EMAIL}$"), "email").when(raw.rlike(rf"^{_ACCESS}$"), "key").when(raw.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
    out = out.when(raw.rlike(rf"^{_IBAN}$"), "iban").when(raw.rlike(rf"^(?:{_IPV6})$"), "ipv6")
    out = out.when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(raw.rlike(rf"^{_CARD}$"), "card").when(raw.rlike(r"^[+(\d][\d .()-]+$") & (raw.rlike(r"[ .()-]") | raw.startswith("+")), "phone")
    for k, names in GIVEN.items():
        out = out.when(raw.isin(names), k)
    out = out.when(raw.rlike(r"^\p{Lu}[\p{IsCyrillic}-]*(?:ова|ева|ина|ая)$"), "surname_f_cyrillic").when(raw.rlike(r"^(?=\p{Lu})[\p{IsCyrillic}-]+$"), "surname_m_cyrillic")
    return out.when(raw.rlike(rf"^{_SURNAME}$"), "surname_latin").otherwise("secret")


def canonical(raw: Column, what: Column) -> Column:
    """One form for all spellings of an entity."""
    d = _digits(raw)
    phone = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    out = F.when(what == "email", F.lower(raw)).when(what == "phone", phone).when(what.isin("card", "ssn"), d)
    return out.when(what == "iban", F.replace(raw, F.lit(" "))).when(what == "ipv6", F.lower(raw)).otherwise(raw)


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _number(hexes: Column, i: Column, most: int) -> Column:
    """The i-th number (from 0) of a hash, below most."""
    return F.conv(F.substring(hexes, (i * 2 % 126 + 1).cast("int"), 2), 16, 10).cast("int") % most


def _like(text: Column, hexes: Column) -> Column:
    """A text of the same form: digits for digits, capitals for capitals, small letters for small ones."""
    letters = F.when(text.rlike(r"^[0-9a-f]+$"), 6).otherwise(26)

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(hexes, (i * 2 % 126 + 1).cast("int"), 2), 16, 10).cast("int")
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), F.char(n % letters + 97)).when(c.rlike("[A-Z]"), F.char(n % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hidden(text: Column, hexes: Column) -> Column:
    """As _like, for secrets: letters of other scripts become small ones; so do all marks where there is little else."""
    few = F.length(F.regexp_replace(text, r"[^0-9A-Za-z]", "")) < 8
    return _like(F.when(few, F.regexp_replace(text, r"[^0-9A-Za-z]", "z")).otherwise(F.regexp_replace(text, r"[^\x21-\x7E]", "z")), hexes)


def _luhn(digits: Column, odd: int) -> Column:
    """The Luhn sum; odd: whether the last digit is doubled."""
    n = lambda c, i: c.cast("int") * F.when((i + odd) % 2 == 1, 2).otherwise(1)
    parts = F.transform(F.split(F.reverse(digits), ""), n)
    return F.aggregate(parts, F.lit(0), lambda t, x: t + F.when(x > 9, x - 9).otherwise(x))


def _rest97(text: Column) -> Column:
    """A text of digits and capitals modulo 97, a capital as its two-digit number from A = 10."""
    step = lambda t, c: F.when(c.rlike("[0-9]"), (t * 10 + F.ascii(c) - 48) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def candidate(what: Column, canon: Column, draw: Column, key: str) -> Column:
    """The surrogate that the keyed hash gives an entity at a draw, in canonical form."""
    sha = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)

    def by(h: Column) -> Column:
        at = lambda i: F.lit(i)
        like = _like(canon, h)
        more = F.repeat(F.lit("x"), draw.cast("int"))
        domain = F.substring_index(canon, "@", -1)
        host = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
        email = F.concat(_like(F.concat(F.substring_index(canon, "@", 1), more), h), F.lit("@"), _let(sha(F.lit("domain"), domain), lambda d: _like(host, d)), F.lit("."), F.substring_index(domain, ".", -1))
        first = (_number(h, at(50), 8) + 2).cast("string")
        phone = F.when(F.length(canon) == 10, F.concat(first, F.substring(like, 2, 2), (_number(h, at(51), 8) + 2).cast("string"), F.substring(like, 5, 6))).otherwise(F.concat(F.substring(canon, 1, 2), like.substr(F.lit(3), F.length(canon))))
        n = F.length(canon)
        lead = F.when(n == 15, 2).otherwise(1)  # the issuer of cards of 15 digits shows in two
        body = F.concat(canon.substr(F.lit(1), lead), like.substr(lead + 1, n - lead - 1))
        card = F.when(_luhn(canon, 0) % 10 == 0, F.concat(body, _let(body, lambda b: ((10 - _luhn(b, 1) % 10) % 10).cast("string")))).otherwise(F.concat(body, like.substr(n, F.lit(1))))
        ip = F.concat_ws(".", (_number(h, at(0), 200) + 11).cast("string"), *[_number(h, at(i), 254).cast("string") for i in (1, 2)], (_number(h, at(3), 253) + 1).cast("string"))
        ssn = F.concat((_number(h, at(50), 8) + 1).cast("string"), F.substring(like, 2, 8))
        syllable = lambda script, i: F.element_at(F.array(*map(F.lit, _SYLLABLES[script])), _number(h, i, 20) + 1)
        names = lambda script, end: F.concat(F.initcap(syllable(script, F.lit(10))), F.array_join(F.transform(F.sequence(F.lit(11), draw.cast("int") + 13), lambda i: syllable(script, i)), ""), F.lit(end))
        iban = _let(F.concat(F.substring(canon, 1, 2), F.substring(like, 5, 34)), lambda x: F.concat(F.substring(x, 1, 2), F.lpad((98 - _rest97(F.concat(x.substr(F.lit(3), F.length(x)), F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x.substr(F.lit(3), F.length(x))))
        group = lambda i: F.substring(h, i * 4 + 1, 4)
        ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[group(i) for i in range(6)])
        digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (_number(h, i, 250) % 10).cast("string")), "")
        wide = draw >= WIDE
        prefix = F.regexp_extract(canon, f"^({_PREFIX})", 1)
        out = F.when(what == "email", email).when(what.isin("phone", "card", "ssn") & wide, digits).when((what == "ip") & wide, ipv6).when((what == "iban") & wide, F.concat(F.substring(canon, 1, 2), digits))
        out = out.when(what == "phone", phone).when(what == "card", card).when(what == "ip", ip).when(what == "ssn", ssn).when(what == "iban", iban).when(what == "ipv6", ipv6)
        out = out.when(what == "key", F.concat(prefix, like.substr(F.length(prefix) + 1, F.length(canon))))
        return out.when(what == "surname_latin", names("latin", "")).when(what == "surname_f_cyrillic", names("cyrillic", "ова")).when(what == "surname_m_cyrillic", names("cyrillic", "ов")).otherwise(_hidden(F.concat(canon, more), h))

    return _let(sha(what, canon, draw.cast("string")), by)


def given_map(key: str) -> list[tuple[str, str, str]]:
    """(type, name, stand-in): a keyed one-to-one map of the known given names."""
    by = lambda name: hashlib.sha256(f"{key}\x1f{name}".encode()).hexdigest()
    return [(k, a, b) for k in GIVEN for a, b in zip(sorted(GIVEN[k], key=by), sorted(STAND_IN[k], key=by), strict=True)]


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """type, canon -> type, canon, s: distinct surrogates, none of them a real entity of its type."""
    spark = entities.sparkSession
    fixed = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(a).alias("canon"), F.lit(b).alias("s")) for k, a, b in given_map(key)]))
    given = spark.range(1).select(fixed.alias("g")).select("g.*")
    assigned = C.cut(entities.where(F.col("type").startswith("given")).join(F.broadcast(given), ["type", "canon"]))
    open_ = C.cut(entities.where(~F.col("type").startswith("given")))
    real = open_.select("type", F.col("canon").alias("s"))
    draw = 0
    while not open_.isEmpty():
        offered = open_.withColumn("s", candidate(F.col("type"), F.col("canon"), F.lit(draw), key))
        free = offered.join(real, ["type", "s"], "left_anti")
        if draw:
            free = free.join(assigned.select("type", "s"), ["type", "s"], "left_anti")
        won = C.cut(free.groupBy("type", "s").agg(F.min("canon").alias("canon")).select("type", "canon", "s"))
        assigned = assigned.unionByName(won)
        open_ = C.cut(open_.join(won, ["type", "canon"], "left_anti"))
        draw += 1
    return assigned


def render(raw: Column, what: Column, s: Column) -> Column:
    """A surrogate in the layout of the text that it replaces."""
    d = _digits(raw)
    full = F.when((what == "phone") & (F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("1"), s)).otherwise(s)
    # the i-th character of the layout takes the next one of the surrogate; a longer surrogate stands as it is
    shown = F.when(what == "iban", F.replace(raw, F.lit(" "))).otherwise(d)
    slot = lambda c: (what == "iban") & (c != " ") | c.rlike("[0-9]")
    place = lambda i: F.length(F.when(what == "iban", F.replace(F.substring(raw, F.lit(1), i + 1), F.lit(" "))).otherwise(_digits(F.substring(raw, F.lit(1), i + 1))))
    laid = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(slot(c), F.substring(full, place(i), F.lit(1))).otherwise(c)), "")
    laid = F.when(F.length(shown) == F.length(full), laid).otherwise(F.concat(F.when(what == "phone", "+").otherwise(""), full))
    return F.when(what.isin("phone", "card", "ssn", "iban"), laid).when((what == "email") & (F.upper(raw) == raw), F.upper(s)).otherwise(s)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, pos, raw, type, canon: the entities of each document, in order."""
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("pos", "raw"))
    typed = found.dropDuplicates(["doc_id", "mark", "pos"]).withColumn("type", kind(F.col("raw")))
    return typed.withColumn("canon", canonical(F.col("raw"), F.col("type")))


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """doc_id, n_entities, text of each row."""
    found = C.cut(mentions(docs, id_col, text_col))
    chosen = C.cut(surrogates(found.select("type", "canon").distinct(), key))
    name = lambda: F.concat_ws("\x1f", "type", "canon")
    named = C.join_small(found.withColumn("name", name()), chosen.select(name().alias("name"), "s"), "name", "inner")
    new = F.struct("pos", render(F.col("raw"), F.col("type"), F.col("s")).alias("new"))
    ident = lambda d, m: F.concat_ws("/", F.coalesce(d.cast("string"), F.lit("null")), m.cast("string"))
    each = C.cut(named.groupBy("doc_id", "mark").agg(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["new"]).alias("news")).select(ident(F.col("doc_id"), F.col("mark")).alias("ident"), "news"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), ident(F.col(id_col), F.xxhash64(text)).alias("ident"))
    both = C.join_small(rows, each, "ident", salted=False)
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split("text", PATTERN, -1), "news", lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    return both.select("doc_id", F.when(F.col("news").isNull(), 0).otherwise(F.size("news")).cast("long").alias("n_entities"), F.when(F.col("news").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(C.table(spark, sf_dir, "documents"))
