"""Personal data replaced by keyed surrogates.

Entities are found by patterns and by titles before names. Each entity has a
canonical form (case, separators and spacing removed where they carry no
meaning), and its surrogate is a keyed function of kind and canonical form,
drawn again wherever two entities would share a surrogate or one would turn
into another's original. The surface of each mention is kept: lengths,
separators, case and script."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.common import table, whole_row
from treesnap.session import materialize

_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_CALL = r"(?<=(?i:phone|telephone|tel|fax|mobile|cell|call|telefon|téléphone|teléfono)[.:]{0,2}\s{0,2})"
# in order of precedence; each is linear in the text
PATTERNS = {
    "pem": r"(?<=PRIVATE KEY-----)\s*+[A-Za-z0-9+/=\s]{16,}+(?=-----END)",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": _LEFT + r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[\p{L}\p{N}+/_-]{8,}+"
              + "|" + _LEFT + r"(?i:password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?(?=[^\s\"']{0,40}[\d!@#$%^&*])[^\s\"',;]{4,}+"
              + "|" + _LEFT + r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36})" + _RIGHT,
    "iban": _LEFT + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _RIGHT,
    "bearer": r"(?<=(?i:bearer)\s)[A-Za-z0-9._~+/-]{16,}+=*+",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:" + _HEX + ":){7}" + _HEX + r"|(?=[0-9A-Fa-f]{3,4}:)(?=[0-9A-Fa-f:]{0,39}\d)(?:" + _HEX + ":){1,7}(?::" + _HEX + r"){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?<!(?i:version|release|ver|rev|build)[.:]?\s{0,2})" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}]|\.\d)",
    # international; area code in brackets; three groups with signs; groups of two; area
    # and number after a zero; ten digits
    "phone": r"(?<![\p{L}\p{N}+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}"
             + r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?:1[.-])?[2-9]\d{2}[.-][2-9]\d{2}[.-]\d{4}|0\d(?:[ .]\d{2}){4}|0\d{1,4}[ /-]\d{5,8}|[2-9]\d{9})(?![\p{L}\p{N}]|[.-]\d)",
    "called": _CALL + r"\d{2,5}(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}]|[.-]\d)",
}
# what an entity looks like by itself, for patterns that look at what stands before it
ALONE = {"pem": r"\s[A-Za-z0-9+/=\s]+", "called": r"\d{2,5}(?:[ .-]?\d{2,4}){1,4}", "bearer": r"[A-Za-z0-9._~+/-]{16,}=*"}
KINDS = ["pem", *[k for k in PATTERNS if k not in ALONE], "called", "bearer"]   # the order in which an entity is judged
FOUND = "|".join(PATTERNS.values())
# titles, as fixed values
_MALE = "Mr|Herr|Monsieur|Señor|Signor|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Signora|Госпожа"
_EITHER = "Dr|Prof|Professor|Doctor|Doktor|Docteur|Doctora|Rev|Capt|Sgt|Judge|Senator"
_ANY = "(?:" + _MALE + "|" + _FEMALE + "|" + _EITHER + ")"
# inner capitals, apostrophes and hyphens; initials and further titles stay as they are
_WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}))+"
_TITLED = _LEFT + r"(TITLE)\.? (?:" + _ANY + r"\.? )?(" + _WORD + r")(?:(?: \p{Lu}\.){0,3} (" + _WORD + "))?" + _RIGHT
_MAYBE = r"[@0-9]|" + _LEFT + _ANY + r"\.? \p{Lu}|(?i:token|secret|passw|pwd|key|bearer)"
_ACCENTED = "àâäçèéêëîïñôöùûü"
_SEP = "\x1f"
RETRIES = 8   # draws in the entity's own format before it is lengthened


def _let(value: Column, body) -> Column:
    """``body`` over one evaluation of ``value``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _names(text: Column) -> Column:
    """(token, kind) of every titled name; the last word is the surname."""
    def of(titles: str, kind: str) -> list[Column]:
        pattern = F.lit(_TITLED.replace("TITLE", titles))
        first, second = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (2, 3))
        pairs = F.arrays_zip(first.alias("a"), second.alias("b"))
        return [F.transform(pairs, lambda p: F.struct(
                    p["a"].alias("token"), F.when(p["b"] == "", "surname").otherwise(kind).alias("kind"))),
                F.transform(F.filter(pairs, lambda p: p["b"] != ""), lambda p: F.struct(
                    p["b"].alias("token"), F.lit("surname").alias("kind")))]
    return F.array_sort(F.array_distinct(F.concat(*of(_MALE, "given_m"), *of(_FEMALE, "given_f"), *of(_EITHER, "given"))))


def _pattern(names: Column) -> Column:
    """What to look for in a text: the patterns and the text's own names."""
    tokens = F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n["token"], F.lit(r"\E"))), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(FOUND + "|" + _LEFT + "(?:"), tokens, F.lit(")" + _RIGHT))).otherwise(F.lit(FOUND))


def _kind(entity: Column, names: Column) -> Column:
    named = F.filter(names, lambda n: n["token"] == entity)
    out = F.get(named, F.lit(0))["kind"]
    for kind in reversed(KINDS):
        alone = ALONE.get(kind, PATTERNS[kind])
        out = F.when(entity.rlike("^(?:" + alone + r")\z"), "phone" if kind == "called" else kind).otherwise(out)
    return out


_LABEL = r"^.*[=:]\s*[\"']?"


def _canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D+", "")
    code = F.regexp_extract(entity, r"^\+(\d{1,3})(?=\D)", 1)
    return (F.when(kind == "phone", F.concat(code, F.lit("|"), F.substr(digits, F.length(code) + 1)))
            .when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(F.lower(entity), " ", ""))
            .when(kind == "secret", F.lower(F.regexp_replace(entity, _LABEL, "")))
            .otherwise(F.lower(entity)))


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """128 keyed hex digits: HMAC-SHA256 of the entity and the draw."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))

    def mac(part: str) -> Column:
        message = F.concat_ws(_SEP, kind, canonical, attempt.cast("string"), F.lit(part)).cast("binary")
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(mac("0"), mac("1"))


def _draw(stream: Column, i: Column, below: int) -> Column:
    """The i-th keyed number below ``below`` (two hex digits each, 16 bits)."""
    return F.conv(F.substr(stream, 1 + 4 * F.pmod(i, F.lit(32)), F.lit(4)), 16, 10).cast("int") % below


def _swap(char: Column, i: Column, s: Column, hexed: Column) -> Column:
    """A character of the same kind and script; others stay."""
    def pick(letters: str) -> Column:
        return F.substr(F.lit(letters), 1 + _draw(s, i, len(letters)), F.lit(1))
    cyrillic, greek = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    return (F.when(char.rlike("[0-9]"), _draw(s, i, 10).cast("string"))
            .when(char.rlike("[a-z]"), F.when(hexed, pick("abcdef")).otherwise(pick("abcdefghijklmnopqrstuvwxyz")))
            .when(char.rlike(r"\p{IsCyrillic}"), pick(cyrillic)).when(char.rlike(r"\p{IsGreek}"), pick(greek))
            .when(char.rlike(r"\p{IsLatin}"), pick(_ACCENTED)).otherwise(char))


def _scramble(text: Column, s: Column, hexed: Column | None = None) -> Column:
    hexed = F.lit(False) if hexed is None else hexed
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _swap(c, i, s, hexed)), "")


def _name(kind: Column, canonical: Column, s: Column) -> Column:
    """A name of keyed syllables: a given name ends in -a for women and in a
    consonant for men; a surname has four syllables."""
    def build(consonants: str, vowels: str, female: str, male: str, surname: str, either: str) -> Column:
        def syllable(i: int) -> Column:
            return F.concat(F.substr(F.lit(consonants), 1 + _draw(s, F.lit(2 * i), len(consonants)), F.lit(1)),
                            F.substr(F.lit(vowels), 1 + _draw(s, F.lit(2 * i + 1), len(vowels)), F.lit(1)))
        stem = F.concat(*[syllable(i) for i in range(4)])
        return F.concat(stem, F.when(kind == "given_f", female).when(kind == "given_m", male).when(kind == "given", either).otherwise(surname))
    return (F.when(canonical.rlike(r"\p{IsCyrillic}"), build("бвгдзклмнпрст", "аеиоу", "на", "н", "ров", "ли"))
            .when(canonical.rlike(r"\p{IsGreek}"), build("βγδζκλμνπρστ", "αειου", "να", "ς", "δης", "λι"))
            .otherwise(build("bdfgklmnprstvz", "aeiou", "na", "n", "ller", "li")))


def _luhn(digits: Column) -> Column:
    """Luhn sum, the last digit being the check digit."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(2 * c.cast("int") > 9, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))), F.lit(0), lambda a, x: a + x)


def _card(digits: Column, s: Column) -> Column:
    """Same first digit; passes the check-digit test where the original does."""
    drawn = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _scramble(F.substr(digits, F.lit(2)), s))
    def fix(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        return F.concat(head, F.pmod(F.lit(10) - _luhn(F.concat(head, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return F.when(_luhn(digits) % 10 == 0, _let(drawn, fix)).otherwise(drawn)


def _octets(ip: Column, s: Column) -> Column:
    return F.array_join(F.transform(F.split(ip, r"\."), lambda o, i: F.when(F.length(o) == 3, 100 + _draw(s, i, 155))
                        .when(F.length(o) == 2, 10 + _draw(s, i, 90)).otherwise(1 + _draw(s, i, 9)).cast("string")), ".")


def surrogate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """Canonical form of the replacement. After RETRIES draws it is drawn
    from a longer format, as the entity's own may be used up."""
    def build(s: Column) -> Column:
        tail = F.when(kind == "email", F.regexp_extract(canonical, r"\.[^.]+$", 0)).otherwise(F.lit(""))
        body = F.substr(canonical, F.lit(1), F.length(canonical) - F.length(tail))
        phone = F.split(canonical, r"\|")
        own = (F.when(kind == "ip", _octets(canonical, s)).when(kind == "card", _card(canonical, s))
               .when(kind == "phone", F.concat(F.get(phone, F.lit(0)), F.lit("|"), _scramble(F.get(phone, F.lit(1)), s)))
               .when(kind == "iban", F.concat(F.substr(canonical, F.lit(1), F.lit(2)), _scramble(F.substr(canonical, F.lit(3)), s)))
               .when(kind.isin("given_m", "given_f", "given", "surname"), _name(kind, canonical, s))
               .otherwise(F.concat(_scramble(body, s, ((kind == "secret") & canonical.rlike("^[0-9a-f]+$")) | (kind == "ipv6")), tail)))
        extra = F.when(kind.isin("email", "given_m", "given_f", "given", "surname"), F.translate(F.substr(s, F.lit(1), F.lit(8)), "0123456789", "ghijklmnop"))
        extra = extra.otherwise(F.translate(F.substr(s, F.lit(1), F.lit(8)), "abcdef", "123456"))
        longer = F.when(kind == "ip", F.concat(own, F.lit(":"), extra)).when(kind == "email", F.concat(extra, own)).otherwise(F.concat(own, extra))
        return F.when(attempt < RETRIES, own).otherwise(longer)
    return _let(_stream(key, kind, canonical, attempt), build)


def _render(kind: Column, entity: Column, new: Column) -> Column:
    """``new`` (canonical) in the surface form of ``entity``."""
    def in_case(n: Column, c: Column) -> Column:
        return F.when(c != F.lower(c), F.upper(n)).otherwise(n)

    def spaced(template: Column, symbols: Column, counted: str) -> Column:
        """Each counted character gets the next symbol; surplus goes last."""
        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
        return F.aggregate(F.split(template, ""), zero, lambda a, c: F.when(
            c.rlike(counted), F.struct(F.concat(a["out"], in_case(F.substr(symbols, a["n"] + 1, F.lit(1)), c)).alias("out"), (a["n"] + 1).alias("n")))
            .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
            lambda a: F.concat(a["out"], F.substr(symbols, a["n"] + 1)))

    label = F.when(kind == "secret", F.regexp_extract(entity, _LABEL, 0)).otherwise(F.lit(""))
    value = F.substr(entity, F.length(label) + 1)
    same = F.array_join(F.transform(F.split(new, ""), lambda n, i: in_case(n, F.substr(value, F.least(i + 1, F.length(value)), F.lit(1)))), "")
    named = F.when(entity == F.upper(entity), F.upper(new)).otherwise(F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2))))
    return (F.when(kind.isin("given_m", "given_f", "given", "surname"), named)
            .when(kind.isin("phone", "card", "ssn"), spaced(entity, F.regexp_replace(new, r"\|", ""), "[0-9]"))
            .when(kind == "iban", spaced(entity, new, "[0-9A-Za-z]"))
            .otherwise(F.concat(label, same)))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, new for distinct (kind, canonical) rows: no two of a
    kind share ``new``, and none is another's original. Of entities that
    drew alike the smallest keeps its draw, the others draw again."""
    drawn = entities.withColumn("attempt", F.lit(0))
    originals = entities.select("kind", F.col("canonical").alias("new"), F.lit(True).alias("real"))
    while True:
        named = materialize(drawn.withColumn("new", surrogate(key, F.col("kind"), F.col("canonical"), F.col("attempt"))), "surrogates")
        holder = (named.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canonical")).alias("holder"))
                  .join(originals, ["kind", "new"], "left"))
        clash = (F.col("holder.canonical") != F.col("canonical")) | F.col("real")
        judged = materialize(named.join(holder, ["kind", "new"]).select(
            "kind", "canonical", "attempt", "new", F.coalesce(clash, F.lit(False)).alias("clash")), "judged")
        if judged.where("clash").isEmpty():
            return judged.select("kind", "canonical", "new")
        drawn = judged.select("kind", "canonical", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def _entities(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


def replace_pii(docs: DataFrame, secret: str, text: str = "text", key: str = "doc_id",
                count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; with ``count``, also
    the number replaced in each row under that name.

    All rows and columns stay. Equal entities get equal surrogates in the
    whole corpus, different ones of a kind different surrogates, under one
    ``secret``. Null texts stay null; texts without entities are unchanged.
    Rows that agree in key and text, null keys included, get the same text. Of
    entities that overlap the one that begins first is taken, of those the one of
    the first pattern. Texts count whole whatever their length; an empty table
    gives an empty one. Columns may have any names; one named as ``count`` is
    replaced."""
    t = F.col(text)
    row = F.xxhash64(key, text)
    maybe = t.rlike(_MAYBE)
    seen = docs.where(maybe).select(F.col(key).alias("__id"), row.alias("__row"), t.alias("__text"), _names(t).alias("names"))
    mentions = (seen.select("__id", "__row", "names", F.posexplode(_entities(F.col("__text"), _pattern(F.col("names")))).alias("at", "entity"))
                .select("__id", "__row", "at", "entity", _kind(F.col("entity"), F.col("names")).alias("kind")))
    mentions = materialize(mentions.withColumn("canonical", _canonical(F.col("kind"), F.col("entity"))), "mentions")
    chosen = distinct_surrogates(mentions.select("kind", "canonical").distinct(), secret)
    rendered = (mentions.join(chosen, ["kind", "canonical"])
                .select("__id", "__row", F.struct("at", _render(F.col("kind"), F.col("entity"), F.col("new")).alias("put")).alias("edit")))
    edits = materialize(rendered.groupBy(F.col("__id").alias("__edit_id"), F.col("__row").alias("__edit_row"))
                        .agg(F.array_sort(F.collect_set("edit")).alias("__edits")), "edits")
    # one plan at every size; the edits are the smaller side
    rows = docs.select(whole_row(docs).alias("__whole"), F.col(key).alias("__id"), row.alias("__row"))
    joined = rows.join(edits.hint("shuffle_hash"), (F.col("__row") == F.col("__edit_row")) & F.col("__id").eqNullSafe(F.col("__edit_id")), "left")
    t = F.col("__whole").getField(text)
    put = F.transform(F.col("__edits"), lambda e: e["put"])
    pieces = F.split(t, _pattern(_names(t)), -1)
    new = F.array_join(F.zip_with(pieces, F.concat(put, F.array(F.lit(""))), lambda p, e: F.concat(p, e)), "")
    out = [(F.when(F.col("__edits").isNotNull(), new).otherwise(t) if c == text else F.col("__whole").getField(c)).alias(c) for c in docs.columns if c != count]
    if count:
        out.append(F.coalesce(F.size("__edits"), F.lit(0)).alias(count))
    return joined.select(*out)


SECRET = "surrogates-1"   # of the registered query where the session names none
SECRET_CONF = "spark.treesnap.surrogateKey"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, spark.conf.get(SECRET_CONF, SECRET), count="n_entities")
