"""Private data replaced by surrogates (operator 9), in DataFrame functions only.

Entities are found by patterns. Each distinct value gets a surrogate made from a keyed digest: of the
same type, format, script and (for names) gender. Values whose surrogate is another's, or is itself an
entity of the corpus, are drawn again until all are distinct; so equal values stay equal and different
ones different in all documents. Names get longer with each draw, other values where a format has no
free ones after many draws; so no number of distinct values uses the surrogates up. Parts of names have
surrogates of their own, and where a document has a name, its parts are replaced wherever they stand alone
in it, so that a surname alone still refers to the person.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.storage import numbered, saved, small

#: Draws for a value before its format's space of surrogates counts as used up; later ones are longer.
FORMAT_DRAWS = 8
#: Syllables of a made-up name at first; each further draw has one more.
NAME_SYLLABLES = 4

# Titles and given names by gender, and syllables of made-up names by script.
TITLES = {
    "m": ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Г-жа", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Mx"],
}
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew "
        "George Peter Edward Brian Kevin Hans Klaus Jürgen Wolfgang Stefan Jean Pierre Michel Jacques François José Antonio "
        "Manuel Carlos Javier Luis Miguel Juan Иван Сергей Дмитрий Алексей Γιώργος Νίκος"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Donna Carol "
        "Michelle Laura Anna Alice Ursula Monika Petra Sabine Katrin Marie Nathalie Isabelle Sylvie Catherine Carmen Dolores "
        "Pilar Lucía Ana Мария Елена Ольга Наталья Μαρία Ελένη"
    ).split(),
}
SYLLABLES = {
    "latin": "bar del fen gor hal jin kor lam mer nel por ras sil tor vin wes".split(),
    "cyrillic": "бар дел фен гор хал жин кор лам мер нел пор рас сил тор вин зес".split(),
    "greek": "βαρ δελ φεν γορ χαλ ζιν κορ λαμ μερ νελ πορ ρασ σιλ τορ βιν ξεσ".split(),
}
ENDINGS = {"latin": {"m": "o", "f": "a", "n": "e"}, "cyrillic": {"m": "", "f": "а", "n": ""}, "greek": {"m": "ος", "f": "α", "n": "ι"}}

# A capitalised word (McDonald, O'Brien, Jean-Luc), without the ending of the genitive.
_NAME_PART = r"\p{Lu}(?:[\p{Ll}-]|['’](?!s(?!\p{L}))|(?<=[\p{Ll}'’-])\p{Lu})++"
_NAME = rf"{_NAME_PART}(?: {_NAME_PART})++"
#: What stands between the names of a list.
_BETWEEN = "(?:, and |, | and | und | et | y )"
# Words that introduce a name.
CUES = (
    "[Mm]y name is|[Nn]ame is|[Nn]amed|[Nn]ame:|[Dd]ear|[Cc]ontact|[Cc]ontact:|[Mm]et|[Mm]eet|[Aa]sk for|[Ss]igned by|[Ww]ritten by|[Ss]igned,|[Rr]egards,"
    "|[Ss]incerely,|[Aa]uthor:|[Pp]atient|[Pp]atient:|[Cc]lient:|[Cc]ustomer:|[Aa]pplicant:|[Ee]mployee:|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es"
)
_ALL_GIVEN = "|".join(GIVEN["m"] + GIVEN["f"])
_ALL_TITLES = "|".join(TITLES["m"] + TITLES["f"] + TITLES["n"])
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns of each type, tried in this order at each place of a text.
PATTERNS = {
    "secret": r"(?=[AaTtSsPp])(?i:\b(?:access[_-]?token|auth[_-]?token|token|api[_-]?key|secret[_-]?key|secret|passwd|password)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}+"
    r"|(?=[Agsx])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)++[\p{L}]{2,}",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?=[0-9])(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    # In full, or with one :: for groups of zeros; with two groups at least.
    "ipv6": r"(?=[0-9A-Fa-f:])(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "mac": r"(?=[0-9A-Fa-f])(?<![\p{L}\p{N}:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:-])|(?=[0-9A-Fa-f])(?<![\p{L}\p{N}:-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:-])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?=[0-9])(?<![0-9.,-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[.,-][0-9])",
    "phone": r"(?=[0-9+(])(?<![\p{L}0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|0[0-9]{2,4} [0-9]{3,4} ?[0-9]{3,4}|0[0-9]{2,4}-[0-9]{3,4}-?[0-9]{3,4}|0[0-9]{2,4}/[0-9]{5,8}|0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}))(?![0-9])",
    "titled": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_ALL_TITLES})\.? {_NAME_PART}(?: {_NAME_PART})?",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_ALL_GIVEN}) {_NAME_PART}",
    # After a word that introduces names, a name or a list of them, of any length. What stands before comes first, so that
    # within a long word nothing is looked at.
    "introduced": rf"(?<= )(?=\p{{Lu}}[\p{{L}}'’-]++ \p{{Lu}})(?<=(?<!\p{{L}})(?:{CUES}) ){_NAME}(?:{_BETWEEN}{_NAME})*+",
}
NAMES = ("titled", "name", "introduced")
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Entities, and words that may be a part of one of a document's names.
ENTITY_OR_PART = rf"{ENTITY}|(?<!\p{{L}}){_NAME_PART}"
#: What a text with an entity has at least; cheaper to look for, as most places fail at their first sign.
HINT = rf"[@0-9=:]|(?=[\p{{Lu}}gsx])(?<!\p{{L}})(?:AKIA|gh[pousr]_|sk-|xox[abp]-|(?=\p{{Lu}})(?:{_ALL_TITLES}|{_ALL_GIVEN})\.? \p{{Lu}})|(?<!\p{{L}})(?:{CUES}) \p{{Lu}}"


def _type_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    # An introduced name is known by what stands before it, so by itself any name may be one.
    for name, pattern in reversed((PATTERNS | {"introduced": rf"{_NAME}(?:{_BETWEEN}{_NAME})*+"}).items()):
        out = F.when(value.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return out


def _digit_sum(digits: Column, odd: int) -> Column:
    """The sum of Luhn's check, with digits doubled at places (from the right) of the given parity."""
    at = F.reverse(F.split(digits, ""))
    value = F.transform(at, lambda d, i: F.when(i % 2 == odd, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(value, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))


def _luhn(value: Column) -> Column:
    return _digit_sum(F.regexp_replace(value, "[ -]", ""), 1) % 10 == 0


def _remainder(value: Column) -> Column:
    """An account number's remainder by 97, letters counting from 10: 1 if its check digits are right."""
    moved = F.regexp_replace(value, "[ ]", "")
    moved = F.concat(F.substr(moved, F.lit(5)), F.substr(moved, F.lit(1), F.lit(4)))

    def step(s: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return (s * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.split(F.upper(moved), ""), F.lit(0), step)


def _checked(made: Column) -> Column:
    """An account number with check digits that are right, in the third and fourth place."""
    open_ = F.concat(F.substr(made, F.lit(1), F.lit(2)), F.lit("00"), F.substr(made, F.lit(5)))
    return _once(open_, lambda o: F.concat(F.substr(o, F.lit(1), F.lit(2)), F.lpad((98 - _remainder(o)).cast("string"), 2, "0"), F.substr(o, F.lit(5))))


def _hexadecimal(made: Column) -> Column:
    """Letters beyond f become some up to f, in either case."""
    return F.translate(made, "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "abcdefabcdefabcdefabABCDEFABCDEFABCDEFAB")


def _digest(key: str, value: Column, kind: str, draw: int) -> Column:
    """192 hexadecimal digits that depend on the key, the kind, the draw and the value."""
    return F.concat(*[F.sha2(F.concat_ws("\0", F.lit(key), F.lit(kind), F.lit(i), F.lit(str(draw)), value), 256) for i in range(3)])


def _hex(digest: Column, i: Column, width: int = 4) -> Column:
    return F.conv(F.substr(digest, F.pmod(i * width, F.lit(192 - width)) + 1, F.lit(width)), 16, 10).cast("int")


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once even where use has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sign(c: Column, n: Column) -> Column:
    """A sign of c's kind, by a number."""

    def of(alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))

    lower = c == F.lower(c)
    return (
        F.when(c.between("0", "9"), of("0123456789"))
        .when(c.between("a", "z"), of("abcdefghijklmnopqrstuvwxyz"))
        .when(c.between("A", "Z"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c < "\u0080", c)
        .when(c.rlike(r"\p{IsCyrillic}"), F.when(lower, of("абвгдежзиклмнопрстуфхцч")).otherwise(of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧ")))
        .when(c.rlike(r"\p{IsGreek}"), F.when(lower, of("αβγδεζηθικλμνξοπρστυφχψω")).otherwise(of("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")))
        .when(c.rlike(r"\p{L}"), F.when(lower, of("abcdefghijklmnopqrstuvwxyz")).otherwise(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
        .otherwise(c)
    )


def _scrambled(value: Column, digest: Column) -> Column:
    """Each digit by a digit, each letter by one of the same script and case; the rest stays."""
    return _once(digest, lambda d: F.array_join(F.transform(F.split(value, ""), lambda c, i: _sign(c, _hex(d, i))), ""))


def _script(part: Column) -> Column:
    return F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _new_name(part: Column, gender: Column, digest: Column, syllables: int) -> Column:
    """A made-up name in the part's script, with an ending for the gender ('' for surnames)."""
    tables = F.create_map(*[x for s, list_ in SYLLABLES.items() for x in (F.lit(s), F.array(*map(F.lit, list_)))])
    ends = F.create_map(*[x for s, by in ENDINGS.items() for g, e in by.items() for x in (F.lit(s + g), F.lit(e))])
    script = _script(part)
    made = F.concat(*[F.element_at(tables[script], _hex(digest, F.lit(i)) % 16 + 1) for i in range(syllables)])
    return F.concat(F.initcap(made), F.coalesce(ends[F.concat(script, gender)], F.lit("")))


def _surrogate(key: str, kind: Column, value: Column, gender: Column, draw: int) -> Column:
    """A candidate for a value (for names: of one part of a name). From draw FORMAT_DRAWS on it is longer
    than the value, by one more digit or letter (for addresses: first of octets of any length) each time."""
    more = max(0, draw - FORMAT_DRAWS + 1)
    out = _scrambled(F.concat(value, F.lit("0" * more)), _digest(key, value, "any", draw))

    def after(pattern: str, name: str) -> Column:
        """The value with what the pattern matches at its start kept."""
        head = F.regexp_extract(value, rf"\A(?:{pattern})", 0)
        rest = F.concat(F.substr(value, F.length(head) + 1), F.lit("0" * more))
        made = _scrambled(rest, _digest(key, rest, name, draw))
        # Hexadecimal digits stay such.
        hexadecimal = rest.rlike(r"\A(?=.*[0-9])[0-9a-f]+\z") if name == "secret" else F.lit(False)
        return F.concat(head, F.when(hexadecimal, _hexadecimal(made)).otherwise(made))

    tail = F.regexp_extract(value, r"\.[^.]*\z", 0)
    head = F.concat(F.lit("a" * more), F.substr(value, F.lit(1), F.length(value) - F.length(tail)))
    email = F.concat(_scrambled(head, _digest(key, head, "email", draw)), tail)

    def octet(o: Column, n: Column) -> Column:
        if more:
            return (n % 254 + 1).cast("string")
        return F.when(F.length(o) == 1, n % 9 + 1).when(F.length(o) == 2, n % 90 + 10).otherwise(n % 155 + 100).cast("string")

    # Four octets as long as there can be free ones, then further ones.
    octets = F.split(F.concat(value, F.lit(".0" * max(0, more - FORMAT_DRAWS))), r"\.")
    address = _once(_digest(key, value, "ip", draw), lambda d: F.array_join(F.transform(octets, lambda o, i: octet(o, _hex(d, i))), "."))
    card = _scrambled(F.concat(F.lit("0" * more), value), _digest(key, value, "card", draw))
    body = F.regexp_replace(F.substr(card, F.lit(1), F.length(card) - 1), "[ -]", "")
    check = F.pmod(-_digit_sum(body, 0), F.lit(10)).cast("string")
    names = _new_name(value, gender, _digest(key, value, "name", draw), NAME_SYLLABLES + draw)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", address)
        .when(kind == "card", F.when(_luhn(value), F.concat(F.substr(card, F.lit(1), F.length(card) - 1), check)).otherwise(card))
        .when(kind == "secret", after(r"(?i:[a-z_-]+?\s*[=:]\s*[\"']?)|AKIA|gh[a-z]_|sk-|xox[abp]-", "secret"))
        # Right check digits stay right.
        .when(kind == "iban", _once(after(r"[A-Z]{2}", "iban"), lambda made: F.when(_remainder(value) == 1, _checked(made)).otherwise(made)))
        .when(kind.isin("ipv6", "mac"), _hexadecimal(out))
        .when(kind == "phone", after(r"\+[0-9]{1,3}(?=[ .(-])|\+", "phone"))
        .when(kind == "part", names)
        .otherwise(out)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) from (kind, value, gender): distinct within a kind, and no value of the
    corpus. Values that collide draw again, the others keep theirs. Null values have none."""
    spread = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = saved(entities.where("value IS NOT NULL").distinct())
    fixed, open_rows = None, values.repartition(spread, "value")
    for draw in count():  # it ends: each draw has more room than the one before
        made = open_rows.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("value"), F.col("gender"), draw))
        made = saved(made)
        first = made.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = made.join(first, ["kind", "surrogate", "value"], "left_semi")
        good = good.join(values.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if fixed is not None:
            good = good.join(fixed.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = saved(good)
        fixed = good if fixed is None else saved(fixed.unionByName(good))
        open_rows = made.drop("surrogate").join(good.select("kind", "value"), ["kind", "value"], "left_anti")
        if open_rows.isEmpty():
            return fixed.select("kind", "value", "surrogate")


def _found(text: Column, pattern: str = ENTITY) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _mapping(values: DataFrame, key: str) -> DataFrame:
    """(value, new, parts) for each distinct entity value (value); parts: (value, new) of a name's parts."""
    # Few bytes but much work: not for one task.
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = saved(values.repartition(spread, "value").withColumn("kind", _type_of(F.col("value"))))
    named = typed.where(F.col("kind").isin(*NAMES))
    title = F.regexp_extract("value", rf"\A(?:(?:{_ALL_TITLES})\.? (?=\p{{Lu}}))?", 0)
    # A value may be a list of names: what stands between parts stays, and a part after anything but a space begins a name.
    rest = F.substr("value", F.length("title") + 1)
    words = named.select("value", "kind", title.alias("title"), F.regexp_extract_all(rest, F.lit(_NAME_PART), F.lit(0)).alias("words"), F.split(rest, _NAME_PART, -1).alias("gaps"))
    bare = F.rtrim(F.regexp_replace("title", r"\.? \z", ""))

    def gender_of(first: Column, titled: Column) -> Column:
        return (
            F.when((titled & bare.isin(TITLES["m"])) | first.isin(GIVEN["m"]), "m").when((titled & bare.isin(TITLES["f"])) | first.isin(GIVEN["f"]), "f").otherwise("n")
        )

    zipped = F.transform("words", lambda w, i: F.struct(w.alias("part"), F.get("gaps", i).alias("gap"), F.get("gaps", i + 1).alias("next")))
    parts = words.select("value", "title", "gaps", F.posexplode(zipped).alias("i", "w")).select("value", "title", "gaps", "i", "w.*")
    # A first name of several is given its gender's ending; surnames have none. One part, one surrogate.
    first = ((F.col("i") == 0) | (F.col("gap") != " ")) & (F.col("next") == " ")
    by_part = parts.groupBy("part").agg(F.min(F.when(first, gender_of(F.col("part"), F.col("i") == 0))).alias("gender"))
    other = typed.where(~F.col("kind").isin(*NAMES)).where((F.col("kind") != "card") | _luhn(F.col("value")))
    wanted = other.select("kind", "value", F.lit(None).cast("string").alias("gender")).unionByName(
        by_part.select(F.lit("part").alias("kind"), F.col("part").alias("value"), "gender")
    )
    made = surrogates(wanted, key)
    pair = "array<struct<value:string,new:string>>"
    plain = made.where("kind <> 'part'").select("value", F.col("surrogate").alias("new"), F.array().cast(pair).alias("parts"))
    new_parts = made.where("kind = 'part'").select(F.col("value").alias("part"), "surrogate")
    joined = parts.join(new_parts, "part").groupBy("value", "title", "gaps").agg(F.sort_array(F.collect_list(F.struct("i", "part", "surrogate"))).alias("s"))
    put = F.transform("gaps", lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col("s.surrogate"), i), F.lit(""))))
    full = joined.select("value", F.concat("title", F.array_join(put, "")).alias("new"), F.arrays_zip(F.col("s.part").alias("value"), F.col("s.surrogate").alias("new")).cast(pair).alias("parts"))
    return saved(plain.unionByName(full))


def replaced(
    docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, length: str | None = None
) -> DataFrame:
    """The columns in keep (default: all) of docs, entities in the text replaced, and n_replaced: how many.

    Surrogates depend on the key, which should be kept secret: who knows it can test guesses. Null texts
    stay null, texts without entities as they are; a text of any length is treated as a whole. Rows with
    equal id and text are treated alike. Where patterns of entities overlap, the first in the text counts,
    and of those that begin at one place the first of PATTERNS. Digits that fail the check sum of payment
    cards are not entities. A column n_replaced of docs gives way. A column of the text's length, if named,
    follows the new text where it is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "n_replaced"]
    own, names, _ = numbered(docs)
    id_col, text_col = F.col(names[doc_id]), F.col(names[text])
    own = own.withColumn("hash", F.xxhash64(names[doc_id], names[text]))
    hinted = F.coalesce(text_col.rlike(HINT), F.lit(False))
    # explode_outer: else Spark looks for entities once more, to drop rows without any beforehand.
    rows = own.where(hinted).select("hash", id_col.alias("id"), F.explode_outer(_found(text_col)).alias("value"))
    found = saved(rows.where("value IS NOT NULL").distinct())
    mapping = _mapping(found.select("value").distinct(), key)
    entry = F.concat(F.array(F.struct("value", "new")), F.col("parts"))
    maps = found.join(small(mapping), "value").groupBy("hash", "id").agg(F.collect_list(entry).alias("entries"), F.max(F.size("parts")).alias("names"))
    maps = saved(maps.select("hash", "id", F.map_from_entries(F.array_distinct(F.flatten("entries"))).alias("new"), (F.col("names") > 0).alias("named")))
    one = small(maps, weight=F.size("new")).withColumnRenamed("hash", "map_hash")
    joined = own.join(one, (F.col("hash") == F.col("map_hash")) & id_col.eqNullSafe(F.col("id")), "left")

    def rewritten(pattern: str) -> Column:
        gaps = F.split(text_col, pattern, -1)

        def put(values: Column) -> Column:
            parts = F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.col("new")[F.get(values, i)], F.get(values, i), F.lit(""))))
            return F.struct(F.array_join(parts, "").alias("text"), F.size(F.filter(values, lambda v: F.col("new")[v].isNotNull())).alias("n"))

        return _once(_found(text_col, pattern), put)

    changed = F.col("new").isNotNull()
    joined = joined.withColumn("made", F.when(changed & F.col("named"), rewritten(ENTITY_OR_PART)).when(changed, rewritten(ENTITY)))
    out = {text: F.when(changed, F.col("made.text")).otherwise(text_col)}
    if length:
        out[length] = F.when(changed, F.length("made.text").cast(docs.schema[length].dataType)).otherwise(F.col(names[length]))
    n = F.coalesce("made.n", F.lit(0)).cast("long")
    return joined.select(*[out.get(c, F.col(names[c])).alias(c) for c in keep], n.alias("n_replaced"))


def pseudonymised(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """docs with entities in the text replaced, and no other column than before."""
    return replaced(docs, key, doc_id, text, length=length).select([F.col(f"`{c}`") for c in docs.columns])


def key_of(spark: SparkSession) -> str:
    """The key that the session names in spark.weftline.surrogateKey; where it is unset, one for tests, which
    is public and so hides nothing from who looks for it."""
    return spark.conf.get("spark.weftline.surrogateKey", None) or "public key for tests"
