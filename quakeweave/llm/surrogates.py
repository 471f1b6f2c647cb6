"""PII surrogates: keyed, type-consistent replacements for detected entities.

One pattern, whose branches are tried in order, finds e-mail addresses, access keys,
hexadecimal secrets, bank accounts, payment cards, social security numbers, phone numbers,
IPv4 addresses and persons' names (a listed given name and a capitalised word; names alone,
other given names and IPv6 addresses are not found).
A value's surrogate is drawn from a keyed hash of its type and value, so every mention
of it in any document gets the same one (coreference).  Digits become digits, letters
letters of the same case and script, all else stays; phone numbers keep their country; cards keep their issuer digit and
a valid check digit where they had one, addresses keep octets of the same number of
digits, e-mail addresses keep their top-level domain, and given names are drawn from
names of the same gender and script.

Draws are checked over all distinct values of all documents: of the values that drew
the same surrogate one keeps it, as does none that drew another value's original; the
rest draw again, until all are distinct.  Only DataFrame functions are used.

Null texts stay null and have no entities; empty texts stay empty.  Equal rows get
equal results.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.llm._common import drop, table, written

#: Common given names by gender and script, and surnames, both to detect and to draw from.
GIVEN = {
    ("f", "Latin"): "Anna Maria Emma Laura Julia Sarah Lisa Mary Linda Susan Karen Nancy Helen Alice Clara Elena Sofia Camille Chloe Manon Lena Hannah Marta Carmen Lucia".split(),
    ("m", "Latin"): "James John Robert Michael David Thomas Peter Paul Mark Daniel Martin Lukas Felix Jonas Pierre Louis Hugo Antoine Carlos Pablo Diego Javier Henry George Simon".split(),
    ("f", "Cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина".split(),
    ("m", "Cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Максим".split(),
}
SURNAMES = {
    "Latin": "Smith Johnson Brown Miller Davis Wilson Moore Taylor Anderson Jackson White Harris Clark Lewis Walker Young King Wright Scott Green Baker Adams Nelson Hill Carter Martin Bernard Dubois Petit Durand Leroy Moreau Garcia Lopez Sanchez Perez Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann".split(),
    "Cyrillic": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров".split(),
}
#: Kinds in the order of their branches.
KINDS = ("email", "key", "secret", "iban", "card", "ssn", "phone", "ip", "person")
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
BRANCHES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|sk|pk)[_-][A-Za-z0-9]{16,}\b",
    "secret": r"\b(?=[0-9a-fA-F]{32})(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,64}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])(?:(?:\d{4}[ -]?){3}\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d.]\d)(?!\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,4}){1,4}|0\d(?:[ .]\d{2}){4}|\d{3} \d{3} \d{4})(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_NAMES}) \p{{Lu}}\p{{L}}+(?!\p{{L}})",
}
#: An entity starts with one of these characters, whatever branch it is of.
PATTERN = r"(?=[A-Za-z0-9._%+(\p{Lu}-])(?:" + "|".join(f"(?:{BRANCHES[k]})" for k in KINDS) + ")"


#: Without a digit or an at sign only these can be there.
OF_LETTERS = f"(?:{BRANCHES['key']})|(?:{BRANCHES['person']})"


def has_entity(text: Column) -> Column:
    """Whether PATTERN is found in a text."""
    return F.coalesce(F.when(text.rlike("[0-9@]"), text.rlike(PATTERN)).otherwise(text.rlike(OF_LETTERS)), F.lit(False))


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{BRANCHES[k]})$"), k).otherwise(out)
    return out


def _pick(text: str, h: Column) -> Column:
    return F.lit(text).substr((F.pmod(h, F.lit(len(text))) + 1).cast("int"), F.lit(1))


def _stream(seed: Column, i: Column) -> Column:
    """63 keyed bits for place i."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _scramble(value: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Every digit another digit, every letter a letter of its case (and script), all else as it is."""
    lower, upper = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def one(c: Column, i: Column) -> Column:
        h = _stream(seed, i)
        return F.when(c.rlike("[0-9]"), _pick("0123456789", h)).when(c.rlike("[a-z]"), _pick(lower, h)).when(c.rlike("[A-Z]"), _pick(upper, h)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _card(value: Column, seed: Column) -> Column:
    drawn = F.concat(F.substring(value, 1, 1), F.substring(_scramble(value, seed), 2, 100))
    body = drawn.substr(F.lit(1), F.length(drawn) - 1)
    check = F.pmod(10 - F.pmod(_luhn(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0"))), F.lit(10)), F.lit(10))
    valid = _luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0
    return F.when(valid, F.concat(body, check.cast("string"))).otherwise(drawn)


def _ip(value: Column, seed: Column, attempt: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        h = _stream(seed, i)
        # short octets make few addresses: past the first draws any will do
        low = F.when(attempt > 3, 0).when(F.length(o) == 3, 100).when(F.length(o) == 2, 10).otherwise(0)
        span = F.when(attempt > 3, 256).when(F.length(o) == 3, 156).when(F.length(o) == 2, 90).otherwise(10)
        return (low + F.pmod(h, span)).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _person(value: Column, seed: Column) -> Column:
    given, family = F.regexp_extract(value, r"^(\S+) ", 1), F.regexp_extract(value, r" (\S+)$", 1)
    h, g = _stream(seed, F.lit(0)), _stream(seed, F.lit(1))
    first, last = given, family
    for (gender, script), names in GIVEN.items():
        take = lambda pool, x: F.element_at(F.array(*[F.lit(n) for n in pool]), (F.pmod(x, F.lit(len(pool))) + 1).cast("int"))
        first = F.when(given.isin(names), take(names, h)).otherwise(first)
        family_names = [n + "а" for n in SURNAMES[script]] if (gender, script) == ("f", "Cyrillic") else SURNAMES[script]
        last = F.when(given.isin(names), take(family_names, g)).otherwise(last)
    return F.concat(first, F.lit(" "), last)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    # a value with few letters has few surrogates: past the first draws an address is made longer
    longer = F.when(attempt > 3, F.lower(F.translate(F.substring(F.hex(_stream(seed, F.lit(3))), 1, 6), "0123456789", "ghijklmnop"))).otherwise(F.lit(""))
    mail = F.concat(longer, _scramble(F.regexp_extract(value, r"^(.*)\.[^.]*$", 1), seed), F.regexp_extract(value, r"(\.[^.]*)$", 1))
    # the names' combinations are few: past the first draws surnames are made longer, so that there is always another
    more = F.when(attempt > 3, F.concat(F.lit("-"), F.initcap(F.translate(F.substring(F.hex(_stream(seed, F.lit(2))), 1, 4), "0123456789", "ghijklmnop")))).otherwise(F.lit(""))
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", _scramble(value, seed, hexadecimal=True))
        .when(kind == "key", F.concat(F.substring(value, 1, 4), F.substring(_scramble(value, seed), 5, 1000)))
        .when(kind == "card", _card(value, seed))
        .when(kind == "ip", _ip(value, seed, attempt))
        .when(kind == "phone", F.concat(F.regexp_extract(value, r"^(\+\d{1,3}[ .-]?)?", 0), _scramble(F.regexp_replace(value, r"^\+\d{1,3}[ .-]?", ""), seed)))
        .when(kind == "person", F.concat(_person(value, seed), more))
        .otherwise(_scramble(value, seed))
    )


def distinct_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value) distinct -> (kind, value, surrogate), no two alike and none of them a value."""
    settled, rest, attempt = None, values.withColumn("attempt", F.lit(0)), 0
    while True:
        drawn = written(rest.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))), "drawn")
        used = values.select(F.col("value").alias("surrogate"))
        if settled is not None:
            used = used.union(settled.select("surrogate")).distinct()
        rank = F.row_number().over(Window.partitionBy("surrogate").orderBy("kind", "value"))
        taken = drawn.join(used.withColumn("_used", F.lit(True)), "surrogate", "left").withColumn("_n", rank)
        taken = written(taken.withColumn("_good", F.col("_used").isNull() & (F.col("_n") == 1)), "checked")
        drop(drawn)
        good = taken.filter("_good").select("kind", "value", "surrogate")
        settled = good if settled is None else settled.union(good)
        attempt += 1
        rest = taken.filter("not _good").select("kind", "value", F.lit(attempt).alias("attempt"))
        if rest.isEmpty():
            return settled


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, uid, place, kind, value: every entity of every text, in order."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("place", "value")
    rows = docs.filter(has_entity(F.col("text"))).select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), found)
    return rows.select("doc_id", "uid", "place", kind_of(F.col("value")).alias("kind"), "value")


def replaced(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """The documents with their texts' entities replaced, all their columns, and _entities, the number of entities."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    found = written(mentions(docs), "mentions")
    values = written(found.select("kind", "value").distinct(), "values")
    drawn = distinct_surrogates(values, key)
    by_doc = found.dropDuplicates(["uid", "place"]).join(drawn, ["kind", "value"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("_s"))
    has = has_entity(F.col("text"))
    touched = docs.filter(has).withColumn("_uid", F.xxhash64("doc_id", "text")).join(by_doc.withColumnRenamed("uid", "_uid"), "_uid")
    between = F.split("text", PATTERN)
    text = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("_s")), F.col("_s.surrogate"), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    touched = touched.withColumns({"text": text, "_entities": F.size("_s").cast("long")}).select(*docs.columns, "_entities")
    return docs.filter(~has).withColumn("_entities", F.lit(0).cast("long")).union(touched)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_entities").alias("n_entities"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.when(F.col("_entities") > 0, F.col("text")).alias("text"))


QUERIES = {"op10_pii": op10_pii}
SQL: dict[str, str] = {}
