"""Personal data and secrets replaced by surrogates; DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, social
security and phone numbers, card numbers (with a valid check digit), access
keys, long hexadecimal tokens, values of a password or key, and names after a
form of address. A name that was found is also replaced where the same document
mentions it without one. Each kind has a canonical form (digits only, lower case, a single name), so an entity written
in several ways stays one entity.

A surrogate is drawn from a keyed hash of kind, canonical form and attempt. It
keeps the kind's shape: digits for digits, letters for letters, the country
prefix, the top-level domain, the card's first digit and a valid check digit,
an address block for private networks, and for names script and gender. Then
collisions are checked over the whole corpus: a surrogate that is somebody's
real value, or that another entity got first, is drawn again. So different
entities stay different, and one entity has one surrogate everywhere. Where a
form has too few surrogates, later attempts lengthen or leave it.

Only documents with entities are shuffled; entity tables are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import staged

#: Forms of address before names of women, of men and of either.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Signor", "Господин", "Κύριος")
EITHER = ("Dr", "Prof")
_TITLE = "|".join(sorted([*FEMALE, *MALE, *EITHER], key=len, reverse=True))
#: A name of two letters or more, with inner capitals, hyphens and apostrophes, without a possessive. Possessive
#: quantifiers, here and below: long runs are matched in a loop, not by recursion.
_NAME = r"\p{Lu}(?:['’]\p{Lu})?+[\p{L}\p{M}]++(?:['’](?![Ss](?!\p{L}))\p{Lu}[\p{L}\p{M}]*+|-\p{L}[\p{L}\p{M}]*+)*+"
NAMED = rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})*+"
#: Words in which a name may be mentioned without a form of address.
BARE = rf"(?<![\p{{L}}\p{{M}}]){_NAME}(?: {_NAME})*+"
_LABEL = "password|passwd|pwd|secret|api_key|apikey|access_token|token"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Patterns of the kinds, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9])(?:{_LABEL})[=:][^\s\"',;]{{6,}}",
    "name": NAMED,
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap test that every text with an entity passes.
MAYBE = rf"[0-9@]|AKIA|(?:{_LABEL})[=:]|(?:{_TITLE})\.? \p{{Lu}}"
#: Beginnings and ends of drawn names, by script.
SYLLABLES = {
    "latin": ("ba be bi bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi".split(), "n r s k l m t d".split(), "a ia ea ina ela ana ora issa".split()),
    "cyrillic": ("ба бе би бо да де до га го ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то ва ве ви".split(), "н р с к л м т д".split(), "а ия ея ина ела ана ора иса".split()),
    "greek": ("βα βε βι βο δα δε δο γα γο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε το".split(), "ν ρ ς".split(), "α ια εα ινα ελα ανα ορα".split()),
}
#: Letters drawn for letters of these scripts, in secrets; those of other scripts become Latin.
ALPHABETS = {"Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Attempts after which a form grows (GROW), a private network is left (ROAM) and an address of four bytes, too (LEAVE).
GROW, ROAM, LEAVE = 4, 4, 12
#: A bound for a mistake in the code: every form is long before.
ATTEMPTS = 64


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th of 64 bytes of a hexadecimal digest."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(digest, (2 * at + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letters(value: Column, each) -> Column:
    """``value`` with each character replaced by each(character, index from 0)."""
    return F.array_join(F.transform(F.split(value, ""), each), "")


def _once(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body has it in a loop over characters or words."""
    return F.get(F.transform(F.array(value), body), 0)


def _drawn(value: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case, the rest as it is."""
    def each(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + b % 26))
                .when(c.rlike("[A-Z]"), F.char(65 + b % 26)).otherwise(c))
    return _letters(value, each)


def _drawn_secret(value: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same script and case; a value without either gets a keyed tail."""
    def each(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        out = F.when(c.rlike(r"\p{N}"), (b % 10).cast("string"))
        for script, letters in ALPHABETS.items():
            of = rf"\p{{Is{script}}}"
            at = (b % len(letters) + 1).cast("int")
            out = (out.when(c.rlike(rf"(?=\p{{Lu}}){of}"), F.substring(F.lit(letters.upper()), at, F.lit(1)))
                   .when(c.rlike(rf"(?=\p{{L}}){of}"), F.substring(F.lit(letters), at, F.lit(1))))
        return out.when(c.rlike(r"\p{Lu}"), F.char(65 + b % 26)).when(c.rlike(r"\p{L}"), F.char(97 + b % 26)).otherwise(c)
    return F.concat(_letters(value, each), F.when(value.rlike(r"[\p{L}\p{N}]"), "").otherwise(F.substring(digest, 1, 16)))


def luhn_sum(digits: Column) -> Column:
    """The check sum of a card number; a valid one is divisible by ten."""
    def each(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), each), F.lit(0), lambda a, x: a + x)


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _pick(options: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), index % len(options))


def surrogate(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """The value drawn for an entity at this attempt, in canonical form."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{attempt}|"), kind, F.lit("|"), canon), 512)
    return _once(digest, lambda h: _from_digest(kind, canon, key, attempt, h))


def _from_digest(kind: Column, canon: Column, key: str, attempt: int, h: Column) -> Column:
    more = F.lit("") if attempt < GROW else F.substring(h, 100, attempt)  # short forms have few neighbours: grow
    longer = F.concat(canon, F.lit("0" * max(0, attempt - GROW + 1)))  # the same for numbers
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    body = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    # a domain's surrogate hangs on the domain alone, so that colleagues stay colleagues
    email = F.concat(_drawn(local, h), more, F.lit("@"), _once(F.sha2(F.concat(F.lit(f"{key}|domain|"), domain), 512), lambda d: _drawn(body, d)), top)
    octet = lambda i: F.regexp_extract(canon, r"(\d+)\.(\d+)\.(\d+)\.(\d+)", i)
    byte = [_byte(h, i).cast("string") for i in range(4)]
    wide = F.concat_ws(".", (_byte(h, 9) % 99 + 11).cast("string"), *byte[1:])
    if attempt < ROAM:
        ip = (F.when(octet(1).isin("10", "127"), F.concat_ws(".", octet(1), *byte[1:]))
              .when(canon.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), *byte[2:]))
              .when(canon.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), (_byte(h, 9) % 16 + 16).cast("string"), *byte[2:]))
              .otherwise(wide))
    elif attempt < LEAVE:  # another private network has more room
        ip = F.when(canon.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\."), F.concat_ws(".", F.lit("10"), *byte[1:])).otherwise(wide)
    else:  # a local address of sixteen bytes
        ip = F.concat(F.lit("fd"), F.substring(h, 1, 2), *[F.concat(F.lit(":"), F.substring(h, 3 + 4 * i, 4)) for i in range(7)])
    number = _letters(longer, lambda c, i: F.when((i == 0) | (i == F.length(canon) - 7), (_byte(h, i) % 8 + 2).cast("string")).otherwise((_byte(h, i) % 10).cast("string")))
    stem = F.concat(F.substring(canon, 1, 1), _letters(F.substring(longer, F.lit(2), F.length(longer) - 2), lambda c, i: (_byte(h, i) % 10).cast("string")))
    card = F.concat(stem, ((10 - luhn_sum(F.concat(stem, F.lit("0"))) % 10) % 10).cast("string"))
    token = _letters(canon, lambda c, i: F.substring(F.lit("0123456789abcdef"), _byte(h, i) % 16 + 1, F.lit(1)))
    access = F.concat(F.lit("AKIA"), _drawn(F.substring(canon, 5, 16), h))

    def name(script: str) -> Column:
        first, men, women = SYLLABLES[script]
        begin = F.concat(_pick(first, _byte(h, 1)), _pick(first, _byte(h, 2)), F.when(_byte(h, 3) % 2 == 0, _pick(first, _byte(h, 4))).otherwise(""),
                         *([_pick(first, _byte(h, 5 + k)) for k in range(attempt // 2)]))
        women_end, men_end = _pick(women, _byte(h, 30)), _pick(men, _byte(h, 31))
        return F.initcap(F.concat(begin, F.when(kind == "name_f", women_end).when(kind == "name_m", men_end).otherwise(F.when(_byte(h, 32) % 2 == 0, men_end).otherwise(F.concat(men_end, women_end)))))
    names = F.when(canon.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("phone", "ssn"), number).when(kind == "card", card)
            .when(kind == "secret", F.concat(F.when(canon.rlike("^[0-9a-f]+$"), token).otherwise(_drawn_secret(canon, h)), more))
            .when(kind == "token", F.concat(token, more)).when(kind == "access_key", access).otherwise(F.lower(names)))


def _kind(raw: Column) -> Column:
    """The kind of a match; null for a long number without a valid check digit."""
    tests = {kind: raw.rlike(f"^(?:{pattern})$") for kind, pattern in PATTERNS.items()}
    tests["card"] &= luhn_sum(_only_digits(raw)) % 10 == 0
    return F.coalesce(*[F.when(test, kind) for kind, test in tests.items()])


def _pieces(idx: Column, raw: Column) -> Column:
    """A match as an array of (idx, sub, lead, kind, canon, raw): one entity, or each name after a form of address."""
    kind = _kind(raw)
    digits = _only_digits(raw)
    label = rf"^(?:{_LABEL})[=:]"
    canon = (F.when(kind == "email", F.lower(raw)).when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits))
             .when(kind.isin("ssn", "card"), digits).otherwise(F.regexp_replace(raw, label, "")))
    words = F.split(raw, " ")
    title = F.regexp_replace(F.get(words, 0), r"\.$", "")
    gender = F.when(title.isin(*FEMALE), "name_f").when(title.isin(*MALE), "name_m").otherwise("name")
    entity = lambda sub, lead, k, c, r: F.struct(idx.alias("idx"), sub.cast("int").alias("sub"), lead.alias("lead"), k.alias("kind"), c.alias("canon"), r.alias("raw"))
    # the last name is a family name, which has no gender; those before it follow the form of address
    names = _once(F.struct(words.alias("words"), gender.alias("gender")), lambda p: F.transform(F.slice(p["words"], F.lit(2), F.size(p["words"]) - 1), lambda w, i: entity(
        i, F.when(i == 0, F.concat(F.get(p["words"], 0), F.lit(" "))).otherwise(F.lit(" ")), F.when(i == F.size(p["words"]) - 2, "surname").otherwise(p["gender"]), F.lower(w), w)))
    value = F.when(kind == "secret", canon).otherwise(raw)
    single = F.array(entity(F.lit(0), F.when(kind == "secret", F.regexp_extract(raw, label, 0)).otherwise(""), kind, canon, value))
    return F.when(kind == "name", names).otherwise(single)


def _written(raw: Column, kind: Column, canon: Column, drawn: Column) -> Column:
    """A surrogate in the way in which its entity was written."""
    extra = F.length(_only_digits(raw)) - F.length(canon)  # a country prefix stays
    # the i-th character of a number: its digits so far tell which digit of the surrogate it takes
    numbered = _letters(raw, lambda c, i: F.when(c.rlike("[0-9]"), F.coalesce(F.nullif(F.substring(
        drawn, (F.length(_only_digits(F.substring(raw, F.lit(1), i + 1))) - extra).cast("int"), F.when(F.length(_only_digits(F.substring(raw, F.lit(1), i + 1))) > extra, 1).otherwise(0)), F.lit("")), c)).otherwise(c))
    numbered = F.concat(numbered, F.substring(drawn, F.length(canon) + 1, F.length(drawn)))  # what a grown number has more
    worded = F.when(raw == F.upper(raw), F.upper(drawn)).when(F.substring(raw, 1, 1) != F.lower(F.substring(raw, 1, 1)), F.initcap(drawn)).otherwise(drawn)
    return (F.when(drawn.isNull(), raw).when(kind.isin("phone", "ssn", "card"), numbered)
            .when(kind == "email", F.when(raw == F.upper(raw), F.upper(drawn)).otherwise(drawn)).when(kind.isin("ip", "token", "access_key", "secret"), drawn).otherwise(worded))


def _mentions(named: DataFrame, pieces: DataFrame, table: DataFrame) -> DataFrame:
    """(hash, idx, sub, at, nth, s, hit): the texts between the matches in documents with names, cut at capitalised
    words; ``hit`` marks a word that is one of the document's names, and s has its surrogate."""
    run = lambda idx, at, lead, words: F.transform(
        F.coalesce(words, F.array(F.lit(None).cast("string"))), lambda w, k: F.struct(
            idx.alias("idx"), at.alias("at"), k.alias("nth"), F.when(k == 0, lead).otherwise(" ").alias("lead"), w.alias("word")))
    # the text before each run of such words, and the run; after the last one only a text
    runs = lambda s: F.arrays_zip(F.split(s, BARE, -1).alias("lead"), F.regexp_extract_all(s, F.lit(BARE), F.lit(0)).alias("run"))
    between = F.transform(F.split("text", ENTITY, -1), lambda s, i: F.flatten(F.transform(runs(s), lambda z, j: run(i, j, z["lead"], F.split(z["run"], " ")))))
    texts = named.groupBy("hash").agg(F.first("text").alias("text"))
    words = texts.select("hash", F.inline(F.flatten(between))).withColumn("canon", F.lower("word"))
    names = (pieces.where(F.col("kind").isin("name", "name_f", "name_m", "surname")).groupBy("hash", "canon").agg(F.min("kind").alias("kind"))
             .join(table, ["kind", "canon"]))
    word = F.coalesce(_written(F.col("word"), F.col("kind"), F.col("canon"), F.col("drawn")), F.lit(""))
    return words.join(names, ["hash", "canon"], "left").select(
        "hash", "idx", F.lit(-1).alias("sub"), "at", "nth", F.concat("lead", word).alias("s"), F.col("drawn").isNotNull().alias("hit"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon) -> (kind, canon, drawn), different for different entities of a kind and never a real one."""
    settled: DataFrame | None = None
    pending = entities
    for attempt in range(ATTEMPTS):
        drawn = staged(pending.withColumn("drawn", surrogate(F.col("kind"), F.col("canon"), key, attempt)), "drawn")
        real = entities.select("kind", F.col("canon").alias("drawn"))
        free = drawn.join(real, ["kind", "drawn"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = staged(free.groupBy("kind", "drawn").agg(F.min("canon").alias("canon")).select("kind", "canon", "drawn"), "settled")
        settled = won if settled is None else settled.unionByName(won)
        pending = staged(drawn.select("kind", "canon").join(won, ["kind", "canon"], "left_anti"), "pending")
        if not pending.limit(1).count():
            return settled
    raise RuntimeError("the surrogates did not settle")


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, n_entities.

    Null texts stay null and empty ones empty. Entities count each time they
    occur; a run of capitalised words with names in it is one. Rows that repeat an id are rows of their own; equal texts get equal
    results. An empty table gives no rows. Other columns are not read.
    """
    found = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    has_name = F.exists("raws", lambda r: r.rlike(f"^(?:{NAMED})$"))
    # only texts with entities are written; the others pass as they are
    hit = staged(rows.withColumn("raws", found).where(F.size("raws") > 0).withColumn("named", has_name).withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary")))), "entities", compression="zstd")
    plain = rows.where(~F.coalesce(F.size(found) > 0, F.lit(False))).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    matches = hit.select("hash", F.posexplode("raws").alias("idx", "raw")).distinct()
    pieces = staged(matches.select("hash", F.inline(_pieces(F.col("idx"), F.col("raw")))), "pieces", compression="zstd")
    table = surrogates(staged(pieces.where(F.col("kind").isNotNull()).select("kind", "canon").distinct(), "values"), key)
    table = staged(table, "surrogates")
    joined = pieces.join(table, ["kind", "canon"], "left")
    written = F.concat("lead", _written(F.col("raw"), F.col("kind"), F.col("canon"), F.col("drawn")))
    joined = joined.select("hash", "idx", "sub", F.lit(0).alias("at"), F.lit(0).alias("nth"), written.alias("s"), F.col("kind").isNotNull().alias("hit"))
    joined = joined.unionByName(_mentions(hit.where("named"), pieces, table))
    told = staged(joined.groupBy("hash").agg(
        F.collect_list(F.struct("idx", "sub", "at", "nth", "s")).alias("pieces"),
        # a bare mention counts apart from the entity after it
        F.count_distinct(F.when(F.col("hit"), F.struct("idx", F.col("sub") < 0, "at"))).alias("n_entities")), "told", compression="zstd")
    # in documents with names the texts between are among the pieces
    between = F.when(F.col("named"), F.array().cast("array<string>")).otherwise(F.split("text", ENTITY, -1))
    between = F.transform(between, lambda s, i: F.struct(i.alias("idx"), F.lit(-1).alias("sub"), F.lit(0).alias("at"), F.lit(0).alias("nth"), s.alias("s")))
    whole = F.array_join(F.transform(F.array_sort(F.concat(between, "pieces")), lambda p: p["s"]), "")
    changed = hit.select("doc_id", "text", "hash", "named").join(told, "hash").select("doc_id", whole.alias("text"), F.col("n_entities").cast("long").alias("n_entities"))
    return plain.unionByName(changed)
