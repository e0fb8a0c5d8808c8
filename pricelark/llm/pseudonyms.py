"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates are found by pattern and validated: cards by their check digit, addresses by
their octets, dates by the calendar. Valid ones are permuted within their format, letters,
digits, separators and check digits staying what they are, so that equal values have equal
pseudonyms in all documents and different values different ones; the rest is left alone. Cards,
phone and social numbers permute digits; addresses permute octets; dates permute days of 1900
to 2099; mail names and access keys permute letters and digits within their class. Country
codes, mail domains and the fixed beginning of access keys are kept.

The permutation takes FEISTEL rounds: half of the symbols are shifted by a SHA-256 of the key,
the kind, the round and the other half. Who has the key can undo it; it is a parameter.

Null texts count as empty. Repeated rows give equal rows; an empty table an empty result.
Further columns are never read. All within the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.text import settled, whole

FEISTEL = 4  # rounds; even, so that both halves end where they began
DAY_ONE, DAYS = "1900-01-01", (250, 292)  # 73,000 days, to 2099-11-13, as two digits of a mixed base
STREAM = 16  # shifts from one hash; beyond, they repeat

# kind: (pattern, what a whole match looks like); the first that fits counts
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ -]?\(\d{3}\) ?|\+\d{1,3}[ -]\d{3}[ -]|\(\d{3}\) ?|(?<![\w-])\d{3}[-.])\d{3}[-. ]\d{4}(?![\w-])",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "access": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "secret": r"(?<=password=|token = \")[0-9A-Za-z]{8,64}(?!\w)",
}
PATTERN = "|".join(f"(?:{x})" for x in KINDS.values())
SHAPES = {  # of a whole match, in this order
    "email": "@",
    "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$",
    "ip": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "social": r"^\d{3}-\d{2}-\d{4}$",
    "phone": r"^(?:\+|\(|\d{3}[-.]\d{3}[-. ])",
    "access": "^AKIA",
    "secret": "[A-Za-z]|^[0-9]{8,12}$",
    "card": "^[0-9]",
}


def feistel(values: Column, bases: Column, key: str, kind: str) -> Column:
    """values permuted: each stays below its base."""
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half

    def part(x: Column, first: bool) -> Column:
        return F.slice(x, F.lit(1), half) if first else F.slice(x, half + 1, rest)

    start = F.struct(
        part(values, True).alias("a"), part(values, False).alias("b"), part(bases, True).alias("m"), part(bases, False).alias("n")
    )

    def step(s: Column, r: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(s["b"].cast("array<string>"), ","))
        stream = F.sha2(said, 256)

        def shifted(v: Column, i: Column) -> Column:
            shift = F.conv(F.substring(stream, (i % STREAM) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return ((v + shift) % F.get(s["m"], i)).cast("int")

        return F.struct(
            s["b"].alias("a"), F.transform(s["a"], shifted).alias("b"), s["n"].alias("m"), s["m"].alias("n")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(FEISTEL)), start, step, lambda s: F.concat(s["a"], s["b"]))


def base(c: Column) -> Column:
    """Size of a character's class, 1 if it is fixed."""
    letter = ((c >= "a") & (c <= "z")) | ((c >= "A") & (c <= "Z"))
    return F.when((c >= "0") & (c <= "9"), 10).when(letter, 26).otherwise(1)


def zero(c: Column) -> Column:
    """Code of the first character of the class."""
    return F.when(c <= "9", 48).when(c <= "Z", 65).otherwise(97)


def permuted(text: Column, key: str, kind: str) -> Column:
    """The text with its letters and digits permuted, each within its class."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    loose = F.filter(chars, lambda c: base(c) > 1)
    new = feistel(F.transform(loose, lambda c: F.ascii(c) - zero(c)), F.transform(loose, base), key, kind)
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"), new.alias("new"))

    def put(s: Column, c: Column) -> Column:
        own = F.char(F.get(s["new"], s["k"]) + zero(c))
        return F.struct(
            (s["k"] + F.when(base(c) > 1, 1).otherwise(0)).alias("k"),
            F.concat(s["out"], F.when(base(c) > 1, own).otherwise(c)).alias("out"),
            s["new"].alias("new"),
        )

    return F.aggregate(chars, start, put, lambda s: s["out"])


def card(h: Column, key: str) -> Column:
    """All digits but the last are permuted; the last becomes the new check digit."""
    body = permuted(F.substring(h, F.lit(1), F.length(h) - 1), key, "card")
    digits = F.regexp_replace(body, "[^0-9]", "")
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: F.call_function("luhn_check", F.concat(digits, x.cast("string"))))
    return F.when(
        F.call_function("luhn_check", F.regexp_replace(h, "[^0-9]", "")), F.concat(body, F.get(check, F.lit(0)).cast("string"))
    )


def address(h: Column, key: str) -> Column:
    octets = F.split(h, r"\.").cast("array<int>")
    new = feistel(octets, F.array_repeat(F.lit(256), 4), key, "ip")
    return F.when(F.forall(octets, lambda x: x <= 255), F.array_join(new.cast("array<string>"), "."))


def date(h: Column, key: str) -> Column:
    def moved(form: str) -> Column:
        day = F.try_to_timestamp(h, F.lit(form)).cast("date")
        n = F.datediff(day, F.lit(DAY_ONE).cast("date"))
        ab = F.array(F.floor(n / DAYS[1]).cast("int"), (n % DAYS[1]).cast("int"))
        new = feistel(ab, F.array(F.lit(DAYS[0]), F.lit(DAYS[1])), key, "date")
        to = F.date_add(F.lit(DAY_ONE).cast("date"), F.get(new, F.lit(0)) * DAYS[1] + F.get(new, F.lit(1)))
        return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), F.date_format(to, form))

    return (
        F.when(h.contains("-"), moved("yyyy-MM-dd"))
        .when(h.contains("/"), F.coalesce(moved("dd/MM/yyyy"), moved("MM/dd/yyyy")))
        .otherwise(moved("dd.MM.yyyy"))
    )


def kept_start(h: Column, start: Column, key: str, kind: str) -> Column:
    """Permuted behind the first `start` characters."""
    return F.concat(F.substring(h, F.lit(1), start), permuted(F.substring(h, start + 1, F.length(h)), key, kind))


def kind_of(h: Column) -> Column:
    out = None
    for kind, shape in SHAPES.items():
        out = F.when(h.rlike(shape), kind) if out is None else out.when(h.rlike(shape), kind)
    return out


def pseudonym(h: Column, key: str) -> Column:
    """What a match becomes; null if it is not valid."""
    country = F.length(F.regexp_extract(h, r"^(\+\d{1,3})?", 0))
    name = F.substring_index(h, "@", 1)
    kind = kind_of(h)
    return (
        F.when(kind == "email", F.concat(permuted(name, key, "email"), F.substring(h, F.length(name) + 1, F.length(h))))
        .when(kind == "date", date(h, key))
        .when(kind == "ip", address(h, key))
        .when(kind == "social", permuted(h, key, "social"))
        .when(kind == "phone", kept_start(h, country, key, "phone"))
        .when(kind == "access", kept_start(h, F.lit(4), key, "access"))
        .when(kind == "secret", permuted(h, key, "secret"))
        .otherwise(card(h, key))
    )


def masked(docs: DataFrame, key: str = "pricelark") -> DataFrame:
    """doc_id, text with pseudonyms, and `found`: (kind, original, pseudonym) of every valid match."""
    d = docs.select("doc_id", whole().alias("t"))
    hits = F.when(F.col("t").rlike("[0-9@]"), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0)))
    d = settled(d.withColumn("hits", hits))
    some = F.size("hits") > 0
    new = F.transform("hits", lambda h: pseudonym(h, key))
    d = settled(d.withColumn("new", F.when(some, new)))
    pieces = F.split("t", PATTERN, -1)
    shown = F.zip_with("hits", "new", lambda h, n: F.coalesce(n, h))
    woven = F.zip_with(pieces, shown, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))

    def entry(h: Column, n: Column) -> Column:
        return F.struct(kind_of(h).alias("kind"), h.alias("original"), n.alias("pseudonym"))

    found = F.zip_with("hits", "new", entry)
    none = F.array().cast("array<struct<kind:string,original:string,pseudonym:string>>")
    return settled(
        d.select(
            "doc_id",
            F.when(some, F.array_join(woven, "")).otherwise(F.col("t")).alias("text"),
            F.when(some, F.filter(found, lambda x: x["pseudonym"].isNotNull())).otherwise(none).alias("found"),
        )
    )
