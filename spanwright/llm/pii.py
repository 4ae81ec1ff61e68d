"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; validators (Luhn, mod 97, value ranges, digit counts) confirm
them; words near a span raise its score. Positions are code points. Possessive quantifiers and
look-behinds give the same leftmost matches as the plain patterns, in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A part of an address up to 255, leading zeros allowed.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
#: What proposes spans of each kind. A match starts where the last one ended or where a
#: run of its first characters starts: from inside a run the same characters follow.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only runs of 12 to 19 digits: shorter and longer ones are whole matches that fail
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # country and check digits only; what may follow them is seen, not taken, as words or a number can stand behind
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # a run of 20 key characters or more behind its name, if there is any, and an equals sign; its own form or the words near it make it a secret
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])",
}
#: Score of a confirmed span without context, and words that raise it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": "mail|contact|write to|address",
    "ip": "ip|host|server|address|login",
    "card": "card|credit|visa|mastercard|payment|cc",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|transfer",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|password|passwd|pwd|passphrase|bearer|credentials?|(?:api|access|private|secret|auth)[ _-]?key",
}
#: Code points to each side in which context words count, what they add, and the least score of an added span.
REACH, BOOST, LEAST = 40, 0.3, 0.5
ADDED = ("iban", "ssn", "secret")
#: Beginnings of keys that well-known services hand out; such a key needs no context.
ISSUED = r"(?:^|[^A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])"
#: Words and numbers between separators, as in paths: such a run is no key.
WORDS = r"^(?:(?:[A-Z]?[a-z]++[0-9]{0,4}|[A-Z]++[0-9]{0,4}|[0-9]++)(?:[/_+=-]++|$))++$"
#: Different characters of a key, at least; it also has a digit and a letter.
VARIED = 9
BLOCK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"
#: Characters of country and check digits, and lengths of account numbers by country (ISO 13616).
HEAD = 4
LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _running(lengths: Column) -> Column:
    """Sums of the elements up to and including each, block by block: never quadratic in long arrays."""
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    none = F.array().cast("array<int>")
    sums = F.transform(blocks, lambda b: F.aggregate(b, none, grow))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(s, -1))))
    return F.flatten(F.zip_with(sums, F.slice(before, 1, F.size(before) - 1), lambda s, b: F.transform(s, lambda x: x + b)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (F.ascii(d) - 48) * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 when its rearranged digits are divided by 97."""
    moved = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    step = lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _account(run: Column) -> Column:
    """The account number that a run of groups begins with, null if none does.

    Tried are all prefixes that end where a group ends. Of those that pass mod 97 the one with the
    country's own length counts, else the longest.
    """
    groups = F.split(run, " ")
    own = F.create_map(*(F.lit(x) for n, countries in LENGTHS.items() for c in countries.split() for x in (c, n)))

    def prefix(k: Column) -> Column:
        part = F.slice(groups, F.lit(1), k)
        plain = F.array_join(part, "")
        n = F.length(plain)
        is_own = F.coalesce(F.try_element_at(own, F.left(run, F.lit(2))) == n, F.lit(False))
        return F.struct(is_own.alias("own"), n.alias("n"), F.array_join(part, " ").alias("m"), plain.alias("plain"))

    tried = F.transform(F.sequence(F.lit(1), F.size(groups)), prefix)
    return F.array_max(F.filter(tried, lambda p: p["n"].between(15, 34) & mod97(p["plain"])))["m"]


def _apart(spans: Column) -> Column:
    """Spans in their order without those that start inside an earlier one that stays; block by block."""
    none = F.array().cast(f"array<{SPAN}>")
    blocks = F.transform(F.sequence(F.lit(0), (F.greatest(F.size(spans) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))
    state = lambda end, kept: F.struct(end.alias("end"), kept.alias("kept"))
    keep = lambda acc, s: F.when(s["start"] >= acc["end"], state(s["end"], F.concat(acc["kept"], F.array(s)))).otherwise(acc)

    def through(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, state(acc["end"], none), keep)
        return state(done["end"], F.concat(acc["kept"], F.array(done["kept"])))

    start = state(F.lit(0), F.array().cast(f"array<array<{SPAN}>>"))
    return F.aggregate(blocks, start, through, lambda acc: F.flatten(acc["kept"]))


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(f"^{PART}(?:\\.{PART}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return m.isNotNull()
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(WORDS) & (F.size(F.array_distinct(F.split(m, ""))) >= VARIED)
    return F.lit(True)


def _near(before: Column, after: Column) -> Column:
    """What stands up to REACH code points from a match, between the matches of its kind."""
    return F.lower(F.concat_ws(" | ", F.right(before, F.lit(REACH)), F.left(after, F.lit(REACH))))


def _score(kind: str, near: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), BOOST).otherwise(0.0))


def _spans(kind: str, rank: int, matches: Column, ends: Column, near: Column) -> Column:
    """The confirmed spans of a kind; of a kind of ADDED those with the least score at least."""

    def span(x: Column, near: Column) -> Column:
        m, end = x["m"], x["end"]
        start = end - F.length(m)
        score = _score(kind, near)
        if kind == "secret":
            score = F.when(m.rlike(ISSUED), F.lit(0.9)).otherwise(score)
        score = F.when(_confirmed(kind, m), score)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    least = LEAST if kind in ADDED else 0.0
    both = F.zip_with(matches, ends, lambda m, end: F.struct(m.alias("m"), end.alias("end")))
    return F.filter(F.zip_with(both, near, span), lambda s: s["score"] >= least)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns one row per input row: ``doc_id, text, spans``; a span has ``start, rank, end, kind,
    score``, sorted by start and then kind (by KINDS). Kinds of ADDED are kept only if their score
    reaches LEAST; the others always. A null text counts as empty and has no spans. Repeated rows
    each give their row; other columns are not read, whatever their names; an empty table gives an
    empty result.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    has = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "iban": F.col("text").rlike("[A-Z]{2}[0-9]{2}"), "secret": F.col("text").rlike("[A-Za-z0-9+/_-]{20}")}
    digits = F.col("text").rlike(r"[0-9][0-9\x20.-][0-9.\x20-]")
    strings, ints = "array<string>", "array<int>"
    df = df.withColumn("digits", digits)
    for kind, pattern in PATTERNS.items():
        found = F.when(has.get(kind, F.col("digits")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        df = df.withColumn(f"m_{kind}", F.coalesce(found, F.array().cast(strings)))
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        matches = F.col(f"m_{kind}")
        between = F.when(F.size(matches) > 0, F.split("text", pattern, -1))
        df = df.withColumn(f"b_{kind}", F.coalesce(between, F.array().cast(strings)))
        df = df.withColumn(f"l_{kind}", F.zip_with(F.slice(f"b_{kind}", 1, F.size(matches)), matches, lambda b, m: F.length(b) + F.length(m)))
        df = df.withColumn(f"e_{kind}", F.when(F.size(f"l_{kind}") > 0, _running(F.col(f"l_{kind}"))).otherwise(F.array().cast(ints)))

        ends, after = F.col(f"e_{kind}"), F.slice(f"b_{kind}", 2, F.size(matches))
        if kind == "iban":
            runs = F.when(F.size(matches) > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
            accounts = F.zip_with(matches, runs, lambda m, run: _account(F.concat(m, run)))
            df = df.withColumn("a_iban", F.coalesce(accounts, F.array().cast(strings)))
            numbers = F.col("a_iban")
            ends = F.zip_with(ends, numbers, lambda end, m: end + F.length(m) - HEAD)
            after = F.zip_with(after, numbers, lambda a, m: F.substr(a, F.length(m) - HEAD + 1))
        near = F.zip_with(F.slice(f"b_{kind}", 1, F.size(matches)), after, _near)
        spans = _spans(kind, rank, numbers if kind == "iban" else matches, ends, near)
        parts.append(_apart(spans) if kind == "iban" else spans)
    return df.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, and the spans with their scores."""
    base = F.filter("spans", lambda s: s["rank"] < 4)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    kinds = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *kinds, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))


def mask() -> Column:
    """The text of a row of ``find`` with a label in place of each span; of overlapping spans the first."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            F.concat(acc["parts"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"),
            s["end"].alias("at"),
        ),
    ).otherwise(acc)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    done = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.lit(2**30)))
    return F.when(F.size("spans") > 0, F.aggregate("spans", start, step, done)).otherwise(F.col("text"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` counted anew.

    All rows and columns are kept, repeated ones too; null texts stay null. Without a column
    ``n_chars`` none is added. An empty table gives an empty result.
    """
    names = docs.columns
    held = docs.select(F.struct(*names).alias("held"), F.col("text"))
    found = find(held, "held", "text").withColumn("clean", mask())
    row = F.col("doc_id")
    text = F.when(row["text"].isNotNull(), F.col("clean"))
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(fresh.get(c, row[c]).alias(c) for c in names))
