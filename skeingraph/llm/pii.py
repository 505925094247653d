"""Personal data as format-preserving pseudonyms, with DataFrame functions alone.

Each value found is validated and then permuted within its own format by a keyed
Feistel network, so equal values become equal pseudonyms in every document, nothing
has to be stored, and `reveal` (the same network backwards) restores them.

* card numbers (13 to 19 digits, Luhn): all digits but the last are permuted, the check digit is computed again. Where several
  numbers stand in a row, separated by one space or hyphen, each group and each row of groups of 3 digits or more is tried, so a
  neighbour does not hide a card; a pseudonym that would make other groups the row's cards is permuted again, at most WALK times in all, so there a card's pseudonym may differ
  from the one it has alone, and after WALK steps may not come back. Cards in groups of 1 or 2 digits are found only where they are the whole row;
* IBANs (compact or in groups of four, check digits by modulus 97): the account part is permuted character by character, the check digits are computed again;
* US social security numbers (NNN-NN-NNNN; area not 000, 666 or 9NN, no part all zeros): a permutation of the 898 x 99 x 9999 valid ones;
* IPv4 addresses (four octets): a permutation of 32 bits, halves of 16;
* dates (YYYY-MM-DD, YYYY/MM/DD, D/M/YYYY, D.M.YYYY, D-M-YYYY; real dates of 1700 to 2099): the number of the day among
  the 146,097 of that Gregorian cycle is permuted as 27 x 5411, so one date in two formats stays one date;
* phone numbers: the digits after a leading +1 are permuted, punctuation stays;
* e-mail addresses: letters stay letters and digits digits, up to the last dot; spellings that differ in capitals alone are permuted as one and keep their capitals, so they stay linked;
* credentials (access keys, `sk-` keys, hex secrets after password, token, secret or key, in small letters or capitals): as e-mail, hex digits stay hex digits.

The work is a regular expression's two passes over a text that has a digit or @, and
hashing for what was found only; there is no shuffle. Possessive runs and look-behinds keep the expression linear on long texts.

Defined results: null text stays null, empty text empty; texts without a match are
returned as they are; all columns are kept, extra ones too; repeated rows give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm.common import fresh, table

ROUNDS = 6
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
DATE = r"(?<![\d.-])\d{4}-\d\d-\d\d(?![\d-])|(?<![\d/])\d{4}/\d\d/\d\d(?![\d/])|(?<![\w-])\d{1,2}-\d{1,2}-\d{4}(?![\w-])|(?<![\d./])\d{1,2}/\d{1,2}/\d{4}(?![\d/])|(?<![\d./])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)"
#: A run of numbers of up to 19 digits with 13 digits or more, up to the next value of another kind; `cards` finds the cards in it.
CARD = rf"(?<![\w.+-])(?=\d(?:[ -]?\d){{12}})\d{{1,19}}+(?!\w)(?:(?: (?!{EMAIL}|{IP}|{DATE}|{PHONE})|-(?!{PHONE}))\d{{1,19}}+(?!\w))*+"
RUN = r"^\d{1,19}(?:[ -]\d{1,19})*$"
SECRET = r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_]{20,}+(?![A-Za-z0-9_])|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=(?i:password|token|secret|key) ?[=:] ?[\"']?)[0-9a-fA-F]{16,}+(?![A-Za-z0-9])"
PATTERN = "|".join((EMAIL, IBAN, SSN, IP, DATE, PHONE, CARD, SECRET))


def _number(text: Column, key: str, r: int, domain: str) -> Column:
    """15 hex digits of a keyed hash, as a bigint."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{r}|{domain}|"), text), 256), 1, 15), 16, 10).cast("bigint")


def _rounds(back: bool):
    return range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)


def feistel_pair(a: Column, b: Column, n_a: int, n_b: int, key: str, domain: str, back: bool) -> tuple[Column, Column]:
    """A permutation of pairs, a below n_a and b below n_b: even rounds add to a, odd ones to b."""
    for r in _rounds(back):
        sign = -1 if back else 1
        if r % 2 == 0:
            a = F.pmod(a + sign * (_number(b.cast("string"), key, r, domain) % n_a), F.lit(n_a))
        else:
            b = F.pmod(b + sign * (_number(a.cast("string"), key, r, domain) % n_b), F.lit(n_b))
    return a, b


def _shift(c: Column, by: Column, letters: int) -> Column:
    """A character moved within its class (digits, the first `letters` small letters, as many capitals); others stay."""
    code = F.ascii(c)
    turn = lambda base, n: F.chr(F.pmod(code - base + by, F.lit(n)) + base)
    return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, letters)).when(c.rlike("^[A-Z]$"), turn(65, letters)).otherwise(c)


def _shape(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")


def feistel_chars(s: Column, key: str, domain: str, back: bool, letters: int = 26) -> Column:
    """A permutation of the strings of one shape: each round moves the characters of one half by a keyed hash of the other half and of the shape."""
    half = (F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

    def moved(part: Column, other: Column, r: Column) -> Column:
        digest = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), r.cast("string"), i.cast("string"), _shape(part), other), 256), 1, 6), 16, 10).cast("int")
        sign = -1 if back else 1
        return F.array_join(F.transform(F.split(part, ""), lambda c, i: _shift(c, sign * (digest(i) % 780), letters)), "")

    def step(x: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(moved(x["l"], x["r"], r).alias("l"), x["r"].alias("r"))).otherwise(F.struct(x["l"].alias("l"), moved(x["r"], x["l"], r).alias("r")))

    return F.aggregate(F.array(*[F.lit(r) for r in _rounds(back)]), start, step, lambda x: F.concat(x["l"], x["r"]))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled and its digits added; the rightmost is not doubled."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda x, d: x + F.coalesce(d, F.lit(0)))


def _into(skeleton: Column, digits: Column) -> Column:
    """`digits` in the places of the skeleton's digits."""
    return F.array_join(F.zip_with(F.split(skeleton, "[0-9]", -1), F.array_append(F.split(digits, ""), ""), lambda p, d: F.concat(p, d)), "")


def cards(run: Column) -> Column:
    """array<struct<rank, at, k>>: the cards of a run, each k groups of digits from group `at` (from 0) on.

    Among the Luhn-valid candidates those of one group or of a usual grouping come first, then the others, from left to right and short ones first."""
    groups = F.split(run, "[ -]")
    n = F.size(groups)

    def of(i):
        part = lambda k: F.slice(groups, i + 1, k)
        digits = lambda k: F.array_join(part(k), "")
        usual = lambda k: (k == 1) | F.array_join(F.transform(part(k), F.length), "-").isin("4-4-4-4", "4-6-5", "4-6-4")
        # Columns of small numbers would often be valid by chance, so their groups count as a card only where they are the whole run.
        fits = lambda k: F.length(digits(k)).between(13, 19) & ((k == n) | ~F.exists(part(k), lambda g: F.length(g) < 3))
        valid = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: F.when(fits(k), luhn_sum(digits(k)) % 10 == 0).otherwise(False))
        return F.transform(valid, lambda k: F.struct(F.when(usual(k), 0).otherwise(1).alias("rank"), i.alias("at"), k.alias("k")))

    found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of)))
    apart = lambda x, y: (x["at"] >= y["at"] + y["k"]) | (y["at"] >= x["at"] + x["k"])
    return F.aggregate(found, F.slice(found, 1, 0), lambda kept, x: F.when(F.forall(kept, lambda y: apart(x, y)), F.array_append(kept, x)).otherwise(kept))


def _card(m: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = feistel_chars(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", back)
    return _into(m, F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")))


def _mod97(text: Column) -> Column:
    """Remainder of a run of digits and capitals, letters read as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _iban(m: Column, key: str, back: bool) -> Column:
    """The pseudonym of a valid IBAN; others as they are."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    valid = _mod97(F.concat(rest, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1
    new = feistel_chars(rest, key, "iban", back)
    whole = F.transform(F.array(new), lambda r: F.concat(country, F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))[0]
    return F.when(~valid, m).when(m.contains(" "), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)


def _ssn(m: Column, key: str, back: bool) -> Column:
    part = F.split(m, "-")
    n = lambda i: F.get(part, F.lit(i)).try_cast("bigint")
    # Areas 001 to 899 without 666, from 0 on.
    area = n(0) - 1 - F.when(n(0) > 666, 1).otherwise(0)
    a, b = feistel_pair(area, (n(1) - 1) * 9999 + n(2) - 1, 898, 99 * 9999, key, "ssn", back)
    pad = lambda c, k: F.lpad(c.cast("bigint").cast("string"), k, "0")
    return F.concat_ws("-", pad(a + 1 + F.when(a >= 665, 1).otherwise(0), 3), pad(F.floor(b / 9999) + 1, 2), pad(b % 9999 + 1, 4))


def _cased(new: Column, like: Column) -> Column:
    """new, a text in small letters, with capitals where `like` has them."""
    return F.array_join(F.zip_with(F.split(new, ""), F.split(like, ""), lambda n, o: F.when(o.rlike("^[A-Z]$"), F.upper(n)).otherwise(n)), "")


#: Steps of a walk at most; one in ten or fewer of a run's pseudonyms needs a further step.
WALK = 10


def _run(m: Column, key: str, back: bool) -> Column:
    """A run with its cards permuted, again until the same groups are its cards, so that the way back finds them."""

    def moved(text, of):
        parts = F.regexp_extract_all(text, F.lit("[ -]?[0-9]+"), F.lit(0))

        def part(p, i):
            card = F.filter(of, lambda x: (x["at"] <= i) & (i < x["at"] + x["k"]))
            whole = F.array_join(F.slice(parts, i + 1, F.get(card, F.lit(0))["k"]), "")
            return F.when(F.size(card) == 0, p).when(F.get(card, F.lit(0))["at"] == i, _card(whole, key, back)).otherwise("")

        return F.array_join(F.transform(parts, part), "")

    def walk(of):
        def step(x, _):
            new = F.transform(F.array(moved(x["text"], of)), lambda t: F.struct(t.alias("text"), (cards(t) == of).alias("done")))
            return F.when(x["done"], x).otherwise(F.get(new, F.lit(0)))

        start = F.struct(m.alias("text"), (F.size(of) == 0).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda x: x["text"])

    return F.get(F.transform(F.array(cards(m)), walk), F.lit(0))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one match of PATTERN; the match itself if it isn't valid."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    card = F.when(m.rlike("[ -]"), _run(m, key, back)).when((F.length(m) >= 13) & (luhn_sum(digits) % 10 == 0), _card(m, key, back)).otherwise(m)
    octet = F.split(m, r"\.")
    o = lambda i: F.get(octet, F.lit(i)).try_cast("bigint")
    hi, lo = feistel_pair(o(0) * 256 + o(1), o(2) * 256 + o(3), 65536, 65536, key, "ip", back)
    ip = F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(hi, 8), hi % 256, F.shiftright(lo, 8), lo % 256)])
    first, cycle = F.lit("1700-01-01").cast("date"), 27 * 5411
    part = F.split(m, r"[-/.]")
    iso = m.rlike(r"^\d{4}[-/]")
    p = lambda i: F.lpad(F.get(part, F.lit(i)), 2, "0")
    date = F.when(iso, F.concat_ws("-", part)).otherwise(F.concat_ws("-", F.get(part, F.lit(2)), p(1), p(0))).try_cast("date")
    day = F.date_diff(date, first).cast("bigint")
    a, b = feistel_pair(F.floor(day / 5411), day % 5411, 27, 5411, key, "date", back)
    new = F.date_add(first, (a * 5411 + b).cast("int"))
    sep = F.when(m.contains("/"), "/").when(m.contains("-"), "-").otherwise(".")
    ymd = F.concat(F.date_format(new, "yyyy"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "dd"))
    dmy = F.concat(F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy"))
    dated = F.when((day >= 0) & (day < cycle), F.when(iso, ymd).otherwise(dmy)).otherwise(m)
    country = F.when(m.startswith("+1"), F.substr(m, F.lit(1), F.lit(2))).otherwise("")
    national = F.substr(m, F.length(country) + 1)
    phone = F.concat(country, _into(national, feistel_chars(F.regexp_replace(national, "[^0-9]", ""), key, "phone", back)))
    name = F.substring_index(m, ".", -1)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(name))
    email = F.concat(_cased(feistel_chars(F.lower(head), key, "email", back), head), name)
    secret = F.when(m.startswith("sk-"), F.concat(F.lit("sk-"), feistel_chars(F.substr(m, F.lit(4)), key, "secret", back))).when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), feistel_chars(F.substr(m, F.lit(5)), key, "secret", back))).otherwise(feistel_chars(m, key, "hex", back, 6))
    return (
        F.when(m.contains("@"), email)
        .when(m.rlike(rf"^{IBAN}$"), _iban(m, key, back))
        .when(m.rlike(rf"^{SSN}$"), _ssn(m, key, back))
        .when(m.rlike(rf"^{IP}$"), ip)
        .when(m.rlike(rf"^(?:{DATE})$"), dated)
        .when(m.rlike(rf"^(?:{PHONE})$"), phone)
        .when(m.rlike(RUN), card)
        .otherwise(secret)
    )


def pseudonymize(docs: DataFrame, key: str, column: str = "text", count: str | None = None, back: bool = False) -> DataFrame:
    """docs with the values of `column` replaced; `count`: a column for the number of values found (of a run of numbers, its cards)."""
    text = F.col(column)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    columns, name = docs.columns, fresh(docs, "_found")
    docs = docs.withColumn(name, found)
    # As the split's pieces stand before, between and after the matches, one empty pseudonym is added at the end.
    new = F.array_append(F.transform(name, lambda m: pseudonym(m, key, back)), "")
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda p, m: F.concat(p, m)), "")
    docs = docs.withColumn(column, F.when(F.size(name) > 0, joined).otherwise(text))
    if count:
        values = F.transform(name, lambda m: F.when(m.rlike(RUN) & ~m.rlike(rf"^(?:{DATE}|{PHONE})$"), F.size(cards(m))).otherwise(1))
        docs = docs.withColumn(count, F.coalesce(F.aggregate(values, F.lit(0), lambda n, k: n + k), F.lit(0)).cast("long"))
    return docs.select(*columns, *([count] if count and count not in columns else []))


def reveal(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """pseudonymize() undone. Dates written D/M come back as DD/MM."""
    return pseudonymize(docs, key, column, back=True)


#: The setting that holds the query's key. The key that stands in for it here is no secret: whoever has it can `reveal`.
KEY_CONF, NO_SECRET = "spark.skeingraph.pii.key", "not a secret"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, spark.conf.get(KEY_CONF, NO_SECRET), count="n_values").select("doc_id", "text", "n_values", F.length("text").cast("long").alias("n_chars"))
