"""Check digits, as plain Python and as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The control letters of the Spanish identity number and of company numbers.
ID_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
# Initials of company numbers whose control must be a letter or a digit.
CIF_LETTER_KINDS = "KPQRSNW"
CIF_DIGIT_KINDS = "ABEH"


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def iban(text: str) -> bool:
    s = "".join(text.split()).upper()
    if len(s) < 5 or not (s[:2].isascii() and s[:2].isalpha() and s[2:4].isdigit() and s.isascii() and s.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def identity_kind(text: str) -> tuple[str, bool] | None:
    """("DNI" or "NIE", whether the control letter fits), or None for another shape."""
    s = text.translate({ord(c): None for c in " \t\n.-"}).upper()
    if len(s) != 9 or not (s.isascii() and s[-1].isalpha()):
        return None
    if s[:8].isdigit():
        return "DNI", ID_LETTERS[int(s[:8]) % 23] == s[-1]
    if s[0] in "XYZ" and s[1:8].isdigit():
        return "NIE", ID_LETTERS[int(str("XYZ".index(s[0])) + s[1:8]) % 23] == s[-1]
    return None


def cif(text: str) -> bool:
    s = "".join(c for c in text.upper() if c.isascii() and c.isalnum())
    if len(s) != 9 or s[0] not in "ABCDEFGHJNPQRSUVW" or not s[1:8].isdigit():
        return False
    total = sum(map(int, s[2:8:2])) + sum(sum(divmod(2 * int(d), 10)) for d in s[1:8:2])
    control = -total % 10
    letter, digit = s[8] == CIF_LETTERS[control], s[8] == str(control)
    if s[0] in CIF_LETTER_KINDS:
        return letter
    return digit if s[0] in CIF_DIGIT_KINDS else letter or digit


def nif_pt(digits: str) -> bool:
    if len(digits) != 9 or not digits.isdigit():
        return False
    check = 11 - sum(int(d) * w for d, w in zip(digits, range(9, 1, -1))) % 11
    return (0 if check >= 10 else check) == int(digits[8])


def citizen_card_pt(text: str) -> bool:
    s = "".join(text.split()).upper()
    if len(s) != 12 or not (s[:9].isdigit() and s[9:11].isalpha() and s[11].isdigit()):
        return False
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c, 36) * (2 if i % 2 else 1)
        total += v - 9 if i % 2 and v > 9 else v
    return total % 10 == 0


# The same as columns.


def luhn_col(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def iban_col(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, r"\s", ""))
    turned = F.split(F.concat(F.substring(s, 5, 1000), F.substring(s, 1, 4)), "")
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: F.pmod(F.when(code(c) > 9, rest * 100 + code(c)).otherwise(rest * 10 + code(c)), F.lit(97))
    return s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+\z") & (F.aggregate(turned, F.lit(0), step) == 1)


def identity_col(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, r"[\s.-]", ""))
    number = F.translate(F.substring(s, 1, 8), "XYZ", "012")
    fits = F.substring(F.lit(ID_LETTERS), (number.cast("int") % 23 + 1), F.lit(1)) == F.substring(s, 9, 1)
    return F.when(s.rlike(r"^[XYZ0-9][0-9]{7}[A-Z]\z"), fits).otherwise(False)


def nif_pt_col(digits: Column) -> Column:
    total = sum((F.substring(digits, i + 1, 1).cast("int") * (9 - i) for i in range(8)), F.lit(0))
    check = 11 - total % 11
    return F.when(digits.rlike(r"^[0-9]{9}\z"), F.when(check >= 10, 0).otherwise(check) == F.substring(digits, 9, 1).cast("int")).otherwise(False)


def cif_col(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    digit = lambda i: F.substring(s, i, 1).cast("int")
    doubled = lambda i: F.floor(2 * digit(i) / 10) + 2 * digit(i) % 10
    total = sum((digit(i) for i in (3, 5, 7)), F.lit(0)) + sum((doubled(i) for i in (2, 4, 6, 8)), F.lit(0))
    control = F.pmod(-total, F.lit(10)).cast("int")
    as_letter = F.substring(F.lit(CIF_LETTERS), control + 1, F.lit(1)) == F.substring(s, 9, 1)
    as_digit = control.cast("string") == F.substring(s, 9, 1)
    kind = F.substring(s, 1, 1)
    fits = F.when(kind.isin(*CIF_LETTER_KINDS), as_letter).when(kind.isin(*CIF_DIGIT_KINDS), as_digit).otherwise(as_letter | as_digit)
    return F.when(s.rlike(r"^[ABCDEFGHJNPQRSUVW][0-9]{7}[A-Z0-9]\z"), fits).otherwise(False)


def fnv1a_col(text: Column) -> Column:
    """32-bit FNV-1a over the code units of text in the basic plane; products are split to stay in range."""
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
        return (low * F.lit(0x01000193) + F.shiftleft((high * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)
