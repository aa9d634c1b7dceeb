"""String functions as Column expressions.  Arguments are column names or Columns; patterns are Python values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a GLOB: * any run, ? one character, [set], [!set] or [^set]."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negated, body = body[0] in "!^", body.lstrip("!^") if body[0] in "!^" else body
            out.append("[" + "^" * negated + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(glob_pattern(pattern))


def regexp(c: Column | str, pattern: str) -> Column:
    """Unanchored search; false for NULL."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def ltrim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+", "")


def rtrim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+$", "")


def substring(c: Column | str, start: int, length: int | None = None) -> Column:
    """1-based; a start below 1 counts as 1."""
    return F.substring(col(c), max(1, start), 2**31 - 1 if length is None else max(0, length))


def left(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, max(0, n))


def right(c: Column | str, n: int) -> Column:
    return F.when(F.lit(n) <= 0, F.lit("")).otherwise(F.right(col(c), F.lit(n)))


def format_number(c: Column | str, digits: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.format_string(f"%.{digits}f", col(c).cast("double"))


def char(*codes: int | Column) -> Column:
    """The characters of the code points, NULLs skipped."""
    one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32") if isinstance(n, Column) else F.lit(chr(n))
    return F.concat_ws("", *map(one, codes))


def unicode(c: Column | str) -> Column:
    return F.when(F.length(col(c)) > 0, F.ascii(col(c)))


def soundex(c: Column | str) -> Column:
    """Four-character code in which every letter without a digit (vowels, H, W, Y) separates equal digits; '0000' for no letters."""
    letters = F.regexp_replace(F.upper(col(c)), "[^A-Z]", "")
    digits = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    runs = F.regexp_replace(digits, r"(\d)\1+", "$1")
    tail = F.regexp_replace(F.substring(runs, 2, 2**31 - 1), "0", "")
    return F.when(F.length(letters) == 0, F.lit("0000")).otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), tail), 4, "0"))


def difference(a: Column | str, b: Column | str) -> Column:
    """How many of the four places of both SOUNDEX codes agree."""
    x, y = soundex(a), soundex(b)
    return sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(2, 5)), F.when(F.substring(x, 1, 1) == F.substring(y, 1, 1), 1).otherwise(0))


# Cases
def words(c: Column | str) -> Column:
    """Words of an identifier or a phrase: runs of letters and digits, also cut before a capital after a small letter."""
    spaced = F.regexp_replace(F.regexp_replace(col(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda w: w != "")


def _cased(c: Column | str, sep: str, change) -> Column:
    return F.array_join(F.transform(words(c), change), sep)


def snake_case(c: Column | str) -> Column:
    return _cased(c, "_", F.lower)


def kebab_case(c: Column | str) -> Column:
    return _cased(c, "-", F.lower)


def dot_case(c: Column | str) -> Column:
    return _cased(c, ".", F.lower)


def path_case(c: Column | str) -> Column:
    return _cased(c, "/", F.lower)


def constant_case(c: Column | str) -> Column:
    return _cased(c, "_", F.upper)


def pascal_case(c: Column | str) -> Column:
    return _cased(c, "", lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1))))


def camel_case(c: Column | str) -> Column:
    p = pascal_case(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))


def title(c: Column | str) -> Column:
    return F.initcap(col(c))


def capitalize(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substring(col(c), 2, 2**31 - 1))


def sentence_case(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.lower(F.substring(col(c), 2, 2**31 - 1)))


def swap_case(c: Column | str) -> Column:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col(c), up + low, low + up)


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def last_index_of(c: Column | str, part: str) -> Column:
    """0-based place of the last occurrence, -1 if absent."""
    return F.when(F.contains(col(c), F.lit(part)), F.length(col(c)) - F.instr(F.reverse(col(c)), part[::-1]) - len(part) + 1).otherwise(-1)


def center(c: Column | str, width: int, pad: str = " ") -> Column:
    room = F.greatest(F.lit(width) - F.length(col(c)), F.lit(0))
    before = F.floor(room / 2).cast("int")
    return F.concat(F.repeat(F.lit(pad), before), col(c), F.repeat(F.lit(pad), (room - before).cast("int")))


def trim_prefix(c: Column | str, prefix: str) -> Column:
    return F.when(col(c).startswith(prefix), F.substring(col(c), len(prefix) + 1, 2**31 - 1)).otherwise(col(c))


def trim_suffix(c: Column | str, suffix: str) -> Column:
    return F.when(col(c).endswith(suffix), F.left(col(c), F.length(col(c)) - len(suffix))).otherwise(col(c))


def word_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(r"\S+"), F.lit(0)))


def truncate_words(c: Column | str, n: int, tail: str = "...") -> Column:
    all_ = F.regexp_extract_all(col(c), F.lit(r"\S+"), F.lit(0))
    return F.when(F.size(all_) > n, F.concat(F.array_join(F.slice(all_, 1, n), " "), F.lit(tail))).otherwise(col(c))


def normalize_space(c: Column | str) -> Column:
    return trim(F.regexp_replace(col(c), r"\s+", " "))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<[^>]*>", "")


def strip_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\p{Punct}", "")


def is_palindrome(c: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")
    return plain == F.reverse(plain)


def is_anagram(a: Column | str, b: Column | str) -> Column:
    letters = lambda c: F.array_sort(F.split(F.regexp_replace(F.lower(col(c)), r"\s", ""), ""))
    return letters(a) == letters(b)


def rot(c: Column | str, n: int = 13) -> Column:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col(c), up + low, up[n % 26 :] + up[: n % 26] + low[n % 26 :] + low[: n % 26])


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def unescape_html(c: Column | str) -> Column:
    out = col(c)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&#34;", '"'), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


PATTERNS = {
    "alpha": r"^[A-Za-z]+$", "numeric": r"^[0-9]+$", "alphanumeric": r"^[A-Za-z0-9]+$", "lower": r"^[^A-Z]*[a-z][^A-Z]*$", "upper": r"^[^a-z]*[A-Z][^a-z]*$",
    "space": r"^\s+$", "printable": r"^[\x20-\x7E]*$", "base64": r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$", "base32": r"^(?:[A-Z2-7]{8})*(?:[A-Z2-7]{2}={6}|[A-Z2-7]{4}={4}|[A-Z2-7]{5}={3}|[A-Z2-7]{7}=)?$", "ascii": r"^[\x00-\x7F]*$", "hex": r"^[0-9A-Fa-f]+$", "hex_color": r"^#(?:[0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$",
    "uuid": r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$", "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$",
}


def is_(kind: str, c: Column | str) -> Column:
    """Whether the text is of a kind: a name in PATTERNS, `json` or `credit_card`."""
    if kind == "json":
        return F.try_parse_json(col(c)).isNotNull()
    if kind == "credit_card":
        digits = F.regexp_replace(col(c), "[ -]", "")
        return digits.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", digits)
    return col(c).rlike(PATTERNS[kind])


def ordinal(c: Column | str) -> Column:
    n, text = col(c), col(c).cast("string")
    return F.concat(text, F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def roman(c: Column | str) -> Column:
    """1 to 3999 as a Roman numeral."""
    n, out = col(c).cast("int"), []
    for unit, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        digit = (F.floor(n / unit) % 10).cast("int")
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out.append(F.element_at(F.array(*map(F.lit, forms)), digit + 1))
    return F.concat(*out)


def from_roman(c: Column | str) -> Column:
    """Value of a Roman numeral: a sign before a larger one counts against it."""
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).when(x == "D", 500).when(x == "M", 1000).otherwise(0)
    signs = F.transform(F.filter(F.split(F.upper(col(c)), ""), lambda x: x != ""), value)
    signed = lambda v: F.transform(v, lambda x, i: F.when(F.coalesce(F.get(v, i + 1), F.lit(0)) > x, -x).otherwise(x))
    return F.aggregate(let(signs, signed), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


# English number words.
ONES = ("", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def to_words(c: Column | str) -> Column:
    """A whole number below 10**15 in English words."""
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    skip = lambda x: F.when(x != "", x)  # noqa: E731  concat_ws leaves NULL out

    def below(n: Column) -> Column:  # 0..999
        rest = n % 100
        two = F.when(rest < 20, pick(ONES, rest)).otherwise(F.concat_ws("-", skip(pick(TENS, F.floor(rest / 10))), skip(pick(ONES, rest % 10))))
        return F.concat_ws(" ", F.when(n >= 100, F.concat(pick(ONES, F.floor(n / 100)), F.lit(" hundred"))), skip(two))

    n = F.abs(col(c).cast("bigint"))
    parts = []
    for scale, name in ((10**12, " trillion"), (10**9, " billion"), (10**6, " million"), (1000, " thousand"), (1, "")):
        group = F.call_function("mod", F.floor(n / F.lit(scale).cast("bigint")), F.lit(1000)).cast("bigint")
        parts.append(F.when(group > 0, F.concat(below(group), F.lit(name))))
    return F.when(n == 0, "zero").when(n.isNotNull(), F.concat_ws(" ", F.when(col(c) < 0, "negative"), *parts))


def to_ordinal(c: Column | str) -> Column:
    """Number words with the ending of the number's ordinal."""
    n = col(c).cast("bigint")
    ending = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(to_words(c), ending)


def format_bytes(c: Column | str) -> Column:
    """Size with a unit up to EB, two decimals; the sign is dropped."""
    n = F.abs(col(c).cast("bigint"))
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", F.bround(n / float(1024**power), 2))).otherwise(out)  # ties to even
    return out


def from_size(c: Column | str) -> Column:
    """Bytes of a size such as 1.5 KB; 0 for what is none."""
    part = lambda i: F.regexp_extract(F.trim(col(c)), r"(?i)^([\d.]+)\s*(B|KB|MB|GB|TB)?$", i)
    unit = F.upper(part(2))
    scale = F.when(unit == "TB", 1024.0**4).when(unit == "GB", 1024.0**3).when(unit == "MB", 1024.0**2).when(unit == "KB", 1024.0).otherwise(1.0)
    return F.coalesce((part(1).try_cast("double") * scale).cast("bigint"), F.lit(0).cast("bigint"))


def thousands(c: Column | str, digits: int = 2) -> Column:
    """Fixed decimals with commas between thousands."""
    return F.format_string(f"%,.{digits}f", col(c).cast("double"))


def currency(c: Column | str, symbol: str = "$", digits: int = 2) -> Column:
    return F.concat(F.when(col(c) < 0, "-").otherwise(""), F.lit(symbol), thousands(F.abs(col(c)), digits))


def percent(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c).cast("double") * 100)


def format_int(c: Column | str, base: int = 10) -> Column:
    """A whole number in any base of 2 to 36; others count as 10."""
    n = col(c).cast("bigint")
    if not 2 <= base <= 36 or base == 10:
        return n.cast("string")
    sign = F.when(n < 0, "-").otherwise("") if base in (2, 8, 16) else F.lit("")
    return F.concat(sign, F.lower(F.conv(F.abs(n).cast("string"), 10, base)))


def pad_number(c: Column | str, width: int = 2, pad: str = "0") -> Column:
    text = col(c).cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, pad[:1] or "0"))


# Cutting and joining
def join(c: Column | str, sep: str) -> Column:
    return F.array_join(col(c), sep)


def split_n(c: Column | str, sep: str, n: int) -> Column:
    """At most n parts, the last with the rest; all parts if n is negative."""
    return F.split(col(c), re.escape(sep), n if n else 1)


def rsplit(c: Column | str, sep: str, n: int = -1) -> Column:
    """At most n parts, the first with the rest; without a limit all parts, last first."""
    parts = F.split(col(c), re.escape(sep))
    if n <= 0:
        return F.reverse(parts)

    def cut(v: Column) -> Column:
        head = F.array_join(F.slice(v, 1, F.greatest(F.size(v) - (n - 1), F.lit(1))), sep)
        tail = F.slice(v, F.greatest(F.size(v) - (n - 2), F.lit(2)), F.lit(n - 1)) if n > 1 else F.slice(v, 1, 0)
        return F.when(F.size(v) <= n, F.reverse(v) if n > 0 else v).otherwise(F.concat(F.array(head), tail))

    return let(parts, cut)


def partition_at(c: Column | str, sep: str) -> Column:
    """[before, sep, after] at the first sep; [text, '', ''] without one."""
    at = F.instr(col(c), sep)
    return F.when(at == 0, F.array(col(c), F.lit(""), F.lit(""))).otherwise(F.array(F.left(col(c), at - 1), F.lit(sep), F.substring(col(c), at + len(sep), F.length(col(c)))))


def rpartition_at(c: Column | str, sep: str) -> Column:
    """[before, sep, after] at the last sep; ['', '', text] without one."""
    at = last_index_of(c, sep)
    return F.when(at < 0, F.array(F.lit(""), F.lit(""), col(c))).otherwise(F.array(F.left(col(c), at), F.lit(sep), F.substring(col(c), at + 1 + len(sep), F.length(col(c)))))


def replace_n(c: Column | str, old: str, new: str, n: int) -> Column:
    """The first n occurrences replaced; all if n is negative."""
    if n < 0:
        return F.replace(col(c), F.lit(old), F.lit(new))
    parts = F.split(col(c), re.escape(old), n + 1)
    return F.array_join(parts, new)


def replace_first(c: Column | str, old: str, new: str) -> Column:
    return replace_n(c, old, new, 1)


def replace_ignore_case(c: Column | str, old: str, new: str) -> Column:
    return F.regexp_replace(col(c), "(?i)" + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$")) if old else col(c)


def unwrap(c: Column | str, wrapper: str = '""') -> Column:
    """Without the first and last character if they are those of wrapper."""
    inside = (F.length(col(c)) >= 2) & col(c).startswith(wrapper[0]) & col(c).endswith(wrapper[-1])
    return F.when(inside, F.substring(col(c), 2, F.length(col(c)) - 2)).otherwise(col(c)) if len(wrapper) > 1 else col(c)


def repeat_until(c: Column | str, length: int) -> Column:
    """The text repeated and cut to a length."""
    if length <= 0:
        return F.when(col(c).isNotNull(), "")
    return F.when(col(c) == "", "").otherwise(F.left(F.repeat(col(c), F.ceil(F.lit(length) / F.greatest(F.length(col(c)), F.lit(1))).cast("int")), F.lit(length)))


def pad_between(a: Column | str, b: Column | str, pad: str = " ") -> Column:
    return F.concat(col(a), F.lit(pad or " "), col(b))


def insert(c: Column | str, at: int, part: str) -> Column:
    """0-based; places out of the text count as its ends."""
    return F.concat(F.left(col(c), F.lit(max(0, at))), F.lit(part), F.substring(col(c), max(0, at) + 1, F.length(col(c)))) if at > 0 else F.concat(F.lit(part), col(c))


def delete(c: Column | str, start: int, length: int | None = None) -> Column:
    start = max(0, start)
    tail = F.lit("") if length is None else F.substring(col(c), start + max(0, length) + 1, F.greatest(F.length(col(c)), F.lit(1)))
    return F.when(F.length(col(c)) <= start, col(c)).otherwise(F.concat(F.left(col(c), F.lit(start)), tail))


def overwrite(c: Column | str, start: int, part: str) -> Column:
    start = max(0, start)
    return F.concat(F.left(col(c), F.lit(start)), F.lit(part), F.substring(col(c), start + len(part) + 1, F.greatest(F.length(col(c)), F.lit(1))))


def surround(c: Column | str, wrapper: str = '"') -> Column:
    return F.concat(F.lit(wrapper), col(c), F.lit(wrapper))


def quote(c: Column | str, sign: str = '"') -> Column:
    sign = (sign or '"')[0]
    return surround(F.replace(col(c), F.lit(sign), F.lit("\\" + sign)), sign)


def unquote(c: Column | str) -> Column:
    """Without equal quotation marks around it, escaped ones inside it freed."""
    out = col(c)
    for sign in ('"', "'", "`"):
        held = (F.length(col(c)) >= 2) & col(c).startswith(sign) & col(c).endswith(sign)
        out = F.when(held, F.replace(F.substring(col(c), 2, F.length(col(c)) - 2), F.lit("\\" + sign), F.lit(sign))).otherwise(out)
    return out


def normalize_newlines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def common_prefix(a: Column | str, b: Column | str) -> Column:
    places = F.sequence(F.lit(0), F.least(F.length(col(a)), F.length(col(b))))
    return F.left(col(a), F.array_max(F.filter(places, lambda i: F.left(col(a), i) == F.left(col(b), i))))


def common_suffix(a: Column | str, b: Column | str) -> Column:
    return F.reverse(common_prefix(F.reverse(col(a)), F.reverse(col(b))))


def is_empty(c: Column | str) -> Column:
    return F.coalesce(F.length(col(c)) == 0, F.lit(True))


def escape_url(c: Column | str) -> Column:
    return F.url_encode(col(c))


def unescape_url(c: Column | str) -> Column:
    return F.try_url_decode(col(c))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def indent(c: Column | str, prefix: str = "  ") -> Column:
    """prefix before each line that isn't empty."""
    return F.array_join(F.transform(lines(c), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(prefix), x))), "\n")


def dedent(c: Column | str) -> Column:
    """Lines without the white space that all lines with content begin with."""

    def cut(v: Column) -> Column:
        room = F.array_min(F.transform(F.filter(v, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))))
        return let(F.coalesce(room, F.lit(0)), lambda n: F.array_join(F.transform(v, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, n + 1, F.length(x)))), "\n"))

    return let(lines(c), cut)


def word_wrap(c: Column | str, width: int) -> Column:
    """Words in lines of at most `width` characters (longer words alone)."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def put(state: Column, word: Column) -> Column:
        line = state["line"]
        fits = (line == "") | (F.length(line) + 1 + F.length(word) <= width)
        joined = F.when(line == "", word).otherwise(F.concat(line, F.lit(" "), word))
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], line, F.lit("\n"))).alias("done"), F.when(fits, joined).otherwise(word).alias("line"))

    return F.aggregate(F.regexp_extract_all(col(c), F.lit(r"\S+"), F.lit(0)), start, put, lambda s: F.concat(s["done"], s["line"]))


def align(c: Column | str, width: int, side: str = "left", pad: str = " ") -> Column:
    """To a width, without cutting."""
    if side == "center":
        return center(c, width, pad)
    padded = F.rpad(col(c), width, pad) if side == "left" else F.lpad(col(c), width, pad)
    return F.when(F.length(col(c)) >= width, col(c)).otherwise(padded)


def template(text: str, values: dict[str, Column]) -> Column:
    """{name} in a Python text replaced by columns."""
    pieces = re.split(r"\{(\w+)\}", text)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 and p in values else F.lit("{" + p + "}" if i % 2 else p) for i, p in enumerate(pieces)))


def sanitize(c: Column | str) -> Column:
    """HTML-escaped, without control characters other than tab and line ends."""
    return F.regexp_replace(escape_html(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def normalize_email(c: Column | str) -> Column:
    """Trimmed lower case; dots in the local part mean nothing at gmail.com."""
    mail = F.trim(F.lower(col(c)))
    whole = mail.rlike("^[^@]*@[^@]*gmail[.]com$")
    return F.when(whole, F.concat(F.replace(F.split_part(mail, F.lit("@"), F.lit(1)), F.lit("."), F.lit("")), F.lit("@"), F.split_part(mail, F.lit("@"), F.lit(2)))).otherwise(mail)


def normalize_phone(c: Column | str, country: str = "1") -> Column:
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.concat(F.lit("+"), F.when(F.length(digits) == 10, F.concat(F.lit(country), digits)).otherwise(digits))


def password(c: Column | str, least: int = 8) -> Column:
    """valid, score (0 to 5) and strength of a password."""
    tests = [F.octet_length(col(c)) >= least, *(col(c).rlike(p) for p in ("[A-Z]", "[a-z]", "[0-9]", r"""[!@#$%^&*()_+\-=\[\]{};':"\\|,.<>/?]"""))]
    score = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    name = lambda n: F.when(n == 5, "very strong").when(n == 4, "strong").when(n == 3, "medium").when(n == 2, "weak").otherwise("very weak")
    return let(score, lambda n: F.struct(((n >= 3) & tests[0]).alias("valid"), n.alias("score"), name(n).alias("strength")))


def regex_escape(text: str) -> str:
    return re.escape(text)


def regex_valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
