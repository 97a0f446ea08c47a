"""Text, number and code functions as column expressions."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

from .. import constants as K
from .geometry import as_col


def blank_to_null(c) -> Column:
    c = as_col(c).cast("string")
    return F.when(F.trim(c) != "", c)


# --- accents and names -----------------------------------------------------------------------

@lru_cache(maxsize=2)
def _accent_table(form: str = "NFKD") -> tuple[str, str]:
    """Characters whose decomposition is one plain character, and that character; combining marks come
    last, so that ``translate`` deletes them. Made from the Unicode rule, over all planes."""
    pairs, marks = [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        base = "".join(c for c in unicodedata.normalize(form, ch) if not unicodedata.combining(c))
        if not base:
            marks.append(ch)
        elif len(base) == 1 and base != ch:
            pairs.append((ch, base))
    return "".join(p for p, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def _long_table() -> tuple[str, ...]:
    """Characters that decompose to several: as entries for ``str_to_map``, as a pattern, and as a wider
    pattern of few ranges, which is quicker to rule out. Then the Hangul syllables, and the first, second
    and third letter of each; those without a third come last."""
    known = {}
    for cp in range(0x80, 0x110000):
        if not (0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
            if len(base) > 1:
                known[chr(cp)] = base
    entries = "\x01".join(f"{k}\x02{v}" for k, v in known.items())
    syllables = sorted(range(0xAC00, 0xD7A4), key=lambda cp: ((cp - 0xAC00) % 28 == 0, cp))
    letters = [unicodedata.normalize("NFD", chr(cp)) for cp in syllables]
    latin = 0x250
    wide = "[" + "".join(k for k in known if ord(k) < latin) + f"{min(k for k in known if ord(k) >= latin)}-\U0010ffff]"
    return (entries, "[" + "".join(known) + "\uac00-\ud7a3]", wide, "".join(map(chr, syllables)),
            "".join(x[0] for x in letters), "".join(x[1] for x in letters), "".join(x[2:] for x in letters))


def strip_accents(c) -> Column:
    """Decompose accented and compatibility characters (NFKD) and drop the marks.

    Plain ASCII texts, whose characters are as many as their bytes, stay as they are. One table serves
    characters that become one. Texts with others (ligatures, fractions, syllables) are taken apart by character
    as well; few texts have them, and none of those that hold nothing beyond ASCII and the letters of Latin-1.
    """
    entries, several, wide, syllables, first, second, third = _long_table()
    known = F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02"))

    def spelled(ch):
        syllable = F.concat(F.translate(ch, syllables, first), F.translate(ch, syllables, second), F.translate(ch, syllables, third))
        return F.when(ch.between("\uac00", "\ud7a3"), syllable).otherwise(F.coalesce(F.try_element_at(known, ch), ch))

    c = as_col(c)
    rare = c.rlike(r"[^\x00-\x7F\u00C0-\u00FF]") & c.rlike(wide) & c.rlike(several)
    whole = F.when(rare, F.array_join(F.transform(F.split(c, ""), spelled), "")).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(whole, *_accent_table()))


def normalize_text(c) -> Column:
    """Without accents, lower case, hyphens as spaces, single spaces."""
    plain = F.translate(F.lower(strip_accents(c)), "-", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def normalize_upper(c) -> Column:
    """Without accents and other non-ASCII characters, single spaces, upper case; null gives ''."""
    ascii_only = F.regexp_replace(F.coalesce(strip_accents(c), F.lit("")), r"[^\x00-\x7F]", "")
    return F.upper(F.trim(F.regexp_replace(ascii_only, r"\s+", " ")))


def sanitize_name(c) -> Column:
    """Identifier-safe form: lower case, ``_`` for spaces and hyphens, nothing but a-z, 0-9, _."""
    s = F.regexp_replace(F.lower(strip_accents(c)), r"[^\x00-\x7F]", "")
    s = F.regexp_replace(F.trim(s), r"[\s\-]+", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_|_$", "")


def safe_filename(c) -> Column:
    # canonical decomposition only: compatibility characters become "_"
    s = F.regexp_replace(F.translate(as_col(c), *_accent_table("NFD")), r"[^a-zA-Z0-9_\-.]", "_")
    return F.lower(F.regexp_replace(s, r"_+", "_"))


# --- court numbers, dates, codes -------------------------------------------------------------

def _masked(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", "$1-$2.$3.$4.$5.$6")


def format_case_number(c, pad: bool = False) -> Column:
    """NNNNNNN-DD.YYYY.J.TR.OOOO for 20 digits, else the text as it is or 'N/A'. ``pad`` also takes
    15 to 19 digits, filled up with zeros on the left."""
    raw = as_col(c).cast("string")
    digits = F.regexp_replace(raw, r"\D", "")
    out = F.when(raw.isNull() | (raw == ""), F.lit("N/A")).when(F.length(digits) == 20, _masked(digits))
    if pad:
        out = out.when(F.length(digits).between(15, 19), _masked(F.lpad(digits, 20, "0")))
    return out.otherwise(raw)


def parse_court_date(c) -> Column:
    """Timestamp without zone from ISO text with a ``T`` (zone mark and fraction dropped),
    yyyyMMddHHmmss or yyyyMMdd; null for anything else."""
    c = as_col(c)
    iso = F.split(F.replace(c, F.lit("Z"), F.lit("")), r"\.")[0]
    spaced = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    day = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3 00:00:00")
    return (F.when(c.contains("T"), iso.try_cast("timestamp_ntz"))
            .when(c.rlike(r"^\d{14}$"), spaced.try_cast("timestamp_ntz"))
            .when(c.rlike(r"^\d{8}$"), day.try_cast("timestamp_ntz")))


def int_or_zero(c) -> Column:
    """All digits of the text read as one number, 0 without any. Numbers have up to 38 digits, leading zeros
    aside; a longer one gives null, not 0."""
    digits = F.regexp_replace(as_col(c).cast("string"), r"[^\d]", "")
    return (F.when(F.coalesce(digits, F.lit("")) == "", F.lit(0).cast("decimal(38,0)"))
            .otherwise(F.regexp_replace(digits, r"^0+(?=\d)", "").try_cast("decimal(38,0)")))


def positive_code(c) -> Column:
    n = F.trim(as_col(c).cast("string")).try_cast("int")
    return F.when(n > 0, n)


def digits_or_null(c) -> Column:
    t = F.trim(as_col(c).cast("string"))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int"))


def clean_code(c) -> Column:
    return F.upper(F.regexp_replace(F.trim(as_col(c)), r"[\s.]", ""))


def mask_id(c) -> Column:
    """Hide the outer digits of an 11-digit personal number; any other digits are hidden too."""
    digits = F.regexp_replace(as_col(c).cast("string"), r"\D", "")
    return (F.when(F.length(digits) == 11,
                   F.regexp_replace(digits, r"^\d{3}(\d{3})(\d{3})\d{2}$", "***.$1.$2-**"))
            .when(as_col(c).isNotNull(), F.regexp_replace(as_col(c).cast("string"), r"\d", "*")))


# --- classification --------------------------------------------------------------------------

def classify_case(subject_codes, class_code, subject_names, class_name) -> Column:
    """Category of a case: the first rule with a listed subject, a listed class or a keyword."""
    codes, names = as_col(subject_codes), as_col(subject_names)
    text = F.lower(F.concat(F.coalesce(F.array_join(names, " "), F.lit("")), F.lit(" "),
                            F.coalesce(as_col(class_name), F.lit(""))))
    out = None
    for category, subjects, classes, keywords in K.CASE_RULES:
        hit = F.coalesce(F.arrays_overlap(codes.cast("array<int>"), F.array(*map(F.lit, subjects))),
                         F.lit(False))
        if classes:
            hit = hit | F.coalesce(as_col(class_code).isin(classes), F.lit(False))
        hit = reduce(lambda a, k: a | text.contains(k), keywords, hit)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(K.OTHER_CATEGORY)


def subjects_text(subjects) -> Column:
    """``code: name; ...``; a missing value shows as ``None``."""
    none = F.lit("None")
    return F.coalesce(F.array_join(F.transform(as_col(subjects), lambda s: F.concat(
        F.coalesce(s["codigo"].cast("string"), none), F.lit(": "), F.coalesce(s["nome"], none))),
        "; "), F.lit(""))


def present_codes(subjects) -> Column:
    return F.filter(F.transform(as_col(subjects), lambda s: s["codigo"]),
                    lambda c: c.isNotNull() & (c != 0))


def present_names(subjects) -> Column:
    return F.filter(F.transform(as_col(subjects), lambda s: s["nome"]),
                    lambda c: c.isNotNull() & (c != ""))


# --- hashing and jitter ----------------------------------------------------------------------

def md5_mod(c, m: int, shift_bits: int = 0) -> Column:
    """``(md5 >> shift_bits) % m`` of the 128-bit digest, by 32-bit limbs."""
    drop = shift_bits // 4
    digest = F.lpad(F.left(F.md5(as_col(c)), F.lit(32 - drop)), 32, "0")
    rest = F.lit(0).cast("bigint")
    for i in range(4):
        limb = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(2 ** 32) + limb) % F.lit(m)
    return rest


def jitter(lon, lat, key, radius_km: float) -> Column:
    """Move a point by up to ``radius_km`` in a direction that depends only on the key, so that
    coincident points can be told apart on a map."""
    lon, lat = as_col(lon), as_col(lat)
    angle = md5_mod(key, 360) * F.lit(math.pi / 180.0)
    dist = md5_mod(key, 1000, 8) / F.lit(1000.0) * F.lit(float(radius_km))
    per_degree = F.lit(K.KM_PER_DEGREE)
    return F.struct(
        (lon + dist * F.cos(angle) / (per_degree * F.cos(F.radians(lat)))).alias("lon"),
        (lat + dist * F.sin(angle) / per_degree).alias("lat"))


# --- lists and labels ------------------------------------------------------------------------

def split_enumeration(c, protected: str = K.PROTECTED_NAME) -> Column:
    """Split "A, B e C." into its names; the protected name may contain the conjunction."""
    mark = "\u0001"
    text = F.replace(as_col(c), F.lit(protected), F.lit(mark))
    items = F.split(F.replace(text, F.lit(" e "), F.lit(", ")), ",")
    kept = F.filter(F.transform(items, lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(kept, lambda p: F.replace(F.regexp_replace(p, r"\.+$", ""),
                                                 F.lit(mark), F.lit(protected)))


def slug_title(c, default: str = K.STATE_NAME) -> Column:
    """Words of a slug without its state suffix, capitalised but for particles."""
    c = as_col(c)
    words = F.split(F.regexp_replace(c, r"(?i)-pe$", ""), "-")

    def word(w, i):
        small = F.lower(w)
        return F.when((i > 0) & small.isin(K.TITLE_PARTICLES), small).otherwise(
            F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.right(w, F.length(w) - 1))))

    return F.when(c.isNull() | (c == ""), default).otherwise(F.array_join(F.transform(words, word), " "))


def taxonomy_label(c, labels: dict[str, str] = K.TAXONOMY_LABELS, default: str = K.NOT_INFORMED) -> Column:
    c = as_col(c)
    known = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.when(c.isNull() | (c == ""), default).otherwise(
        F.coalesce(F.try_element_at(known, c), F.initcap(F.translate(c, "-", " "))))


def taxonomy_list(arr, default: str) -> Column:
    text = F.array_join(F.transform(as_col(arr), lambda s: taxonomy_label(s)), "; ")
    return F.when(F.size(as_col(arr)) > 0, text).otherwise(default)


def join_or_default(c, default: str = K.NOT_INFORMED, present: Column | None = None) -> Column:
    """Text of a JSON value that is either a list or a scalar: lists are joined with '; '. Where the key is
    not ``present`` the text is ''; a null or empty value gives the default."""
    c = as_col(c)
    start = F if present is None else F.when(~present, "")
    return (start.when(c.isNull() | (c == ""), default)
            .when(F.ltrim(c).startswith("["), F.array_join(F.from_json(c, "array<string>"), "; "))
            .otherwise(c))


def first_present(*cols) -> Column:
    """First trimmed value that is not blank, '' when all are."""
    return F.coalesce(*[F.nullif(F.trim(as_col(c).cast("string")), F.lit("")) for c in cols], F.lit(""))


def label(c, labels: dict[str, str], default: str | None = None) -> Column:
    c = as_col(c)
    out = reduce(lambda w, kv: w.when(c == kv[0], kv[1]), labels.items(), F)
    return out.otherwise(c if default is None else F.lit(default))


def pressure_label(c) -> Column:
    c = as_col(c)
    return F.when(c.contains("mining"), K.MINING_LABEL).otherwise(label(c, K.PRESSURE_LABELS))


def property_source_label(c) -> Column:
    c = as_col(c)
    out = reduce(lambda w, kv: w.when(c.contains(kv[0]), kv[1]), K.PROPERTY_SOURCE_LABELS, F)
    return out.otherwise(K.PROPERTY_SOURCE_DEFAULT)


def territory_label(c) -> Column:
    return label(c, K.TERRITORY_LABELS, K.TERRITORY_DEFAULT_LABEL)


def case_url(court) -> Column:
    return F.when(as_col(court) == K.STATE_COURT, K.STATE_CASE_URL).otherwise(K.FEDERAL_CASE_URL)


def compose_label(template: str, *cols, max_len: int) -> Column:
    """Fill ``{}`` of the template; null in gives null out; cut to ``max_len`` characters."""
    texts = template.split("{}")
    bits = [F.lit(texts[0])]
    for c, t in zip(cols, texts[1:]):
        bits += [as_col(c).cast("string"), F.lit(t)]
    return F.left(F.concat(*bits), F.lit(max_len))


def compose_address(street, number, district, city, postcode) -> Column:
    post = F.concat(F.lit("CEP "), blank_to_null(postcode))
    return F.concat_ws(", ", *[blank_to_null(c) for c in (street, number, district, city)], post)


def zip_lists(*cols, sep: str = "; ", pad: str = "N/A") -> Column:
    """Split joined lists and pair their items by position, short lists filled with ``pad``."""
    import re
    lists = [F.split(F.coalesce(as_col(c), F.lit(pad)), re.escape(sep)) for c in cols]
    n = F.greatest(*[F.size(a) for a in lists]) if len(lists) > 1 else F.size(lists[0])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[
        F.coalesce(F.nullif(F.get(a, i), F.lit("")), F.lit(pad)).alias(f"v{k}")
        for k, a in enumerate(lists)]))


def role_label(is_seat) -> Column:
    return F.when(as_col(is_seat), K.SEAT_LABEL).otherwise(K.DAUGHTER_LABEL)


def has_daughters(n) -> Column:
    return as_col(n) > 1


def format_ptbr(c, digits: int = 2, min_digits: int | None = None) -> Column:
    """1.234,5 style; at most ``digits`` and at least ``min_digits`` decimals."""
    text = F.translate(F.format_number(as_col(c).cast("double"), digits), ",.", ".,")
    keep = 0 if min_digits is None else min_digits
    if keep >= digits:
        return text
    zeros = rf"0{{1,{digits - keep}}}$"
    trimmed = F.regexp_replace(text, zeros, "") if digits else text
    return F.regexp_replace(trimmed, r",$", "")


def date_ptbr(c) -> Column:
    return F.date_format(as_col(c), "dd/MM/yyyy")


def parse_coordinates(c) -> Column:
    """Vertices of a KML coordinate text; tuples that are no numbers are left out, heights dropped."""
    tuples = F.split(F.trim(as_col(c)), r"\s+")
    pts = F.transform(F.transform(tuples, lambda t: F.split(t, ",")), lambda p: F.struct(
        F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.filter(pts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def valid_ring(pts) -> Column:
    """Closed ring, null when there are fewer than three vertices."""
    closed = lambda p: F.when(p[0] == F.element_at(p, -1), p).otherwise(F.array_append(p, p[0]))
    # as a lambda variable the vertices are worked out once
    return F.transform(F.array(as_col(pts)), lambda p: F.when(F.size(p) >= 3, closed(p)))[0]


# --- aggregates over text --------------------------------------------------------------------

def distinct_join(c, sep: str = "; ", default: str = "N/A") -> Column:
    """Distinct trimmed values of a group in order, blanks left out."""
    values = F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(values)), sep), F.lit("")),
                      F.lit(default))


def ordered_join(c, order, sep: str = "; ") -> Column:
    """Values of a group joined in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(as_col(order).alias("o"), as_col(c).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)
